"""From raw documents to token shards: quality, near copies, contamination, mixing, ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trussline.llm import decontam, mixing, nearcopies, quality, tokens
from trussline.llm.common import aside, new_path, table
from trussline.llm.queries import THRESHOLD, default_tokenizer


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote doesn't reject; it learns from the labels of those that are here."""
    model = quality.fit(quality.labelled_texts(docs, table(spark, sf_dir, "labels"), "quality"))
    renamed, own = aside(docs, ["score"])
    return quality.score(renamed, model).where(F.col("score") >= THRESHOLD).select(own)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; a hit below that share stays as it is."""
    renamed, own = aside(docs, decontam.ADDED)
    return decontam.match_benchmark(renamed, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(own)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; the token shards after it are sorted by doc_id and don't hold it."""
    return mixing.curriculum(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-shards")
    tokens.write_shards(docs, path, default_tokenizer())
    return tokens.read_documents(spark, path)


STAGES = [
    ("quality_classifier", keep_good),
    ("near_dedup", keep_first_copies),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("token_ids", write_ids),
]
#: The neighbour vote and the sketches aren't SQL. tests/llm/test_pipeline.py holds near_dedup and mixing against plain versions, checks decontamination on planted
#: passages, the vote on clear cases and token counts of the run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
