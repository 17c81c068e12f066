"""Session-level helpers shared by the operators: where to write, how large the input is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a local one in local mode; elsewhere that is an error, as executors wouldn't see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="trussline-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder. For rounds that join a table with itself: a checkpoint keeps the size that Spark expects of its plan, which such joins square each time; a table has its own."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column; one pass over that column."""
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_word_count(column: str = "text"):
    """Number of raw words, in JVM expressions: words are one more than the spaces between them.

    Other white space is replaced by spaces; only a text with two in a row needs a regular expression to fold them.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    text = F.trim(F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " +", " ")).otherwise(text))
    return F.when(text == "", F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def aside(docs: DataFrame, added: list[str]) -> tuple[DataFrame, list]:
    """docs with columns of the names in `added` renamed out of an operator's way, and the columns that give docs' own back."""
    held = {c: f"__own_{c}" for c in docs.columns if c in added}
    return docs.withColumnsRenamed(held), [F.col(f"`{held.get(c, c)}`").alias(c) for c in docs.columns]
