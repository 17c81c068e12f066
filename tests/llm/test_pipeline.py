"""The pipeline's stages and whole run on one small folder with nulls, empty texts and clashing columns, against plain versions."""

import random

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from trussline.llm import queries

DOCS = "doc_id long, text string, source string, score string, size string, contaminated string, starts string"


def words(n, seed, of=400):
    r = random.Random(seed)
    return [f"w{r.randrange(of)}" for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("small"))
    item = words(20, 999, 10**6)
    texts = {i: " ".join(words(60, i)) + "." for i in range(60)} | {100 + i: " ".join(f"{w}$$$ |" for w in words(60, i)) for i in range(30)}
    texts |= {200: texts[0], 201: texts[1] + " end", 202: " ".join([*words(40, 777), *item]), 203: " ".join([*words(600, 778), *item]), 204: None, 205: ""}
    rows = [(i, t, ("a", "b", None)[i % 3], "mine", "mine", "mine", "mine") for i, t in texts.items()]
    spark.createDataFrame(rows, DOCS).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in texts if i < 200], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (None, None)], "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    return at, texts


def stage(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert out.columns == docs.columns and {r.score for r in out.select("score").collect()} == {"mine"}
    return sorted(r.doc_id for r in out.collect())


def near_by_force(texts):
    """The ids that stay: the least of each class."""
    split = {i: (t or "").split() for i, t in texts.items()}
    sets = {i: {tuple(w[a : a + 5]) for a in range(len(w) - 4)} for i, w in split.items()}
    label = {i: i for i in texts}
    for _ in range(3):
        for i in texts:
            for j in texts:
                if split[i] == split[j] or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    return sorted(set(label.values()))


def test_stages_that_drop(spark, folder):
    at, texts = folder
    kept = stage(spark, at, "quality_classifier")
    assert set(range(60)) <= set(kept) and not set(range(100, 130)) & set(kept)
    assert stage(spark, at, "near_dedup") == near_by_force(texts)
    assert stage(spark, at, "decontamination") == sorted(set(texts) - {202})  # 20 of 60 words; 20 of 620 stay


def emitted_by_sql(at):
    """Each document as often as the mix takes it in whole or in part."""
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{at}/documents.parquet/*.parquet')")
    return {i: -(-taken // size) if size else 0 for i, size, taken in con.execute(f"select doc_id, size, taken from ({queries.SQL['op8_mixing']})").fetchall()}


def test_mixing_emits_what_op8_takes_in_part_as_a_whole(spark, folder):
    at, texts = folder
    got = stage(spark, at, "mixing")
    assert {i: got.count(i) for i in texts} == emitted_by_sql(at)


def test_run(spark, folder):
    at, texts = folder
    out = corpus_pipeline.run(spark, at)
    got = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("n_tokens").alias("least"), F.max("n_tokens").alias("most")).collect()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(queries.default_tokenizer())
    for r in got:
        assert r.least == r.most == len(tk.encode(texts[r.doc_id] or "", add_special_tokens=False).ids) + 1
    good = {i for i, t in texts.items() if i < 100 or i in (203,)}
    assert {r.doc_id for r in got} <= set(near_by_force(texts)) - {202} - set(range(100, 130)) and len({r.doc_id for r in got} & good) > 40
