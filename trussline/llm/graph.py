"""Connected components of an undirected link table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """Labels the nodes of links (a long, b long): node, label (the smallest node of the component).

    A hub of many links costs no more than its links: labels are sent along links and meet in partial minima. Each round also
    replaces a label by its own label, so rounds grow with the logarithm of the diameter; each is checkpointed.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    digest = (F.bit_xor(F.xxhash64("label", "node")).alias("s"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", "label")).alias("x"))
    before = labels.agg(*digest).first()
    while True:
        sent = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "label")
        own = labels.select("node", "label")
        jumped = own.select(F.col("label").alias("node"), F.col("node").alias("back")).join(labels, "node").select(F.col("back").alias("node"), "label")
        labels = cut(sent.unionByName(own).unionByName(jumped).groupBy("node").agg(F.min("label").alias("label")))
        now = labels.agg(*digest).first()
        if now == before:
            return labels
        before = now
