"""Comparing two models: by identity, by place, by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = Callable[[DataFrame], list[Column]]


def by_identity(a: DataFrame, b: DataFrame, key: Sequence[Column], compare: Sequence[str] = ()) -> DataFrame:
    """key, change: added (in b only), removed, unchanged or, where compared columns differ, modified.

    Rows are the same where all parts of the key are, nulls being equal to nulls; key shows them joined by '|'. Of rows with equal keys that with the greatest compared columns counts.
    """
    parts = [f"__k{i}" for i in range(len(key))]

    def keyed(df: DataFrame, v: str) -> DataFrame:
        rows = df.select(*(k.cast("string").alias(p) for k, p in zip(key, parts, strict=True)), F.struct(*compare).alias("v") if compare else F.lit(0).alias("v"))
        return rows.groupBy(*parts).agg(F.max("v").alias(v), F.lit(True).alias(f"in_{v}"))

    one, two = keyed(a, "va").alias("l"), keyed(b, "vb").alias("r")
    match = F.lit(True)
    for p in parts:
        match = match & F.col(f"l.{p}").eqNullSafe(F.col(f"r.{p}"))
    both = one.join(two, match, "full_outer")
    same = F.col("va").eqNullSafe(F.col("vb"))
    change = F.when(F.col("in_va").isNull(), "added").when(F.col("in_vb").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    shown = F.concat_ws("|", *(F.when(F.col("in_va").isNull(), F.col(f"r.{p}")).otherwise(F.col(f"l.{p}")) for p in parts))
    return both.select(shown.alias("key"), change.alias("change"))


def coverage(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Count and area of each grid cell in both models, and the difference of counts, for cells that either has."""
    def celled(df: DataFrame, name: str) -> DataFrame:
        keys = [F.floor(F.col(f"c{c}") / size).cast("long").alias(f"g{c}") for c in "xyz"]
        return df.groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.sum("area").alias(f"area_{name}"))

    both = celled(a, "a").join(celled(b, "b"), ["gx", "gy", "gz"], "full_outer").fillna(0)
    return both.withColumn("delta", F.col("n_b") - F.col("n_a"))


def by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """name, area_a, area_b, ratio of shared and single names after dropping an instance suffix /N."""
    def total(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.regexp_replace("name", r"/[0-9]+$", "").alias("name")).agg(F.sum("area").alias(f"area_{name}"))

    both = total(a, "a").join(total(b, "b"), "name", "full_outer")
    least, most = F.least("area_a", "area_b"), F.greatest("area_a", "area_b")
    return both.withColumn("ratio", F.when(F.col("area_a").isNotNull() & F.col("area_b").isNotNull() & (most > 0), least / most))


def merge_map(rows: DataFrame, key: Sequence[str], item: str) -> DataFrame:
    """item, survivor: of items with equal key the smallest stays; nulls in a key are equal to each other."""
    first = rows.groupBy(*key).agg(F.min(item).alias("survivor"))
    match = F.lit(True)
    left, right = rows.alias("l"), first.alias("r")
    for k in key:
        match = match & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, match).select(F.col(f"l.{item}").alias(item), "survivor")


def name_suffixes(rows: DataFrame, order: str) -> DataFrame:
    """Adds unique_name: the n-th row of a name (from 0, in `order`) after the first gets _n."""
    n = F.row_number().over(Window.partitionBy("name").orderBy(order)) - 1
    return rows.withColumn("unique_name", F.when(n == 0, F.col("name")).otherwise(F.concat_ws("_", "name", n.cast("string"))))
