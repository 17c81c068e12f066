"""FE results: long rows, restriction to sets, averages, ranges, histories, modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.operators.graph import dealt
from trussline.operators.mesh import corners


def long_form(wide: DataFrame, components: Sequence[str]) -> DataFrame:
    """One row for each component: step, elem_id, int_pt, component, value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in components))
    return wide.select("step", "elem_id", "int_pt", F.explode(pairs).alias("c")).select("step", "elem_id", "int_pt", "c.component", "c.value")


def last_step(results: DataFrame) -> DataFrame:
    """Rows of the greatest step."""
    top = results.agg(F.max("step").alias("step"))
    return results.join(F.broadcast(top), "step")  # one row


def in_set(results: DataFrame, members: DataFrame, int_points: Sequence[int] = ()) -> DataFrame:
    """Rows of elements in members.elem_id and, if given, of some integration points."""
    rows = results.where(F.col("int_pt").isin(*int_points)) if int_points else results
    return rows.join(members.select("elem_id"), "elem_id", "left_semi")


def nodal_average(results: DataFrame, elements: DataFrame, rows: int = 0) -> DataFrame:
    """step, node_id, component, value: the mean over all elements at a node; averaged per element first, so that corners are few.

    rows: about how many rows results has; the averages at nodes are dealt over tasks by it."""
    per = results.groupBy("step", "elem_id", "component").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    at = per.join(corners(elements).select("elem_id", "node_id").hint("merge"), "elem_id")
    return dealt(at, 4 * rows, "node_id").groupBy("step", "node_id", "component").agg((F.sum("s") / F.sum("n")).alias("value"))


def ranges(results: DataFrame) -> DataFrame:
    """component, low, high over finite values; 0, 0 where there is none."""
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return results.groupBy("component").agg(F.coalesce(F.min(finite), F.lit(0.0)).alias("low"), F.coalesce(F.max(finite), F.lit(0.0)).alias("high"))


def point_matrix(results: DataFrame, points: Sequence[int]) -> DataFrame:
    """step, elem_id, component and a column p1, p2, ... for each integration point."""
    return results.groupBy("step", "elem_id", "component").agg(*(F.max(F.when(F.col("int_pt") == p, F.col("value"))).alias(f"p{p}") for p in points))


def modal_totals(modes: DataFrame, directions: Sequence[str]) -> DataFrame:
    """Effective mass of each case and direction; null counts as 0."""
    return modes.groupBy("case_id").agg(*(F.sum(F.coalesce(F.col(d), F.lit(0.0))).alias(d) for d in directions))


def mode_table(modes: DataFrame, cases: Sequence[int], value: str) -> DataFrame:
    """mode by case."""
    return modes.where(F.col("case_id").isin(*cases)).groupBy("mode").pivot("case_id", list(cases)).agg(F.max(value)).select("mode", *(F.col(str(c)).alias(f"c{c}") for c in cases))


def mode_values(modes: DataFrame, value: str) -> DataFrame:
    """mode, case_id, value for all cases, in long form."""
    return modes.groupBy("mode", "case_id").agg(F.max(value).alias("value"))


def magnitude(components: Sequence[str]) -> Column:
    return F.sqrt(sum((F.col(c) * F.col(c) for c in components[1:]), F.col(components[0]) * F.col(components[0])))


def ranges_with_magnitude(wide: DataFrame, components: Sequence[str], *by: str) -> DataFrame:
    """by, component, low, high of each component and of the magnitude of the first three; as `ranges` otherwise."""
    values = [*((c, F.col(c)) for c in components), ("magnitude", magnitude(components[:3]))]
    long = wide.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("component"), v.cast("double").alias("value")) for n, v in values))).alias("e")).select(*by, "e.*")
    finite = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    return long.groupBy(*by, "component").agg(F.coalesce(F.min(finite), F.lit(0.0)).alias("low"), F.coalesce(F.max(finite), F.lit(0.0)).alias("high"))


def deformed(nodes: DataFrame, displacements: DataFrame, components: Sequence[str], scale: float = 1.0) -> DataFrame:
    """Nodes moved by `scale` times their displacement; nodes without one are left out."""
    rows = nodes.join(displacements, "node_id")
    return rows.withColumns({c: F.col(c) + scale * F.col(d) for c, d in zip("xyz", components, strict=True)}).select(*nodes.columns)


def shades(wide: DataFrame, components: Sequence[str], by: str) -> DataFrame:
    """Adds shade: where the magnitude lies between the least (0) and greatest (1) of its step; 0.5 where all are equal."""
    rows = wide.withColumn("__v", magnitude(components))
    span = rows.groupBy(by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    shade = F.when(F.col("__hi") > F.col("__lo"), (F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(0.5)
    return rows.join(span, by).withColumn("shade", shade).drop("__v", "__lo", "__hi")
