"""Closed polygons with fewer corners: Douglas-Peucker over all open spans of all polygons at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.geometry import Point, cross, minus, norm
from trussline.operators.graph import written


def _of(prefix: str) -> Point:
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")


def _named(prefix: str, p: Column) -> dict[str, Column]:
    return {f"{prefix}{c}": p[c] for c in "xyz"}


def _area(corners: DataFrame, order: str, name: str) -> DataFrame:
    """Area of each polygon by the cross products of neighbouring corners; order: numbers from 0 on without gaps, n of them."""
    then = corners.select("poly_id", F.pmod(F.col(order) - 1, F.col("n")).alias(order), *(F.col(c).alias(f"n{c}") for c in "xyz"))
    first = corners.where(F.col(order) == 0).select("poly_id", *(F.col(c).alias(f"f{c}") for c in "xyz"))
    both = corners.join(then, ["poly_id", order]).join(first, "poly_id")
    spin = cross(minus(_of(""), _of("f")), minus(_of("n"), _of("f")))
    sums = both.groupBy("poly_id").agg(*(F.sum(v / 2).alias(f"s{c}") for c, v in zip("xyz", spin, strict=True)))
    return sums.select("poly_id", norm(_of("s")).alias(name))


def simplified(corners: DataFrame, rel_tol: float = 0.01, max_area_change: float = 0.02) -> DataFrame:
    """Closed flat polygons without corners that stand out by at most rel_tol of the polygon's size: poly_id, seq, n, x, y, z, changed.

    Input: poly_id, seq (0, 1, 2 ... without gaps), x, y, z. The size is the longest edge of the polygon's box, 1 at least. The polygon is parted at its first and last corner along that edge, which are corners for certain; then each span between two
    kept corners keeps the one that is farthest from the line between them, the earlier of equal ones, if it is farther than the tolerance, and is parted there. All open spans of all polygons are looked at in each round; rounds are as
    many as spans lie within one another, and are written to the shared folder. Kept corners stay where they are.

    A polygon of fewer than four corners, one that would keep fewer than three, and one whose area would change by more than max_area_change of itself stay as they are (changed is false).
    """
    rows = corners.select("poly_id", F.col("seq").cast("long").alias("seq"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    spans = {c: F.max(c) - F.min(c) for c in "xyz"}
    facts = rows.groupBy("poly_id").agg(F.count("*").alias("n"), *(s.alias(f"d{c}") for c, s in spans.items()))
    longest = F.greatest("dx", "dy", "dz")
    axis = F.when(F.col("dx") == longest, "x").when(F.col("dy") == longest, "y").otherwise("z")
    rows = written(rows.join(facts.select("poly_id", "n", axis.alias("axis"), (F.greatest(longest, F.lit(1.0)) * rel_tol).alias("tol")), "poly_id"))
    along = F.when(F.col("axis") == "x", F.col("x")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("z"))
    at = F.struct("seq", *"xyz")
    # ties go to the smaller number
    anchors = rows.where("n >= 4").groupBy("poly_id").agg(F.min(F.struct(along.alias("v"), at.alias("at"))).alias("low"), F.min(F.struct((-along).alias("v"), at.alias("at"))).alias("high"))
    anchors = anchors.where("low.at.seq <> high.at.seq").select("poly_id", F.least("low.at", "high.at").alias("a"), F.greatest("low.at", "high.at").alias("b"))
    placed = rows.join(anchors, "poly_id")
    pos = F.pmod(F.col("seq") - F.col("a.seq"), "n")
    middle = F.col("b.seq") - F.col("a.seq")
    early = F.col("pos") < F.col("middle")
    placed = placed.withColumns({"pos": pos, "middle": middle})
    kept = placed.where("pos = 0 or pos = middle").select("poly_id", "seq")
    lo, hi = F.when(early, 0).otherwise(F.col("middle")), F.when(early, F.col("middle")).otherwise(F.col("n"))
    ends = _named("a", F.when(early, F.col("a")).otherwise(F.col("b"))) | _named("b", F.when(early, F.col("b")).otherwise(F.col("a")))
    open_ = written(placed.where("pos <> 0 and pos <> middle").select("poly_id", "seq", "tol", "pos", *"xyz", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), *(v.alias(k) for k, v in ends.items())))
    while True:
        line, away = minus(_of("b"), _of("a")), minus(_of(""), _of("a"))
        length = norm(line)
        off = F.when(length < 1e-12, norm(away)).otherwise(norm(cross(line, away)) / F.greatest(length, F.lit(1e-12)))
        far = open_.groupBy("poly_id", "lo", "hi").agg(F.max(F.struct(off.alias("off"), (-F.col("pos")).alias("back"), "seq", F.struct(*"xyz").alias("p"))).alias("far"), F.any_value("tol").alias("t"))
        far = written(far.where("far.off > t").select("poly_id", "lo", "hi", (-F.col("far.back")).alias("cut"), F.col("far.seq").alias("cut_seq"), F.col("far.p").alias("p")))
        if not far.head(1):
            break
        kept = kept.union(far.select("poly_id", "cut_seq"))
        parted = open_.join(far, ["poly_id", "lo", "hi"]).where("pos <> cut")
        before = F.col("pos") < F.col("cut")
        bounds = {"lo": F.when(before, F.col("lo")).otherwise(F.col("cut")), "hi": F.when(before, F.col("cut")).otherwise(F.col("hi"))}
        moved = {f"a{c}": F.when(before, F.col(f"a{c}")).otherwise(F.col("p")[c]) for c in "xyz"} | {f"b{c}": F.when(before, F.col("p")[c]).otherwise(F.col(f"b{c}")) for c in "xyz"}
        open_ = written(parted.select("poly_id", "seq", "tol", "pos", *"xyz", *(v.alias(k) for k, v in (bounds | moved).items())))
    chosen = rows.join(kept, ["poly_id", "seq"]).select("poly_id", "seq", *"xyz")
    rank = F.row_number().over(Window.partitionBy("poly_id").orderBy("seq")) - 1
    chosen = written(chosen.withColumns({"at": rank.cast("long"), "n": F.count("*").over(Window.partitionBy("poly_id"))}))
    before, after = _area(rows, "seq", "area"), _area(chosen, "at", "now")
    good = before.join(after, "poly_id").join(chosen.select("poly_id", F.col("n").alias("k")).distinct(), "poly_id").where("k >= 3").where(~((F.col("area") > 1e-12) & (F.abs(F.col("now") - F.col("area")) > max_area_change * F.col("area"))))
    good = written(good.select("poly_id"))
    new = chosen.join(good, "poly_id").select("poly_id", F.col("at").alias("seq"), "n", *"xyz", F.lit(True).alias("changed"))
    old = rows.join(good, "poly_id", "left_anti").select("poly_id", "seq", "n", *"xyz", F.lit(False).alias("changed"))
    return new.union(old)
