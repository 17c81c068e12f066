"""Spatial joins on grid cells: every pair meets in cells that both touch, and is kept once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.functions.geometry import cell, closest_approach, dot, minus, norm, point


def exploded(rows: DataFrame) -> DataFrame:
    """Rows of an explode, for a join that shuffles both sides: Spark counts none of an explode's rows in its estimates and would send such a side whole through the driver."""
    return rows.hint("merge")


def in_cells(boxes: DataFrame, size: float) -> DataFrame:
    """A row for each cell of one size that a box touches: cx, cy, cz. For boxes of like size; see `at_home` for others."""
    for c in "xyz":
        boxes = boxes.withColumn(f"c{c}", F.explode(F.sequence(cell(F.col(f"{c}0"), size), cell(F.col(f"{c}1"), size))))
    return exploded(boxes)


def levelled(boxes: DataFrame, size: float) -> DataFrame:
    """Adds level: cells of `size` times 2 to the level are no smaller than the box's longest edge, so it touches at most eight of them."""
    longest = F.greatest(*(F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"))
    return boxes.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(longest, F.lit(size)) / size))).cast("int"))


def _grid(value: Column, size: float) -> Column:
    return F.floor(value / (size * F.pow(F.lit(2.0), F.col("level")))).cast("long")


def at_home(boxes: DataFrame, size: float) -> DataFrame:
    """Levelled boxes with a row for each cell of their level that they touch."""
    for c in "xyz":
        boxes = boxes.withColumn(f"c{c}", F.explode(F.sequence(_grid(F.col(f"{c}0"), size), _grid(F.col(f"{c}1"), size))))
    return exploded(boxes)


def levels_of(boxes: DataFrame) -> list[int]:
    """The levels that there are: as many as the edges' lengths have powers of two, a few tens at most."""
    return sorted(r.level for r in boxes.select("level").distinct().collect())


CELL = ["level", "cx", "cy", "cz"]


def box_pairs(a: DataFrame, b: DataFrame | None = None, size: float = 2.0) -> DataFrame:
    """a, b, ax0..az1, bx0..bz1 and the bounds lx..lz, hx..hz of what two boxes share or where they touch; of one table with itself a < b.

    Boxes meet on the level of the larger one: it is in its few cells there, and the smaller one in its own cells of that level. A pair is kept in the one cell that holds
    the low corner of what they share. A crowded cell is a skewed key of an equi-join, which Spark splits at run time.
    """
    alone = b is None
    one = levelled(a, size)
    two = one if alone else levelled(b, size)
    levels = sorted({*levels_of(one), *(() if alone else levels_of(two))})

    def named(rows: DataFrame, k: str, own: bool) -> DataFrame:
        if own:
            held = at_home(rows.withColumn("__own", F.col("level")), size)
        else:
            wide = rows.withColumnRenamed("level", "__own")
            held = at_home(wide.withColumn("level", F.explode(F.filter(F.array(*(F.lit(v) for v in levels)), lambda v: v >= F.col("__own")))), size)
        return held.select(F.col("box_id").alias(k), F.col("__own").alias(f"own_{k}"), *(F.col(f"{c}{i}").alias(f"{k}{c}{i}") for c in "xyz" for i in "01"), *CELL)

    if not levels:
        levels = [0]
    large_a = named(one, "a", True).join(named(two, "b", False), CELL)
    if alone:
        # the larger one is called a here; of equal ones that of the smaller id
        large_a = large_a.where("own_a > own_b or own_a = own_b and a < b").where("a <> b")
        pairs = large_a
    else:
        pairs = large_a.unionByName(named(one, "a", False).join(named(two, "b", True), CELL).where("own_b > own_a"))
    for c in "xyz":
        pairs = pairs.withColumns({f"l{c}": F.greatest(f"a{c}0", f"b{c}0"), f"h{c}": F.least(f"a{c}1", f"b{c}1")})
    pairs = pairs.where("hx >= lx and hy >= ly and hz >= lz")
    for c in "xyz":
        pairs = pairs.where(_grid(F.col(f"l{c}"), size) == F.col(f"c{c}"))
    if alone:
        turn = F.col("a") > F.col("b")
        swapped = {k: F.when(turn, F.col(o)).otherwise(F.col(k)) for k, o in [("a", "b"), ("b", "a"), *((f"{p}{c}{i}", f"{q}{c}{i}") for p, q in ("ab", "ba") for c in "xyz" for i in "01")]}
        pairs = pairs.withColumns(swapped)
    return pairs.select("a", "b", *(f"{k}{c}{i}" for k in "ab" for c in "xyz" for i in "01"), *(f"{k}{c}" for k in "lh" for c in "xyz"))


def overlapping_boxes(boxes: DataFrame, size: float = 2.0, least: float = 1e-4, least_volume: float = 1e-8) -> DataFrame:
    """a < b and the overlap's volume of boxes (box_id, x0..z1) that overlap by more than `least` along each axis."""
    sides = [F.col(f"h{c}") - F.col(f"l{c}") for c in "xyz"]
    pairs = box_pairs(boxes, size=size)
    for s in sides:
        pairs = pairs.where(s > least)
    return pairs.select("a", "b", (sides[0] * sides[1] * sides[2]).alias("volume")).where(F.col("volume") > least_volume)


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float = 2.0, also: Column | None = None) -> DataFrame:
    """box_id, node_id of points inside a box, bounds included. A box is in at most eight cells of its level, a point in one of each level.

    also: a further condition on the point's x, y, z and the box's x0..z1.
    """
    held = levelled(boxes, size)
    levels = levels_of(held) or [0]
    keyed = points.select("node_id", "x", "y", "z", F.explode(F.array(*(F.lit(v) for v in levels))).alias("level"))
    keyed = keyed.select("*", *(_grid(F.col(c), size).alias(f"c{c}") for c in "xyz"))
    hits = at_home(held, size).join(keyed, CELL)
    for c in "xyz":
        hits = hits.where(F.col(c).between(F.col(f"{c}0"), F.col(f"{c}1")))
    return (hits if also is None else hits.where(also)).select("box_id", "node_id")


def segments(route: DataFrame) -> DataFrame:
    """Polyline points (system, seq, x, y, z) as segments to the next point."""
    from pyspark.sql import Window

    w = Window.partitionBy("system").orderBy("seq")
    ends = route.withColumns({f"{c}2": F.lead(c).over(w) for c in "xyz"})
    return ends.where("x2 is not null").withColumn("length", F.sqrt(sum(((F.col(f"{c}2") - F.col(c)) ** 2 for c in "yz"), (F.col("x2") - F.col("x")) ** 2)))


def beam_crossings(beams: DataFrame, gap: float = 0.1, size: float = 5.0) -> DataFrame:
    """a < b, s, t, gap of beams (beam_id, x1..z2) whose axes come within `gap` inside both spans; parallel ones have no crossing."""
    wide = beams.select(F.col("beam_id").alias("box_id"), *(F.least(f"{c}1", f"{c}2").alias(f"{c}0") for c in "xyz"), *((F.greatest(f"{c}1", f"{c}2") + gap).alias(f"{c}1") for c in "xyz"))
    # both boxes reach `gap` to one side: two that come within it share a place
    near_boxes = box_pairs(wide, size=size).select("a", "b")
    pairs = near_boxes
    for k in "ab":
        pairs = pairs.join(beams.select(F.col("beam_id").alias(k), *(F.col(f"{c}{i}").alias(f"{k}{c}{i}") for c in "xyz" for i in "12")), k)
    return crossed(pairs, gap).select("a", "b", "s", "t", "gap")


def crossed(pairs: DataFrame, gap: float) -> DataFrame:
    """Pairs of beams (ax1..az2, bx1..bz2) whose axes come within `gap` inside both spans, with s, t and gap."""
    p, q = point("ax1", "ay1", "az1"), point("bx1", "by1", "bz1")
    u, v = minus(point("ax2", "ay2", "az2"), p), minus(point("bx2", "by2", "bz2"), q)
    w = minus(p, q)
    # in steps: columns that later ones use more than once are worked out once
    products = pairs.withColumns({"uu": dot(u, u), "uv": dot(u, v), "vv": dot(v, v), "uw": dot(u, w), "vw": dot(v, w)})
    met = closest_approach(products)
    gap_columns = [w[i] + F.col("s") * u[i] - F.col("t") * v[i] for i in range(3)]
    near = met.where(F.col("s").between(0, 1) & F.col("t").between(0, 1)).withColumns({f"g{i}": g for i, g in enumerate(gap_columns)})
    return near.withColumn("gap", norm(point("g0", "g1", "g2"))).where(F.col("gap") <= gap)
