"""Outlines of sets of facets: facets turned to agree, inner edges cancelled, boundary rings numbered, holes put into the rings around them.

Everything is a join or a grouping on edges; rings are numbered by pointer doubling, so neither a patch nor a ring has to fit a task. Facets are rows (facet_id, p) with columns of one's own, where p is
an array of (x, y, z); corners are the same where they agree to `digits` decimals. facet_id is a whole number from 0 on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.geometry import Point, cross, dot, minus, norm, once
from trussline.operators.graph import checkpointed, parity_components, ranked_cycles, ranked_within


def _spot(q: Column, digits: int) -> Column:
    return F.struct(*((F.round(q[c], digits) + 0.0).alias(c) for c in "xyz"))  # + 0.0: no negative zero


def facet_sides(facets: DataFrame, by: Sequence[str], digits: int = 9) -> DataFrame:
    """facet_id, *by, a, b: the sides of facets from corner to corner, in the facet's direction. A corner that follows itself counts once; facets of fewer than three corners give none."""
    spots = once(F.transform("p", lambda q: _spot(q, digits)), lambda s: F.filter(s, lambda q, i: q != F.get(s, F.pmod(i - 1, F.size(s)))))
    sides = once(spots, lambda s: F.when(F.size(s) >= 3, F.transform(s, lambda q, i: F.struct(q.alias("a"), F.get(s, F.pmod(i + 1, F.size(s))).alias("b")))))
    return facets.select("facet_id", *by, F.inline(sides))


def agreeing_sides(sides: DataFrame, by: Sequence[str]) -> DataFrame:
    """sides with piece and clash, turned about so that neighbours run along their common side in opposite directions.

    Facets are neighbours over a side that exactly two sides of the same `by` share. A piece is what is linked so, named by its smallest facet, whose direction holds for all; clash: it can't be had (a band that is twisted).
    """
    # a facet and its direction in one number: extremes of numbers are found by hashing, those of structs by sorting
    side = F.col("facet_id").cast("long") * 2 + (F.col("a") < F.col("b")).cast("long")
    shared = sides.groupBy(*by, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n"), F.min(side).alias("p"), F.max(side).alias("q")).where("n = 2")
    met = shared.select(*(F.shiftright(c, 1).alias(n) for c, n in (("p", "a"), ("q", "b"))), (F.col("p") % 2 == F.col("q") % 2).alias("odd"))
    turned = checkpointed(parity_components(sides.select(F.col("facet_id").alias("node")).distinct(), met.where("a <> b")))
    turned = turned.join(turned.groupBy("label").agg(F.bool_or("clash").alias("__clash")), "label")
    turned = turned.select(F.col("node").alias("facet_id"), F.col("label").alias("piece"), "flip", F.col("__clash").alias("clash"))
    out = sides.join(turned, "facet_id")
    return out.select("facet_id", *by, "piece", "clash", F.when(F.col("flip"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("flip"), F.col("a")).otherwise(F.col("b")).alias("b"))


def net_edges(sides: DataFrame, by: Sequence[str]) -> DataFrame:
    """Directed boundary: sides that run in one direction more often than in the other, so often as that is."""
    up = F.col("a") < F.col("b")
    counts = sides.groupBy(*by, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg((F.count_if(up) - F.count_if(~up)).alias("net")).where("net <> 0")
    ends = (F.when(F.col("net") > 0, F.col(x)).otherwise(F.col(y)) for x, y in (("lo", "hi"), ("hi", "lo")))
    rows = counts.select(*by, *(e.alias(n) for e, n in zip(ends, "ab", strict=True)), F.abs("net").alias("net"))
    return rows.select(*by, "a", "b", F.explode(F.sequence(F.lit(1).cast("long"), F.col("net"))).alias("copy")).drop("copy")


def _xyz(name: str) -> Point:
    return tuple(F.col(f"{name}.{c}") for c in "xyz")


def _flat(v: Point, drop: Column, sign: Column) -> tuple[Column, Column]:
    """A vector in the plane of the two axes other than `drop` (0, 1, 2), mirrored where the normal points down that axis: directions about the normal keep their order."""
    first = F.when(drop == 0, v[1]).when(drop == 1, v[2]).otherwise(v[0])
    second = F.when(drop == 0, v[2]).when(drop == 1, v[0]).otherwise(v[1])
    return first, second * sign


def _with_axis(df: DataFrame, normal: Point) -> DataFrame:
    """Adds drop (the axis along which the normal is longest) and sign (which way it points there)."""
    size = [F.abs(c) for c in normal]
    drop = F.when((size[0] >= size[1]) & (size[0] >= size[2]), 0).when(size[1] >= size[2], 1).otherwise(2)
    along = F.when(drop == 0, normal[0]).when(drop == 1, normal[1]).otherwise(normal[2])
    return df.withColumns({"drop": drop, "sign": F.when(along < 0, -1.0).otherwise(1.0)})


def boundary_rings(facets: DataFrame, by: Sequence[str] = (), digits: int = 9, split_pinches: bool = True) -> DataFrame:
    """Oriented boundary rings of the pieces of facets: *by, piece, ring, seq, n, x, y, z. Flat or curved.

    Facets of one `by` that share a side are a piece, named by its smallest facet_id, whose direction holds: seen from its front, outer rings run against the clock and holes with it. ring numbers a piece's rings by their
    length in corners, most first, then by their first corner, the smallest (x, y, z) of the ring; seq counts from 0 on from there; n is the number of corners.

    Where more than one boundary edge leaves a corner (a pinch), the ring goes on by the edge that turns farthest to the left, so that the parts which touch there get rings of their own; the normal is that of the whole piece.
    With split_pinches=False such a piece has no rings. Pieces that can't be turned to agree, and pieces whose edges don't close, have none either.
    """
    by = list(by)
    sides = checkpointed(agreeing_sides(checkpointed(facet_sides(facets, by, digits)), by))
    sides = sides.where("not clash")
    one = [*by, "piece"]
    # ids stay as they are written
    edges = checkpointed(net_edges(sides.drop("facet_id", "clash"), one).withColumn("e", F.monotonically_increasing_id()))
    spins = cross(_xyz("a"), _xyz("b"))
    normals = _with_axis(sides.groupBy("piece").agg(*(F.sum(v).alias(f"n{c}") for v, c in zip(spins, "xyz", strict=True))), tuple(F.col(f"n{c}") for c in "xyz")).select("piece", "drop", "sign")
    # corners with the edges that leave and arrive: where that is one of each, one follows the other without a join
    ends = [edges.select(*one, F.col(c).alias("at"), *(F.when(F.lit(c == k), F.col("e")).alias(n) for k, n in (("a", "out"), ("b", "into")))) for c in "ab"]
    corners = ends[0].union(ends[1]).groupBy(*one, "at").agg(F.count("out").alias("n_out"), F.count("into").alias("n_in"), F.min("out").alias("next"), F.min("into").alias("e"))
    corners = checkpointed(corners)
    # a corner that not as many edges leave as arrive at
    bad = corners.where("n_out <> n_in" if split_pinches else "n_out <> n_in or n_out > 1").select("piece").distinct()
    usual = corners.join(bad, "piece", "left_anti")
    # a step from an edge to the next one, whose first corner is where they meet
    steps = usual.where("n_out = 1").select(*one, "at", "e", "next")
    if split_pinches:
        pinches = usual.where("n_out > 1").select("piece", F.col("at").alias("b"))
        then = edges.select("piece", F.col("a").alias("b"), F.col("b").alias("c"), F.col("e").alias("next"))
        sharp = edges.select(*one, "a", "b", "e").join(pinches, ["piece", "b"]).join(then.join(pinches, ["piece", "b"]), ["piece", "b"]).join(normals, "piece")
        back, on = (_flat(minus(_xyz(x), _xyz("b")), F.col("drop"), F.col("sign")) for x in ("a", "c"))
        turn = F.pmod(F.atan2(on[1], on[0]) - F.atan2(back[1], back[0]) + F.lit(1e-12), F.lit(2 * 3.141592653589793))
        best = sharp.groupBy(*one, "b", "e").agg(F.max(F.struct(turn.alias("turn"), "next")).alias("best")).select(*one, F.col("b").alias("at"), "e", F.col("best.next").alias("next"))
        steps = checkpointed(steps.union(best))
        torn = steps.groupBy("piece", "next").agg(F.count("*").alias("n")).where("n > 1").select("piece").distinct()
        steps = steps.join(torn, "piece", "left_anti")
    numbered = ranked_within(steps.select(*one, F.col("at").alias("a"), F.col("next").alias("e"), F.col("e").alias("prev")), "piece")
    rows = checkpointed(numbered.select(*one, "cycle", "rank", "n", "a"))
    first = rows.groupBy(*one, "cycle", "n").agg(F.min(F.struct("a", "rank")).alias("first"))
    order = Window.partitionBy(*one).orderBy(F.desc("n"), "first.a", "cycle")  # one row for each ring of a piece
    first = first.withColumn("ring", F.row_number().over(order) - 1).select("cycle", "ring", F.col("first.rank").alias("from"))
    return rows.join(first, "cycle").select(*one, "ring", F.pmod(F.col("rank") - F.col("from"), "n").alias("seq"), "n", *(F.col(f"a.{c}").alias(c) for c in "xyz"))


def _following(rings: DataFrame, one: Sequence[str]) -> DataFrame:
    """Adds x2, y2, z2, the next corner of the ring: a join on the number of the next one."""
    then = rings.select(*one, F.pmod(F.col("seq") - 1, "n").alias("seq"), *(F.col(c).alias(f"{c}2") for c in "xyz"))
    return rings.join(then, [*one, "seq"])


def without_straight_corners(rings: DataFrame, by: Sequence[str] = (), factor: float = 1e-8) -> DataFrame:
    """Rings without the corners that lie on the line of their two neighbours (twice the triangle's area at most factor times the square of the ring's size), numbered anew. Rings that keep fewer than three corners are left out."""
    one = [*by, "piece", "ring"]
    around = _following(rings, one)
    before = around.select(*one, F.pmod(F.col("seq") + 1, "n").alias("seq"), *(F.col(c).alias(f"{c}0") for c in "xyz"))
    size = rings.groupBy(*one).agg(F.greatest(*(F.max(c) - F.min(c) for c in "xyz")).alias("size"))
    p, q, r = (tuple(F.col(f"{c}{i}") for c in "xyz") for i in ("0", "", "2"))
    bent = norm(cross(minus(q, p), minus(r, q))) > factor * F.col("size") * F.col("size")
    kept = around.join(before, [*one, "seq"]).join(size, one).where(bent).select(*one, "seq", "x", "y", "z")
    # numbers among those that stay: counts of blocks of a ring first, then within the block
    block = F.floor(F.col("seq") / 10_000)
    kept = kept.withColumn("__b", block)
    blocks = kept.groupBy(*one, "__b").agg(F.count("*").alias("__k"))
    upto = Window.partitionBy(*one).orderBy("__b")
    blocks = blocks.select(*one, "__b", (F.sum("__k").over(upto) - F.col("__k")).alias("__base"), F.sum("__k").over(Window.partitionBy(*one)).alias("n"))
    rows = kept.withColumn("__at", F.row_number().over(Window.partitionBy(*one, "__b").orderBy("seq")) - 1).join(blocks, [*one, "__b"])
    return rows.where("n >= 3").select(*one, (F.col("__base") + F.col("__at")).alias("seq"), "n", "x", "y", "z")


def ring_facts(rings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each ring of flat pieces: *by, piece, ring, n_corners, area, hole, outer.

    A ring is a hole if it runs the other way round than the piece's ring of most area. outer is the ring it belongs to: itself, or of those around the mean of a hole's corners the one of least area; null where none is around it, and then
    the hole belongs to no face.
    """
    by = list(by)
    one = [*by, "piece"]
    sides = _following(rings, [*one, "ring"])
    centre = rings.groupBy(*one).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    a, b = (minus(tuple(F.col(f"{c}{i}") for c in "xyz"), tuple(F.col(f"m{c}") for c in "xyz")) for i in ("", "2"))
    spin = cross(a, b)
    sums = sides.join(centre, one).groupBy(*one, "ring").agg(
        F.count("*").alias("n_corners"), *(F.sum(v / 2).alias(f"a{c}") for v, c in zip(spin, "xyz", strict=True)), *(F.avg(c).alias(f"m{c}") for c in "xyz")
    )
    spun = tuple(F.col(f"a{c}") for c in "xyz")
    sums = checkpointed(sums.withColumn("area", norm(spun)))
    large = sums.groupBy(*one).agg(F.max_by(F.struct(*(F.col(f"a{c}").alias(c) for c in "xyz")), F.struct("area", -F.col("ring"))).alias("large"))
    sums = _with_axis(sums.join(large, one), _xyz("large")).withColumn("hole", dot(spun, _xyz("large")) < 0)
    sums = checkpointed(sums)
    holes = sums.where("hole").select(*one, F.col("ring").alias("inner"), "drop", "sign", *_named(_flat(tuple(F.col(f"m{c}") for c in "xyz"), F.col("drop"), F.col("sign")), ("u", "v")))
    outers = sums.where("not hole").select(*one, "ring", "area", "drop", "sign")
    # sides of outer rings stand in strips across their piece, a hole in one strip: a ray along it is crossed by sides of that strip alone
    wall = sides.join(outers, [*one, "ring"])
    ends = [_flat(tuple(F.col(f"{c}{i}") for c in "xyz"), F.col("drop"), F.col("sign")) for i in ("", "2")]
    wall = wall.select(*one, "ring", "area", *_named(ends[0], ("u1", "v1")), *_named(ends[1], ("u2", "v2")))
    strips = wall.groupBy(*one).agg(F.min("v1").alias("low"), F.greatest((F.max("v1") - F.min("v1")) / F.ceil(F.sqrt(F.count("*").cast("double"))), F.lit(1e-12)).alias("high"))

    def strip(v: str) -> Column:
        return F.floor((F.col(v) - F.col("low")) / F.col("high"))

    wall = wall.join(strips, one).withColumn("strip", F.explode(F.sequence(F.least(strip("v1"), strip("v2")), F.greatest(strip("v1"), strip("v2")))))
    near = holes.join(strips, one).withColumn("strip", strip("v")).select(*one, "strip", "inner", "u", "v").join(wall.select(*one, "strip", "ring", "area", "u1", "v1", "u2", "v2"), [*one, "strip"])
    hit = ((F.col("v1") > F.col("v")) != (F.col("v2") > F.col("v"))) & (F.col("u") < (F.col("u2") - F.col("u1")) * (F.col("v") - F.col("v1")) / (F.col("v2") - F.col("v1")) + F.col("u1"))
    around = near.where(F.col("v1") != F.col("v2")).groupBy(*one, "inner", "ring", "area").agg(F.count_if(hit).alias("crossed")).where("crossed % 2 = 1")
    of = around.groupBy(*one, F.col("inner").alias("ring")).agg(F.min(F.struct("area", "ring")).alias("o")).select(*one, "ring", F.col("o.ring").alias("around"))
    out = sums.join(of, [*one, "ring"], "left")
    return out.select(*one, "ring", "n_corners", "area", "hole", F.when(F.col("hole"), F.col("around")).otherwise(F.col("ring")).alias("outer"))


def _named(values: Sequence[Column], names: Sequence[str]) -> list[Column]:
    return [v.alias(n) for v, n in zip(values, names, strict=True)]


def merged_outlines(facets: DataFrame, by: Sequence[str], digits: int = 9) -> DataFrame:
    """The one outline of the facets of each `by`: *by, seq, n, x, y, z, straight corners left out. Directions of facets don't count.

    Sides that one facet alone has are the boundary. There is an outline only if two such sides meet at each of their corners and all are one ring: a hole, a pinch or a second part gives none. It starts at its smallest corner
    and goes on to the smaller one of that corner's neighbours.
    """
    by = list(by)
    sides = facet_sides(facets, by, digits)
    lone = sides.groupBy(*by, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n")).where("n = 1")
    # either direction of each side is a step; the one of a ring that starts towards the smaller neighbour stays
    both = lone.select(*by, F.col("lo").alias("a"), F.col("hi").alias("b")).union(lone.select(*by, F.col("hi").alias("a"), F.col("lo").alias("b")))
    both = checkpointed(both.withColumn("e", F.monotonically_increasing_id()))
    off = both.groupBy(*by, "a").agg(F.count("*").alias("n")).where("n <> 2").select(*by).distinct()
    plain = both.join(off, by, "left_anti") if by else both
    then = plain.select(*by, F.col("a").alias("b"), F.col("b").alias("c"), F.col("e").alias("next"))
    steps = plain.join(then, [*by, "b"]).where(F.col("a") != F.col("c")).select("e", "next")
    rows = checkpointed(plain.join(ranked_cycles(steps), "e").select(*by, "cycle", "rank", "n", "a", "b"))
    cycles = rows.groupBy(*by, "cycle", "n").agg(F.min(F.struct("a", "b", "rank")).alias("first"))
    # two cycles are one ring in its two directions
    chosen = cycles.groupBy(*by).agg(F.count("*").alias("k"), F.min(F.struct("first", "cycle")).alias("m")).where("k = 2").select(F.col("m.cycle").alias("cycle"), F.col("m.first.rank").alias("from"))
    rings = rows.join(chosen, "cycle").select(*by, F.lit(0).alias("piece"), F.lit(0).alias("ring"), F.pmod(F.col("rank") - F.col("from"), "n").alias("seq"), "n", *(F.col(f"a.{c}").alias(c) for c in "xyz"))
    return without_straight_corners(checkpointed(rings), by).drop("piece", "ring")
