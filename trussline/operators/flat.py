"""Flat patches that grow from seed planes, and the surface that a patch lies on: plane, cylinder or neither.

Facets are rows (facet_id, p) with columns of one's own, p an array of (x, y, z). facet_id is a whole number from 0 on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.functions.geometry import Point, cross, dot, minus, norm
from trussline.operators.graph import checkpointed, components, written
from trussline.operators.mesh import area_vector, middle
from trussline.operators.outlines import facet_sides


def neighbours_by_side(facets: DataFrame, by: Sequence[str], digits: int = 9) -> DataFrame:
    """a, b: facets of one `by` with a common side that no third facet of it has, both ways round."""
    sides = facet_sides(facets, by, digits)
    met = sides.groupBy(*by, F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n"), F.min("facet_id").alias("p"), F.max("facet_id").alias("q")).where("n = 2 and p <> q")
    return met.select(F.explode(F.array(F.struct(F.col("p").alias("a"), F.col("q").alias("b")), F.struct(F.col("q").alias("a"), F.col("p").alias("b")))).alias("l")).select("l.a", "l.b").distinct()


def auto_deviation(facets: DataFrame, share: float = 1e-3) -> float:
    """A thousandth of the diagonal of the box around all corners."""
    ends = facets.select(F.explode("p").alias("q")).agg(*(f(F.col(f"q.{c}")).alias(f"{c}{i}") for c in "xyz" for i, f in enumerate((F.min, F.max)))).first()
    if ends is None or ends["x0"] is None:
        return share * 1e-9
    return share * max(math.dist([ends[f"{c}0"] for c in "xyz"], [ends[f"{c}1"] for c in "xyz"]), 1e-9)


def _in_one_plane(near: DataFrame, planes: DataFrame, max_dev: float) -> DataFrame:
    """Of near those links a < b whose ends' means lie within max_dev of each other's planes and whose normals hardly differ. A guess to begin with: corners aren't looked at."""
    ends = [planes.select(F.col("facet_id").alias(e), *(F.col(f"{k}{c}").alias(f"{k}{c}_{e}") for k in "mn" for c in "xyz")) for e in "ab"]
    met = near.where("a < b").join(ends[0], "a").join(ends[1], "b")
    n, m = ({e: tuple(F.col(f"{k}{c}_{e}") for c in "xyz") for e in "ab"} for k in "nm")
    gap = minus(m["b"], m["a"])
    return met.where((F.abs(dot(gap, n["a"])) <= max_dev) & (F.abs(dot(gap, n["b"])) <= max_dev) & (F.abs(dot(n["a"], n["b"])) > 0.9999)).select("a", "b")


def flat_patches(facets: DataFrame, by: Sequence[str] = (), max_dev: float | None = None, digits: int = 9, links: DataFrame | None = None) -> DataFrame:
    """facet_id, seed: facets in patches none of whose corners is further than max_dev from the plane of the patch's seed, so that errors don't add up along a curve.

    The result is that of growing one after the other: the smallest facet left is a seed; it takes neighbours over and over, as long as all their corners lie within max_dev of its plane (through the mean of its corners, by its normal).
    Here all grow at once and the smaller seed wins. A facet takes the least seed among those of its neighbours and of its own seed's seed whose plane it is near to; it falls back to itself where its seed is itself taken. When
    nothing changes, patches must hang together with their seeds; parts that don't fall back too, and from then on seeds only travel from neighbour to neighbour. A state in which nothing changes and all hangs together is the one that growing
    one after the other gives: the smallest seed has all that it can reach, the next one all that is left to it, and so on. So any state will do to begin with whose facets are near their seeds' planes: here the components of neighbours
    that lie in each other's planes by their means and normals, without the facets that are off their component's smallest one. Where that is the result already, one round finds nothing to change. Rounds are written to the shared folder.
    """
    max_dev = auto_deviation(facets) if max_dev is None else max_dev
    solid = F.size("p") >= 3
    spun = area_vector(F.col("p"))
    known = facets.select("facet_id", *by, "p", *(F.when(solid, v).alias(f"n{c}") for c, v in zip("xyz", spun, strict=True)), *(F.when(solid, middle(F.col("p"), c)).alias(f"m{c}") for c in "xyz"))
    length = norm(tuple(F.col(f"n{c}") for c in "xyz"))
    # whatever facets are made of is worked out once
    known = checkpointed(known.select("facet_id", *by, "p", *(f"m{c}" for c in "xyz"), *((F.col(f"n{c}") / F.when(length > 0, length).otherwise(1.0)).alias(f"n{c}") for c in "xyz")))
    planes = known.where(solid)
    near = checkpointed(neighbours_by_side(known, list(by), digits) if links is None else links.select("a", "b"))
    seed_planes = planes.select(F.col("facet_id").alias("to"), *(F.col(f"{k}{c}") for k in "mn" for c in "xyz"))
    corners = planes.select("facet_id", "p")
    off = F.array_max(F.transform("p", lambda q: F.abs(sum(((q[c] - F.col(f"m{c}")) * F.col(f"n{c}") for c in "yz"), (q["x"] - F.col("mx")) * F.col("nx")))))
    parts = components(known.select(F.col("facet_id").alias("node")), _in_one_plane(near, planes, max_dev)).select(F.col("node").alias("facet_id"), F.col("label").alias("to"))
    parts = parts.join(corners, "facet_id", "left").join(seed_planes, "to", "left")
    begun = written(parts.select("facet_id", F.when(off <= max_dev, F.col("to")).otherwise(F.col("facet_id")).alias("seed"), "to"))
    state = begun.select("facet_id", "seed")
    # components that nothing was left out of hang together
    whole_parts = not begun.where("seed <> to").head(1)
    jumping = True
    while True:
        valid = state.where("facet_id = seed").select(F.col("seed").alias("to"))
        own = state.join(valid.select(F.col("to").alias("seed"), F.lit(True).alias("alive")), "seed", "left")
        kept = own.select("facet_id", F.when(F.col("alive"), F.col("seed")).otherwise(F.col("facet_id")).alias("seed"))
        offers = near.join(state.select(F.col("facet_id").alias("a"), F.col("seed").alias("to")), "a").select(F.col("b").alias("facet_id"), "to")
        if jumping:
            offers = offers.union(state.join(state.select(F.col("facet_id").alias("seed"), F.col("seed").alias("to")), "seed").select("facet_id", "to"))
        offers = offers.join(kept, "facet_id").where(F.col("to") < F.col("seed")).select("facet_id", "to").distinct().join(valid, "to")
        tried = offers.join(corners, "facet_id").join(seed_planes, "to")
        taken = tried.where(off <= max_dev).groupBy("facet_id").agg(F.min("to").alias("to"))
        after = written(kept.join(taken, "facet_id", "left").join(state.withColumnRenamed("seed", "was"), "facet_id").select("facet_id", F.least("seed", "to").alias("seed"), "was"))
        state = after.select("facet_id", "seed")
        if after.where("seed <> was").head(1):
            whole_parts = False
            continue
        if whole_parts:
            return state
        seeds = [state.select(F.col("facet_id").alias(e), F.col("seed").alias(f"s{e}")) for e in "ab"]
        inner = near.join(seeds[0], "a").join(seeds[1], "b").where("sa = sb").select("a", "b")
        whole = components(state.select(F.col("facet_id").alias("node")), inner).withColumnRenamed("node", "facet_id")
        checked = written(state.join(whole, "facet_id").select("facet_id", F.when(F.col("label") == F.col("seed"), F.col("seed")).otherwise(F.col("facet_id")).alias("seed"), (F.col("label") != F.col("seed")).alias("torn")))
        if not checked.where("torn").head(1):
            return state
        state, jumping = checked.select("facet_id", "seed"), False


def _least_direction(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Direction of the least eigenvalue of a symmetric 3 x 3 matrix, not of unit length: the eigenvalue in closed form, then the longest cross product of two rows of what is left."""
    mean = (xx + yy + zz) / 3
    a, b, c = xx - mean, yy - mean, zz - mean
    spread = F.sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    third = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * spread * spread * spread)))) / 3
    least = F.when(spread > 0, mean + 2 * spread * F.cos(third + 2 * math.pi / 3)).otherwise(mean)
    rows = ((xx - least, xy, xz), (xy, yy - least, yz), (xz, yz, zz - least))
    pairs = [cross(rows[0], rows[1]), cross(rows[0], rows[2]), cross(rows[1], rows[2])]
    best = F.array_max(F.array(*(F.struct(dot(v, v).alias("size"), *(w.alias(n) for w, n in zip(v, "xyz", strict=True))) for v in pairs)))
    return best["x"], best["y"], best["z"]


def _unit(df: DataFrame, name: str, v: Point, otherwise: tuple[float, float, float]) -> DataFrame:
    """Adds namex, namey, namez: v as a unit vector, or `otherwise` where it has no length."""
    raw = df.withColumns({f"__{c}": w for c, w in zip("xyz", v, strict=True)})
    raw = raw.withColumn("__l", norm(tuple(F.col(f"__{c}") for c in "xyz")))
    out = {f"{name}{c}": F.when(F.col("__l") > 0, F.col(f"__{c}") / F.col("__l")).otherwise(F.lit(o)) for c, o in zip("xyz", otherwise, strict=True)}
    return raw.withColumns(out).drop("__x", "__y", "__z", "__l")


def _covariances(prefix: str) -> list[Column]:
    at = [F.col(f"{prefix}{c}") for c in "xyz"]
    return [F.covar_pop(at[i], at[j]).alias(f"{prefix}{'xyz'[i]}{'xyz'[j]}") for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))]


def classify_patches(facets: DataFrame, by: Sequence[str], plane_tol: float = 1e-3, cylinder_tol: float = 0.02, least_span: float = 0.3) -> DataFrame:
    """The surface of each patch (the facets of one `by`): *by, surface, plane_dev, radius, rel_dev, span.

    planar: no corner is further from the best plane than plane_tol of the diagonal of the patch's box (plane_dev is that share). cylinder: normals stand square to an axis, the corners' circle about it (least squares) has no relative error over
    cylinder_tol (rel_dev) and the patch is longer along the axis than least_span radii (span). Else freeform. Planes come first. Three groupings: moments of corners and normals, sums of the circle's equations in the axis' frame, largest errors.
    Fits of planes and axes are eigenvectors in closed form. A corner counts once for each facet. Facets of fewer than three corners are left out.
    """
    by = list(by)
    spun = area_vector(F.col("p"))
    flat = facets.where(F.size("p") >= 3).select(*by, "p", *(v.alias(f"w{c}") for v, c in zip(spun, "xyz", strict=True)))
    length = norm(tuple(F.col(f"w{c}") for c in "xyz")) + 1e-300
    normals = flat.select(*by, *((F.col(f"w{c}") / length).alias(f"n{c}") for c in "xyz")).groupBy(*by).agg(*_covariances("n"))
    points = checkpointed(flat.select(*by, F.explode("p").alias("q")).select(*by, *(F.col(f"q.{c}").alias(f"p{c}") for c in "xyz")))
    moments = points.groupBy(*by).agg(*_covariances("p"), *(F.avg(f"p{c}").alias(f"m{c}") for c in "xyz"), norm(tuple(F.max(f"p{c}") - F.min(f"p{c}") for c in "xyz")).alias("diagonal")).join(normals, by)
    cov = lambda k: [F.col(f"{k}{e}") for e in ("xx", "yy", "zz", "xy", "xz", "yz")]
    fitted = _unit(moments, "f", _least_direction(*cov("p")), (0.0, 0.0, 1.0))
    fitted = _unit(fitted, "a", _least_direction(*cov("n")), (0.0, 0.0, 1.0))
    axis = tuple(F.col(f"a{c}") for c in "xyz")
    aside = (F.when(F.abs(axis[0]) < 0.9, 1.0).otherwise(0.0), F.when(F.abs(axis[0]) < 0.9, 0.0).otherwise(1.0), F.lit(0.0))
    fitted = _unit(fitted, "u", cross(axis, aside), (1.0, 0.0, 0.0))
    across = cross(axis, tuple(F.col(f"u{c}") for c in "xyz"))
    fitted = checkpointed(fitted.withColumns({f"v{c}": w for c, w in zip("xyz", across, strict=True)}).select(*by, "diagonal", *(f"{k}{c}" for k in "mfauv" for c in "xyz")))
    away = minus(tuple(F.col(f"p{c}") for c in "xyz"), tuple(F.col(f"m{c}") for c in "xyz"))
    parts = {k: dot(away, tuple(F.col(f"{k}{c}") for c in "xyz")) for k in "fauv"}
    local = points.join(fitted, by).select(*by, "diagonal", *(v.alias(k) for k, v in parts.items()))
    u, v, r2 = F.col("u"), F.col("v"), F.col("u") * F.col("u") + F.col("v") * F.col("v")
    # u and v have mean 0, so the third unknown of the circle's equations is the mean of r2
    sums = local.groupBy(*by).agg(
        F.max(F.abs("f")).alias("off"), F.any_value("diagonal").alias("diagonal"), (F.max("a") - F.min("a")).alias("reach"), F.avg(r2).alias("r2"),
        F.avg(u * u).alias("uu"), F.avg(u * v).alias("uv"), F.avg(v * v).alias("vv"), F.avg(u * r2).alias("ur"), F.avg(v * r2).alias("vr"),
    )
    # where all corners lie on one line along or across the axis there is no circle
    sums = sums.withColumn("den", F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv"))
    sums = sums.withColumn("den", F.when(F.col("den") > 1e-14 * F.col("r2") * F.col("r2"), F.col("den")))
    sums = sums.withColumns({"cu": (F.col("ur") * F.col("vv") - F.col("vr") * F.col("uv")) / (2 * F.col("den")), "cv": (F.col("vr") * F.col("uu") - F.col("ur") * F.col("uv")) / (2 * F.col("den"))})
    circle = F.sqrt(F.col("r2") + F.col("cu") * F.col("cu") + F.col("cv") * F.col("cv"))
    sums = checkpointed(sums.withColumn("radius", circle))
    gap = F.abs(F.sqrt((u - F.col("cu")) * (u - F.col("cu")) + (v - F.col("cv")) * (v - F.col("cv"))) - F.col("radius"))
    errors = local.select(*by, "u", "v").join(sums.select(*by, "cu", "cv", "radius"), by).groupBy(*by).agg(F.max(gap).alias("gap"))
    out = sums.join(errors, by).withColumns({"plane_dev": F.when(F.col("diagonal") > 1e-12, F.col("off") / F.col("diagonal")).otherwise(0.0), "rel_dev": F.col("gap") / F.col("radius"), "span": F.col("reach") / F.col("radius")})
    surface = F.when(F.col("plane_dev") <= plane_tol, "planar").when((F.col("rel_dev") <= cylinder_tol) & (F.col("span") > least_span), "cylinder").otherwise("freeform")
    return out.select(*by, surface.alias("surface"), "plane_dev", "radius", "rel_dev", "span")
