"""Polygons, faces of cells and points: predicates, clean-up, groups, and moves."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.geometry import cross, dot, minus, norm, once
from trussline.operators.mesh import area_vector
from trussline.operators.patches import cell_faces
from trussline.operators.spatial import exploded


def _at(p: Column, i: Column) -> tuple[Column, Column, Column]:
    q = F.get(p, F.pmod(i, F.size(p)))
    return q["x"], q["y"], q["z"]


def _part(c: str):
    def take(q: Column) -> Column:
        return q[c]

    return take


def polygon_facts(polygons: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Adds n_corners, area, clockwise (seen from above), coplanar (all corners within tol of the plane through the first one, normal to the area vector) and reflex (a corner that turns the other way) to polygons with corners p."""
    p = F.col("p")
    v = area_vector(p)
    rows = polygons.withColumns({"n_corners": F.size(p), "area": norm(v), "__nx": v[0], "__ny": v[1], "__up": v[2]})
    a = _at(p, F.lit(0))
    plane = (F.col("__nx"), F.col("__ny"), F.col("__up"))
    off = F.transform(p, lambda q: F.abs(dot(plane, (q["x"] - a[0], q["y"] - a[1], q["z"] - a[2]))))
    rows = rows.withColumns({"clockwise": F.col("__up") < 0, "coplanar": F.array_max(off) <= tol * F.greatest("area", F.lit(1e-12))})

    def turn(i: Column) -> Column:
        u, w = minus(_at(p, i), _at(p, i - 1)), minus(_at(p, i + 1), _at(p, i))
        return u[0] * w[1] - u[1] * w[0]

    turns = F.transform(F.sequence(F.lit(0), F.size(p) - 1), turn)
    rows = rows.withColumn("reflex", F.exists(turns, lambda t: t * F.col("__up") < -1e-9))
    return rows.drop("__up", "__nx", "__ny")


def without_collinear(polygons: DataFrame, factor: float = 1e-8) -> DataFrame:
    """Polygons whose corners p that lie on the line of their neighbours are dropped; one that would keep fewer than three stays as it is."""
    p = F.col("p")
    along = {c: F.transform(p, _part(c)) for c in "xyz"}
    scale = F.greatest(*(F.array_max(v) - F.array_min(v) for v in along.values()))

    def bend(i: Column) -> Column:
        three = F.struct(*(F.get(p, F.pmod(i + k, F.size(p))).alias(n) for k, n in ((-1, "a"), (0, "b"), (1, "c"))))
        a, b, c = (lambda t, n=n: tuple(t[n][k] for k in "xyz") for n in "abc")
        steps = once(three, lambda t: F.struct(*(v.alias(f"{n}{k}") for n, step in (("u", minus(b(t), a(t))), ("w", minus(c(t), b(t)))) for k, v in zip("xyz", step, strict=True))))
        turn = once(steps, lambda s: F.struct(*(v.alias(k) for k, v in zip("xyz", cross(tuple(s[f"u{k}"] for k in "xyz"), tuple(s[f"w{k}"] for k in "xyz")), strict=True))))
        return once(turn, lambda v: norm((v["x"], v["y"], v["z"])))

    kept = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: bend(i) > factor * F.col("__scale") * F.col("__scale"))
    clean = once(kept, lambda k: F.when(F.size(k) >= 3, F.transform(k, lambda i: F.get(p, i))).otherwise(p))
    return polygons.withColumn("__scale", scale).withColumn("p", clean).drop("__scale")


def polygon_edges(polygons: DataFrame, key: str) -> DataFrame:
    """key, seq, length of all sides, the last back to the first corner."""
    sides = F.transform(F.sequence(F.lit(0), F.size("p") - 1), lambda i: norm(minus(_at(F.col("p"), i + 1), _at(F.col("p"), i))))
    return polygons.select(key, F.posexplode(sides).alias("seq", "length"))


def plane_buckets(polygons: DataFrame, by: Sequence[str], digits: int = 6) -> DataFrame:
    """Polygons by `by` and plane: n, area, and the plane as its normal (first part that isn't 0 is positive) and offset, rounded."""
    v = area_vector(F.col("p"))
    rows = polygons.withColumns({"__x": v[0], "__y": v[1], "__z": v[2]}).withColumn("__l", norm((F.col("__x"), F.col("__y"), F.col("__z"))))
    sign = F.when(F.abs("__x") > 1e-9 * F.col("__l"), F.signum("__x")).when(F.abs("__y") > 1e-9 * F.col("__l"), F.signum("__y")).otherwise(F.signum("__z"))
    rows = rows.withColumns({f"n{c}": F.round(sign * F.col(f"__{c}") / F.when(F.col("__l") > 0, F.col("__l")), digits) + 0.0 for c in "xyz"})
    first = _at(F.col("p"), F.lit(0))
    offset = F.round(F.col("nx") * first[0] + F.col("ny") * first[1] + F.col("nz") * first[2], digits) + 0.0
    # polygons without an area have no plane and go as a group: a condition on rows would be pushed below their area, which would be worked out many times over
    return rows.withColumn("offset", offset).groupBy(*by, "nx", "ny", "nz", "offset").agg(F.count("*").alias("n"), F.sum("__l").alias("area")).where("area > 0")


def face_flags(cells: DataFrame) -> DataFrame:
    """cell_id, side, horizontal, floor, roof, wall and the face's middle x, y, z."""
    mid = {c: (F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in "xyz"}
    out = []
    for c in "xyz":
        for i in "01":
            at = [(F.col(c + i) if k == c else mid[k]).alias(k) for k in "xyz"]
            out.append(F.struct(F.lit(c + i).alias("side"), F.lit(c == "z").alias("horizontal"), F.lit(c + i == "z0").alias("floor"), F.lit(c + i == "z1").alias("roof"), F.lit(c != "z").alias("wall"), *at))
    return cells.select("cell_id", F.explode(F.array(*out)).alias("f")).select("cell_id", "f.*")


def in_plane(faces: DataFrame, point: Sequence[float], normal: Sequence[float], tol: float = 1e-6) -> DataFrame:
    """Faces whose middle lies in the plane through a point and whose normal is its normal, either way round."""
    away = sum((normal[i] * (F.col(c) - point[i]) for i, c in enumerate("xyz") if i), normal[0] * (F.col("x") - point[0]))
    length = math.sqrt(sum(n * n for n in normal))
    axis = max(range(3), key=lambda i: abs(normal[i]))
    return faces.where((F.abs(away) / length <= tol) & F.col("side").startswith("xyz"[axis]))


def wall_groups(faces: DataFrame, digits: int = 6) -> DataFrame:
    """axis, level, n: walls of one plane, whichever way they face."""
    axis = F.substring("side", 1, 1)
    level = F.round(F.when(axis == "x", F.col("x")).otherwise(F.col("y")), digits)
    return faces.where("wall").groupBy(axis.alias("axis"), level.alias("level")).agg(F.count("*").alias("n"))


#: So many cells a task at most before they become 24 edges each.
CELLS_A_TASK = 50_000


def face_edges(cells: DataFrame) -> DataFrame:
    """cell_id, side and the middles (x, y, z) of each face's four edges. Cells are dealt anew first: a small file of many cells is one task, which would hold all their edges."""
    dealt = cells.repartition(max(1, -(-cells.count() // CELLS_A_TASK)), "cell_id")
    faces = cell_faces(dealt).select("cell_id", "side", "key")
    low, high = {c: F.col("key")[i] for i, c in enumerate("xyz")}, {c: F.col("key")[i + 3] for i, c in enumerate("xyz")}
    out = []
    for free in "xyz":
        for fixed in ("low", "high"):
            # the edge along `free`: the middle there, and each end of the other direction of the face
            ends = low if fixed == "low" else high
            out.append(F.struct(F.lit(free).alias("along"), *(((low[c] + high[c]) / 2 if c == free else ends[c]).alias(c) for c in "xyz")))
    rows = faces.select("cell_id", "side", F.explode(F.array(*out)).alias("e")).select("cell_id", "side", "e.*")
    return rows.where(F.col("along") != F.substring("side", 1, 1))


def edge_use(edges: DataFrame) -> DataFrame:
    """x, y, z, n_faces, n_cells, outer (all its faces are of one cell) of edges by their middle, with the first cell and side in order."""
    first = F.min(F.struct("cell_id", "side"))
    out = edges.groupBy("x", "y", "z").agg(F.count("*").alias("n_faces"), F.count_distinct("cell_id").alias("n_cells"), first.alias("f"))
    return out.select("x", "y", "z", "n_faces", "n_cells", (F.col("n_cells") == 1).alias("outer"), F.col("f.cell_id").alias("cell_id"), F.col("f.side").alias("side"))


def coplanar_neighbours(cells: DataFrame) -> DataFrame:
    """a, b, side: faces of one side kind and plane, of two cells a < b, that meet at an edge."""
    edges = face_edges(cells).withColumns({"axis": F.substring("side", 1, 1)})
    level = F.when(F.col("axis") == "x", F.col("x")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("z"))
    rows = edges.withColumn("level", level).select("cell_id", "axis", "side", "level", "x", "y", "z")
    other = rows.select(F.col("cell_id").alias("b"), F.col("side").alias("side_b"), "axis", "level", "x", "y", "z")
    return exploded(rows.withColumnRenamed("cell_id", "a")).join(other, ["axis", "level", "x", "y", "z"]).where("a < b and side = side_b").select("a", "b", "side").distinct()


def coincident_cells(cells: DataFrame, digits: int = 6) -> DataFrame:
    """cell_id, kept, unique_name: of cells with one rounded middle that of the highest priority stays, the first of equal ones; equal names get _n in order of ids."""
    middle = [F.round((F.col(f"{c}0") + F.col(f"{c}1")) / 2, digits) for c in "xyz"]
    rank = F.row_number().over(Window.partitionBy(*middle).orderBy(F.desc("priority"), "cell_id"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("cell_id")) - 1
    return cells.select("cell_id", (rank == 1).alias("kept"), F.when(n == 0, F.col("name")).otherwise(F.concat_ws("_", "name", n.cast("string"))).alias("unique_name"))


def face_numbers(faces: DataFrame, digits: int = 6) -> DataFrame:
    """Adds number: the place (from 0) of a face in its cell by side and rounded middle."""
    order = [F.col("side"), *(F.round(c, digits) for c in "xyz")]
    return faces.withColumn("number", F.row_number().over(Window.partitionBy("cell_id").orderBy(*order)) - 1)


def in_oriented_box(nodes: DataFrame, centre: Sequence[float], degrees: float, half: Sequence[float]) -> DataFrame:
    """Nodes in a box turned about the upright axis through its centre."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    dx, dy, dz = (F.col(k) - v for k, v in zip("xyz", centre, strict=True))
    u, v = dx * c + dy * s, dy * c - dx * s
    return nodes.where((F.abs(u) <= half[0]) & (F.abs(v) <= half[1]) & (F.abs(dz) <= half[2]))


#: Length units in metres.
UNITS = {"m": 1.0, "mm": 0.001}


def moved(nodes: DataFrame, shift: Sequence[float] = (0, 0, 0), degrees: float = 0.0, scale: float = 1.0, units: tuple[str, str] = ("m", "m"), digits: int | None = None) -> DataFrame:
    """Nodes turned about the upright axis, shifted, scaled, changed from one unit to another and rounded half to even, in this order."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    factor = scale * UNITS[units[0]] / UNITS[units[1]]
    at = {"x": F.col("x") * c - F.col("y") * s + shift[0], "y": F.col("x") * s + F.col("y") * c + shift[1], "z": F.col("z") + shift[2]}
    at = {k: v * factor for k, v in at.items()}
    return nodes.withColumns({k: F.bround(v, digits) if digits is not None else v for k, v in at.items()})


def by_distance(nodes: DataFrame, point: Sequence[float], limit: int) -> DataFrame:
    """The `limit` nodes nearest a point, nearest first, with distance."""
    away = F.sqrt(sum(((F.col(c) - v) ** 2 for c, v in list(zip("xyz", point, strict=True))[1:]), (F.col("x") - point[0]) ** 2))
    return nodes.withColumn("distance", away).orderBy("distance", "node_id").limit(limit)
