"""Health of triangle meshes, one row a part: counts of what is broken, and a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trussline.functions.geometry import point, triangle_area
from trussline.operators.graph import checkpointed, dealt

#: Degenerate doubled area against the squared diagonal, sliver against the median, weld grid against the diagonal.
DEGENERATE, SLIVER, WELD = 1e-10, 1e-4, 1e-7
#: Shares of triangles and of edges beyond which a part fails.
DEGENERATE_FAILS, NONMANIFOLD_FAILS = 0.02, 0.01


def mesh_health(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """By part: n_verts, n_tris, nonfinite_verts, collapsed_tris, area, bbox_diag, degenerate_tris, sliver_tris, welded_verts, boundary_edges,
    nonmanifold_edges, watertight.

    vertices: part, vertex_id, x, y, z; triangles: part, tri_id, v0, v1, v2. Parts without a triangle have no row. Vertices are welded on a grid
    relative to the part's diagonal by their rounded coordinates, so no pairs of vertices are formed.
    """
    finite = ~(F.isnan("x") | F.isnan("y") | F.isnan("z")) & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")) & (F.abs("z") < float("inf"))
    spans = {c: F.max(F.when(finite, F.col(c))) - F.min(F.when(finite, F.col(c))) for c in "xyz"}
    diagonal = F.sqrt(spans["x"] * spans["x"] + spans["y"] * spans["y"] + spans["z"] * spans["z"])
    parts = vertices.groupBy("part").agg(F.count("*").alias("n_verts"), F.count_if(~finite).alias("nonfinite_verts"), F.coalesce(diagonal, F.lit(0.0)).alias("bbox_diag"))
    # written, so that Spark knows their size before it plans the joins on part: shuffled by part, a large part would be one task
    parts = checkpointed(parts)
    n_verts, n_corners = parts.agg(F.sum("n_verts")).first()[0] or 0, 3 * triangles.count()
    grid = {f"g{c}": F.when(F.col("bbox_diag") > 0, F.rint(F.col(c) / (F.col("bbox_diag") * WELD))).otherwise(F.col("vertex_id")).cast("long") for c in "xyz"}
    placed = vertices.join(parts.select("part", "bbox_diag"), "part").withColumns(grid).withColumn("weld", F.struct("gx", "gy", "gz"))
    welded = dealt(placed.select("part", "weld"), n_verts, "part", "weld").distinct().groupBy("part").agg(F.count("*").alias("welded_verts"))

    corners = triangles.select("part", "tri_id", F.posexplode(F.array("v0", "v1", "v2")).alias("seq", "vertex_id"))
    met = dealt(corners, n_corners, "part", "vertex_id").hint("merge").join(placed, ["part", "vertex_id"])
    sides = [F.max(F.when(F.col("seq") == i, F.struct("x", "y", "z", "weld", "vertex_id"))).alias(k) for i, k in enumerate("abc")]
    wide = dealt(met, n_corners, "part", "tri_id").groupBy("part", "tri_id").agg(*sides, F.first("bbox_diag").alias("bbox_diag"))
    a, b, c = (point(f"{k}.x", f"{k}.y", f"{k}.z") for k in "abc")

    def alike(field: str) -> Column:
        return (F.col(f"a.{field}") == F.col(f"b.{field}")) | (F.col(f"b.{field}") == F.col(f"c.{field}")) | (F.col(f"a.{field}") == F.col(f"c.{field}"))

    welds = [F.col(f"{k}.weld").alias(k) for k in "abc"]
    wide = checkpointed(wide.select("part", *welds, "bbox_diag", (2 * triangle_area(a, b, c)).alias("double_area"), alike("vertex_id").alias("collapsed"), alike("weld").alias("folded")))
    shapes = wide.groupBy("part").agg(
        F.count("*").alias("n_tris"), F.count_if("collapsed").alias("collapsed_tris"), (F.sum(F.when(~F.isnan("double_area"), F.col("double_area"))) / 2).alias("area"),
        F.count_if(F.col("double_area") <= F.col("bbox_diag") * F.col("bbox_diag") * DEGENERATE).alias("degenerate_tris"), F.expr("percentile(double_area, 0.5) filter (where double_area > 0 and not isnan(double_area))").alias("median"),
    )
    shapes = checkpointed(shapes)
    slivers = wide.select("part", "double_area").join(shapes.select("part", "median"), "part").groupBy("part").agg(F.count_if(F.col("double_area") <= F.col("median") * SLIVER).alias("sliver_tris"))

    def edge(p: str, q: str) -> Column:
        return F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))

    sides = wide.where(~F.col("folded")).select("part", F.explode(F.array(edge("a", "b"), edge("b", "c"), edge("c", "a"))).alias("e"))
    edges = dealt(sides, n_corners, "part", "e").groupBy("part", "e").agg(F.count("*").alias("n"))
    used = edges.groupBy("part").agg(F.count_if(F.col("n") == 1).alias("boundary_edges"), F.count_if(F.col("n") > 2).alias("nonmanifold_edges"), F.bool_and(F.col("n") == 2).alias("watertight"))
    out = shapes.drop("median").join(parts, "part").join(welded, "part").join(slivers, "part").join(used, "part", "left")
    return out.fillna(0, ["boundary_edges", "nonmanifold_edges"]).withColumn("watertight", F.coalesce("watertight", F.lit(False)))


def verdict(health: DataFrame) -> DataFrame:
    """Adds ok, problems and warnings (comma-joined names): a part fails on what is broken throughout, a few bad triangles only warn."""
    degenerate = F.round(F.col("degenerate_tris") / F.col("n_tris"), 4)
    crowded = F.col("nonmanifold_edges") > NONMANIFOLD_FAILS * 3 * F.col("n_tris")

    def named(pairs: list[tuple[Column, str]]) -> Column:
        return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in pairs))), ",")

    problems = named([(F.col("nonfinite_verts") > 0, "non-finite"), (F.coalesce("area", F.lit(0.0)) <= 0, "no area"), (degenerate > DEGENERATE_FAILS, "degenerate"), (crowded, "non-manifold")])
    few = [((F.col("degenerate_tris") > 0) & (degenerate <= DEGENERATE_FAILS), "degenerate"), ((F.col("nonmanifold_edges") > 0) & ~crowded, "non-manifold"), (F.col("sliver_tris") > 0, "slivers")]
    return health.withColumns({"problems": problems, "warnings": named(few)}).withColumn("ok", F.col("problems") == "")
