"""Chains of beams, smooth patches of shells, and shared faces of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.geometry import cross, dot, minus, norm, point
from trussline.operators.graph import components
from trussline.operators.mesh import node_list, side_list, with_coordinates


def beam_chains(beams: DataFrame, digits: int = 6, angle: float = 1e-4) -> DataFrame:
    """beam_id, chain: straight runs of beams of one section that meet two by two at their ends, named by their smallest beam.

    beams: beam_id, section, x1..z2. Two beams join at a point where no third of the section ends and where they go on in opposite directions.
    A chain without two open ends (a closed one can't be straight) can't arise from such joints.
    """
    ends = [F.struct(*(F.round(F.col(f"{c}{i}"), digits).alias(c) for c in "xyz"), *((F.col(f"{c}{j}") - F.col(f"{c}{i}")).alias(f"d{c}") for c in "xyz")) for i, j in ((1, 2), (2, 1))]
    at = beams.select("beam_id", "section", F.explode(F.array(*ends)).alias("e")).select("beam_id", "section", "e.*")
    # at most two ends of a point are kept beside their count, so a crowded point is no large group
    heading = F.struct("beam_id", "dx", "dy", "dz")
    meets = at.groupBy("section", "x", "y", "z").agg(F.count("*").alias("n"), F.min(heading).alias("p"), F.max(heading).alias("q")).where("n = 2 and p.beam_id <> q.beam_id")
    u, v = (point(f"{k}.dx", f"{k}.dy", f"{k}.dz") for k in "pq")
    straight = (norm(cross(u, v)) < angle * norm(u) * norm(v)) & (dot(u, v) < 0)
    links = meets.where(straight).select(F.col("p.beam_id").alias("a"), F.col("q.beam_id").alias("b"))
    return components(beams.select(F.col("beam_id").alias("node")), links).select(F.col("node").alias("beam_id"), F.col("label").alias("chain"))


def smooth_patches(nodes: DataFrame, elements: DataFrame, by: list[str], degrees: float = 30.0) -> DataFrame:
    """elem_id, label: shells joined over edges that exactly two of their kind share and that bend by at most `degrees`; elsewhere patches end.

    The sign of normals doesn't count. An edge of more than two shells joins none.
    """
    placed = with_coordinates(nodes, elements, [*by, *(c for c in elements.columns if c == "nodes" or c[0] == "n" and c[1:].isdigit())])
    normal = cross(minus(point("cx", "cy", "cz"), point("ax", "ay", "az")), minus(point("dx", "dy", "dz"), point("bx", "by", "bz")))
    placed = placed.withColumns({f"n{c}": normal[i] for i, c in enumerate("xyz")})
    pairs = side_list(node_list(elements))
    sides = placed.select("elem_id", *by, "nx", "ny", "nz", F.explode(pairs).alias("edge"))
    heading = F.struct("elem_id", "nx", "ny", "nz")
    shared = sides.groupBy("edge", *by).agg(F.count("*").alias("n"), F.min(heading).alias("p"), F.max(heading).alias("q")).where("n = 2 and p.elem_id <> q.elem_id")
    u, v = (point(f"{k}.nx", f"{k}.ny", f"{k}.nz") for k in "pq")
    flat = F.abs(dot(u, v)) >= math.cos(math.radians(degrees)) * norm(u) * norm(v)
    links = shared.where(flat).select(F.col("p.elem_id").alias("a"), F.col("q.elem_id").alias("b"))
    return components(elements.select(F.col("elem_id").alias("node")), links).select(F.col("node").alias("elem_id"), "label")


def patch_report(labels: DataFrame, elements: DataFrame, by: list[str]) -> DataFrame:
    """By `by`: n_elements, n_patches, n_single, largest and reduction, the elements that one of a patch stands for."""
    sizes = labels.join(elements.select("elem_id", *by), "elem_id").groupBy(*by, "label").agg(F.count("*").alias("size"))
    out = sizes.groupBy(*by).agg(F.sum("size").alias("n_elements"), F.count("*").alias("n_patches"), F.count_if(F.col("size") == 1).alias("n_single"), F.max("size").alias("largest"))
    return out.withColumn("reduction", F.col("n_elements") / F.col("n_patches"))


def cell_faces(cells: DataFrame, digits: int = 6) -> DataFrame:
    """cells (cell_id, priority, cantilever, x0..z1) as six faces each: side (x0, x1, y0, y1, z0, z1), kind and key, the face's rounded corners."""

    def face(side: str) -> Column:
        c, i = side
        corners = [F.round(F.col(side if k == c else f"{k}{e}"), digits) for e in "01" for k in "xyz"]
        return F.struct(F.lit(side).alias("side"), F.lit("floor" if c == "z" else "wall").alias("kind"), F.array(*corners).alias("key"))

    return cells.select("cell_id", "priority", "cantilever", F.explode(F.array(*(face(c + i) for c in "xyz" for i in "01"))).alias("f")).select("cell_id", "priority", "cantilever", "f.*")


def shared_faces(cells: DataFrame) -> DataFrame:
    """Faces of cells with internal (seen in exactly two cells, neither a cantilever) and kept: all external ones and one of an internal pair.

    Of two walls that of the cell of higher priority stays, then of the smaller id; of two floors the upper side of the lower cell.
    """
    of_face = Window.partitionBy("key")
    faces = cell_faces(cells).withColumn("internal", (F.count("*").over(of_face) == 2) & ~F.bool_or("cantilever").over(of_face))
    order = [F.when(F.col("kind") == "floor", F.when(F.col("side") == "z1", 0).otherwise(1)).otherwise(-F.col("priority")), F.col("cell_id")]
    rank = F.row_number().over(of_face.orderBy(*order))
    return faces.withColumn("kept", ~F.col("internal") | (rank == 1)).select("cell_id", "side", "kind", "internal", "kept")
