"""Elements of any kind and number of nodes: families, removal, numbering, sides and faces, surfaces, axes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.geometry import cross, minus, norm
from trussline.operators.mesh import corners, node_list, renumber, side_list

#: Element types of each family.
FAMILIES = {"line": ("B31", "B32", "B33"), "shell": ("S3", "S4", "S4R", "S6", "S8", "S8R"), "solid": ("C3D4", "C3D8", "C3D10", "C3D20"), "mass": ("MASS",), "connector": ("CONN3D2",)}
#: Corners of the faces of solids, numbered from 1.
FACES = {4: ((1, 2, 3), (1, 4, 2), (2, 4, 3), (3, 4, 1)), 8: ((1, 2, 3, 4), (5, 8, 7, 6), (1, 5, 6, 2), (2, 6, 7, 3), (3, 7, 8, 4), (4, 8, 5, 1))}


def family(elem_type: Column) -> Column:
    out = None
    for name, kinds in FAMILIES.items():
        out = F.when(elem_type.isin(*kinds), name) if out is None else out.when(elem_type.isin(*kinds), name)
    return out.otherwise("other")


def of_family(elements: DataFrame, *names: str) -> DataFrame:
    """Elements of some families; 'structural' are lines, shells and solids."""
    wanted = [n for name in names for n in (("line", "shell", "solid") if name == "structural" else (name,))]
    return elements.where(family(F.col("elem_type")).isin(*wanted))


def removed(elements: DataFrame, members: DataFrame, start: int = 1) -> DataFrame:
    """elements without those of members.elem_id, numbered anew from `start` in the order of their ids: new_id."""
    return renumber(elements.join(members.select("elem_id"), "elem_id", "left_anti"), "elem_id", start)


def renumber_by_block(elements: DataFrame, start: int = 1) -> DataFrame:
    """Adds new_id: block by block of one element type, in the order of types, then of ids.

    Ids are numbered within types by ranges; types' offsets are a small table.
    """
    kinds = elements.groupBy("elem_type").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("elem_type").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a type
    offsets = kinds.select("elem_type", offset.alias("offset"))
    # within a type: rows before it among all, less those of other types, by ranges of all ids
    blocks = max(1, elements.count() // 100_000)
    from trussline.operators.graph import checkpointed

    ranged = checkpointed(elements.repartitionByRange(blocks, "elem_id").withColumn("__block", F.spark_partition_id()))
    before = Window.partitionBy("elem_type").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("elem_type", "__block").agg(F.count("*").alias("m")).withColumn("earlier", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    rank = F.row_number().over(Window.partitionBy("elem_type", "__block").orderBy("elem_id"))
    numbered = ranged.withColumn("__rank", rank).join(counts, ["elem_type", "__block"]).join(offsets, "elem_type")
    return numbered.withColumn("new_id", F.col("offset") + F.col("earlier") + F.col("__rank") + F.lit(start - 1)).drop("__block", "__rank", "offset", "earlier")


def renumber_by_map(elements: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements with new_id by mapping (elem_id, new_id), masses left out, and the elements that the mapping lacks: an error of the caller's."""
    rest = elements.where(family(F.col("elem_type")) != "mass")
    return rest.join(mapping.select("elem_id", "new_id"), "elem_id"), rest.join(mapping.select("elem_id"), "elem_id", "left_anti")


def face_list(nodes: Column) -> Column:
    """Faces as arrays of nodes with their number from 1: of solids by pattern, of a shell itself."""
    out = F.array(F.struct(F.lit(1).alias("number"), nodes.alias("nodes")))
    for n, pattern in FACES.items():
        faces = F.array(*(F.struct(F.lit(i + 1).alias("number"), F.array(*(F.get(nodes, F.lit(k - 1)) for k in face)).alias("nodes")) for i, face in enumerate(pattern)))
        out = F.when((F.size(nodes) == n) & F.col("elem_type").startswith("C3D"), faces).otherwise(out)
    return out


def unique_edges(elements: DataFrame) -> DataFrame:
    """a, b: all element sides, once; solids by the sides of their faces, masses have none."""
    stiff = of_family(elements, "structural", "connector")
    faces = stiff.select(F.when(F.col("elem_type").startswith("C3D"), F.transform(face_list(node_list(elements)), lambda f: f["nodes"])).otherwise(F.array(node_list(elements))).alias("f"))
    return faces.select(F.explode("f").alias("f")).select(F.explode(side_list(F.col("f"))).alias("s")).select("s.a", "s.b").distinct()


def triangles(elements: DataFrame) -> DataFrame:
    """elem_id, face, tri, v0, v1, v2: faces of shells and solids cut into triangles from their first corner; lines, connectors and masses have none."""
    faces = of_family(elements, "shell", "solid").select("elem_id", F.explode(face_list(node_list(elements))).alias("f")).select("elem_id", F.col("f.number").alias("face"), F.col("f.nodes").alias("n"))
    cut = faces.where(F.size("n") >= 3).select("elem_id", "face", "n", F.explode(F.sequence(F.lit(1), F.size("n") - 2)).alias("tri"))
    return cut.select("elem_id", "face", "tri", F.get("n", F.lit(0)).alias("v0"), F.get("n", F.col("tri")).alias("v1"), F.get("n", F.col("tri") + 1).alias("v2"))


def surface(elements: DataFrame, node_set: DataFrame) -> DataFrame:
    """elem_id, face: of each element the first face all of whose nodes are in node_set.node_id; a shell's is 1."""
    faces = of_family(elements, "shell", "solid").select("elem_id", F.explode(face_list(node_list(elements))).alias("f")).select("elem_id", "f.number", F.explode("f.nodes").alias("node_id"), F.size("f.nodes").alias("size"))
    held = faces.join(node_set.select("node_id").distinct(), "node_id", "left_semi")
    whole = held.groupBy("elem_id", "number", "size").agg(F.count("*").alias("n")).where("n = size")
    return whole.groupBy("elem_id").agg(F.min("number").alias("face"))


def shell_axes(placed: DataFrame) -> DataFrame:
    """elem_id, ok and the local axes of flat shells from their corners p: x along the first side, z the normal, y across. Degenerate ones are not ok and have none."""
    p = F.col("p")
    a, b, c = ((F.get(p, F.lit(i))["x"], F.get(p, F.lit(i))["y"], F.get(p, F.lit(i))["z"]) for i in (0, 1, 2))
    along, other = minus(b, a), minus(c, a)
    out = placed.where(F.size("p") >= 3).select("elem_id", *(v.alias(f"u{k}") for k, v in zip("xyz", along, strict=True)), *(v.alias(f"w{k}") for k, v in zip("xyz", other, strict=True)))
    u, w = ((F.col(f"{k}x"), F.col(f"{k}y"), F.col(f"{k}z")) for k in "uw")
    out = out.withColumns({f"n{k}": v for k, v in zip("xyz", cross(u, w), strict=True)})
    n = (F.col("nx"), F.col("ny"), F.col("nz"))
    out = out.withColumns({"lu": norm(u), "ln": norm(n)}).withColumn("ok", (F.col("lu") > 1e-12) & (F.col("ln") > 1e-12))
    x = tuple(F.when(F.col("ok"), v / F.col("lu")) for v in u)
    z = tuple(F.when(F.col("ok"), v / F.col("ln")) for v in n)
    out = out.withColumns({f"x{k}": v for k, v in zip("xyz", x, strict=True)} | {f"z{k}": v for k, v in zip("xyz", z, strict=True)})
    y = cross((F.col("zx"), F.col("zy"), F.col("zz")), (F.col("xx"), F.col("xy"), F.col("xz")))
    return out.select("elem_id", "ok", "xx", "xy", "xz", *(v.alias(f"y{k}") for k, v in zip("xyz", y, strict=True)), "zx", "zy", "zz")


def flat_parts(placed: DataFrame) -> DataFrame:
    """elem_id, part, corners: a quad whose fourth corner lies exactly in the plane of the others is one part, else two triangles."""
    p = F.col("p")
    a, b, c, d = ((F.get(p, F.lit(i))["x"], F.get(p, F.lit(i))["y"], F.get(p, F.lit(i))["z"]) for i in range(4))
    n = cross(minus(b, a), minus(c, a))
    off = minus(d, a)
    flat = n[0] * off[0] + n[1] * off[1] + n[2] * off[2] == 0
    quads = placed.where(F.size("p") == 4)
    parts = F.when(flat, F.array(F.lit(4))).otherwise(F.array(F.lit(3), F.lit(3)))
    return quads.select("elem_id", F.posexplode(parts).alias("part", "corners"))


def sets_merged(members: DataFrame, names: Sequence[str] = ("set_name",)) -> DataFrame:
    """Sets of equal name as one: each member once."""
    return members.select(*names, "member_id").distinct()


def ranged_members(ranges: DataFrame) -> DataFrame:
    """Members of sets given as first, last and step."""
    return ranges.select("set_name", F.explode(F.sequence("first", "last", "step")).alias("member_id"))


def node_users(elements: DataFrame) -> DataFrame:
    """node_id and its elements in order."""
    return corners(elements).groupBy("node_id").agg(F.sort_array(F.collect_set("elem_id")).alias("elements"))
