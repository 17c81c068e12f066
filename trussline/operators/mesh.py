"""Nodes, elements and sets as tables: select, resolve, merge, renumber, check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.functions.geometry import cell, neighbours, norm
from trussline.operators.graph import checkpointed, components, dealt

POINT_TOL = 1e-4


def in_box(nodes: DataFrame, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
    """Nodes in an inclusive box."""
    for c, a, b in zip("xyz", lo, hi, strict=True):
        nodes = nodes.where(F.col(c).between(a, b))
    return nodes


def at_point(nodes: DataFrame, p: Sequence[float], tol: float = POINT_TOL) -> DataFrame:
    return in_box(nodes, [v - tol for v in p], [v + tol for v in p])


def in_cylinder(nodes: DataFrame, p: Sequence[float], r: float, h: float, t: float | None = None, tol: float = POINT_TOL) -> DataFrame:
    """Nodes in an upright cylinder of radius r and height h on p; with t (not r) those of the ring between r and r + t.

    The box of r, widened by tol, is selected first, also for a ring: only its part inside that box counts.
    """
    near = in_box(nodes, (p[0] - r - tol, p[1] - r - tol, p[2] - tol), (p[0] + r + tol, p[1] + r + tol, p[2] + h + tol))
    away = F.sqrt((F.col("x") - p[0]) ** 2 + (F.col("y") - p[1]) ** 2)
    if t is None or t == r:
        return near.where(away <= r)
    return near.where((away <= r + t) & (away > r))


def node_list(elements: DataFrame) -> Column:
    """The nodes of each element, in order: column nodes where there is one, else n1, n2, ... without the nulls at its end."""
    return F.col("nodes") if "nodes" in elements.columns else F.array_compact(F.array(*sorted((c for c in elements.columns if c[0] == "n" and c[1:].isdigit()), key=lambda c: int(c[1:]))))


def corners(elements: DataFrame) -> DataFrame:
    """elem_id, seq, node_id: one row a corner, in order, for elements of any number of nodes; nulls are none."""
    return elements.select("elem_id", F.posexplode(node_list(elements)).alias("seq", "node_id")).where("node_id is not null")


def side_list(nodes: Column) -> Column:
    """Sides (a < b) of closed polygons; a line of two nodes has one side, a point none."""
    n = F.size(nodes)
    last = F.when(n > 2, n).otherwise(n - 1)
    index = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))

    def side(i: Column) -> Column:
        p, q = F.get(nodes, i), F.get(nodes, (i + 1) % n)
        return F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))

    return F.transform(index, side)


def incidence(elements: DataFrame) -> DataFrame:
    """node_id, degree: corners at each node, a doubled corner counted twice."""
    return corners(elements).groupBy("node_id").agg(F.count("*").alias("degree"))


def standalone(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Nodes of no element. Corners come from an explode, whose rows Spark doesn't count: a merge join, as they would be broadcast whole, over tasks dealt by their number."""
    used = corners(elements).select("node_id")
    return nodes.join(dealt(used, used.count(), "node_id").hint("merge"), "node_id", "left_anti")


def unknown_corners(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Corners whose node is not there: an error of the model."""
    return corners(elements).join(nodes.select("node_id"), "node_id", "left_anti")


def placed(nodes: DataFrame, elements: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """elements (their columns in `keep`, or all) with p, the array of their nodes' (x, y, z) in order. Corners are shuffled bare, once by node and once by element, where they meet one row of the element's columns."""
    rest = [c for c in elements.columns if c != "elem_id" and (keep is None or c in keep)]
    # corners come from an explode, whose rows Spark doesn't count: a merge join, no broadcast of them
    at = corners(elements).hint("merge").join(nodes.select("node_id", "x", "y", "z"), "node_id").select("elem_id", F.struct("seq", "x", "y", "z").alias("q"), F.lit(None).alias("e"))
    own = elements.select("elem_id", F.lit(None).alias("q"), F.struct(*rest, F.size(node_list(elements)).alias("__n")).alias("e"))
    # raw rows are shuffled: a corner's own array in a partial grouping would be larger
    met = at.union(own).repartition("elem_id").groupBy("elem_id").agg(F.any_value("e", True).alias("e"), F.sort_array(F.collect_list("q")).alias("p"))
    return met.where((F.size("p") == F.col("e.__n")) & (F.size("p") > 0)).select("elem_id", *(F.col(f"e.{c}").alias(c) for c in rest), "p")


def area_vector(p: Column) -> tuple[Column, Column, Column]:
    """Half the sum of the cross products of neighbouring corners: its length is a flat polygon's area, its direction the normal."""

    def part(u: str, v: str) -> Column:
        def add(total: Column, i: Column) -> Column:
            a, b = F.get(p, i), F.get(p, (i + 1) % F.size(p))
            return total + (a[u] * b[v] - a[v] * b[u])

        return F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0.0), add) / 2

    return part("y", "z"), part("z", "x"), part("x", "y")


def middle(p: Column, c: str) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda total, q: total + q[c]) / F.size(p)


def with_coordinates(nodes: DataFrame, elements: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """elements (their columns in `keep`, or all) with ax..dz, the coordinates of the first four corners; a triangle's third corner stands in for the fourth."""
    at = placed(nodes, elements, keep).where(F.size("p") >= 3)
    corner = {k: F.coalesce(F.get("p", F.lit(i)), F.get("p", F.lit(2))) for i, k in enumerate("abcd")}
    return at.select(*(c for c in at.columns if c != "p"), *(corner[k][c].alias(f"{k}{c}") for k in "abcd" for c in "xyz"))


def weighed(nodes: DataFrame, elements: DataFrame, density: float = 7850.0) -> DataFrame:
    """elem_id, family, mass, x, y, z: shells by area and thickness, lines by length and section area a, point masses as given (solids, by elem_type, have none); the middle of the corners.

    Columns thickness, a and point_mass are used where elements have them; an element without its own has no mass (null).
    """
    have = {c: F.col(c) if c in elements.columns else F.lit(None).cast("double") for c in ("thickness", "a", "point_mass")}
    at = placed(nodes, elements, ("thickness", "a", "point_mass", "elem_type"))
    at = at.withColumns({f"__{c}": v for c, v in zip("xyz", area_vector(F.col("p")), strict=True)})
    p, n = F.col("p"), F.size("p")
    length = F.sqrt(sum(((F.get(p, F.lit(1))[c] - F.get(p, F.lit(0))[c]) ** 2 for c in "yz"), (F.get(p, F.lit(1))["x"] - F.get(p, F.lit(0))["x"]) ** 2))
    shell = norm((F.col("__x"), F.col("__y"), F.col("__z")))
    solid = F.col("elem_type").startswith("C3D") if "elem_type" in elements.columns else F.lit(False)
    family = F.when(solid, "solid").when(n >= 3, "shell").when(n == 2, "line").otherwise("point")
    mass = F.when(solid, None).when(n >= 3, shell * have["thickness"] * density).when(n == 2, length * have["a"] * density).otherwise(have["point_mass"])
    return at.select("elem_id", family.alias("family"), mass.alias("mass"), *(middle(p, c).alias(c) for c in "xyz"))


def centre(rows: DataFrame, *by: str) -> DataFrame:
    """Mass and centre of weighed rows; zero mass has no centre."""
    total = F.sum("mass")
    return rows.groupBy(*by).agg(total.alias("mass"), *(F.when(total > 0, F.sum(F.col("mass") * F.col(c)) / total).alias(f"cog_{c}") for c in "xyz"))


def centre_of_gravity(nodes: DataFrame, elements: DataFrame, density: float = 7850.0) -> DataFrame:
    """One row: mass and centre of all elements of a model."""
    return centre(weighed(nodes, elements, density))


def coincident_pairs(nodes: DataFrame, tol: float = POINT_TOL) -> DataFrame:
    """Pairs a < b of nodes at most tol apart along each axis. Cells are 64 tolerances wide; one side stands in its own cell, the other also in those that lie within tol of it, which are hardly ever more than one."""
    size = 64 * tol
    keyed = nodes.select("node_id", "x", "y", "z", *(cell(F.col(c), size).alias(f"c{c}") for c in "xyz"))
    wide = nodes.select(F.col("node_id").alias("b"), *(F.col(c).alias(f"b{c}") for c in "xyz"))
    for c in "xyz":
        wide = wide.withColumn(f"c{c}", F.explode(F.sequence(cell(F.col(f"b{c}") - 1.000001 * tol, size), cell(F.col(f"b{c}") + 1.000001 * tol, size))))
    near = keyed.withColumnRenamed("node_id", "a").join(wide, ["cx", "cy", "cz"]).where("a < b")
    for c in "xyz":
        near = near.where(F.abs(F.col(c) - F.col(f"b{c}")) <= tol)
    return near.select("a", "b")


def merge_coincident(nodes: DataFrame, elements: DataFrame, tol: float = POINT_TOL) -> DataFrame:
    """node_id, survivor: of nodes linked by coincidence the one in most elements, then the smallest id, stays.

    Chains count as one group, so the outcome does not hang on an order of visits. Only nodes that have a twin go through the rounds.
    """
    pairs = checkpointed(coincident_pairs(nodes, tol))
    twins = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = checkpointed(components(twins, pairs))
    degrees = corners(elements).join(labels.select(F.col("node").alias("node_id")), "node_id", "left_semi").groupBy(F.col("node_id").alias("node")).agg(F.count("*").alias("degree"))
    refs = labels.join(degrees, "node", "left").withColumn("refs", F.coalesce("degree", F.lit(0)))
    best = refs.groupBy("label").agg(F.max(F.struct("refs", (-F.col("node")).alias("minus"))).alias("best"))
    moved = labels.join(best, "label").select(F.col("node").alias("node_id"), (-F.col("best.minus")).alias("survivor"))
    return nodes.select("node_id").join(moved, "node_id", "left").select("node_id", F.coalesce("survivor", "node_id").alias("survivor"))


def insert_nodes(existing: DataFrame, new: DataFrame, tol: float = POINT_TOL) -> DataFrame:
    """new.node_id, found: the smallest existing node less than tol away, or null."""
    left = new.select(F.col("node_id").alias("new_id"), *(F.col(c).alias(f"n{c}") for c in "xyz"), *(cell(F.col(c), tol).alias(f"c{c}") for c in "xyz"))
    probe = left
    for c in ("cx", "cy", "cz"):
        probe = probe.withColumn(c, F.explode(neighbours(F.col(c))))
    held = existing.select("node_id", "x", "y", "z", *(cell(F.col(c), tol).alias(f"c{c}") for c in "xyz"))
    away = sum(((F.col(c) - F.col(f"n{c}")) ** 2 for c in "yz"), (F.col("x") - F.col("nx")) ** 2)
    hits = probe.join(held, ["cx", "cy", "cz"]).where(F.sqrt(away) < tol).groupBy("new_id").agg(F.min("node_id").alias("found"))
    return left.select("new_id").join(hits, "new_id", "left").select(F.col("new_id").alias("node_id"), "found")


def renumber(rows: DataFrame, column: str, start: int = 1, blocks: int | None = None) -> DataFrame:
    """Adds new_id: start, start + 1, ... in the order of the integer `column`, which is unique.

    No row passes through one task: Spark cuts the ids into ranges of like size by a sample, each range counts its rows, and numbers them from its offset.
    """
    blocks = blocks or max(1, rows.count() // 100_000)
    ranged = checkpointed(rows.repartitionByRange(blocks, column).withColumn("__block", F.spark_partition_id()))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranged.groupBy("__block").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("__block").orderBy(column))
    return ranged.join(offsets, "__block").withColumn("new_id", F.col("offset") + within + F.lit(start - 1)).drop("__block", "offset")


def concat_offsets(parts: DataFrame) -> DataFrame:
    """parts (part, node_id): part and the offset that its ids get: the sum of all earlier parts' greatest id + 1."""
    top = parts.groupBy("part").agg((F.max("node_id") + 1).alias("span"))
    return top.select("part", F.coalesce(F.sum("span").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("offset"))


def offsets_by_kind(ids: DataFrame) -> DataFrame:
    """ids (part, kind, id): the offset of each part's ids of a kind (nodes, elements, sections, materials): the sum of earlier parts' greatest id + 1."""
    top = ids.groupBy("kind", "part").agg((F.max("id") + 1).alias("span"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    return top.select("part", "kind", F.coalesce(F.sum("span").over(before), F.lit(0)).cast("long").alias("offset"))


def concatenated_sets(members: DataFrame, offsets: DataFrame) -> DataFrame:
    """Set members (part, set_name, member_id) of all parts in one mesh: names with the part before them, ids with the part's offset."""
    rows = members.join(offsets.select("part", "offset"), "part")
    return rows.select(F.concat_ws("_", "part", "set_name").alias("set_name"), (F.col("member_id") + F.col("offset")).cast("long").alias("member_id"))


def hanging_nodes(nodes: DataFrame, elements: DataFrame, tol: float = POINT_TOL, size: float = 1.0) -> DataFrame:
    """node_id, a, b: nodes strictly inside an element edge a-b and not its ends. Edges look into the cells they cover."""
    pairs = side_list(node_list(elements))
    edges = elements.select(F.explode(pairs).alias("e")).select("e.a", "e.b").distinct()
    for k in "ab":
        edges = edges.join(nodes.select(F.col("node_id").alias(k), *(F.col(c).alias(f"{k}{c}") for c in "xyz")), k)
    for c in "xyz":
        lo, hi = F.least(f"a{c}", f"b{c}") - tol, F.greatest(f"a{c}", f"b{c}") + tol
        edges = edges.withColumn(f"c{c}", F.explode(F.sequence(cell(lo, size), cell(hi, size))))
    hit = edges.join(nodes.select("node_id", "x", "y", "z", *(cell(F.col(c), size).alias(f"c{c}") for c in "xyz")), ["cx", "cy", "cz"]).where("node_id <> a and node_id <> b")
    along = sum(((F.col(c) - F.col(f"a{c}")) * (F.col(f"b{c}") - F.col(f"a{c}")) for c in "yz"), (F.col("x") - F.col("ax")) * (F.col("bx") - F.col("ax")))
    length2 = sum(((F.col(f"b{c}") - F.col(f"a{c}")) ** 2 for c in "yz"), (F.col("bx") - F.col("ax")) ** 2)
    hit = hit.withColumn("s", along / length2).where((F.col("s") > 1e-6) & (F.col("s") < 1 - 1e-6))
    off2 = sum(((F.col(c) - F.col(f"a{c}") - F.col("s") * (F.col(f"b{c}") - F.col(f"a{c}"))) ** 2 for c in "yz"), (F.col("x") - F.col("ax") - F.col("s") * (F.col("bx") - F.col("ax"))) ** 2)
    return hit.where(F.sqrt(off2) <= tol).select("node_id", "a", "b").distinct()


def boundary_edges(elements: DataFrame) -> DataFrame:
    """a, b of edges that one element alone has."""
    pairs = side_list(node_list(elements))
    return elements.select(F.explode(pairs).alias("e")).groupBy("e.a", "e.b").agg(F.count("*").alias("n")).where("n = 1").select("a", "b")


def edge_components(elements: DataFrame, by: Sequence[str]) -> DataFrame:
    """elem_id, label: elements joined over shared edges within equal values of `by`."""
    pairs = side_list(node_list(elements))
    edges = elements.select("elem_id", *by, F.explode(pairs).alias("e"))
    first = edges.groupBy("e", *by).agg(F.min("elem_id").alias("a"))
    links = edges.join(first, ["e", *by]).select("a", F.col("elem_id").alias("b")).where("a <> b")
    return components(elements.select(F.col("elem_id").alias("node")), links).select(F.col("node").alias("elem_id"), "label")
