"""Models of several formats and origins: parity, matching by place, merged records, graphs of instances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trussline.operators.graph import checkpointed
from trussline.operators.spatial import points_in_boxes

#: How much smaller than the largest a format's extent may be, the least share of the median area, and the formats whose areas count.
EXTENT_SHARE, AREA_SHARE, CAD = 0.98, 0.34, ("step", "stp", "ifc", "xml")


def format_parity(measures: DataFrame) -> DataFrame:
    """measures (source_id, fmt, bbox, area, tris) with state and expected (triangles of the largest format of the source).

    state: empty (a CAD format without geometry: no mismatch), lost (another format without geometry while some format has it), bbox, area, bbox,area, or ok.
    """
    has = F.col("tris") > 0
    by = Window.partitionBy("source_id")
    cad = F.col("fmt").isin(*CAD)
    rows = measures.withColumns(
        {
            "__top": F.max(F.when(has, F.struct("bbox", F.expr("-ascii(fmt)"), "tris"))).over(by),
            "__mid": F.percentile(F.when(has & cad, F.col("area")), F.lit(0.5)).over(by),
        }
    )
    small = F.col("bbox") < EXTENT_SHARE * F.col("__top.bbox")
    thin = cad & (F.col("area") < AREA_SHARE * F.col("__mid"))
    state = F.when(~has & cad, "empty").when(~has, F.when(F.col("__top").isNotNull(), "lost").otherwise("empty"))
    state = state.when(small & thin, "bbox,area").when(small, "bbox").when(thin, "area").otherwise("ok")
    return rows.select("source_id", "fmt", state.alias("state"), F.coalesce(F.col("__top.tris"), F.lit(0)).alias("expected"))


def count_parity(counts: DataFrame, baseline: str, formats: Sequence[str]) -> DataFrame:
    """source_id, a column of counts for each format, and differs: the formats, comma-joined, whose count isn't the baseline's."""
    wide = counts.groupBy("source_id").pivot("fmt", list(formats)).agg(F.max("tris"))
    differs = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(baseline)), F.lit(f)) for f in formats if f != baseline))), ",")
    return wide.withColumn("differs", differs)


def match_by_centroid(a: DataFrame, b: DataFrame, size: float, least_ratio: float = 1 / 3) -> DataFrame:
    """name_a, name_b, distance: one-to-one matches of parts (name, cx, cy, cz, diagonal, area) of two models.

    A pair may match within half the smaller diagonal plus `size`, and where the smaller area is at least least_ratio of the larger. Partners of parts of any size are found: b's centre is sought in a box about a's that reaches half of a's
    diagonal plus `size` to each side, on the level of that box. Pairs that are nearest to each other match first, then those nearest among the rest, until none is left. Ties go by names. Each round settles every locally nearest
    pair, so rounds are few where parts have twins; in a row of parts whose gaps shrink, each pair waits for the next and takes a round of its own.
    """
    reach = F.col("diagonal") / 2 + size
    around = a.select(F.col("name").alias("box_id"), *(e for c in "xyz" for e in ((F.col(f"c{c}") - reach).alias(f"{c}0"), (F.col(f"c{c}") + reach).alias(f"{c}1"))))
    near = points_in_boxes(b.select(F.col("name").alias("node_id"), *(F.col(f"c{c}").alias(c) for c in "xyz")), around, size)
    pairs = near.select(F.col("box_id").alias("name_a"), F.col("node_id").alias("name_b"))
    for side, rows in (("a", a), ("b", b)):
        own = rows.select(F.col("name").alias(f"name_{side}"), *(F.col(f"c{c}").alias(f"{side}{c}") for c in "xyz"), F.col("diagonal").alias(f"d_{side}"), F.col("area").alias(f"area_{side}"))
        pairs = pairs.join(own, f"name_{side}")
    distance = F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "yz"), (F.col("ax") - F.col("bx")) ** 2))
    ratio = F.least("area_a", "area_b") / F.greatest("area_a", "area_b")
    left = checkpointed(pairs.select("name_a", "name_b", distance.alias("distance"), "d_a", "d_b", ratio.alias("r")).where(F.col("distance") <= F.least("d_a", "d_b") / 2 + size).where(F.col("r") >= least_ratio).select("name_a", "name_b", "distance"))
    done = None
    while left.head(1):
        key = F.struct("distance", "name_a", "name_b")
        best_a = left.groupBy("name_a").agg(F.min(key).alias("k")).select("k")
        best_b = left.groupBy("name_b").agg(F.min(key).alias("k")).select("k")
        new = checkpointed(best_a.join(best_b, "k").select("k.name_a", "k.name_b", "k.distance"))
        done = new if done is None else done.unionByName(new)
        left = checkpointed(left.join(new.select("name_a"), "name_a", "left_anti").join(new.select("name_b"), "name_b", "left_anti"))
    return done if done is not None else left


def diverged(areas: DataFrame, least: float = 0.9) -> DataFrame:
    """Names in both models whose area ratio is below `least`, worst first: name, ratio, rank."""
    rows = areas.where(F.col("ratio") < least)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("ratio", "name"))).select("name", "ratio", "rank")  # names that diverged: a report


def heat(coverage: DataFrame) -> DataFrame:
    """Adds changed (counts differ) and heat, the difference over the greatest one of all cells (0 where none differs)."""
    top = coverage.agg(F.max(F.abs("delta")).alias("__top"))
    rows = coverage.join(F.broadcast(top))  # one row
    return rows.withColumns({"changed": F.col("delta") != 0, "heat": F.when(F.col("__top") > 0, F.col("delta") / F.col("__top")).otherwise(0.0)}).drop("__top")


def failures_by_stage(reports: DataFrame) -> DataFrame:
    return reports.where("first_failed_stage is not null").groupBy("first_failed_stage").agg(F.count("*").alias("n"))


def merged_records(parts: Sequence[DataFrame], key: str, item: str) -> DataFrame:
    """Records of equal name of several tables as one, with their distinct items in order."""
    rows = parts[0].select(key, item)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(key, item))
    return rows.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("items"), F.count("*").alias("n_records"))


def together(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of several tables under one another, with their kind; columns that a table lacks are null."""
    out = None
    for kind, rows in tables.items():
        rows = rows.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def physical_objects(tables: Mapping[str, DataFrame], kinds: Sequence[str] = (), guids: Sequence[str] = (), metadata: Mapping[str, str] | None = None) -> DataFrame:
    """Objects of all tables (guid, metadata, ...) by exact kind, guid and all of some metadata; what isn't given admits all."""
    rows = together({k: v for k, v in tables.items() if not kinds or k in kinds})
    rows = rows.where(F.col("guid").isin(*guids)) if guids else rows
    for k, v in (metadata or {}).items():
        rows = rows.where(F.col("metadata")[k] == v)
    return rows


def reached(refs: DataFrame, roots: DataFrame, levels: int) -> DataFrame:
    """root, node, level: what is reached from each root over refs (src, dst) in at most `levels` steps, at its least level; a root reaches itself at 0."""
    seen = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("level"))
    edge = seen
    links = refs.select("src", "dst").distinct()
    for level in range(1, levels + 1):
        step = edge.join(links, edge.node == links.src).select("root", F.col("dst").alias("node"), F.lit(level).alias("level")).distinct()
        edge = checkpointed(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", "level"))
        if not edge.head(1):
            break
        seen = checkpointed(seen.unionByName(edge))
    return seen


def inverse(refs: DataFrame, of: DataFrame) -> DataFrame:
    """dst, src, attr: who refers to the instances of.id."""
    return refs.join(of.select(F.col("id").alias("dst")), "dst", "left_semi").select("dst", "src", "attr")


def of_class(instances: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """Instances of a class or of those under it: classes (class, parent) is a small tree that is walked level by level."""
    wanted = classes.where(F.col("class") == name).select("class")
    level = wanted
    while True:
        level = checkpointed(classes.join(level.select(F.col("class").alias("parent")), "parent", "left_semi").select("class"))
        if not level.head(1):
            return instances.join(wanted.distinct(), "class", "left_semi")
        wanted = wanted.union(level)


def with_geometry(shapes: DataFrame, geometry: DataFrame, default: Column) -> DataFrame:
    """Shapes with their geometry's matrix, the default where they have none."""
    return shapes.join(geometry.select("shape_id", "matrix"), "shape_id", "left").withColumn("matrix", F.coalesce("matrix", default))
