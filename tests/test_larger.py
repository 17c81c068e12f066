"""Cases that grew with the square of the input, or went whole through the driver or one task, in earlier versions."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trussline.jobs import registry
from trussline.operators import graph, members, routes, shapes, spatial

BOX = "x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
SEGMENT = "system long, seq long, x double, y double, z double, x2 double, y2 double, z2 double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def boxes(spark):
    return spark.createDataFrame([(i, float(i), 0.0, 0.0, i + 1.5, 1.0, 1.0) for i in range(4)], f"box_id long, {BOX}")


def nodes(spark):
    return spark.createDataFrame([(10 * i + j, float(i), j / 2, 0.0) for i in range(4) for j in range(3)], "node_id long, x double, y double, z double")


def test_cells_of_boxes_are_not_broadcast(spark):
    """Spark's estimates don't count the rows of an explode."""
    plates = spark.createDataFrame([(1, 2, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0), (2, 0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)], f"plate_id long, axis int, {BOX}")
    for df in (members.on_side(nodes(spark), boxes(spark), "z0"), routes.plate_contacts(plates), spatial.box_pairs(boxes(spark)).select("a", "b")):
        assert "Broadcast" not in plan(df) and df.count() > 0


def test_edge_nodes_in_one_pass(spark):
    """one join of nodes and boxes, not two and an anti join."""
    df = members.along_edges(nodes(spark), boxes(spark))
    assert plan(df).count("SortMergeJoin") == 1 and "Broadcast" not in plan(df)
    got = {(r.box_id, r.node_id) for r in df.collect()}
    # (1, 0.5) lies inside box 0, all other nodes of boxes on an edge
    want = {(i, 10 * k + j) for i in range(4) for k in range(4) for j in range(3) if i <= k <= i + 1.5 and not (i < k < i + 1.5 and j == 1)}
    assert got == want


def equal_beams(spark):
    """Beams along axes on few places, so most have copies; slightly apart ones cross within the gap."""
    random.seed(5)
    rows = []
    for i in range(120):
        at = [float(random.randrange(3)) for _ in "xyz"]
        at[random.randrange(3)] += random.choice([0.0, 0.0, 0.0006])
        to = list(at)
        to[random.randrange(3)] += 2.0
        rows.append((i, *at, *to, 0.2, 0.1, random.random() < 0.5))
    return spark.createDataFrame(rows, "beam_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, h double, w double, is_round boolean").localCheckpoint()


@pytest.mark.parametrize("interior", [False, True])
def test_joints_of_classes_equal_joints_of_beams(spark, interior):
    """crossings between classes of equal beams give the joints that crossings of all beams give."""
    beams = equal_beams(spark)
    want = members.joints(spatial.beam_crossings(beams, 1e-3), beams, interior=interior)
    got = members.class_joints(beams, 1e-3, interior=interior)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_clash_candidates_of_classes(spark):
    """pairs of classes become pairs of beams, and are neither doubled nor lost."""
    beams = equal_beams(spark)
    inside = members.grown(members.boxes(beams), members.MARGIN).join(members.ends(beams).withColumnRenamed("end", "e"), F.expr("box_id <> beam_id and x between x0 and x1 and y between y0 and y1 and z between z0 and z1"))
    want = sorted(map(tuple, inside.select("box_id", "beam_id").distinct().collect()))
    df = members.clash_candidates(beams)
    assert sorted(map(tuple, df.collect())) == want and len(want) > 300
    copies = beams.union(beams.withColumn("beam_id", F.col("beam_id") + 1000))
    assert members.clash_candidates(copies).count() == 4 * len(want) + 2 * 120


def segments(spark, n=60):
    random.seed(3)
    rows = [(i // 3, i % 3, *(float(random.randrange(4)) for _ in range(6))) for i in range(n)]
    return spark.createDataFrame(rows, SEGMENT)


def test_equal_segments_are_sampled_once(spark):
    """copies of a segment don't make copies of its samples, and cells of boxes are not broadcast."""
    runs = segments(spark, 6)
    copies = runs.union(runs.withColumn("system", F.col("system") + 10))
    held = boxes(spark)
    once, twice = (sorted(map(tuple, routes.runs_through_boxes(s, held, 0.1).collect())) for s in (runs, copies))
    assert twice == sorted([*once, *((r[0] + 10, *r[1:]) for r in once)]) and once
    first = routes.runs_through_boxes(copies, held, 0.1)._jdf.queryExecution().optimizedPlan().toString()
    assert first.index("Generate explode") < first.rindex("Aggregate [x")  # distinct segments lie below the explode


def test_planes_at_one_place(spark):
    """F8: counts over equal planes are those of single penetrations, which are made for one of the planes alone."""
    runs = segments(spark)
    planes = spark.createDataFrame([(i, i % 3, i % 2 + 0.5) for i in range(30)], "plane_id long, axis int, level double")
    hits = routes.plane_penetrations(runs, planes)
    want = hits.groupBy("plane_id").agg(F.count("*").alias("n"), F.count_distinct("system").alias("systems"))
    got = routes.plane_counts(runs, planes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() == 30


@pytest.mark.parametrize("kind", ["faces", "polygons"])
def test_sums_of_crossings(spark, kind):
    """sums over equal faces and segments are those of single crossings."""
    runs = segments(spark).union(segments(spark).withColumn("system", F.col("system") + 100))
    if kind == "faces":
        faces = spark.createDataFrame([(i, 1.0, 0.0, 0.0, i % 3 + 0.5, 0.0, 0.0, i % 3 + 0.5, 3.0, 3.0) for i in range(9)], f"face_id long, nx double, ny double, nz double, {BOX}")
        single, sums = routes.face_crossings, routes.face_crossing_sums
    else:
        corners = F.array(*(F.struct((F.col("id") % 3 + u).cast("double").alias("x"), F.lit(float(v)).alias("y"), F.lit(0.5 + u).alias("z")) for u, v in ((0, 0), (2, 0), (2, 3), (0, 3))))
        faces = spark.range(9).select(F.col("id").alias("face_id"), corners.alias("p"))
        single, sums = routes.polygon_crossings, routes.polygon_crossing_sums
    want = {r.face_id: (r.n, r.hx, r.hz) for r in single(runs, faces).groupBy("face_id").agg(F.count("*").alias("n"), F.sum("hx").alias("hx"), F.sum("hz").alias("hz")).collect()}
    got = {r.face_id: (r.n, pytest.approx(r.hx), pytest.approx(r.hz)) for r in sums(runs, faces).collect()}
    assert got == want and len(want) == 9


def test_edges_of_cells_are_not_broadcast(spark):
    """twelve edges a cell are not counted by Spark's estimates."""
    cells = spark.createDataFrame([(i, 1, False, float(i), 0.0, 0.0, i + 1.0, 1.0, 1.0) for i in range(3)], f"cell_id long, priority int, cantilever boolean, {BOX}")
    df = shapes.coplanar_neighbours(cells)
    assert "Broadcast" not in plan(df) and df.count() == 8


def test_model_diff_of_a_name_that_comes_twice(spark, tmp_path):
    """part 17's copy has the name of part 1000017; the SQL counts one of the two, as the query does."""
    spark.createDataFrame([(17, "t1", "b1", 1, 5.0), (1000017, "t2", "b2", 2, 6.0)], "p_partkey long, p_type string, p_brand string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted(map(tuple, registry.QUERIES["model_diff"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(db.execute(registry.SQL["model_diff"]).fetchall()) == [("P1000017", "unchanged"), ("P17", "unchanged")]


def test_cells_are_dealt_before_they_become_edges(spark, monkeypatch):
    """F16: the edges of one file's cells are made in as many tasks as there are lots of cells."""
    cells = spark.createDataFrame([(i, 1, False, float(i), 0.0, 0.0, i + 1.0, 1.0, 1.0) for i in range(100)], f"cell_id long, priority int, cantilever boolean, {BOX}").coalesce(1)
    monkeypatch.setattr(shapes, "CELLS_A_TASK", 10)
    edges = shapes.face_edges(cells)
    assert edges.count() == 2400 and edges.rdd.getNumPartitions() == 10


@pytest.mark.parametrize("along", [lambda i, n: i, lambda i, n: n - i, lambda i, n: i * 7919 % n])
def test_rounds_of_components(spark, monkeypatch, along):
    """links are contracted, so each round writes less than the one before, also for a chain numbered along itself; labels are the smallest nodes."""
    sizes, n = [], 2003
    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df: (rows := kept(df), sizes.append(rows.count()) if rows.columns == ["lo", "hi"] else None)[0])
    links = spark.createDataFrame([(along(i, n), along(i + 1, n)) for i in range(n - 1)] + [(5000, 5001), (5001, 5000), (6000, 6000)], "a long, b long")
    nodes = spark.createDataFrame([(x,) for x in {along(i, n) for i in range(n)} | {5000, 5001, 6000, 7000}], "node int")
    labels = graph.components(nodes, links)
    low = min(along(i, n) for i in range(n))
    assert {r.node: r.label for r in labels.collect()} == {along(i, n): low for i in range(n)} | {5000: 5000, 5001: 5000, 6000: 6000, 7000: 7000}
    assert all(b < a for a, b in zip(sizes, sizes[1:], strict=False)) and len(sizes) <= 12 and dict(labels.dtypes)["label"] == "int"


def test_short_chains_leave_the_rounds(spark, monkeypatch):
    """squares are numbered in few rounds, and only the long chain goes on."""
    sizes = []
    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df: (rows := kept(df), sizes.append(rows.count()))[0])
    squares = [(10 * i + j, 10 * i + (j + 1) % 4) for i in range(200) for j in range(4)]
    long = [(5000 + i, 5000 + (i + 1) % 100) for i in range(100)]
    got = {r.e: (r.cycle, r["rank"], r.n) for r in graph.ranked_cycles(spark.createDataFrame(squares + long, "e long, next long")).collect()}
    assert got == {e: (e - e % 10, e % 10, 4) for e, _ in squares} | {e: (5000, e - 5000, 100) for e, _ in long}
    assert sizes[0] == 900 and sizes[-1] == 0 and sizes.count(100) >= 3
