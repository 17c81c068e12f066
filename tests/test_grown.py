"""Steps whose work or memory once grew faster than their input."""

import random

from pyspark.sql import functions as F

from trussline.operators import graph, health, mesh, results, shapes, tree


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def nodes_and_elements(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 1.0, 1.0, 0.0), (4, 0.0, 1.0, 0.0)], "node_id long, x double, y double, z double")
    elements = spark.createDataFrame(
        [(1, "a", 1, 2, 3, 4), (2, "b", 3, 2, 1, None), (3, "c", 1, 2, 9, None), (4, "d", None, None, None, None), (5, None, 2, 1, None, None)], "elem_id long, material string, n1 long, n2 long, n3 long, n4 long"
    )
    return nodes, elements


def test_corners_are_shuffled_without_their_elements_columns(spark):
    nodes, elements = nodes_and_elements(spark)
    out = mesh.placed(nodes, elements, ("material",))
    got = {r.elem_id: (r.material, [(q.x, q.y) for q in r.p]) for r in out.collect()}
    assert got == {1: ("a", [(0, 0), (1, 0), (1, 1), (0, 1)]), 2: ("b", [(1, 1), (1, 0), (0, 0)]), 5: (None, [(1, 0), (0, 0)])}  # 3 has an unknown node, 4 has none
    assert mesh.placed(nodes, elements).columns == [*elements.columns, "p"]
    generated = [line for line in optimized(out).split("\n") if "Generate" in line]
    assert len(generated) == 1 and "material" not in generated[0]


def test_plane_buckets_work_out_areas_once(spark):
    polygons = spark.createDataFrame([(1, [(0.0, 0.0, 2.0), (1.0, 0.0, 2.0), (1.0, 1.0, 2.0)]), (2, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0)])], "id long, p array<struct<x: double, y: double, z: double>>")
    lifted = polygons.withColumn("p", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), (q["z"] + 1).alias("z"))))
    out = shapes.plane_buckets(lifted, [])
    assert [tuple(r) for r in out.collect()] == [(0.0, 0.0, 1.0, 3.0, 1, 0.5)]  # the second one has no area
    assert optimized(out).count("aggregate(") <= 3


def test_bends_are_worked_out_once(spark):
    polygons = spark.createDataFrame([(1, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0), (2.0, 2.0, 0.0)]), (2, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0)])], "id long, p array<struct<x: double, y: double, z: double>>")
    out = shapes.without_collinear(polygons)
    assert {r.id: [q.x for q in r.p] for r in out.collect()} == {1: [0, 2, 2], 2: [0, 1, 2]}
    assert optimized(out.select("p")).count("SQRT") == 1


def test_corners_are_never_broadcast(spark):
    nodes, elements = nodes_and_elements(spark)
    out = mesh.standalone(nodes.unionByName(nodes.withColumn("node_id", F.col("node_id") + 10)), elements)
    assert sorted(r.node_id for r in out.collect()) == [11, 12, 13, 14]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_rows(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "Repartition" not in optimized(graph.dealt(rows, own * graph.ROWS_A_TASK, "k"))
    more = graph.dealt(rows, (own + 3) * graph.ROWS_A_TASK, "k")
    assert more.rdd.getNumPartitions() == own + 3 and more.count() == 1000


def test_averages_at_nodes_are_dealt_by_rows(spark):
    _, elements = nodes_and_elements(spark)
    long = spark.createDataFrame([(1, 1, 1, "s", 2.0), (1, 2, 1, "s", 4.0)], "step int, elem_id long, int_pt int, component string, value double")
    out = results.nodal_average(long, elements, 10**9)
    assert {r.node_id: r.value for r in out.collect()} == {1: 3.0, 2: 3.0, 3: 3.0, 4: 2.0}
    assert "RepartitionByExpression" in optimized(out)


def test_health_of_a_mesh_is_the_same_over_many_tasks(spark, monkeypatch):
    vertices = spark.createDataFrame([("p", i, x, y, 0.0) for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], "part string, vertex_id long, x double, y double, z double")
    triangles = spark.createDataFrame([("p", 0, 0, 1, 2), ("p", 1, 3, 4, 5), ("p", 2, 0, 0, 1)], "part string, tri_id long, v0 long, v1 long, v2 long")
    seen = []
    monkeypatch.setattr(health, "dealt", lambda df, rows, *keys: seen.append(rows) or df.repartition(5, *keys))
    row = health.mesh_health(vertices, triangles).first()
    assert (row.n_verts, row.n_tris, row.welded_verts, row.boundary_edges, row.collapsed_tris, row.degenerate_tris, row.area) == (6, 3, 4, 4, 1, 1, 1.0)
    assert seen == [6, 9, 9, 9]


def test_welds_below_parts_are_counted_without_their_pairs(spark):
    spans = tree.intervals(spark.createDataFrame([(1, None), (2, 1), (3, 1)], "part_id long, parent_id long"))
    welds = spark.createDataFrame([(10, 2), (11, 3), (11, 2), (12, 1), (13, 3)], "weld_id long, part_id long")
    members = spark.createDataFrame([(10, 5), (10, 6), (10, 6), (11, 5), (12, 7)], "weld_id long, member_id long")
    plain = tree.welds_for(welds, members, spans).distinct().groupBy("part_id").agg(F.count_distinct("weld_id"), F.count_distinct("member_id"), F.count("*"))
    got = {tuple(r) for r in tree.weld_counts(welds, members, spans).collect()}
    assert got == {tuple(r) for r in plain.collect()} == {(1, 3, 3, 4), (2, 2, 2, 3), (3, 1, 1, 1)}


def test_weld_counts_bring_nothing_up_the_tree(spark, monkeypatch):
    """on a deep tree, beside a second root and a circle, with welds at several parts: as by pairs, without a row for each part above."""
    r = random.Random(4)
    parent = {0: None, 100: 999} | {k: k - 1 if k < 12 else r.randrange(k) for k in range(1, 60)} | {100 + k: 100 + r.randrange(k) for k in range(1, 10)} | {200: 201, 201: 200}
    spans = tree.intervals(spark.createDataFrame(list(parent.items()), "part_id long, parent_id long"))
    welds = [(k, r.choice(list(parent))) for k in range(80) for _ in range(1 + k % 3)]
    members = [(k, r.randrange(15)) for k in range(90) for _ in range(k % 4)]
    below = {p: set() for p in parent if p < 200}
    for w, p in welds:
        while p in below:
            below[p] |= {(w, m) for v, m in members if v == w}
            p = parent[p]
    want = {(p, len({w for w, _ in s}), len({m for _, m in s}), len(s)) for p, s in below.items() if s}
    monkeypatch.setattr(tree, "at_or_below", None)
    got = tree.weld_counts(spark.createDataFrame(welds, "weld_id long, part_id long"), spark.createDataFrame(members, "weld_id long, member_id long"), spans)
    assert [tuple(x) for x in got.orderBy("part_id").collect()] == sorted(want) and len(want) > 50
