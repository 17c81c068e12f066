"""Small literal cases, and every registered query of the library against its SQL."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from trussline.functions import sections
from trussline.jobs import joblog, registry, takeoff
from trussline.operators import compare, health, mesh, patches, routes, spatial

FOLDER = "/root/testdata/sf0.001"
NODES = [(1, 1, 2, 3), (2, 1, 1, 1), (3, 2, 1, 8), (4, 1, 2, 3), (5, 1, 3, 2), (6, 1, 1, 3), (7, 4, 5, 1), (8, 2, 4, 3), (9, 1, 1, 4), (10, 5, 2, 3)]


@pytest.fixture
def nodes(spark):
    return spark.createDataFrame([(i, float(x), float(y), float(z)) for i, x, y, z in NODES], "node_id long, x double, y double, z double")


def ids(df, column="node_id"):
    return {r[column] for r in df.collect()}


def test_nodes_by_volume(nodes):
    assert ids(mesh.at_point(nodes, (4, 5, 1))) == {7}
    assert ids(mesh.in_box(nodes, (1.5, 0.5, 0.5), (4.5, 5.5, 8.5))) == {3, 7, 8}
    assert ids(mesh.in_cylinder(nodes, (1, 1, 0.5), 0.2, 4, 0.2)) == {2, 6, 9}


def test_duplicate_corners_count(spark):
    quads = spark.createDataFrame([(1, 10, 20, 30, 40), (2, 20, 50, 30, 30)], "elem_id long, n1 long, n2 long, n3 long, n4 long")
    assert {r.node_id: r.degree for r in mesh.incidence(quads).collect()} == {10: 1, 20: 2, 30: 3, 40: 1, 50: 1}


def test_merge_keeps_the_most_used(spark, nodes):
    quads = spark.createDataFrame([(1, 4, 2, 3, 5)], "elem_id long, n1 long, n2 long, n3 long, n4 long")
    kept = {r.node_id: r.survivor for r in mesh.merge_coincident(nodes, quads).collect()}
    assert kept[1] == 4 and kept[4] == 4 and kept[7] == 7


@pytest.mark.parametrize("blocks", [1, 3, 7])
def test_renumber_does_not_hang_on_blocks(nodes, blocks):
    assert [(r.node_id, r.new_id) for r in mesh.renumber(nodes, "node_id", 5, blocks).orderBy("node_id").collect()] == [(i, i + 4) for i in range(1, 11)]


def test_two_boxes_clash_once(spark):
    rows = [(1, 0, 0, 0, 3, 3, 3), (2, 2, 2, 2, 9, 9, 9), (3, 9, 9, 9, 10, 10, 10)]
    boxes = spark.createDataFrame([(r[0], *map(float, r[1:])) for r in rows], "box_id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    assert [tuple(r) for r in spatial.overlapping_boxes(boxes).collect()] == [(1, 2, 1.0)]


def test_takeoff_mass(spark):
    beams = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0, 10.0)] * 2, "section string, x1 double, y1 double, z1 double, axis int, length double")
    sections = spark.createDataFrame([("a", "round", 0.2, 0.2, 0.0)], "section string, kind string, h double, w double, t double")
    row = takeoff.by_section(takeoff.weighed_beams(beams, sections)).first()
    assert row.n == 2 and row.length == 20 and math.isclose(row.mass, math.pi / 4 * 0.04 * 20 * 7.85)


def test_a_model_is_like_itself(spark):
    a = spark.createDataFrame([("b1", "x"), ("b2", None), ("b2", "y")], "name string, material string")
    assert {r.change for r in compare.by_identity(a, a, [F.col("name")], ("material",)).collect()} == {"unchanged"}
    b = a.where("name = 'b1'").withColumn("material", F.lit("z"))
    assert sorted((r.key, r.change) for r in compare.by_identity(a, b, [F.col("name")], ("material",)).collect()) == [("b1", "modified"), ("b2", "removed")]


def test_verdict_needs_samples_and_values(spark):
    kinds = "n long, rss_per_mb_p95 double, duration_p95 double, peak_rss_mb double, failure_rate double, cpu_fraction double"
    rows = [(4, 99.0, 1e6, 9e3, 1.0, 0.0), (50, None, 5e3, 250.0, 0.0, None), (50, 21.0, 5e3, 250.0, 0.0, 0.9), (50, 1.0, 5e3, 250.0, 0.06, 0.2)]
    assert [r.signals for r in joblog.verdict(spark.createDataFrame(rows, kinds)).collect()] == ["", "", "rss_per_mb", "failures,cpu"]


def test_owner_is_the_longest_prefix(spark):
    derived = spark.createDataFrame([("a.b/c",), ("a.bc",), ("x",), (None,)], "derived_key string")
    sources = spark.createDataFrame([("a",), ("a.b",)], "source_key string")
    assert {r.derived_key: r.source_key for r in joblog.owners(derived, sources).collect()} == {"a.b/c": "a.b", "a.bc": "a", "x": None, None: None}


def shown(v):
    return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else f"{float(v):.6g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
    got = registry.QUERIES[name](spark, FOLDER)
    want = con.execute(registry.SQL[name])
    columns, order = sorted(got.columns), [d[0] for d in want.description]
    assert columns == sorted(order)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(shown(r[order.index(c)]) for c in columns) for r in want.fetchall())


def test_two_plates_meet_mid_span(spark):
    # three level plates and two upright ones that stand on the first, inside it
    flat = [(i, 2, 0.0, 0.0, z, 4.0, 4.0, z) for i, z in ((1, 0.0), (2, 5.0), (3, 9.0))]
    rows = [*flat, (4, 0, 1.0, 1.0, 0.0, 1.0, 2.0, 1.0), (5, 0, 0.0, 0.0, 0.0, 0.0, 4.0, 1.0)]
    plates = spark.createDataFrame(rows, "plate_id long, axis int, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    met = {(r.a, r.b): r.contact for r in routes.plate_contacts(plates).collect()}
    assert met[1, 4] == "mid-span" and met[1, 5] == "edge" and met[5, 1] == "edge" and (2, 4) not in met


def test_a_run_that_doubles_back(spark):
    rows = [("r", 1, 0, 0, 0, 4, 0, 0), ("r", 2, 4, 0, 0, 4, 1, 0), ("r", 3, 4, 1, 0, 0, 1, 0), ("r", 4, 0, 1, 0, 0, 1, 0)]
    kinds = "system string, seq long, x double, y double, z double, x2 double, y2 double, z2 double"
    segments = spark.createDataFrame([(*r[:2], *map(float, r[2:])) for r in rows], kinds)
    assert {(r.i, r.j, r.gap) for r in routes.self_collisions(segments, 0.6).collect()} == {(1, 3, 1.0), (1, 4, 1.0)}
    assert routes.self_collisions(segments, 0.5).count() == 0
    faces = spark.createDataFrame([(7, 1.0, 0.0, 0.0, 2.0, -1.0, -1.0, 2.0, 0.5, 1.0)], "face_id long, nx double, ny double, nz double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    assert [(r.seq, r.hx) for r in routes.face_crossings(segments, faces).collect()] == [(1, 2.0)]


def test_health_of_a_square(spark):
    points = [("a", i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])]
    vertices = spark.createDataFrame([*points, ("b", 0, float("nan"), 0.0, 0.0), ("b", 1, 0.0, 0.0, 0.0)], "part string, vertex_id long, x double, y double, z double")
    good, flat = [("a", 1, 0, 1, 2), ("a", 2, 0, 2, 3)], [("a", 3, 0, 1, 1), ("b", 1, 0, 1, 1)]
    kinds = "part string, tri_id long, v0 long, v1 long, v2 long"
    row = health.verdict(health.mesh_health(vertices, spark.createDataFrame(good, kinds))).first()
    assert (row.area, row.degenerate_tris, row.nonmanifold_edges, row.boundary_edges, row.ok, row.warnings) == (1.0, 0, 0, 4, True, "")
    rows = {r.part: r for r in health.verdict(health.mesh_health(vertices, spark.createDataFrame(good + flat, kinds))).collect()}
    assert rows["a"].degenerate_tris == 1 and rows["a"].collapsed_tris == 1 and rows["a"].problems == "degenerate" and "non-finite" in rows["b"].problems


def test_two_cells_share_a_wall(spark):
    kinds = "cell_id long, priority long, cantilever boolean, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
    cells = spark.createDataFrame([(1, 1, False, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0), (2, 5, False, 1.0, 0.0, 0.0, 2.0, 1.0, 1.0)], kinds)
    faces = patches.shared_faces(cells).collect()
    assert sum(not f.internal for f in faces) == 10 and [(f.cell_id, f.side) for f in faces if f.internal and f.kept] == [(2, "x0")]


def test_chains_break_at_bends_and_branches(spark):
    rows = [(1, "s", 0, 0, 1, 0), (2, "s", 2, 0, 1, 0), (3, "s", 2, 0, 2, 1), (4, "t", 5, 5, 6, 5), (5, "t", 6, 5, 7, 5), (6, "t", 6, 5, 6, 6)]
    beams = spark.createDataFrame([(b, s, float(x), float(y), 0.0, float(p), float(q), 0.0) for b, s, x, y, p, q in rows], "beam_id long, section string, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    assert {r.beam_id: r.chain for r in patches.beam_chains(beams).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


SECTIONS = [("i", 0.3, 0.2, 0.01, 0.02, None, None), ("u", 0.3, 0.2, 0.01, 0.02, 0.1, 0.03), ("tee", 0.3, 0.2, 0.01, 0.02, None, None), ("angle", 0.2, 0.1, 0.01, 0.012, None, None), ("channel", 0.3, 0.1, 0.01, 0.015, None, None), ("poly", 0.3, 0.1, 0.0, None, None, None), ("blob", 1.0, 1.0, 0.1, None, None, None)]


def section_by_force(kind, h, w, t, tf, wb, tb, n=60_000):
    """Area and inertia by thin strips."""
    tf, wb = tf or t, wb or w
    tb, total, first, second = {"tee": 0}.get(kind, tb or tf), 0.0, 0.0, 0.0
    for i in range(n):
        z = (i + 0.5) * h / n
        low, high = z < (tf if kind == "angle" else tb), z > h - tf and kind != "angle"
        wide = (wb if kind in "iu" and low else w) if low or high else t
        total, first, second = total + wide * h / n, first + wide * z * h / n, second + wide * z * z * h / n
    return total, second - first * first / total


def test_section_kinds(spark):
    rows = spark.createDataFrame([("i" if k == "u" else k, k, *r) for k, *r in SECTIONS], "kind string, section string, h double, w double, t double, tf double, wb double, tb double")
    columns = [F.col(c) for c in ("kind", "h", "w", "t", "tf", "wb", "tb")]
    got = {r.section: r for r in rows.select("section", sections.area(*columns).alias("a"), sections.inertia(*columns).alias("i")).collect()}
    for row in SECTIONS[:5]:
        want = section_by_force(*row)
        assert got[row[0]].a == pytest.approx(want[0], rel=1e-3) and got[row[0]].i == pytest.approx(want[1], rel=1e-3)
    assert got["poly"].a == got["poly"].i == 0 and got["blob"].a is None
    beams = spark.createDataFrame([(s, 0.0, 0.0, 0.0, 0, 2.0) for s in ("i", "blob", "unlisted", "unlisted")], "section string, x1 double, y1 double, z1 double, axis int, length double")
    weighed = takeoff.weighed_beams(beams, rows)
    assert {r.section: (r.n, r.length) for r in takeoff.by_section(weighed).collect()} == {"i": (1, 2.0), "blob": (1, 2.0), "unlisted": (2, 4.0)}
    assert {tuple(r) for r in takeoff.unweighed(weighed).collect()} == {("blob", 1, 2.0), ("unlisted", 2, 4.0)}


def test_takeoff_by_discipline(spark):
    kinds = "run_id string, object_type string, segment_class string, size string, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, a double, density double, w double, h double"
    rows = [
        ("p", "straight", None, "60", 0, 0, 0, 2, 0, 0, 0.01, None, None, None), ("p", "elbow", None, "60", 2, 0, 0, 2, 3, 4, 0.01, None, None, None), ("q", "straight", None, "60", 0, 0, 0, 0, 0, 4, 0.01, 1000, None, None),
        ("d", "beam", "IfcDuctSegment", "DU", 0, 0, 0, 0, 5, 0, 0.02, 0, 0.3, 0.2), ("t", "beam", "IfcCableSegment", "TR", 0, 0, 0, 1, 0, 0, None, None, None, None),
        ("b", "beam", None, "I", 0, 0, 0, 10, 0, 0, 0.01, None, None, None), ("e", "shape", None, "E", 0, 0, 0, 1, 0, 0, 9.0, None, None, None),
    ]
    rows = [(*r[:4], *(None if x is None else float(x) for x in r[4:])) for r in rows]
    weighed = takeoff.weighed_runs(spark.createDataFrame(rows, kinds))
    sizes = {r["size"]: r for r in takeoff.runs_by_size(weighed).collect()}
    assert set(sizes) == {"60", "DU", "TR"} and (sizes["60"].segments, sizes["60"].length, sizes["60"].elbows) == (2, 6.0, 1)
    assert sizes["60"].mass == pytest.approx(0.157 + 0.04) and sizes["DU"].area == pytest.approx(5.0) and sizes["DU"].mass == pytest.approx(0.785)
    assert takeoff.flanges(weighed).first().flanges == 4
    got = {r.discipline: r for r in takeoff.by_discipline(weighed).collect()}
    assert set(got) == {"piping", "hvac", "electrical", "structural", "other", None} and got["electrical"].n_unweighed == 1 and got[None].n == 6
    assert got["piping"].mass == pytest.approx(0.157 + 0.3925 + 0.04) and got[None].mass == pytest.approx(0.5895 + 0.785 + 0.785)


def test_joint_takeoff(spark):
    rows = [("j1", "k", "member", "b2"), ("j1", "k", "member", "b1"), ("j1", "k", "member", "b2"), ("j1", "k", "plate", "p"), ("j1", "k", "weld", "w"), ("j1", "k", "weld", "v"), ("j2", "k", "member", "b1")]
    items = takeoff.joint_items(spark.createDataFrame(rows, "joint string, slug string, role string, name string"))
    assert {tuple(map(str, r)) for r in items.collect()} == {("j1", "k", "['b1', 'b2']", "1", "2"), ("j2", "k", "['b1']", "0", "0")}
    assert [tuple(r) for r in takeoff.joints_by_type(items).collect()] == [("k", 2)]
