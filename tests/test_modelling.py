"""Small literal cases of mixed elements, decks, the result store, members and shapes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trussline.functions import names, sections, steel
from trussline.operators import compare, elements, members, mesh, parity, shapes, spatial
from trussline.operators.graph import checkpointed
from trussline.sources import decks, store
from trussline.streaming import events

GRID = [(i, float(i % 3), float(i // 3), 0.0) for i in range(9)]
NODE = "node_id long, x double, y double, z double"


def column(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}")


def test_a_triangle_has_no_fourth_node(spark):
    nodes = spark.createDataFrame(GRID, NODE)
    rows = [(1, "S3", 0, 1, 4, None, 0.01, None, None), (2, "S4", 3, 4, 7, 6, 0.02, None, None), (3, "B31", 0, 8, None, None, None, 0.1, None), (4, "MASS", 8, None, None, None, None, None, 5.0)]
    el = spark.createDataFrame(rows, "elem_id long, elem_type string, n1 long, n2 long, n3 long, n4 long, thickness double, a double, point_mass double")
    assert {r.node_id: r.degree for r in mesh.incidence(el).collect()} == {0: 2, 1: 1, 4: 2, 3: 1, 7: 1, 6: 1, 8: 2}
    got = {r.elem_id: (r.family, r.mass) for r in mesh.weighed(nodes, el).collect()}
    assert got[1] == ("shell", pytest.approx(0.5 * 0.01 * 7850)) and got[3] == ("line", pytest.approx(math.sqrt(8) * 785)) and got[4] == ("point", 5.0)
    total = mesh.centre_of_gravity(nodes, el).first()
    assert total.mass == pytest.approx(39.25 + 157 + math.sqrt(8) * 785 + 5)
    lost = spark.createDataFrame([(9, 0, 77, None, None)], "elem_id long, n1 long, n2 long, n3 long, n4 long")
    assert [(r.elem_id, r.node_id) for r in mesh.unknown_corners(nodes, lost).collect()] == [(9, 77)] and mesh.placed(nodes, lost).count() == 0
    assert {(r.a, r.b) for r in elements.unique_edges(el).collect()} == {(0, 1), (1, 4), (0, 4), (3, 4), (4, 7), (6, 7), (3, 6), (0, 8)}


@pytest.mark.parametrize("blocks", [1, 4])
def test_numbers_over_a_gap(spark, blocks):
    ids = [*range(50), *range(10_000_000, 10_000_030)]
    rows = spark.createDataFrame([(i,) for i in ids], "node_id long")
    assert [r.new_id for r in mesh.renumber(rows, "node_id", 1, blocks).orderBy("node_id").collect()] == list(range(1, 81))


DECK = """*HEADING
** sets of sets
*Node
 1, 0., 0., 0.
 2, 1., 0., 0.
 3, 1., 1.
 4, 0., 1., 0.
*Element, type=S3, ELSET=right
 1, 1, 2, 3
*ELEMENT, TYPE=S3, elset=left
 2, 1,
 3, 4
*Elset, elset=all
Right, LEFT, 99
*Nset, nset=some, generate
1, 9, 2"""


def test_keyword_deck(spark, tmp_path):
    (tmp_path / "a.inp").write_text("*Include, input=b.inp\n*Nset, nset=more\n 4\n")
    (tmp_path / "b.inp").write_text(DECK)
    lines = checkpointed(decks.expanded(decks.read_lines(spark, str(tmp_path))))
    assert {r.file for r in lines.collect()} == {"a.inp"}
    assert {(r.node_id, r.x, r.y, r.z) for r in decks.deck_nodes(lines).collect()} == {(1, 0, 0, 0), (2, 1, 0, 0), (3, 1, 1, 0), (4, 0, 1, 0)}
    assert {(r.elem_id, r.elem_type, tuple(r.nodes), r.elset) for r in decks.deck_elements(lines).collect()} == {(1, "S3", (1, 2, 3), "right"), (2, "S3", (1, 3, 4), "left")}
    sets = {}
    for r in decks.deck_sets(lines).collect():
        sets.setdefault(r.set_name, set()).add(r.member_id)
    assert sets == {"right": {1}, "left": {2}, "all": {1, 2}, "some": {1, 3}, "more": {4}}


def test_values_are_carried_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(decks, "BLOCK", 4)
    rows = spark.createDataFrame([("f", i, "x" if i in (1, 14) else None) for i in range(20)], "file string, line long, text string")
    got = {r.line: r.v for r in decks.carried(rows.withColumn("k", F.when(F.col("text").isNotNull(), F.col("line"))), F.col("k"), "v").collect()}
    assert got == {i: None if i < 1 else 1 if i < 14 else 14 for i in range(20)}


def test_failures_collapse(spark):
    a = "Conversion failed at 2026-05-27T14:23:11.918432+00:00 in /tmp/tmpabc123/x.ifc: id 0123456789abcdef0123456789abcdef"
    b = "Conversion failed at 2026-01-02 03:04:05Z in /var/folders/zz/y.ifc: id ffffffffffffffffffffffffffffffff"
    rows = spark.createDataFrame([(a, 'x\n  File "m.py", line 3\nValueError: bad at :12  \n\n'), (b, "ValueError: bad at :99"), (a + " 0xFF", None), ("code E42", None), ("code E43", None)], "m string, t string")
    got = [r.f for r in rows.select(names.failure_fingerprint(F.lit(" IFC "), F.lit("glb"), F.col("m"), F.col("t")).alias("f")).collect()]
    assert got[0] == got[1] and len(set(got)) == 4
    assert column(spark, "on 2024-02-03").select(names.stable_text(F.col("v"))).first()[0] == "on <date>"


@pytest.mark.parametrize(("name", "category"), [("signup", "other"), ("error", "other"), ("U", "other"), ("DEPL", "displacement"), ("rvnoddis", "displacement"), ("RVFORCES", "reaction"), ("SIEF_NOEU", "stress"), ("EPSI", "strain")])
def test_field_categories(spark, name, category):
    assert column(spark, name).select(names.field_category(F.col("v"))).first()[0] == category


def test_names(spark):
    one = column(spark, "/a-b.c/d=1").select(names.safe_name(F.col("v")), names.safe_name(F.col("v"), True), names.safe_identifier(F.col("v"))).first()
    assert tuple(one) == ("a-b.c_d1", "a-b_c_d1", "d_1")
    assert [tuple(r) for r in spark.createDataFrame([("1x.rmed",), ("",)], "v string").select(names.safe_identifier(F.col("v"))).collect()] == [("_1x",), ("case",)]


def test_null_parts_of_a_key_are_no_other_key(spark):
    kinds = "p string, q string, r string, m string"
    a, b = spark.createDataFrame([("a", None, "b", "x")], kinds), spark.createDataFrame([("a", "b", None, "x")], kinds)
    key = [F.col(c) for c in "pqr"]
    assert sorted(r.change for r in compare.by_identity(a, b, key, ("m",)).collect()) == ["added", "removed"]
    assert [r.change for r in compare.by_identity(a, a, key, ("m",)).collect()] == ["unchanged"]


def test_boxes_of_very_unlike_size(spark):
    r = random.Random(5)
    rows = [(0, -200.0, -200.0, -200.0, 200.0, 200.0, 200.0)] + [(i, *(x := [r.uniform(0, 6) for _ in range(3)]), *(v + r.uniform(0.1, 3) for v in x)) for i in range(1, 60)]
    boxes = spark.createDataFrame(rows, "box_id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and all(min(p[k + 4], q[k + 4]) - max(p[k + 1], q[k + 1]) > 1e-4 for k in range(3))}
    assert {(x.a, x.b) for x in spatial.overlapping_boxes(boxes).collect()} == want
    levels = spatial.levelled(boxes, 2.0)
    assert spatial.at_home(levels, 2.0).groupBy("box_id").count().agg(F.max("count")).first()[0] <= 8
    points = spark.createDataFrame([(i, *(r.uniform(-1, 8) for _ in range(3))) for i in range(80)], NODE)
    inside = {(b[0], p.node_id) for b in rows for p in points.collect() if all(b[1 + k] <= p[1 + k] <= b[4 + k] for k in range(3))}
    assert {(x.box_id, x.node_id) for x in spatial.points_in_boxes(points, boxes).collect()} == inside
    pairs = spatial.box_pairs(boxes.where("box_id < 20"), boxes.where("box_id >= 20")).select("a", "b").collect()
    assert len(pairs) == len({tuple(p) for p in pairs}) and {tuple(p) for p in pairs} == {(a, b) for a, b in want if a < 20 <= b}


def test_merge_of_chained_nodes(spark):
    r = random.Random(8)
    points = [(i, round(r.random() * 3e-3, 5), 0.0, 0.0) for i in range(60)]
    nodes = spark.createDataFrame(points, NODE)
    label = {i: i for i, *_ in points}
    for _ in points:
        for i, x, *_ in points:
            for j, y, *_ in points:
                if abs(x - y) <= 1e-4:
                    label[i] = label[j] = min(label[i], label[j])
    none = spark.createDataFrame([], "elem_id long, n1 long, n2 long")
    assert {x.node_id: x.survivor for x in mesh.merge_coincident(nodes, none).collect()} == label


def test_section_text(spark):
    texts = {"BG200x100x10x12": ("box", 0.2, 0.1, 0.01, 0.012, None), "TUB300x15": ("tube", 0.6, None, 0.015, None, None), "ipe200": ("profile", None, None, None, None, "IPE200"), "what": (None,) * 6}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", sections.from_text(F.col("t")).alias("s")).select("t", "s.*").collect()
    assert {r.t: tuple(v if v is None or isinstance(v, str) else round(v, 9) for v in r[1:]) for r in rows} == texts


def test_steel(spark):
    row = column(spark, 550.0, "double").select(steel.stiffness(F.lit(100.0), F.col("v")), steel.strength(F.lit(100.0), F.col("v")), steel.grade(F.lit(355e6)), steel.conductivity(F.col("v")), steel.specific_heat(F.lit(800.0))).first()
    assert (round(row[0], 6), round(row[1], 6), row[2]) == (45.5, 62.5, "S355") and row[3] == pytest.approx(54 - 550 * 0.0333) and row[4] == pytest.approx(545 + 17820 / 69)


def test_polygons(spark):
    square = [(0, 0), (2, 0), (4, 0), (4, 3), (0, 3)]
    rows = [(1, [(i, float(x), float(y), 0.0) for i, (x, y) in enumerate(square)]), (2, [(i, float(x), float(y), 0.0) for i, (x, y) in enumerate([(0, 0), (2, 1), (4, 0), (4, 3), (0, 3)][::-1])])]
    p = spark.createDataFrame(rows, "poly_id long, p array<struct<seq: int, x: double, y: double, z: double>>")
    got = {r.poly_id: (r.area, r.clockwise, r.coplanar, r.reflex) for r in shapes.polygon_facts(p).collect()}
    assert got == {1: (12.0, False, True, False), 2: (10.0, True, True, True)}
    assert {r.poly_id: len(r.p) for r in shapes.without_collinear(p).collect()} == {1: 4, 2: 5}


def test_matches_are_one_to_one(spark):
    kinds = "name string, cx double, cy double, cz double, diagonal double, area double"
    a = spark.createDataFrame([("a1", 0.0, 0.0, 0.0, 1.0, 1.0), ("a2", 0.3, 0.0, 0.0, 1.0, 1.0), ("a3", 9.0, 0.0, 0.0, 1.0, 1.0)], kinds)
    b = spark.createDataFrame([("b1", 0.25, 0.0, 0.0, 1.0, 1.0), ("b2", 0.6, 0.0, 0.0, 1.0, 0.1), ("b3", -0.4, 0.0, 0.0, 1.0, 0.5)], kinds)
    assert {(r.name_a, r.name_b) for r in parity.match_by_centroid(a, b, 0.5).collect()} == {("a2", "b1"), ("a1", "b3")}


def test_member_boxes(spark):
    rows = [(1, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.2, 0.1, False), (2, 0.0, 0.0, 0.0, 0.0, 0.0, 3.0, 0.2, 0.1, True)]
    beams = spark.createDataFrame(rows, "beam_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, h double, w double, is_round boolean")
    got = {r.box_id: tuple(round(v, 6) + 0.0 for v in r[1:]) for r in members.boxes(beams).collect()}
    assert got == {1: (0.0, -0.05, -0.1, 2.0, 0.05, 0.1), 2: (-0.1, -0.1, 0.0, 0.1, 0.1, 3.0)}


def test_one_step_is_read(spark, tmp_path):
    rows = spark.range(30).select(F.col("id").alias("elem_id"), (F.col("id") % 3).alias("step"))
    store.append(rows, str(tmp_path / "s"), "step")
    store.append(rows, str(tmp_path / "s"), "step")
    one = store.read_step(spark, str(tmp_path / "s"), 1)
    assert one.count() == 20 and "PartitionFilters: [isnotnull(step" in one._jdf.queryExecution().toString()


def test_run_states(spark):
    counters = spark.createDataFrame([(1, 3, 1), (2, 1, 0), (3, 9, 9)], "run_id long, ok long, failed long")
    totals = spark.createDataFrame([(1, 4, False), (2, 4, False), (3, 4, True)], "run_id long, total long, aborted boolean")
    assert {r.run_id: r.state for r in events.run_states(counters, totals).collect()} == {1: "ended", 2: "running", 3: "aborted"}
