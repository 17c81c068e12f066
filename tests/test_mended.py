"""Cases in which earlier versions differed from what is asked for."""

import math
import random

import pytest
from pyspark.sql import functions as F

from trussline.functions import names, sections
from trussline.jobs import joblog, registry
from trussline.operators import members, parity, routes, spatial
from trussline.sources import decks


def prints(spark, rows):
    df = spark.createDataFrame(rows, "m string, t string")
    return [r.f for r in df.select(names.failure_fingerprint(F.lit("ifc"), F.lit("glb"), F.col("m"), F.col("t")).alias("f")).collect()]


def test_white_space_at_ends_makes_no_other_failure(spark):
    got = prints(spark, [("boom", "a\nValueError: x"), ("boom\n", "a\nValueError: x\t\n \t\r\n"), ("\t boom \r\n", "a\rValueError: x  "), ("bo om", "a\nValueError: x")])
    assert got[0] == got[1] == got[2] != got[3]
    assert spark.createDataFrame([("x\n\t",), ("\n",), (None,), ("  only ",)], "t string").select(names.last_line(F.col("t")).alias("l")).collect() == [("x",), ("",), ("",), ("only",)]


def test_run_progress_by_state(spark):
    states = ["ok", "running", "queued", "skipped", None]
    log = spark.createDataFrame([(i, 1, s, f"f{i}") for i, s in enumerate(states)] + [(9, 2, "failed", "x"), (10, 2, "skipped", "y")], "id long, run_id long, status string, file_key string")
    got = {r.run_id: (r.ok, r.failed, r.skipped, r.pending, r.state) for r in joblog.run_progress(log, 5).collect()}
    assert got == {1: (1, 0, 1, 3, "running"), 2: (0, 1, 1, 3, "running")}
    assert {r.run_id: r.state for r in joblog.run_progress(log, 2).collect()} == {1: "done", 2: "done"}


def test_nodes_of_an_end_section(spark):
    beams = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0, 0.3, 0.2, False)], "beam_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, h double, w double, is_round boolean")
    corners = [(10 * e + i, x, y, z) for e, x in ((1, 0.0), (2, 4.0)) for i, (y, z) in enumerate([(0.1, 0.15), (-0.1, 0.15), (0.1, -0.15), (-0.1, -0.15), (0.0, 0.0), (0.11, 0.0)])]
    got = {(r.end, r.node_id) for r in members.at_ends(spark.createDataFrame(corners + [(99, 0.01, 0.0, 0.0)], "node_id long, x double, y double, z double"), beams).collect()}
    assert got == {(e, 10 * e + i) for e in (1, 2) for i in range(5)}


def deck(spark, files):
    rows = [(f, i, t) for f, text in files.items() for i, t in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "file string, line long, text string")


def test_comments_inside_records(spark):
    lines = deck(spark, {"a": "*Element, type=S4, elset=e\n1, 1, 2,\n** a comment\n\n 3, 4\n2, 5,\n 6, 7,\n** another\n8\n*Node\n1, 0, 0, 0"})
    assert {(r.elem_id, tuple(r.nodes)) for r in decks.deck_elements(lines).collect()} == {(1, (1, 2, 3, 4)), (2, (5, 6, 7, 8))}


def test_sets_in_sets_to_any_depth(spark):
    lines = deck(spark, {"a": "*Node\n1, 0\n2, 0\n3, 0\n4, 0\n*Nset, nset=d\nc, 4\n*Nset, nset=c\nB\n*Nset, nset=b\nA, 2\n*Nset, nset=a\n1\n*Nset, nset=loop\nring, 3\n*Nset, nset=ring\nloop"})
    got = {}
    for r in decks.deck_sets(lines).collect():
        got.setdefault(r.set_name, set()).add(r.member_id)
    assert got == {"a": {1}, "b": {1, 2}, "c": {1, 2}, "d": {1, 2, 4}, "loop": {3}, "ring": {3}}


def test_includes_to_any_depth(spark, monkeypatch):
    files = {"f0": "top\n*Include, input=f1\nend"} | {f"f{i}": f"in {i}\n*include, input=f{i + 1}\nout {i}" for i in range(1, 24)} | {"f24": "last"}
    got = [r.text for r in decks.expanded(deck(spark, files)).orderBy("line").collect()]
    assert got == ["top", *[f"in {i}" for i in range(1, 24)], "last", *[f"out {i}" for i in range(23, 0, -1)], "end"]


def test_includes_in_a_circle_are_an_error(spark):
    files = {"main": "*Include, input=a"} | {"a": "x\n*Include, input=b", "b": "*Include, input=a"}
    with pytest.raises(ValueError):
        decks.expanded(deck(spark, files))


def parts(r, n, prefix):
    return [(f"{prefix}{i}", r.uniform(0, 40), r.uniform(0, 40), r.uniform(0, 5), math.exp(r.uniform(-2, 4)), r.uniform(1, 2)) for i in range(n)]


def matched(a, b, size):
    pairs = sorted((math.dist(x[1:4], y[1:4]), x[0], y[0]) for x in a for y in b if math.dist(x[1:4], y[1:4]) <= min(x[4], y[4]) / 2 + size and min(x[5], y[5]) / max(x[5], y[5]) >= 1 / 3)
    used, out = set(), set()
    for _, x, y in pairs:
        if x not in used and y not in used:
            used |= {x, y}
            out.add((x, y))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_matches_of_parts_of_any_size(spark, seed):
    r = random.Random(seed)
    a, b = parts(r, 25, "a"), parts(r, 25, "b")
    kind = "name string, cx double, cy double, cz double, diagonal double, area double"
    got = {(x.name_a, x.name_b) for x in parity.match_by_centroid(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 1.0).collect()}
    assert got == matched(a, b, 1.0)


TEXTS = {
    "BG800x600x20x30": ("box", 0.8, 0.6, 0.02, 0.03, None), "OD400x10": ("tube", 0.4, None, 0.01, None, None), "TUB200x10": ("tube", 0.4, None, 0.01, None, None), "HEA300": ("profile", None, None, None, None, "HEA300"),
    "T650x300x25x40": ("tee", 0.65, 0.3, 0.025, 0.04, None), "HP180x10": ("profile", None, None, None, None, "HP180x10"), "UNP180x10": ("profile", None, None, None, None, "UNP180"), "CIRC100": ("round", 0.2, None, None, None, None),
    "FB100x10": ("bar", 0.1, 0.01, None, None, None), "he240m": ("profile", None, None, None, None, "HEM240"), "L100x8": ("angle", 0.1, 0.1, 0.008, 0.008, None), "Pile": (None,) * 6,
}


def test_section_texts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", sections.from_text(F.col("t")).alias("s")).select("t", "s.*").collect()
    assert {r.t: tuple(v if v is None or isinstance(v, str) else round(v, 9) for v in r[1:]) for r in rows} == TEXTS


def strips(kind, h, w, t, tf, wb, tb, n=4000):
    """Area and both second moments by summing thin strips of the outline: rectangles (y0, y1, z0, z1)."""
    if kind == "box":
        rects = [(0, w, h - tf, h), (0, wb, 0, tb), (0, t, tb, h - tf), (w - t, w, tb, h - tf)]
    elif kind in ("i", "tee"):
        rects = [(-w / 2, w / 2, h - tf, h), (-t / 2, t / 2, tb, h - tf)] + ([(-wb / 2, wb / 2, 0, tb)] if kind == "i" else [])
    elif kind == "angle":
        rects = [(0, t, tf, h), (0, w, 0, tf)]
    elif kind == "channel":
        rects = [(0, w, h - tf, h), (0, w, 0, tf), (0, t, tf, h - tf)]
    else:
        rects = [(0, w, 0, h)]
    size = sum((b - a) * (d - c) for a, b, c, d in rects)
    out = [size]
    for i in (2, 0):
        bars = []
        for r in rects:
            lo, hi = r[i], r[i + 1]
            wide = r[1 - i + 2 if i else 3] - r[0 if i else 2]
            step = (hi - lo) / n
            bars += [(lo + (k + 0.5) * step, step * wide) for k in range(n)]
        mean = sum(z * a for z, a in bars) / size
        out.append(sum(a * (z - mean) ** 2 for z, a in bars))
    return out


@pytest.mark.parametrize("kind", ["box", "i", "tee", "angle", "channel", "bar"])
def test_moments_equal_sums_of_strips(spark, kind):
    h, w, t, tf = 0.4, 0.25, 0.012, 0.02
    wb, tb = (0.25, 0.02) if kind in ("box", "channel", "angle", "bar") else (0.18, 0.015) if kind == "i" else (0.0, 0.0)
    row = spark.createDataFrame([(kind, h, w, t, tf, wb, tb)], "kind string, h double, w double, t double, tf double, wb double, tb double")
    args = [F.col(c) for c in row.columns]
    got = row.select(sections.area(*args), sections.inertia(*args), sections.weak_inertia(*args)).first()
    assert tuple(got) == pytest.approx(strips(kind, h, w, t, tf, wb, tb), rel=1e-5)


def box_by_hand():
    """Of the text BG800x600x20x30, worked out in millimetres."""
    h, w, t, f = 800.0, 600.0, 20.0, 30.0
    clear, ha, hb = h - 2 * f, h - f, w - t
    a = 2 * w * f + 2 * t * clear
    iy = 2 * (w * f**3 / 12 + w * f * (h / 2 - f / 2) ** 2) + 2 * t * clear**3 / 12
    iz = 2 * f * w**3 / 12 + 2 * (clear * t**3 / 12 + clear * t * (hb / 2) ** 2)
    ix = 4 * (ha * hb) ** 2 / (hb / f + hb / t + 2 * ha / t)
    sy, sz = w * f * (h / 2 - f / 2) + t * (h / 2 - f) ** 2, 2 * f * w * w / 8 + t * clear * hb / 2
    return {"ax": a, "iy": iy, "iz": iz, "ix": ix, "wymin": iy / (h / 2), "wzmin": iz / (w / 2), "wxmin": ix * (ha + hb) / (ha * hb), "sy": sy, "sz": sz, "shary": iz / sz * 2 * t, "sharz": iy / sy * 2 * t, "cy": w / 2, "cz": h / 2, "shcenz": 0.0, "iyz": 0.0}


def test_all_properties(spark):
    kind = "kind string, h double, w double, t double, tf double"
    rows = [("box", 800.0, 600.0, 20.0, 30.0), ("round", 200.0, None, None, None), ("tube", 400.0, None, 10.0, None), ("bar", 100.0, 10.0, None, None), ("i", 650.0, 300.0, 25.0, 40.0), ("tee", 650.0, 300.0, 25.0, 40.0), ("angle", 100.0, 100.0, 8.0, 8.0), ("channel", 180.0, 70.0, 8.0, 11.0), ("poly", 1.0, 1.0, 1.0, None), ("profile", None, None, None, None), ("angle", 100.0, 100.0, 8.0, 6.0)]
    df = spark.createDataFrame(rows, kind)
    got = [r.p for r in df.coalesce(1).select(sections.properties(*(F.col(c) for c in df.columns)).alias("p")).collect()]
    assert got[8:] == [None, None, None]
    assert all(set(p.asDict()) == set(sections.PROPERTIES) and None not in p.asDict().values() for p in got[:8])
    box = got[0].asDict()
    for name, value in box_by_hand().items():
        assert box[name] == pytest.approx(value, rel=1e-9, abs=1e-6), name
    r = 100.0
    assert (got[1].ax, got[1].ix, got[1].wymin, got[1].wxmin) == pytest.approx((math.pi * r**2, math.pi * r**4 / 2, math.pi * r**3 / 4, math.pi * r**3 / 2))
    assert (got[2].ax, got[2].ix) == pytest.approx((math.pi * (200**2 - 190**2), math.pi / 2 * (200**4 - 190**4)))
    assert got[3].wymin == pytest.approx(10 * 100**2 / 6) and got[3].wzmin == pytest.approx(100 * 10**2 / 6)
    foot = got[5]
    assert foot.cz == pytest.approx((300 * 40 * 630 + 25 * 610 * 305) / (300 * 40 + 25 * 610))
    assert got[4].cz == pytest.approx(325) and got[4].shcenz == pytest.approx(0, abs=1e-9)
    assert got[6].cgz == pytest.approx(got[6].cgy) and got[6].shceny < 0
    assert got[7].cgy == pytest.approx((2 * 70 * 11 * 35 + 158 * 8 * 4) / (2 * 70 * 11 + 158 * 8)) and got[7].cz == 90


def test_near_joints_and_a_factory(spark):
    """Places either side of a rounding limit are one joint; a function may make nothing of a joint."""
    lines = [(1, 0.0, 0.0, 10.0, 0.0), (2, 2.00004, -1.0, 2.00004, 1.0), (3, 2.00006, -1.0, 2.00006, 1.0), (4, 7.0, -1.0, 7.0, 1.0)]
    beams = spark.createDataFrame([(i, a, b, 0.0, c, d, 0.0) for i, a, b, c, d in lines], "beam_id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    crossings = spatial.beam_crossings(beams)
    assert members.joints(crossings, beams).count() == 3
    found = members.near_joints(crossings, beams)
    got = sorted((round(r.x, 5), tuple(r.members)) for r in found.collect())
    assert got == [(2.00005, (1, 2, 3)), (7.0, (1, 4))]
    made = members.made_joints(found, lambda number, who, at: {"kind": "big", "n": len(who)} if len(who) > 2 else None, "kind string, n long, weight double")
    assert [tuple(r) for r in made.collect()] == [("big", 3, None)]
    assert members.near_joints(crossings.limit(0), beams).collect() == []


def test_mode_values_grow_with_the_table(spark):
    folder = "/root/testdata/sf0.001"
    assert registry.QUERIES["mode_values"](spark, folder).count() == 6 * spark.read.parquet(f"{folder}/supplier.parquet").count()


def test_slanted_faces_equal_all_pairs(spark):
    r = random.Random(5)
    spot = lambda w=12: tuple(r.uniform(-w, w) for _ in range(3))
    faces = []
    for i in range(60):
        o, u, v = spot(), *((spot(1), spot(1)) if i % 3 else (spot(9), spot(9)))
        faces.append((i, [o, tuple(a + b for a, b in zip(o, u, strict=True)), tuple(a + b + c for a, b, c in zip(o, u, v, strict=True)), tuple(a + c for a, c in zip(o, v, strict=True))]))
    faces.append((99, [(0.0, 0.0, 0.0), (4.0, 0.0, 0.0), (4.0, 4.0, 0.0), (0.0, 4.0, 0.0)]))
    segments = [(0, k, *spot(), *spot()) for k in range(150)] + [(1, 0, 2.0, 2.0, -1.0, 2.0, 2.0, 1.0), (1, 1, 2.0, 2.0, 0.0, 2.0, 2.0, 8.0), (1, 2, 1.0, 1.0, 0.0, 3.0, 1.0, 0.0), (1, 3, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    want = set()
    for f, p in faces:
        n = [0.0, 0.0, 0.0]
        for a, b in zip(p, p[1:] + p[:1], strict=True):
            n = [n[0] + a[1] * b[2] - a[2] * b[1], n[1] + a[2] * b[0] - a[0] * b[2], n[2] + a[0] * b[1] - a[1] * b[0]]
        n = [x / math.hypot(*n) for x in n]
        for system, seq, *ends in segments:
            a, d = ends[:3], [y - x for x, y in zip(ends[:3], ends[3:], strict=True)]
            across = sum(x * y for x, y in zip(n, d, strict=True))
            if abs(across) < 1e-6:
                continue
            t = sum(x * (y - z) for x, y, z in zip(n, p[0], a, strict=True)) / across
            hit = [x + t * y for x, y in zip(a, d, strict=True)]
            if 0 <= t <= 1 and all(min(c) - 1e-6 <= h <= max(c) + 1e-6 for h, c in zip(hit, zip(*p, strict=True), strict=True)):
                want.add((system, seq, f))
    kind = "face_id long, p array<struct<x double, y double, z double>>"
    for size in (0.7, 2.0, 30.0):
        got = routes.polygon_crossings(spark.createDataFrame(segments, "system long, seq long, x double, y double, z double, x2 double, y2 double, z2 double"), spark.createDataFrame(faces, kind), size=size)
        assert {(r.system, r.seq, r.face_id) for r in got.collect()} == want
    assert len(want) > 30 and {(1, 0, 99), (1, 1, 99)} <= want
