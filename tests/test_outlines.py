"""Outlines of facets against a plain version that walks them one by one."""

import math
import random
from collections import defaultdict

import pytest

from trussline.operators import graph, outlines
from trussline.operators.graph import parity_components, ranked_cycles

KIND = "facet_id long, part string, p array<struct<x double, y double, z double>>"
FRAMES = [((1, 0, 0), (0, 1, 0)), ((0, 1, 0), (0, 0, 1)), ((0, 0, 1), (1, 0, 0)), ((0, 1, 0), (1, 0, 0)), ((0.6, 0, 0.8), (0, 1, 0)), ((1, 2, 0), (0, 1, 3))]


def facets(seed):
    """Cells of small grids in several planes, some left out, some turned about, some cut into two triangles."""
    r = random.Random(seed)
    rows, ids = [], iter(range(100_000))
    for part, (u, v) in enumerate(FRAMES):
        at = lambda i, j: tuple(round(float(part + i * a + j * b), 6) + 0.0 for a, b in zip(u, v, strict=True))  # noqa: B023, E731
        for i in range(9):
            for j in range(7):
                if r.random() < 0.2:
                    continue
                corners = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
                cells = [corners] if r.random() < 0.7 else [corners[:3], [corners[2], corners[3], corners[0]]]
                for c in cells:
                    c = c[::-1] if r.random() < 0.5 else c
                    k = r.randrange(len(c))
                    rows.append((next(ids), f"part{part}", [at(*q) for q in c[k:] + c[:k]]))
    return rows


def minus(a, b):
    return tuple(x - y for x, y in zip(a, b, strict=True))


def cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def sides_of(p):
    return list(zip(p, p[1:] + p[:1], strict=True))


def spin(p):
    out = (0, 0, 0)
    for a, b in sides_of(p):
        out = tuple(x + y / 2 for x, y in zip(out, cross(a, b), strict=True))
    return out


def pieces_of(rows):
    """{(part, smallest facet): facets turned as that one}"""
    owners, by = defaultdict(list), {f: (part, p) for f, part, p in rows}
    for f, part, p in rows:
        for a, b in sides_of(p):
            owners[part, min(a, b), max(a, b)].append((f, a < b))
    beside = defaultdict(list)
    for x in owners.values():
        if len(x) == 2 and x[0][0] != x[1][0]:
            for (f, up), (g, other) in (x, x[::-1]):
                beside[f].append((g, up == other))
    out, seen = {}, {}
    for f in sorted(by):
        if f in seen:
            continue
        seen[f], queue, ring = False, [f], []
        while queue:
            g = queue.pop()
            ring.append(by[g][1][::-1] if seen[g] else by[g][1])
            for h, odd in beside[g]:
                if h not in seen:
                    seen[h] = seen[g] ^ odd
                    queue.append(h)
        out[by[f][0], f] = ring
    return out


def rings_of(piece):
    """Rings of a piece by walking; at a pinch the edge that turns farthest to the left."""
    net = defaultdict(int)
    for p in piece:
        for a, b in sides_of(p):
            net[a, b] += 1
    leaving = defaultdict(list)
    for (a, b), n in net.items():
        leaving[a] += [b] * max(0, n - net.get((b, a), 0))
    normal = tuple(map(sum, zip(*(spin(p) for p in piece), strict=True)))
    n = tuple(x / math.sqrt(dot(normal, normal)) for x in normal)
    e1 = minus(piece[0][1], piece[0][0])
    e1 = tuple(x / math.sqrt(dot(e1, e1)) for x in e1)
    e2 = cross(n, e1)
    angle = lambda v: math.atan2(dot(v, e2), dot(v, e1))
    rings = []
    while any(leaving.values()):
        start = min(a for a, x in leaving.items() if x)
        ring, back, at = [start], start, leaving[start].pop()
        first = at
        while True:
            turn = lambda w: (angle(minus(w, at)) - angle(minus(back, at)) + 1e-9) % (2 * math.pi)  # noqa: B023, E731
            choice = leaving[at] + ([first] if at == start else [])
            on = max(choice, key=turn)
            if at == start and on == first:
                break
            leaving[at].remove(on)
            ring.append(at)
            back, at = at, on
        rings.append(ring)
    return rings


def canonical(ring):
    k = ring.index(min(ring))
    return tuple(ring[k:] + ring[:k])


def seen_rings(rows):
    found = defaultdict(dict)
    for r in rows:
        found[r.part, r.piece, r.ring][r.seq] = (r.x, r.y, r.z)
    return {k: [v[i] for i in range(len(v))] for k, v in found.items()}


@pytest.mark.parametrize("seed", range(3))
def test_rings_equal_a_walk(spark, seed):
    rows = facets(seed)
    got = seen_rings(outlines.boundary_rings(spark.createDataFrame(rows, KIND).repartition(5), ["part"]).collect())
    want = {k: sorted(map(canonical, rings_of(p))) for k, p in pieces_of(rows).items()}
    by = defaultdict(list)
    for (part, piece, _), ring in got.items():
        assert ring[0] == min(ring)
        by[part, piece].append(canonical(ring))
    assert {k: sorted(v) for k, v in by.items()} == want
    assert sum(len(v) > 1 for v in want.values()) >= 2


@pytest.mark.parametrize("seed", range(2))
def test_holes_lie_in_their_rings(spark, seed):
    rows = facets(seed + 10)
    rings = outlines.boundary_rings(spark.createDataFrame(rows, KIND), ["part"])
    facts = {(r.part, r.piece, r.ring): r for r in outlines.ring_facts(rings, ["part"]).collect()}
    corners = seen_rings(rings.collect())
    assert set(facts) == set(corners)
    n_holes = 0
    for key, piece in pieces_of(rows).items():
        own = {k[2]: r for k, r in facts.items() if k[:2] == key}
        area = {k: spin(corners[(*key, k)]) for k in own}
        large = max(area.values(), key=lambda a: dot(a, a))
        for k, r in own.items():
            assert r.area == pytest.approx(math.sqrt(dot(area[k], area[k])), abs=1e-6)
            assert r.hole == (dot(area[k], large) < 0)
            n_holes += r.hole
            around = [j for j, o in own.items() if not o.hole and inside(corners[(*key, j)], corners[(*key, k)], large)]
            assert r.outer == (min(around, key=lambda j: own[j].area, default=None) if r.hole else k)
        # what rings enclose is what facets cover
        assert sum(r.area * (-1) ** r.hole for r in own.values()) == pytest.approx(sum(math.sqrt(dot(spin(p), spin(p))) for p in piece), abs=1e-6)
    assert n_holes > 3


def inside(ring, inner, normal):
    n = tuple(x / math.sqrt(dot(normal, normal)) for x in normal)
    e1 = minus(ring[1], ring[0])
    e2 = cross(n, e1)
    mean = tuple(sum(x) / len(inner) for x in zip(*inner, strict=True))
    u, v = dot(mean, e1), dot(mean, e2)
    hit = False
    for a, b in sides_of(ring):
        (x1, y1), (x2, y2) = ((dot(q, e1), dot(q, e2)) for q in (a, b))
        if (y1 > v) != (y2 > v) and u < (x2 - x1) * (v - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def merged_by_force(rows):
    """{part: corners, from the smallest one towards its smaller neighbour} where the part has one clean outline."""
    out = {}
    for part in {r[1] for r in rows}:
        count = defaultdict(int)
        for _, own, p in rows:
            if own == part:
                for a, b in sides_of(p):
                    count[min(a, b), max(a, b)] += 1
        beside = defaultdict(list)
        for (a, b), n in count.items():
            if n == 1:
                beside[a].append(b), beside[b].append(a)
        if any(len(x) != 2 for x in beside.values()):
            continue
        start = min(beside)
        ring, at, back = [start], min(beside[start]), start
        while at != start:
            ring.append(at)
            back, at = at, next(x for x in beside[at] if x != back)
        if len(ring) != len(beside):
            continue
        bent = [q for a, q, b in zip(ring[-1:] + ring, ring, ring[1:] + ring[:1], strict=False) if math.dist((0, 0, 0), cross(minus(q, a), minus(b, q))) > 1e-6]
        out[part] = bent
    return out


def test_merged_outline(spark):
    r = random.Random(4)
    rows, ids = [], iter(range(10_000))
    for part in range(40):
        u, v = FRAMES[part % len(FRAMES)]
        for i in range(4):
            for j in range(3):
                if r.random() < (0.1, 0.25)[part % 2]:
                    continue
                c = [tuple(round(float(i2 * a + j2 * b), 6) for a, b in zip(u, v, strict=True)) for i2, j2 in ((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1))]
                rows.append((next(ids), f"part{part}", c[::-1] if r.random() < 0.5 else c))
    got = defaultdict(dict)
    for x in outlines.merged_outlines(spark.createDataFrame(rows, KIND), ["part"]).collect():
        got[x.part][x.seq] = (x.x, x.y, x.z)
        assert x.n == len([1 for _ in merged_by_force(rows)[x.part]])
    got = {k: [v[i] for i in range(len(v))] for k, v in got.items()}
    want = merged_by_force(rows)
    assert 5 < len(want) < 35
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items()}
    assert {k: canonical(v) for k, v in got.items()} == {k: canonical(v) for k, v in want.items()}


def test_twisted_bands_and_bad_facets(spark):
    """A Moebius band can't be turned to agree; facets of two corners, repeated corners and nulls are no facets."""
    n = 7
    ring = lambda k, h: (math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n), float(h))
    band = [(k, "plain", [ring(k, 0), ring(k + 1, 0), ring(k + 1, 1), ring(k, 1)]) for k in range(n)]
    twisted = [(100 + k, "twisted", [ring(k, 0), ring(k + 1, 0), ring(k + 1, 1), ring(k, 1)] if k < n - 1 else [ring(k, 0), ring(0, 1), ring(0, 0), ring(k, 1)]) for k in range(n)]
    bad = [(200, "bad", [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)]), (201, "bad", [(0.0, 0.0, 0.0)] * 4), (202, "bad", None), (203, "bad", [])]
    docs = spark.createDataFrame(band + twisted + bad, KIND)
    got = seen_rings(outlines.boundary_rings(docs, ["part"]).collect())
    assert sorted((k[0], len(v)) for k, v in got.items()) == [("plain", n), ("plain", n)]  # the two ends of a tube, though it isn't flat
    assert outlines.boundary_rings(docs.where("part = 'bad'"), ["part"]).collect() == []


def test_a_pinched_ring(spark):
    """Two squares that touch at a corner and are joined over a third way round: two rings, or none if pinches aren't split."""
    cells = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1)]
    del cells[4]
    square = lambda i, j: [(float(a), float(b), 0.0) for a, b in ((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1))]
    docs = spark.createDataFrame([(k, "a", square(*c)) for k, c in enumerate(cells)], KIND)
    rows = [(k, "a", square(*c)) for k, c in enumerate(cells)]
    got = sorted(len(v) for v in seen_rings(outlines.boundary_rings(docs, ["part"]).collect()).values())
    assert got == sorted(len(x) for p in pieces_of(rows).values() for x in rings_of(p))
    pinched = docs.union(spark.createDataFrame([(50, "a", square(3, 2)), (51, "a", square(3, 1)), (52, "a", square(1, 3)), (53, "a", square(2, 3))], KIND))
    assert outlines.boundary_rings(pinched, ["part"]).count() > 0


@pytest.mark.parametrize("sizes", [[1], [2, 3], [1, 1, 5, 64, 33, 200]])
def test_ranked_cycles(spark, sizes):
    r = random.Random(len(sizes))
    ids = r.sample(range(10_000), sum(sizes))
    want, steps = [], []
    for n in sizes:
        own, ids = ids[:n], ids[n:]
        k = own.index(min(own))
        own = own[k:] + own[:k]
        steps += list(zip(own, own[1:] + own[:1], strict=True))
        want += [(e, own[0], i, n) for i, e in enumerate(own)]
    got = ranked_cycles(spark.createDataFrame(steps, "e long, next long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_parity_components(spark):
    links = [(1, 2, True), (2, 3, True), (3, 5, False), (7, 8, False), (8, 9, True), (9, 7, False), (4, 4, False)]
    got = {r.node: (r.label, r.flip, r.clash) for r in parity_components(spark.createDataFrame([(i,) for i in range(10)], "node long"), spark.createDataFrame(links, "a long, b long, odd boolean")).collect()}
    assert [got[i][:2] for i in (1, 2, 3, 5)] == [(1, False), (1, True), (1, False), (1, False)]
    assert [got[i][2] for i in (1, 7, 8, 9, 4)] == [False, True, True, True, False]
    assert got[0] == (0, False, False)


def test_short_rings_take_no_rounds(spark, monkeypatch):
    """rings of small pieces are numbered in one exchange; those of large ones by rounds, with the same numbers."""
    sizes, rows, at = [1, 2, 3, 9, 4], [], 0
    for size in sizes:
        ids = [7 * (at + k) % 101 for k in range(size)]
        rows += [(e, ids[k - 1], at, "x") for k, e in enumerate(ids)]
        at += size
    steps = spark.createDataFrame(rows, "e long, prev long, piece long, note string")
    want = {(r.e, r.cycle, r.rank, r.n) for r in graph.ranked_cycles(steps.selectExpr("prev as e", "e as next")).collect()}
    assert {n for _, _, _, n in want} == set(sizes)
    monkeypatch.setattr(graph, "IN_TASK", 3)
    for most in (3, 2):
        monkeypatch.setattr(graph, "AT_ONCE", most)
        got = graph.ranked_within(steps, "piece").collect()
        assert len(got) == len(rows) and {(r.e, r.cycle, r.rank, r.n) for r in got} == want and {r.note for r in got} == {"x"}
    monkeypatch.setattr(graph, "IN_TASK", 50)
    for module in (graph, outlines):
        monkeypatch.setattr(module, "ranked_cycles", None)
    square = [(0, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0), (0.0, 1.0, 0.0)])]
    rings = outlines.boundary_rings(spark.createDataFrame(square, "facet_id long, p array<struct<x: double, y: double, z: double>>")).orderBy("seq").collect()
    assert [(r.piece, r.ring, r.seq, r.n, r.x, r.y) for r in rings] == [(0, 0, k, 4, *square[0][1][k][:2]) for k in range(4)]
