"""Simplified polygons and part trees against plain versions."""

import math
import random

import pytest

from trussline.operators import simplify, tree

KIND = "poly_id long, seq long, x double, y double, z double"


def polygon(r, n):
    """A star of n corners about a centre, with steps along its sides, in a plane of its own."""
    u, v = r.choice([((1, 0, 0), (0, 1, 0)), ((0, 1, 0), (0, 0, 1)), ((0.6, 0, 0.8), (0, 1, 0))])
    corners = [((3 + r.uniform(0, 2)) * math.cos(2 * math.pi * k / n), (3 + r.uniform(0, 2)) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    steps = []
    for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1], strict=True):
        steps.append((a, b))
        steps += [(a + (c - a) * k / 6 + r.uniform(-1, 1) * r.choice([0, 0.01, 0.08]), b + (d - b) * k / 6 + r.uniform(-1, 1) * 0.02) for k in range(1, r.choice([1, 6]))]
    return [tuple(p * a + q * b for a, b in zip(u, v, strict=True)) for p, q in steps]


def distance(p, a, b):
    line, away = [y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, p, strict=True)]
    length = math.dist(a, b)
    c = (line[1] * away[2] - line[2] * away[1], line[2] * away[0] - line[0] * away[2], line[0] * away[1] - line[1] * away[0])
    return math.hypot(*away) if length < 1e-12 else math.hypot(*c) / length


def area(p):
    f, s = p[0], [0.0, 0.0, 0.0]
    for a, b in zip(p, p[1:] + p[:1], strict=True):
        a, b = [x - y for x, y in zip(a, f, strict=True)], [x - y for x, y in zip(b, f, strict=True)]
        s = [s[0] + (a[1] * b[2] - a[2] * b[1]) / 2, s[1] + (a[2] * b[0] - a[0] * b[2]) / 2, s[2] + (a[0] * b[1] - a[1] * b[0]) / 2]
    return math.hypot(*s)


def plain(p, rel=0.01, change=0.02):
    n = len(p)
    if n < 4:
        return p, False
    size = [max(x) - min(x) for x in zip(*p, strict=True)]
    axis, tol = size.index(max(size)), rel * max(*size, 1.0)
    a, b = sorted((min(range(n), key=lambda i: p[i][axis]), max(range(n), key=lambda i: (p[i][axis], -i))))
    ring = p[a:] + p[: a + 1]
    keep, stack = {0, b - a}, [(0, b - a), (b - a, n)]
    while stack:
        lo, hi = stack.pop()
        if hi <= lo + 1:
            continue
        k = max(range(lo + 1, hi), key=lambda i: (distance(ring[i], ring[lo], ring[hi]), -i))
        if distance(ring[k], ring[lo], ring[hi]) > tol:
            keep.add(k)
            stack += [(lo, k), (k, hi)]
    out = [p[i] for i in sorted((k + a) % n for k in keep)]
    if len(out) < 3 or area(p) > 1e-12 and abs(area(out) - area(p)) > change * area(p):
        return p, False
    return out, True


def test_simplified_equals_a_plain_version(spark):
    r = random.Random(6)
    polygons = {i: polygon(r, r.randrange(3, 9)) for i in range(40)}
    polygons |= {100: [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)], 101: [(2.0, 2.0, 2.0)] * 5, 102: [(0.0, 0.0, 0.0), (5.0, 0.0, 0.0), (5.0, 0.01, 0.0), (0.0, 0.01, 0.0)]}
    rows = [(i, k, *map(float, q)) for i, p in polygons.items() for k, q in enumerate(p)]
    got = {}
    for x in simplify.simplified(spark.createDataFrame(rows, KIND).repartition(3)).collect():
        got.setdefault(x.poly_id, {})[x.seq] = ((x.x, x.y, x.z), x.changed, x.n)
    for i, p in polygons.items():
        want, changed = plain(p)
        assert [got[i][k][0] for k in range(len(got[i]))] == [pytest.approx(q) for q in want], i
        assert {(c, n) for _, c, n in got[i].values()} == {(changed, len(want))}
    assert sum(len(v) for v in got.values()) < 0.7 * len(rows)
    assert simplify.simplified(spark.createDataFrame([], KIND)).collect() == []


def test_welds_of_a_member_over_the_tree(spark):
    r = random.Random(3)
    parts = [(i, None if i in (0, 50) else r.randrange(max(0, i - 9), i) if i < 50 else r.randrange(50, i) if i > 50 else None) for i in range(90)] + [(200, 201), (201, 200), (300, 999)]
    parts = [(i, p) for i, p in parts]
    welds = [(k, r.choice(parts)[0]) for k in range(150)]
    members = [(k, r.randrange(12)) for k, _ in welds for _ in range(r.randrange(4))]
    parent = dict(parts)

    def chain(p):
        seen = []
        while p is not None and p in parent and p not in seen:
            seen.append(p)
            p = parent[p]
        return seen

    spans = tree.intervals(spark.createDataFrame(parts, "part_id long, parent_id long"))
    rows = {x.part_id: x for x in spans.collect()}
    assert set(rows) == {p for p, _ in parts} - {200, 201}
    assert sorted(x.low for x in rows.values()) == list(range(len(rows)))
    for p in rows:
        assert rows[p].depth == len(chain(p)) - 1
        assert {q for q in rows if rows[p].low <= rows[q].low <= rows[p].high} == {q for q in rows if p in chain(q)}
    got = tree.welds_for(spark.createDataFrame(welds, "weld_id long, part_id long"), spark.createDataFrame(members, "weld_id long, member_id long"), spans)
    want = {(p, m, k) for k, at in welds for p in chain(at) if p in rows and at in rows for w, m in members if w == k}
    assert sorted(map(tuple, got.collect())) == sorted(want)
