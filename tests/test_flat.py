"""Flat patches against growing one after the other, and surfaces of made patches against numpy's decompositions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from trussline.operators import flat

KIND = "facet_id long, part string, p array<struct<x double, y double, z double>>"


def grid(seed, wave, n=9, m=7):
    """Quads and triangles over a wavy sheet, ids dealt at random."""
    r = random.Random(seed)
    height = [[wave * math.sin(i / 2.0) + wave * 0.6 * math.cos(j / 1.5) + r.uniform(-1, 1) * wave * 0.05 for j in range(m + 1)] for i in range(n + 1)]
    at = lambda i, j: (float(i), float(j), height[i][j])
    cells = []
    for i in range(n):
        for j in range(m):
            c = [at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)]
            cells += [c] if r.random() < 0.6 else [c[:3], [c[2], c[3], c[0]]]
    ids = r.sample(range(5 * len(cells)), len(cells))
    return [(k, "ab"[r.random() < 0.15], c) for k, c in zip(ids, cells, strict=True)]


def plane(p):
    p = np.array(p)
    n = sum(np.cross(a, b) for a, b in zip(p, np.roll(p, -1, 0), strict=True))
    return p.mean(0), n / np.linalg.norm(n)


def one_by_one(rows, dev):
    owners = defaultdict(list)
    for k, part, p in rows:
        for a, b in zip(p, p[1:] + p[:1], strict=True):
            owners[part, min(a, b), max(a, b)].append(k)
    beside = defaultdict(set)
    for x in owners.values():
        if len(x) == 2:
            beside[x[0]].add(x[1]), beside[x[1]].add(x[0])
    of = {k: p for k, _, p in rows}
    seed = {}
    for s in sorted(of):
        if s in seed:
            continue
        m, n = plane(of[s])
        seed[s], queue = s, [s]
        while queue:
            for k in beside[queue.pop()]:
                if k not in seed and np.abs((np.array(of[k]) - m) @ n).max() <= dev:
                    seed[k] = s
                    queue.append(k)
    return seed


@pytest.mark.parametrize("seed,wave,dev", [(1, 0.3, 0.15), (2, 1.0, 0.3), (3, 0.02, 0.1)])
def test_patches_equal_growing_one_by_one(spark, seed, wave, dev):
    rows = grid(seed, wave)
    got = flat.flat_patches(spark.createDataFrame(rows, KIND).repartition(3), ["part"], dev).collect()
    want = one_by_one(rows, dev)
    assert {r.facet_id: r.seed for r in got} == want
    assert 1 < len(set(want.values())) < len(rows)


def test_auto_deviation(spark):
    rows = grid(1, 0.3)
    corners = np.array([q for _, _, p in rows for q in p])
    assert flat.auto_deviation(spark.createDataFrame(rows, KIND)) == pytest.approx(1e-3 * np.linalg.norm(corners.max(0) - corners.min(0)))
    assert flat.auto_deviation(spark.createDataFrame([], KIND)) == pytest.approx(1e-12)
    assert flat.flat_patches(spark.createDataFrame([], KIND), ["part"], 0.1).collect() == []


def made(name, r):
    q, _ = np.linalg.qr(np.array([[r.gauss(0, 1) for _ in range(3)] for _ in range(3)]))
    shift = np.array([r.uniform(-50, 50) for _ in range(3)])

    def at(i, j):
        if name.startswith("plane"):
            v = (i * 0.7, j * 1.1, 1e-5 * ((i * j) % 3))
        elif name.startswith("tube") or name.startswith("arc") or name.startswith("short"):
            turn = 2 * math.pi * i / 24 if name.startswith("tube") else 1.4 * i / 24
            v = (3 * math.cos(turn), 3 * math.sin(turn), j * (0.02 if name.startswith("short") else 0.9))
        else:
            v = (2 * math.sin(j / 8 + 0.3) * math.cos(i / 5), 2 * math.sin(j / 8 + 0.3) * math.sin(i / 5), 2 * math.cos(j / 8 + 0.3))
        return tuple(map(float, q @ np.array(v) + shift))

    return [[at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)] for i in range(24) for j in range(10)]


def by_numpy(facets):
    pts = np.vstack([np.array(p) for p in facets])
    c = pts.mean(0)
    n = np.linalg.svd(pts - c, full_matrices=False)[2][-1]
    dev = np.abs((pts - c) @ n).max() / np.linalg.norm(pts.max(0) - pts.min(0))
    nn = np.array([plane(p)[1] for p in facets])
    axis = np.linalg.svd(nn - nn.mean(0), full_matrices=False)[2][-1]
    e1 = np.cross(axis, [1, 0, 0] if abs(axis[0]) < 0.9 else [0, 1, 0])
    e1 /= np.linalg.norm(e1)
    u, v = (pts - c) @ e1, (pts - c) @ np.cross(axis, e1)
    s = np.linalg.lstsq(np.column_stack([u, v, np.ones_like(u)]), u * u + v * v, rcond=None)[0]
    radius = math.sqrt(s[2] + s[0] ** 2 / 4 + s[1] ** 2 / 4)
    rel = np.abs(np.hypot(u - s[0] / 2, v - s[1] / 2) - radius).max() / radius
    span = np.ptp((pts - c) @ axis) / radius
    return ("planar" if dev <= 1e-3 else "cylinder" if rel <= 0.02 and span > 0.3 else "freeform"), dev, radius, rel, span


def test_surfaces_equal_decompositions(spark):
    r = random.Random(8)
    names = [f"{k}{i}" for k in ("plane", "tube", "arc", "short", "ball") for i in range(3)]
    patches = {n: made(n, r) for n in names}
    rows = [(i, n, p) for n, ps in patches.items() for i, p in enumerate(ps)]
    got = {x.part: x for x in flat.classify_patches(spark.createDataFrame(rows, KIND), ["part"]).collect()}
    assert set(got) == set(names)
    for n, ps in patches.items():
        surface, dev, radius, rel, span = by_numpy(ps)
        assert got[n].surface == surface, n
        if n.startswith(("plane", "arc", "short")):  # of a whole tube two directions are as good
            assert got[n].plane_dev == pytest.approx(dev, abs=1e-6)
        if surface == "cylinder":
            assert (got[n].radius, got[n].rel_dev, got[n].span) == pytest.approx((radius, rel, span), abs=1e-5)
    assert [got[f"{k}0"].surface for k in ("plane", "tube", "arc", "short", "ball")] == ["planar", "cylinder", "cylinder", "freeform", "freeform"]


def test_surfaces_of_odd_patches(spark):
    one = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)]
    rows = [(1, "one", one), (2, "none", one[:2]), (3, "null", None), (4, "spot", [one[0]] * 3), (5, "line", [one[0], one[1], (2.0, 0.0, 0.0)])]
    got = {x.part: x.surface for x in flat.classify_patches(spark.createDataFrame(rows, KIND), ["part"]).collect()}
    assert got == {"one": "planar", "spot": "planar", "line": "planar"}


def test_flat_strips_need_no_rounds(spark, monkeypatch):
    """A strip of 64 squares with a fold in its middle: the state is written twice, however wide a patch is."""
    states, write = [], flat.written
    monkeypatch.setattr(flat, "written", lambda df: states.append(1) or write(df))
    z = lambda x: float(abs(x - 32))
    rows = [(i, "a", [(float(i + dx), float(dy), z(i + dx)) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))]) for i in range(64)]
    facets = spark.createDataFrame(rows, "facet_id long, part string, p array<struct<x: double, y: double, z: double>>")
    got = dict(flat.flat_patches(facets, ["part"], 1e-3).select("facet_id", "seed").collect())
    assert got == {i: 0 if i < 32 else 32 for i in range(64)}
    assert len(states) == 2
