"""SimHash groups against all pairs, and the parts of the work alone."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trussline.llm import simhash
from trussline.llm.simhash import forest, near_pairs, simhash_groups, text_fingerprint


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def grouped(nodes, linked):
    """Smallest node that each can reach."""
    out = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for x, y in linked:
            low = min(out[x], out[y])
            changed |= (out[x], out[y]) != (low, low)
            out[x] = out[y] = low
    return out


def words(r, n, of=500):
    return [f"w{r.randrange(of)}é" for _ in range(n)]


def edited(r, w):
    w = list(w)
    for _ in range(r.randrange(3)):
        w[r.randrange(len(w))] = f"edit{r.randrange(999)}"
    return w


def rows():
    r = random.Random(7)
    made = []
    for n in (150, 60, 30, 12, 4):
        base = words(r, n)
        made += [" ".join(edited(r, base)) for _ in range(14)]
    made += ["one two", "One  TWO", "one", "", None, " \n\t\x0b", "É é É", "É é É", "a b c a b c a b c", *[made[0]] * 20]
    return list(enumerate(made)) + [(500, made[3]), (500, made[20]), (None, made[40]), (None, "nobody else has these words at all"), (-3, made[60])]


def test_groups_equal_all_pairs(spark):
    given = rows()
    prints = [plain_fingerprint(t) for _, t in given]
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    of = grouped(range(len(prints)), links)
    least = {}
    for i, (doc, _) in enumerate(given):
        if doc is not None:
            least[of[i]] = min(least.get(of[i], doc), doc)
    want = sorted(((doc, f"{p:016x}", least.get(of[i])) for i, ((doc, _), p) in enumerate(zip(given, prints, strict=True))), key=str)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in given], "doc_id long, text string, print string, component_id string")
    for settings in ({}, {"n_parts": 8}, {"n_parts": 1, "tile": 7}, {"n_parts": 2, "tile": 3}):
        got = simhash_groups(docs, **settings).select("doc_id", simhash.as_hex(), "component_id").collect()
        assert sorted(map(tuple, got), key=str) == want, settings
    assert len({x[2] for x in want}) < len(prints) - 40


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert simhash_groups(docs).collect() == []


def test_fingerprint_in_blocks(monkeypatch):
    texts = [" ".join(words(random.Random(i), n)) for i, n in enumerate((0, 1, 2, 3, 4, 90, 700))] + ["x" * 300 + " y z", "  lead and trail  "]
    for block in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert [text_fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_hash_is_sparks_own(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("é b c"))).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("é b c".encode(), 42)


@pytest.mark.parametrize("seed", range(4))
def test_near_pairs_connect_as_all_pairs_do(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 64, 6, dtype=np.uint64)
    made = {0, (1 << 64) - 1}
    for c in centres.tolist():
        for _ in range(40):
            made.add(c ^ sum({1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 6)))}))
    made = sorted(made)
    links = [(x, y) for i, x in enumerate(made) for y in made[:i] if (x ^ y).bit_count() <= 3]
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in made], "print long")
    for n_parts, tile in ((4, 4096), (4, 5), (8, 9), (1, 50)):
        got = [(r.a % 2**64, r.b % 2**64) for r in near_pairs(df, n_parts=n_parts, tile=tile).collect()]
        assert set(got) <= set(links) | {(y, x) for x, y in links}
        assert grouped(made, got) == grouped(made, links)


def test_dense_group_gives_few_links():
    """All within two bits of one centre, so within four of each other: nearly all pairs are links, the forest has no more rows than fingerprints."""
    x = np.array([1 << i | 1 << j for i in range(64) for j in range(i)], np.uint64)
    one, two = forest(x, x, 4)
    assert len(one) <= 2 * len(x)
    assert set(grouped(range(len(x)), zip(one, two, strict=True)).values()) == {0}
