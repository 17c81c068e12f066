"""Large groups of texts that are apart from their leader: classes against brute force, and no row for each pair."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa

from trussline.llm import nearcopies


def family_texts(n):
    """n texts of one common part and one of four middles, each with an end of its own (under 0.8 alike also within a middle); every 20th has a near copy."""
    r = random.Random(7)
    word = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    base, middles, rows = word(150), [word(25) for _ in range(4)], []
    for i in range(n):
        own = base + middles[i % 4] + word(25)
        rows.append((i, " ".join(own)))
        if i % 20 == 1:
            own[185] = "changed"
            rows.append((1000 + i, " ".join(own)))
    return rows


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_no_row_for_each_pair_of_a_group(spark, monkeypatch):
    rows, counts, cut = family_texts(600), [], nearcopies.cut

    def counted(df):
        out = cut(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "cut", counted)
    if hasattr(nearcopies, "BLOCK"):
        monkeypatch.setattr(nearcopies, "BLOCK", 100_000)  # several blocks a leader
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in nearcopies.near_duplicates(docs).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    sets = dict((i, shingles(t)) for i, t in rows)
    assert all(len(sets[i] & sets[i - 1000]) >= 0.8 * len(sets[i] | sets[i - 1000]) for i in sets if i >= 1000)
    assert max(counts) <= nearcopies.SKETCHES * len(rows)


def test_two_blocks_give_the_links_that_join_classes():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**32, 100, dtype=np.uint32)
    moved = [np.concatenate([base[20 * k :], base[: 20 * k]]) for k in range(5)]  # alike as sets, but in five orders
    texts = [moved[i % 5].copy() for i in range(40)]
    for i, t in enumerate(texts):
        t[i] = i
    order = lambda t: next(k for k, m in enumerate(moved) if (t == m).sum() > 80)
    assert [order(t) for t in texts] == [i % 5 for i in range(40)]
    block = np.arange(40) // 20

    def joined(**columns):
        rows = {"a": [99] * 40, "lo": [0] * 40, "hi": [1] * 40, "block": block, "label": np.arange(40), "best": [99] * 40, "packed": [t.tobytes() for t in texts]} | columns
        out = nearcopies._joins(Fraction(4, 5))(pa.table(rows))
        return list(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))

    for in_vain in (256, 0):  # with and without finer sketches
        nearcopies_in_vain, nearcopies.IN_VAIN = nearcopies.IN_VAIN, in_vain
        pairs = joined()
        nearcopies.IN_VAIN = nearcopies_in_vain
        assert len(pairs) == 35 and all(i % 5 == j % 5 and block[i] != block[j] for i, j in pairs)  # five trees over eight texts
    assert joined(label=[i % 5 for i in range(40)]) == [] and joined(best=[7] * 40) == []
    assert len(joined(hi=[0] * 40, block=[0] * 40)) == 35


def test_blocks_leave_no_link_out_after_alignments_in_vain(monkeypatch):
    """Moved, edited and repeated passages about the bound: classes as by aligning every pair."""
    monkeypatch.setattr(nearcopies, "IN_VAIN", 0)
    least, r, texts = Fraction(4, 5), np.random.default_rng(3), []
    for k in range(12):
        base = r.integers(0, 2**32, 60, dtype=np.uint32)
        if k % 2:
            texts += [np.tile(base, 9), np.tile(base, 2)]  # the shorter one is in order within the longer one
        texts.append(r.permutation(base))
        for share in (3, 6, 9, 12, 13):
            moved = base.copy()
            moved[20 : 20 + share], moved[20 + share : 40] = base[40 - share : 40].copy(), base[20 : 40 - share].copy()
            moved[r.integers(0, 60, share // 4)] = r.integers(0, 2**32)
            texts += [moved, np.roll(base, share)]
    n = len(texts)
    rows = {"a": [-1] * n, "lo": [0] * n, "hi": [0] * n, "block": [0] * n, "label": np.arange(n), "best": [-1] * n, "packed": [t.tobytes() for t in texts]}
    out = nearcopies._joins(least)(pa.table(rows))

    def classes(pairs):
        label = list(range(n))
        for i, j in pairs:
            low, high = sorted((label[i], label[j]))
            label = [low if v == high else v for v in label]
        return label

    linked = [(i, j) for i in range(n) for j in range(i) if nearcopies.similar(texts[i], texts[j], least)]
    got = classes(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))
    assert 30 < len(linked) and len(set(got)) > 12 and got == classes(linked)
