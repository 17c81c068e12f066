"""Repair of conversations against a plain search over single edits, in chunks of any size."""

import hashlib
import heapq
import random
import zlib

import pytest
from pyspark.sql import functions as F

from trussline.llm import repair
from trussline.llm.repair import SPECULATIVE, TERMINAL, alike, costs, damaged, fixed_up, matrix, repair_conversations

KIND = "conv_id long, turn long, role string, text string, mine string, copies string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WHITE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def cheapest(codes):
    """Least (cost, audit) by Dijkstra over (rows done, last initial), and the roles put out; codes: (initial, must go, truncated)."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, put = heapq.heappop(queue)
        if i == len(codes) and last in ("", "a"):
            return cost, audit, put
        if (i, last) in done:
            continue
        done.add((i, last))
        nexts = [c for c in "sua" if last + c in ("s", "u", "su", "ua", "au")]
        for c in nexts:
            if c != "s":
                heapq.heappush(queue, (cost + 3, audit + "I", i, c, (*put, (None, c))))
        if i < len(codes):
            initial, must, cut = codes[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, last, put))
            for c in nexts if not must else ():
                if c == initial:
                    heapq.heappush(queue, (cost + 3 * cut, audit + "K", i + 1, c, (*put, (i, None))))
                if c != "s":
                    heapq.heappush(queue, (cost + 3 + 3 * cut, audit + "R", i + 1, c, (*put, (i, c))))
    raise AssertionError


def plain(rows):
    out = []
    after = plain_damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in own if t is not None}
        seen, codes, n = set(), [], [0, 0, 0]
        for _, role, text in own:
            solid = text.strip(WHITE)
            fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            codes.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:], strict=False))
        cost, audit, put = cheapest(codes)
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names[c] if c else own[i][1]}:{'' if i is None else own[i][2]}" for i, c in put]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=5):
    r = random.Random(seed)
    rows = []
    for conv in range(50):
        turn = r.randrange(3)
        for i in range(r.randrange(1, 12)):
            role = r.choice(["user", "assistant"]) if r.random() < 0.3 else ("user", "assistant")[i % 2]
            role = r.choice(["system", "tool", "", None, "User", "s", "unknown"]) if r.random() < 0.15 else role
            text = r.choice(["Yes.", "No!", "Is it? ", "cut off", "a.\n", " ", "", None, "é…", "tail . \t"]) if r.random() < 0.6 else f"text {r.randrange(40)}."
            rows.append((conv, None if r.random() < 0.05 else turn, role, text))
            turn += r.choice([0, 1, 1, 1, 2])
    for i in range(150):  # one conversation holds a third of all rows
        rows.append((1000, i, ("user", "assistant")[i % 2] if r.random() < 0.8 else "tool", f"t{i}." if r.random() < 0.8 else "same"))
    rows += [(1001, i, "tool", f"t{i}.") for i in range(24)]  # no state ever gains
    rows += [(1002, 3, "user", "again and again")] * 50 + [(1003, i, "user", "  ") for i in range(30)]
    rows += [(None, 1, "user", "nobody's."), (None, None, "assistant", "reply."), (-7, 5, "system", "alone.")]
    gone = [c for c in range(2000, 2600) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    return rows + [(c, 0, "user", "it goes.") for c in gone]


@pytest.fixture(scope="module")
def given():
    rows = conversations()
    return rows, plain(rows)


@pytest.mark.parametrize("settings", [{}, {"chunk_rows": 3, "passes": 2}, {"chunk_rows": 7, "passes": 0}, {"chunk_bytes": 9}])
def test_equals_plain_search(spark, given, settings):
    rows, want = given
    docs = spark.createDataFrame([(*r, "mine", "clash") for r in rows], KIND).repartition(5)
    got = repair_conversations(damaged(docs), **settings)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_no_rows(spark):
    assert repair_conversations(damaged(spark.createDataFrame([], KIND))).collect() == []


def test_fixed_up_equals_a_full_run():
    r = random.Random(2)
    early = 0
    for _ in range(3000):
        codes = "".join(r.choice("suaxSUAXd") for _ in range(r.randrange(1, 30)))
        end = costs("".join(r.choice("suaxSUAXd") for _ in range(r.randrange(9))), TERMINAL)[0]
        begin = costs(codes, SPECULATIVE)[0]
        got, want = fixed_up(codes, SPECULATIVE, begin, end), costs(codes, end)[0]
        assert got == want
        early += alike(begin, want)
        m = matrix(codes)
        assert [min(m[4 * i + j] + end[j] for j in range(4)) for i in range(4)] == list(want)
    assert early > 1500


def test_edits_by_hand():
    whole = lambda codes: repair._whole(codes)[0]
    assert whole("") == ""
    assert whole("s") == "D"
    assert whole("sua") == "KKK"
    assert whole("u") == "KI"
    assert whole("a") == "IK"
    assert whole("uda") == "KDK"
    assert whole("xa") == "RK"
    assert whole("uu") == "KR"
    assert whole("U") == "D"  # deleting it costs 4, keeping and answering it 6


def test_ends_are_settled_by_passes_or_by_matrices(spark):
    """Both ways give the same vectors up to a constant."""
    rows = [(7, i, ("user", "assistant", "tool")[(i * i) % 3], f"t{i}.") for i in range(46)]
    chunks = repair.numbered_chunks(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit(1)), 4)
    whole = costs("".join(r.codes for r in chunks.orderBy("g").collect()), TERMINAL)
    for passes in (0, 40):
        for r in repair.end_vectors(chunks.select("g", "conv_id", "n", "place", "codes"), passes).collect():
            assert alike(tuple(r.end), whole[(r.g + 1) * 4] if (r.g + 1) * 4 < len(whole) else TERMINAL)
