"""The ten operators on small tables with nulls, empty and odd texts, ties, repeats and clashing columns."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from trussline.llm import chat, decontam, licences, mixing, nearcopies, pii, quality, rules, substring, tokens
from trussline.llm.queries import default_tokenizer

DOCS = "doc_id long, text string, source string, n_words string"


def words(n, seed, of=60):
    r = random.Random(seed)
    return [f"w{r.randrange(of)}" for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash") for i, t in rows], DOCS)


def odd(spark):
    long = " ".join(words(20_000, 1, 5000))
    return table(spark, [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (5, long), (None, "no id here"), (6, "é#$% ßx\n\né#$% ßx")])


def removed_by_force(rows, k):
    split = [(i, (t or "").split()) for i, t in rows]
    first = {}
    for i, w in split:
        for a in range(len(w) - k + 1):
            g = tuple(w[a : a + k])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in split:
        gone = set()
        for a in range(len(w) - k + 1):
            if first[tuple(w[a : a + k])] < i:
                gone |= set(range(a, a + k))
        out[i] = " ".join(x for a, x in enumerate(w) if a not in gone)
    return out


@pytest.mark.parametrize("k", [2, 5, 8])
def test_repeats_equal_brute_force(spark, k):
    shared = words(30, 5)
    rows = [(i, " ".join(words(25, i, 8) + shared[i % 7 : i % 7 + 12] + words(9, i + 100))) for i in range(40)] + [(90, None), (91, "")]
    got = {r.doc_id: r.kept_text for r in substring.repeated_passages(table(spark, rows), k).collect()}
    assert got == removed_by_force(rows, k)


def test_chunk_is_the_same_in_parts():
    rows = [(i, " ".join(words(40, i % 9, 30))) for i in range(50)] + [(None, "x " * 60), (60, None), (61, "")]
    table = pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows])})
    plan = substring.layout(10**6, 10)
    whole, cut = substring._Chunk(table, plan), substring._Chunk(table, plan, 200)
    assert len(cut.cuts) > 5 and len(whole.cuts) == 1
    hit = np.arange(whole.n + 1) % 13 == 0
    start = whole.candidates(hit)
    for x, y in (*zip(whole.anchors(), cut.anchors(), strict=True), (start, cut.candidates(hit)), *zip(whole.full(start), cut.full(start), strict=True)):
        assert (x == y).all() and len(x)


def test_repeats_of_odd_rows(spark):
    rows = substring.repeated_passages(odd(spark)).collect()
    assert len(rows) == 8
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows if r.n_words == 20_000) == [(4, 0), (5, 20_000), (5, 20_000)]
    assert substring.repeated_passages(table(spark, [])).count() == 0


def test_benchmark_hits_equal_brute_force(spark):
    items = [(i, " ".join(words(random.Random(i).randrange(0, 12), i, 6))) for i in range(12)] + [(50, None), (None, "W1 w2")]
    docs = [(i, " ".join(words(80, i + 40, 6))) for i in range(15)] + [(80, None), (81, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (10, 10_000):  # several automata, then one
        got = {r.doc_id: r for r in decontam.match_benchmark(table(spark, docs), bench, window=4, max_words=limit).collect()}
        for i, t in docs:
            w, hit, names = (t or "").split(), set(), set()
            for item, text in items:
                own = (text or "").lower().split()
                n = min(4, len(own))
                for a in range(len(own) - n + 1 if n else 0):
                    for b in range(len(w) - n + 1):
                        if w[b : b + n] == own[a : a + n]:
                            hit |= set(range(b, b + n))
                            names.add("" if item is None else str(item))
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(names))
            assert got[i].contaminated == (bool(hit) and 20 * len(hit) >= len(w))
    assert not any(r.contaminated for r in decontam.match_benchmark(odd(spark), bench.limit(0)).collect())


def test_one_automaton_at_a_time(spark, monkeypatch):
    sizes = []
    made = decontam.SuffixAutomaton.__init__

    def count(self, items, window):
        sizes.append(sum(len(w) for _, w, _ in items))
        made(self, items, window)

    monkeypatch.setattr(decontam.SuffixAutomaton, "__init__", count)
    long, short = words(200, 3, 10**6), words(12, 4, 10**6)
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, "x y")], "item_id long, text string")
    docs = table(spark, [(1, " ".join(long[50:170])), (2, " ".join(["a", *long[:4], "b", *short[5:11]])), (2, "x y"), (3, "x")])
    got = decontam.match_benchmark(docs, bench, window=5, max_words=40)
    assert sorted((r.doc_id, r.n_hit, ",".join(r["items"]), r.n_words) for r in got.collect()) == [(1, 120, "1", 120), (2, 2, "3", 2), (2, 6, "2", 12), (3, 0, "", 1)]
    assert got.columns[:4] == docs.columns[:3] + ["n_words"] and len(sizes) > 5 and max(sizes) <= 40


def test_cut_hits(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    docs = table(spark, [(1, "x " * 80 + "One, two three end"), (2, "one two three"), (3, None)])
    assert {r.doc_id: r.text for r in decontam.cut_hits(docs, bench).collect()} == {1: ("x " * 80).strip() + " end", 3: None}


def test_pseudonyms(spark):
    text = "card 4111111111111111 bad 4111111111111112 on 2024-02-29 not 2023-02-29, +1 (974) 555-3436 at 10.0.0.1 a.b@c.org"
    rows = pii.pseudonymise(table(spark, [(1, text), (2, text.upper()), (3, None), (4, "")]), "k").orderBy("doc_id").collect()
    out = rows[0].text
    assert "4111111111111111" not in out and "4111111111111112" in out and "2023-02-29" in out and "2024-02-29" not in out and "a.b@c.org" not in out and "10.0.0.1" not in out
    assert rows[0].n_private == 5 and rows[0].text.split()[1] == rows[1].text.split()[1] and rows[2].text is None and rows[3].text == ""
    card = [int(c) for c in out.split()[1]]
    assert sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(card)) % 10 == 0
    assert pii.pseudonymise(table(spark, [(1, text)]), "other").first().text != out


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms_of_other_forms(spark):
    cards = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "378282246310005", "3782 822463 10005", "30569309025904", "3056-930902-5904", "4222222222222", "6304000000000000000", "6304 0000 0000 0000 000", "60110000000000004"]
    phones = ["+1 (974) 555-3436", "(974) 555-3436", "974-555-3436", "974.555.3436", "+1-974-555-3436", "+1 974 555 3436", "+19745553436", "1-974-555-3436", "+44 20 7946 0958", "+49 (0)30 901820", "+442079460958"]
    cards = [c for c in cards if luhn(c.replace(" ", "").replace("-", ""))]
    assert len(cards) >= 10
    left = ["4111-1111 1111 1111", "4111 1111 1111 1112", "1234567890123", "41111111111111111111", "10.0.0", "555-3436", "1.12.05.2020"]
    kinds = {"card": cards, "phone": phones, "date": ["ended.2024-02-29", "ended.29.02.2024"], "": left}
    rows = [(k, t) for k, own in kinds.items() for t in own]
    docs = [(i, f"call {t} now") for i, (_, t) in enumerate(rows)]
    got = {r.doc_id: r for r in pii.pseudonymise(table(spark, docs), "k").collect()}
    for i, (kind, t) in enumerate(rows):
        new = got[i].text.removeprefix("call ").removesuffix(" now")
        assert (got[i].private_kinds, got[i].n_private) == (kind, int(kind != "")) and (new == t) == (kind == ""), t
        assert ["0" if c.isdigit() else c for c in new] == ["0" if c.isdigit() else c for c in t]
        assert kind != "card" or luhn("".join(c for c in new if c.isdigit()))
    bare = {(k, "".join(c for c in t if c.isdigit())[-10:] if k == "phone" else "".join(c for c in t if c.isdigit())): set() for k, t in rows if k in ("card", "phone")}
    for i, (k, t) in enumerate(rows):
        if k in ("card", "phone"):
            d = ["".join(c for c in x if c.isdigit()) for x in (t, got[i].text)]
            bare[k, d[0][-10:] if k == "phone" else d[0]].add(d[1][-10:] if k == "phone" else d[1])
    assert all(len(x) == 1 for x in bare.values())


def test_feistel_is_a_permutation(spark):
    x = spark.range(7 * 13).select(pii.feistel(F.col("id"), 7, 13, "k", "t").alias("y"))
    assert sorted(r.y for r in x.collect()) == list(range(91))


def test_licences(spark):
    docs = [(1, "x. Released under the MIT License! the mit license"), (2, "relased undr the MIT licence"), (3, "nothing"), (4, None), (5, "CC BY-NC cc by nc cc by nc")]
    got = {r.doc_id: r for r in licences.scan_licences(table(spark, docs)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].base_labels, got[1].score) == (1, 2, "mit", 1.0)
    assert got[2].n_base == 0 and got[2].labels == "mit" and 0.8 < got[2].score < 1
    assert got[3].labels == "" and got[3].score == 0 and got[4].n_words == 0
    assert (got[5].n_base, got[5].first_word, got[5].last_word) == (3, 0, 6)


def edits_by_force(pattern, text):
    row = list(range(len(text) + 1))
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, c in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != c)))
    return row[-1]


def spans_by_force(text, pattern, k, lo=0, hi=None):
    hi = len(text) if hi is None else hi
    size = len(pattern)
    whole = [i for i in range(len(text) + 1) if i in (0, len(text)) or text[i - 1] == " " or text[i] == " "]  # edges of words
    starts, ends = [i for i in whole if i < len(text) and (i == 0 or text[i - 1] == " ")], [i for i in whole if i == len(text) or text[i] == " "]
    spans = [(edits_by_force(pattern, text[a:b]), a, b) for a in starts if lo <= a < hi for b in ends if a + size - k <= b <= min(hi, a + size + k)]
    d, a, b = min(spans, default=(k + 1, 0, 0))
    return [*spans_by_force(text, pattern, k, lo, a), (a, b, d), *spans_by_force(text, pattern, k, b, hi)] if d <= k else []


@pytest.mark.parametrize("seed", range(12))
def test_licence_spans_equal_brute_force(seed):
    r = random.Random(seed)
    notice = licences.notice("under the mit license", "mit")
    text = []
    for _ in range(5):
        own = list("under the mit license")
        for _ in range(r.randrange(4)):
            own[r.randrange(len(own))] = r.choice(["", "x", "li", " "])
        text.append("".join(own) + r.choice(["", " ", " and ", "license "]))
    text = " ".join("".join(text).split())
    assert [(f.start, f.end, f.edits) for f in licences.find_notices(text, [notice])] == spans_by_force(text, "under the mit license", 2)


def test_licence_misspelt_before_clean():
    notice = licences.notice("licensed under the mit license", "mit")
    for between in (" and ", " and then again later ", " "):
        for pair in (("licensed undr the mit license", "licensed under the mit license"), ("licensed under the mit license", "licensed undr the mit license")):
            assert sorted(f.edits for f in licences.find_notices(between.join(pair), [notice])) == [0, 1]
    many = " ".join(["licensed undr the mit license", "licensed under the mit license"] * 3000)
    assert len(licences.find_notices(many, [notice])) == 6000


def test_licence_words_are_whole():
    known = [licences.notice(t, label, exact=licences.EXACT.get(label, ())) for t, label in licences.NOTICES]
    for t in ("small rights reserved", "we released under the summit license", "all rights reservedly held"):
        assert not licences.find_notices(t, known)
    assert [(f.start, f.end, f.edits) for f in licences.find_notices("all rights reserve all rights reserved", known)] == [(0, 18, 1), (19, 38, 0)]


CLOSE = [
    ("gnu general public license version 2", "gpl-2"), ("gnu general public license version 3", ""), ("gnu general public license version 3 2 0", ""), ("gnu general public license version 20", ""),
    ("gnu generl public licence version 2", "gpl-2"), ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this work is licensed under the gnu general public license version 2", "gpl-2"), ("this work is lisensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under cc by nc 4 0", "cc-by-nc"), ("licensed under cc by sa 4 0", "cc-by-sa"), ("licensd under cc by sa 4 0", "cc-by-sa"), ("licensed under cc by nd 4 0", ""),
    ("licensed under the mit license", "mit"), ("licensed under the bsd license", ""), ("released under the isc license", ""), ("relased undr teh mit licence", ""), ("relased under teh mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"), ("licensed under the apache license version 1 1", ""), ("licensed under the apach license version 2", "apache-2"),
    ("mozilla public license version 2 0", "mpl-2"), ("mozilla public license version 1 1", ""), ("gnu lesser general public license version 2 1", "lgpl"), ("gnu lesser general public license version 3", "lgpl"),
    ("gnu affero general public license version 2", ""), ("gnu lesser general public license version 2", "lgpl"),
    ("gnu affero general public license version 3", ""), ("creative commons attribution noncomercial", "cc-by-nc"), ("creative commons atribution sharealike", "cc-by-sa"),
]


def test_close_licences(spark):
    docs = [(i, f"x {t} y") for i, (t, _) in enumerate(CLOSE)]
    got = {r.doc_id: r for r in licences.scan_licences(table(spark, docs)).collect()}
    base = {i: {label for phrase, label in licences.BASE if f" {phrase} " in f" {t} "} for i, (t, _) in enumerate(CLOSE)}
    assert {i: {s.label for s in got[i].spans} for i in got} == {i: {label} - {""} for i, (_, label) in enumerate(CLOSE)}
    assert {i: got[i].labels for i in got} == {i: ",".join(sorted(base[i] | {label} - {""})) for i, (_, label) in enumerate(CLOSE)}


def test_notices_of_other_labels_do_not_match():
    known = [licences.notice(t, label, exact=licences.EXACT.get(label, ())) for t, label in licences.NOTICES]
    for t, label in licences.NOTICES:
        assert {f.label for f in licences.find_notices(t, known)} == {label}


def near_by_force(rows, least):
    sets = {i: set(zip(*[t.split()[a:] for a in range(5)], strict=False)) for i, t in rows}
    label = {i: i for i, _ in rows}
    texts = dict(rows)
    for _ in rows:
        for i in label:
            for j in label:
                if texts[i].split() == texts[j].split() or sets[i] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_copies_equal_brute_force(spark):
    rows, r = [], random.Random(3)
    for g in range(6):
        base = words(150, 1000 + g, 900)
        for c in range(9):
            own = list(base)
            for _ in range(c):
                own[r.randrange(len(own))] = f"n{r.randrange(10**6)}"
            rows.append((100 * g + c, " ".join(own)))
    rows += [(900, rows[0][1]), (901, "one two"), (902, "one  two"), (903, ""), (904, " ")]
    got = {x.doc_id: x.class_id for x in nearcopies.near_duplicates(table(spark, rows)).collect()}
    assert got == near_by_force(rows, 0.8)
    kept = nearcopies.keep_one_of_each(table(spark, [*rows, (None, "x")]))
    assert kept.columns == ["doc_id", "text", "source", "n_words"] and kept.count() == len(set(got.values())) + 1


def test_banded_alignment():
    r = np.random.default_rng(1)
    for _ in range(30):
        a, b = r.integers(0, 9, 40).astype(np.uint32), r.integers(0, 9, 35).astype(np.uint32)
        best = np.zeros((41, 36), int)
        for i in range(40):
            for j in range(35):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + 1 if a[i] == b[j] else 0)
        assert nearcopies.banded_common(a, b, 60) == best[40, 35]
    turned = np.concatenate((a[20:], a[:20]))
    assert nearcopies.similar(a, a, Fraction(4, 5)) and not nearcopies.similar(np.arange(40, dtype=np.uint32), np.roll(np.arange(40, dtype=np.uint32), 20), Fraction(4, 5)) and len(turned) == 40


def labelled(spark):
    good = [(" ".join(words(60, i, 500)) + ".", 1) for i in range(60)]
    bad = [(" ".join(f"{w}$$$ |" for w in words(60, i, 500)), 0) for i in range(30)]
    return spark.createDataFrame([*good, *bad, (None, 1), ("x", None)], "text string, label int")


def test_neighbour_vote(spark):
    model = quality.fit(labelled(spark))
    docs = table(spark, [(1, " ".join(words(50, 900, 500))), (2, " ".join(f"{w}$$$ |" for w in words(50, 901, 500))), (3, None), (4, "")])
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    others = (model.labels.sum() - 1) / (len(model.labels) - 1)  # an empty text is labelled 1: it has no say in its own score
    assert got[1] > 0.7 > 0.3 > got[2] and got[3] == got[4] == pytest.approx(others)
    assert quality.fit(labelled(spark).limit(0)).prior == 0.5


def vote_by_force(model, text):
    x = np.log1p(quality.term_counts([text.encode()])[0]) * model.weight
    parts = [x[: quality.LEXICAL], x[quality.LEXICAL :]]
    x = np.concatenate([p / (np.linalg.norm(p) or 1) for p in parts]) @ model.basis
    own = quality.text_keys([text.encode()])[0]
    near = sorted(((float(v @ x / (np.linalg.norm(x) or 1)), y) for v, y, k in zip(model.vectors, model.labels, model.keys, strict=True) if k != own), reverse=True)[: model.neighbours]
    total = sum(max(c, 0) for c, _ in near)
    return sum(max(c, 0) * y for c, y in near) / total


def test_vote_equals_brute_force_and_own_label_has_no_say(spark):
    rows = labelled(spark)
    model = quality.fit(rows)
    texts = [r.text for r in rows.where("text is not null and label is not null").collect()] + [" ".join(words(40, 7, 300)) + " $$$"]
    got = quality.vote(model, [t.encode() for t in texts])
    assert all(abs(g - vote_by_force(model, t)) < 1e-4 for g, t in zip(got, texts, strict=True))
    for i in range(0, len(model.labels), 7):
        flipped = model.labels.copy()
        flipped[i] = 1 - flipped[i]
        text = next((t for t in texts if quality.text_keys([t.encode()])[0] == model.keys[i]), "")
        assert quality.vote(model._replace(labels=flipped), [text.encode()])[0] == pytest.approx(quality.vote(model, [text.encode()])[0])


def test_rules(spark):
    model = rules.fit_quality(labelled(spark))
    line = " ".join(words(30, 7, 500))
    docs = [(1, line), (2, "\n".join([line] * 3)), (3, None), (4, " ".join(f"{w}$$$ |" for w in words(50, 901, 500))), (5, "ä#b\n\nä#b")]
    got = {r.doc_id: r for r in rules.apply_rules(table(spark, docs), model).collect()}
    assert got[1].kept and not got[1].base_failed and got[1].n_repeat_words == 0 and got[1].word_chars == len(line.replace(" ", ""))
    assert got[2].base_failed and got[2].n_repeat_words == 90 and got[2].n_dup_lines == 2
    assert got[3].n_words == 0 and got[3].base_failed and not got[4].kept
    assert (got[5].n_words, got[5].word_chars, got[5].n_symbols, got[5].n_dup_lines) == (2, 6, 2, 1)


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), ("a", "b", None)[i % 3]) for i in range(300)] + [(None, "x y", "b"), (1000, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    total = got["size"].sum()
    assert abs(got.groupby(got.source.fillna("~")).target.first().sum() - 1.5 * total) < 1e-6
    for _, g in got.groupby(got.source.fillna("~")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1 and g.target.iloc[0] <= 2 * g["size"].sum() and (g.taken <= 2 * g["size"]).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert dict(zip(got.doc_id.fillna(-1), got.taken, strict=True)) == dict(zip(again.doc_id.fillna(-1), again.taken, strict=True))
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns and out.count() == got.starts.map(len).sum()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_token_round_trip(spark, tmp_path):
    texts = [None, "", " two  spaces", "a\n\n b\t", "it's 1 22 it's", "ünïcode — x", "Ġ Ġx", "plain words here"] + [" ".join(words(40, i, 400)) for i in range(60)]
    docs = table(spark, [*((i * 7, t) for i, t in enumerate(texts)), (0, "second of id 0"), (0, "second of id 0")])
    tokens.write_shards(docs, str(tmp_path / "x"), default_tokenizer(), shard_bytes=(600, 600))
    from tokenizers import Tokenizer

    tk, start = Tokenizer.from_file(default_tokenizer()), 0
    rows = tokens.read_documents(spark, str(tmp_path / "x")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([0, 0, *(i * 7 for i in range(len(texts)))])
    for r in rows:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id:
            ids = [*tk.encode(texts[r.doc_id // 7] or "", add_special_tokens=False).ids, 0]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    # payloads of shards that aren't asked for are spoilt: they are not read
    wanted = {r.shard for r in spark.read.parquet(str(tmp_path / "x")).where("low <= 14 and high >= 14 or low <= 63 and high >= 63").collect()}
    spoilt = 0
    for f in (tmp_path / "x").glob("*.parquet"):
        if not set(pq.read_table(f, columns=["shard"])["shard"].to_pylist()) & wanted:
            raw = bytearray(f.read_bytes())
            foot = len(raw) - 8 - int.from_bytes(raw[-8:-4], "little")
            raw[4:foot] = bytes(foot - 4)
            whole, columns = f.read_bytes(), pq.ParquetFile(f).metadata.row_group(0)
            for c in (columns.column(c) for c in range(columns.num_columns)):
                if c.path_in_schema in ("shard", "low", "high"):
                    begin = c.dictionary_page_offset or c.data_page_offset
                    raw[begin : begin + c.total_compressed_size] = whole[begin : begin + c.total_compressed_size]
            f.write_bytes(raw)
            for crc in f.parent.glob(f".{f.name}.crc"):
                crc.unlink()
            spoilt += 1
    assert spoilt
    found = tokens.look_up(spark, str(tmp_path / "x"), spark.createDataFrame([(14,), (15,), (63,), (None,)], "doc_id long")).collect()
    assert {r.doc_id: r.ids for r in found} == {i: [*tk.encode(texts[i // 7], add_special_tokens=False).ids, 0] for i in (14, 63)}


def test_perfect_hash():
    keys = np.random.default_rng(5).integers(0, 1 << 62, 5000).astype(np.uint64)
    index = tokens.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(5000))


def test_preferences(spark):
    rows = [(0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (1, 2, "user", None), (2, 0, None, "<|x"), (None, 0, "user", "lost")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.preference_pairs(turns, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert got[0].prompt == "<|user|>\nhi\n" and got[0].chosen == "<|assistant|>\ngood\n" and got[0].rejected == "<|assistant|>\nbad\n<|user|>\n\n" and got[0].usable
    assert [got[0].chosen[s.start : s.end] for s in got[0].chosen_mask] == ["good\n"]
    assert not got[1].usable and got[1].rejected == "" and got[1].chosen == "<||>\n< |x\n"


def ordered_near(x, y, s=Fraction(4, 5)):
    """By definition: shared shingles, then the longest common subsequence inside the band."""
    a, b = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (x.split(), y.split()))
    if not a or not b or len(set(a) & set(b)) < s * len(set(a) | set(b)):
        return False
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    need = -(-s.numerator * len(b) // s.denominator)
    band = len(a) + len(b) - 2 * need
    best = [0] * (len(b) + 1)
    for i, p in enumerate(a):
        row = [0]
        for j, q in enumerate(b):
            row.append(max(best[j + 1], row[j], best[j] + 1 if p == q and abs(i - j) <= band else 0))
        best = row
    return best[-1] >= need


def classes_by_force(rows):
    label = {}
    texts = [(i, " ".join((t or "").split())) for i, t in rows if i is not None]
    for i, _ in texts:
        label[i] = i
    changed = True
    links = [(i, j) for n, (i, x) in enumerate(texts) for j, y in texts[:n] if i == j or x == y or ordered_near(x, y)]
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def test_classes_of_moved_blocks_and_repeated_ids(spark):
    r = random.Random(4)
    blocks = [" ".join(words(14, 70 + b, 10**6)) for b in range(8)]
    rows = []
    for i in range(24):  # the same blocks in 12 orders, each order twice with one word changed
        order = list(range(8))
        random.Random(i // 2).shuffle(order)
        text = " ".join(blocks[b] for b in order).split()
        text[r.randrange(len(text))] = f"new{i}"
        rows.append((100 + i, " ".join(text)))
    one, two = " ".join(words(50, 1, 10**6)), " ".join(words(50, 2, 10**6))
    rows += [(5, one), (5, two), (6, one + " more"), (7, two + " more"), (None, one), (8, None), (9, "")]
    got = {(x.doc_id, x.class_id) for x in nearcopies.near_duplicates(table(spark, rows)).collect()}
    assert got == set(classes_by_force(rows).items()) and (7, 5) in got and (6, 5) in got
    assert len({c for d, c in got if d >= 100}) == 12
    kept = nearcopies.keep_one_of_each(table(spark, rows))
    assert kept.where("doc_id = 5").count() == 1 and kept.count() == len({c for _, c in got}) + 1


def test_encoder_equals_the_library(spark):
    from tokenizers import Tokenizer

    plain, mine, r = Tokenizer.from_file(default_tokenizer()), tokens.Encoder(default_tokenizer(), 0, 200), random.Random(2)
    signs = [*"ab .,'s\n\t  　\u0085é“”x1​\x1c\x0b漢字!-|<>", "<|endoftext|>", " the", " don't", "'ll", "\r\n", "  ", "\n\n", " \n", "z" * 300]
    for n in range(40):  # 200 remembered pieces: the memory is trimmed again and again
        texts = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(50)] + ["", f"end{n}"]
        want = [x.ids + [0] for x in plain.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, np.uint32).tolist() for x in mine([t.encode() for t in texts])] == want
    assert not tokens.splits_by_words(default_tokenizer().replace("byte_bpe_50k", "word_bpe_49k"))
