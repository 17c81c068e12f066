"""Every operator on nulls, empty and very long texts, repeated rows, empty tables and columns whose names clash; and two against brute force."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trussline.llm import alignment, chat, decontam, licences, mixing, nearcopies, pii, quality, rules, simhash, substring, tokens
from trussline.llm.queries import default_tokenizer

#: Columns that operators add themselves.
CLASH = ("score", "size", "starts", "n_words", "items", "labels", "kept", "quality", "print", "n_private", "key", "shard")
KIND = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)


def words(n, seed, of=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    long = words(20_000, 1, 5000)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (5, long), (5, "another text of id five"), (None, "no id here"), (None, None), (6, "é#$% ßx\n\né#$% ßx"), (7, words(60, 3)), (8, words(60, 3))]
    return spark.createDataFrame([(i, t, (None, "a")[n % 2], *["mine"] * len(CLASH)) for n, (i, t) in enumerate(texts)], KIND)


@pytest.fixture(scope="module")
def models(spark):
    rows = spark.createDataFrame([(words(40, i), 1) for i in range(20)] + [(words(40, i).replace(" ", "$$ |"), 0) for i in range(20)] + [(None, 0)], "text string, label int")
    return quality.fit(rows), rules.fit_quality(rows)


def bench(spark):
    return spark.createDataFrame([(1, words(20, 3)), (None, None), (2, "")], "item_id long, text string")


OPERATORS = {
    "vote": lambda spark, docs, m: quality.score(docs, m[0]),
    "decontamination": lambda spark, docs, m: decontam.match_benchmark(docs, bench(spark)),
    "decontamination in blocks": lambda spark, docs, m: decontam.match_benchmark(docs, bench(spark), max_words=30),
    "cut hits": lambda spark, docs, m: decontam.cut_hits(docs, bench(spark)),
    "pseudonyms": lambda spark, docs, m: pii.pseudonymise(docs, "k"),
    "licences": lambda spark, docs, m: licences.scan_licences(docs),
    "repeats": lambda spark, docs, m: substring.repeated_passages(docs),
    "near copies": lambda spark, docs, m: nearcopies.near_duplicates(docs),
    "one of each": lambda spark, docs, m: nearcopies.keep_one_of_each(docs),
    "alignment": lambda spark, docs, m: alignment.align_tokenizers(docs, default_tokenizer(), public_tokenizers.path("piece_bpe_32k.model")),
    "alignment, pairs joined": lambda spark, docs, m: alignment.align_tokenizers(docs, default_tokenizer(), public_tokenizers.path("piece_bpe_32k.model"), max_sent=0),
    "simhash": lambda spark, docs, m: simhash.simhash_groups(docs),
    "rules": lambda spark, docs, m: rules.apply_rules(docs, m[1]),
    "mix": lambda spark, docs, m: mixing.mix(docs),
    "curriculum": lambda spark, docs, m: mixing.curriculum(docs),
}
#: Rows that an operator gives for the twelve rows of `odd`, where that isn't twelve: those of no id, copies, or of a contaminated text go; the mix repeats.
ROWS = {"near copies": 10, "one of each": 6, "cut hits": 10, "curriculum": None}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, models, name):
    rows = OPERATORS[name](spark, odd, models).collect()
    want = ROWS.get(name, 12)
    assert want is None or len(rows) == want
    if name in ("cut hits", "one of each", "curriculum"):
        assert {r.score for r in rows} <= {"mine"}


#: What operators give for a null, an empty and a blank text.
BARE = {
    "decontamination": {"n_words": 0, "n_hit": 0, "contaminated": False},
    "pseudonyms": {"n_private": 0, "private_kinds": ""},
    "licences": {"n_words": 0, "n_base": 0, "first_word": None, "last_word": None, "labels": ""},
    "repeats": {"n_words": 0, "n_removed": 0, "kept_text": ""},
    "near copies": {"class_id": 1, "n_copies": 3},
    "simhash": {"print": 0, "component_id": 1},
    "rules": {"n_words": 0, "base_failed": True, "kept": False},
}


@pytest.mark.parametrize("name", BARE)
def test_values_of_bare_texts(spark, odd, models, name):
    got = {r.doc_id: r for r in OPERATORS[name](spark, odd.where("doc_id in (1, 2, 3)"), models).collect()}
    assert set(got) == {1, 2, 3}
    for r in got.values():
        assert {k: r[k] for k in BARE[name]} == BARE[name]


def test_equal_support_and_equal_votes_give_the_same_again(spark, odd, models):
    """Ties: rows in another order and other partitions give the same classes, groups and scores."""
    for name in ("near copies", "simhash", "vote"):
        one, two = ({tuple(map(str, (r.doc_id, *(r[c] for c in ("class_id", "component_id", "score") if c in r)))) for r in OPERATORS[name](spark, d, models).collect()} for d in (odd, odd.orderBy(F.desc("doc_id")).repartition(5)))
        assert one == two


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, odd, models, name):
    assert OPERATORS[name](spark, odd.limit(0), models).collect() == []


def test_token_shards_of_odd_rows(spark, odd, tmp_path):
    for name, docs, n in (("a", odd, 10), ("b", odd.limit(0), 0)):
        tokens.write_shards(docs, str(tmp_path / name), default_tokenizer())
        rows = tokens.read_documents(spark, str(tmp_path / name)).orderBy("start").collect()
        assert len(rows) == n and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
        assert all(r.n_tokens >= 1 for r in rows)


def test_pairs_of_odd_rows(spark):
    long = words(20_000, 5)
    rows = [(0, 0, "user", long), (0, 1, "assistant", None), (1, 0, "user", long), (1, 1, "assistant", "x"), (2, 0, None, None), (2, 0, None, None), (None, 0, "user", "x"), (4, None, "user", "b"), (4, None, "user", "a"), (5, 0, "user", "a")]
    turns = spark.createDataFrame([(*r, "mine") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in chat.preference_pairs(turns, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert set(got) == {0, 1, 2} and got[0].n_common == 1 and got[0].usable and got[0].prompt.count(long) == 1 and not got[1].usable and got[2].n_common == 1
    assert chat.preference_pairs(turns.limit(0), F.col("conv_id"), F.lit(True)).collect() == []


def test_rule_statistics_equal_brute_force(spark, models):
    r, texts = random.Random(2), []
    for _ in range(40):
        lines = [" ".join(r.choice(["a", "bé", "#c", "d|", "e"]) for _ in range(r.randrange(12))) for _ in range(r.randrange(1, 9))]
        texts.append("\n".join(lines + lines[: r.randrange(3)]) + r.choice(["", "\n", " \t\x0b"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in rules.apply_rules(docs, models[1]).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", row.text)
        lines = [x for x in row.text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        inside = {i + k for i, g in enumerate(runs) if runs.count(g) > 1 for k in range(8)}
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", row.text)), len(lines) - len(set(lines)), len(inside))
        assert row.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and row.kept == (not row.base_failed and row.quality >= 0.3)


def test_base_phrases_equal_brute_force(spark):
    r, parts = random.Random(6), ["under the MIT license", "Apache License, Version 2", "cc by-nc", "under the mit licenses", "cc by", "nc", "the", "é", "UNDER", "version 2"]
    docs = spark.createDataFrame([(i, r.choice([" ", ", ", "\n"]).join(r.choice(parts) for _ in range(r.randrange(9)))) for i in range(60)], "doc_id long, text string")
    for row in licences.scan_licences(docs).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in row.text))
        places = [(i, label) for phrase, label in licences.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        first, last = (min(places)[0], max(places)[0]) if places else (None, None)
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == (len(w), len(places), first, last, ",".join(sorted({x for _, x in places})))


def test_repetitive_texts_are_scanned_in_one_go():
    """Time is in proportion to the text also where every word goes on a match."""
    import time

    from trussline.llm.decontam import SuffixAutomaton

    automaton = SuffixAutomaton([("a", [b"x"] * 20_000, True), ("b", [b"x"] * 12, True)], 13)
    began = time.process_time()
    runs, names = automaton.scan([b"x"] * 100_000)
    assert runs == [(0, 100_000)] and names == {"a", "b"}
    assert time.process_time() - began < 5
