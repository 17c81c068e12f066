"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton accepts every run of words of every test item, so one pass over a document's words tracks the
longest match that ends at each word. Items are cut into blocks of a bounded number of words (a longer item into pieces that overlap by a window). A benchmark
of one block needs one pass and no shuffle of documents. A larger one takes a pass for each block, one automaton after another on the driver and in
the tasks; each pass writes the hits of the few texts that have some, by a hash of the text, and these are joined in the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trussline.llm.bytetext import folded_words, parts, utf8
from trussline.llm.common import aside, cut, new_path

#: Words of test items in one automaton: at most two states a word, some 100 MB in a worker.
MAX_AUTOMATON_WORDS = 200_000
_FAR = 1 << 60


class SuffixAutomaton:
    """States are classes of word runs with the same ends; links lead to the longest proper suffix elsewhere.

    items: name, words and whether these are the whole item (else a piece of window words or more).
    """

    def __init__(self, items: list[tuple[str, list[bytes], bool]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        found: list[set[str]] = [set()]
        whole: list[dict[int, set[str]]] = [{}]  # items of fewer words than a window, by their length
        for name, words, complete in items:
            last = 0
            for w in words:
                last = self._add(last, w)
                while len(found) < len(self.length):
                    found.append(set()), whole.append({})
                if self.length[last] >= window:  # shorter states are never asked for names
                    found[last].add(name)
            if complete and 0 < len(words) < window:
                whole[last].setdefault(len(words), set()).add(name)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for s in reversed(order):
            if self.length[self.link[s]] >= window:
                found[self.link[s]] |= found[s]
        self.short: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.length)
        self.need = [_FAR] * len(self.length)  # the least match that counts in a state
        for s in order:
            own = tuple((n, frozenset(names)) for n, names in sorted(whole[s].items()))
            self.short[s] = self.short[self.link[s]] + own
            self.need[s] = min([window, *(n for n, _ in self.short[s])])
        # the shortest state of at least a window on the way up the links: it has all items of those above it
        self.top = [0] * len(self.length)
        for s in order:
            self.top[s] = self.top[self.link[s]] if self.length[self.link[s]] >= window else s
        self.items = [frozenset(x) for x in found]
        self.items[0] = frozenset()

    def _new(self, length: int, link: int, step: dict[bytes, int]) -> int:
        self.length.append(length), self.link.append(link), self.step.append(step)
        return len(self.length) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _add(self, last: int, w: bytes) -> int:
        if w in self.step[last]:
            return self._split(last, w, self.step[last][w])
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, w, self.step[p][w])
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs as (start, end) in order, and the items with an occurring window."""
        step, link, length, need, window, top = self.step, self.link, self.length, self.need, self.window, self.top
        state = n = 0
        runs: list[tuple[int, int]] = []
        names: set[str] = set()
        seen: set[int] = set()
        for i, w in enumerate(words):
            to = step[state].get(w)
            if to is None:
                while state and to is None:
                    state = link[state]
                    to = step[state].get(w)
                n = length[state]
                if to is None:
                    state = n = 0
                    continue
            state = to
            n += 1
            if n < need[state]:
                continue
            cover = n if n >= window else 0
            for m, which in self.short[state]:
                if m <= n:
                    names |= which
                    cover = max(cover, m)
            if n >= window:
                s = top[state]
                if s not in seen:
                    seen.add(s)
                    names |= self.items[s]
            start = i + 1 - cover
            while runs and runs[-1][1] >= start:
                start = min(start, runs.pop()[0])
            runs.append((start, i + 1)) if cover else None
        return runs, names


_PIECE = "item string, words binary, complete boolean, size int"


def _blocks(benchmark: DataFrame, window: int, limit: int) -> DataFrame:
    """Items in pieces of at most half the limit (a window at least), dealt to blocks of at most `limit` words: block, item, words, complete."""
    most = max(window, limit // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch):
                rows = []
                for name, t in zip(part["item"].to_pylist(), texts, strict=True):
                    w = folded_words(t)
                    step = most - window + 1
                    cuts = range(0, max(1, len(w) - window + 1), step) if len(w) > most else [0]
                    rows += [(name, b" ".join(w[a : a + most]), len(w) <= most, min(most, len(w) - a)) for a in cuts] if w else []
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.bool_(), pa.int32()), strict=True)], [x.split()[0] for x in _PIECE.split(", ")])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    pieces = cut(items.mapInArrow(run, _PIECE).withColumn("uid", F.monotonically_increasing_id()))
    before = Window.orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)  # of two numbers a piece
    numbered = pieces.select("uid", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / F.lit(most)).cast("int").alias("block"))
    return cut(pieces.join(numbered, "uid").select("block", "item", "words", "complete"))


def _automaton(blocks: DataFrame, number: int, window: int) -> SuffixAutomaton:
    """Of one block: a bounded number of words on the driver."""
    rows = blocks.where(F.col("block") == number).collect()
    return SuffixAutomaton(sorted((r["item"], bytes(r["words"]).split(b" "), r["complete"]) for r in rows), window)


ADDED = ["n_words", "n_hit", "hit_spans", "items", "items_sha256", "contaminated"]
_KEYED = "__key binary, __hits array<struct<start:long,end:long>>, __items array<string>"
_HIT = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _text_key(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _spans(runs: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in runs]


def _hits_alone(shared, text: str):
    """One automaton: key, hits and items of the texts that have hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            for _, texts in parts(batch, text):
                seen = [(_text_key(t), *automaton.scan(folded_words(t))) for t in texts]
                keys, runs, names = list(zip(*(x for x in seen if x[1]), strict=True)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array([_spans(r) for r in runs], _HIT), pa.array([sorted(n) for n in names], pa.list_(pa.string()))], ["__key", "__hits", "__items"]
                )

    return run


def _keys(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_text_key(t) for t in utf8(batch[text])]
            yield pa.RecordBatch.from_pydict({n: batch[n] for n in batch.schema.names} | {"__key": pa.array(keys, pa.binary())})

    return run


def _finish(text: str, share: Fraction, shared=None):
    """The added columns, from one automaton or from __hits and __items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value if shared else None
        for batch in batches:
            for part, texts in parts(batch, text):
                n_words, n_hit, spans, items = [], [], [], []
                known = None if automaton else zip(part["__hits"].to_pylist(), part["__items"].to_pylist(), strict=True)
                for t in texts:
                    words = folded_words(t)
                    if automaton:
                        runs, names = automaton.scan(words)
                    else:
                        held, named = next(known)
                        runs, names = _merge([(r["start"], r["end"]) for r in held or ()]), set(named or ())
                    n_words.append(len(words)), n_hit.append(sum(b - a for a, b in runs)), spans.append(_spans(runs)), items.append(sorted(names))
                yield pa.RecordBatch.from_pydict(
                    {n: part[n] for n in part.schema.names if n not in ("__hits", "__items")}
                    | {
                        "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "hit_spans": pa.array(spans, _HIT), "items": pa.array(items, pa.list_(pa.string())),
                        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                        "contaminated": pa.array([n > 0 and share.denominator * n >= share.numerator * w for n, w in zip(n_hit, n_words, strict=True)], pa.bool_()),
                    }
                )

    return run


def match_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, min_share: float = 0.05, text: str = "text", max_words: int = MAX_AUTOMATON_WORDS
) -> DataFrame:
    """Adds to each row of docs what the benchmark shares with it; docs keep their columns and rows.

    Words are folded (A-Z lower-cased; runs of a-z, 0-9 and non-ASCII characters). A window is `window` words of an
    item in a row; a shorter item is one window. Added columns: n_words, n_hit (words inside an occurring window),
    hit_spans (runs of such words, numbers from 0), items (ids with an occurring window, as strings, sorted),
    items_sha256, contaminated (n_hit > 0 and n_hit >= min_share of the words, as the nearest fraction of a denominator up to a million).

    A null or empty text has no words and is clean. A null item text counts as no item, a null item_id as ''. Items of the same
    words are all reported. Without items every document is clean. Columns that are already named so are replaced.
    """
    docs = docs.drop(*ADDED, "__hits", "__items", "__key")
    spark = docs.sparkSession
    share = Fraction(min_share).limit_denominator(10**6)
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    full = f"{carried}, n_words long, n_hit long, hit_spans array<struct<start:long,end:long>>, items array<string>, items_sha256 string, contaminated boolean"
    blocks = _blocks(benchmark, window, max_words)
    last = blocks.agg(F.max("block")).first()[0] or 0
    if not last:
        return docs.mapInArrow(_finish(text, share, spark.sparkContext.broadcast(_automaton(blocks, 0, window))), full)
    paths = []
    for number in range(last + 1):
        shared = spark.sparkContext.broadcast(_automaton(blocks, number, window))
        paths.append(new_path(spark, "benchmark-hits"))
        docs.select(text).mapInArrow(_hits_alone(shared, text), _KEYED).dropDuplicates(["__key"]).write.parquet(paths[-1])
        shared.unpersist()
    hits = spark.read.schema(_KEYED).parquet(*paths).groupBy("__key").agg(F.flatten(F.collect_list("__hits")).alias("__hits"), F.flatten(F.collect_list("__items")).alias("__items"))
    joined = docs.mapInArrow(_keys(text), f"{carried}, __key binary").join(hits, "__key", "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), "__hits", "__items").mapInArrow(_finish(text, share), full)


def cut_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, min_share: float = 0.05, max_words: int = MAX_AUTOMATON_WORDS) -> DataFrame:
    """Documents without contamination: those over min_share go, from others the hit spans are cut.

    Columns of docs stay; a text that is cut becomes its remaining white-space separated pieces, see `match_benchmark`
    for what counts. Null and empty texts stay as they are.
    """
    renamed, own = aside(docs, ADDED)
    seen = match_benchmark(renamed, benchmark, window, min_share, max_words=max_words).where(~F.col("contaminated"))
    columns = renamed.columns

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        word = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        for batch in batches:
            texts, spans = batch["text"].to_pylist(), batch["hit_spans"].to_pylist()
            for i, runs in enumerate(spans):
                if runs:
                    at = [m.span() for m in word.finditer(texts[i])]
                    pieces, begin = [], 0
                    for r in runs:
                        pieces.append(texts[i][begin : at[r["start"]][0]].strip())
                        begin = at[r["end"] - 1][1]
                    texts[i] = " ".join(p for p in [*pieces, texts[i][begin:].strip()] if p)
            yield pa.RecordBatch.from_pydict({n: pa.array(texts, pa.string()) if n == "text" else batch[n] for n in columns})

    return seen.mapInArrow(without, renamed.schema).select(own)
