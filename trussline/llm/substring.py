"""Exact repeated passages across documents, found by fixed-block anchors.

Let `window` be the shortest repeat that counts and `block` = window // 2. A document is cut into
non-overlapping blocks of `block` words; these are the index. Every rolling window of `block` words of every
document probes it. Since 2 * block - 1 <= window, each repeat of `window` words holds one whole block of the
document it repeats, so a repeat can't be missed. Around each hit the repeat is extended: all `window`-word
windows that hold a hit are compared by their full hash, and runs of consecutive equal windows are the maximal
exact repeats.

How it runs. Documents are dealt to chunks by a hash; the text is shuffled once, and that one exchange feeds all
three passes. Passes 1 and 2 send packed, de-duplicated hashes of a chunk to hash buckets and get back one bit for
each. Pass 1 sends 4 bytes a word: the rest of the hash is the bucket, and a false hit only makes one more candidate.
Pass 2 sends 64 bits (besides the bucket, from an independent hash) for candidates only. A passage that a
third of the documents share is one entry of each chunk, so no bucket is hot. The numbers of chunks and buckets
follow the size of the input.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.llm.bytetext import WordIndex, slices, utf8
from trussline.llm.common import text_bytes

#: Text bytes whose words are indexed at once, some 70 MB in a task.
PART = 2 << 20
_SENT = "chunk long, bucket long, kind int, n int, data binary, more binary"
_BACK = "chunk long, bucket long, kind int, n int, data binary"


class Layout(NamedTuple):
    chunks: int
    buckets: int
    window: int
    block: int


def layout(size: int, window: int) -> Layout:
    """Chunks of 2 to 32 MB and buckets for 8 to 64 MB of text: about 4096 of each while sizes allow."""
    mb = 1 << 20
    chunk = min(32 * mb, max(2 * mb, size // 4096))
    bucket = min(64 * mb, max(8 * mb, size // 4096))
    return Layout(max(16, size // chunk), max(16, size // bucket), window, window // 2)


class _Chunk:
    """The documents of a chunk in an order that each pass repeats.

    Words are indexed by slices of whole texts (PART bytes or one text), one at a time; what is kept for the chunk is a few numbers a word.
    """

    def __init__(self, rows: pa.Table, plan: Layout, part: int = PART):
        ids, texts = rows["doc_id"].to_pylist(), utf8(rows["text"])
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
        self.ids, self.texts, self.plan = [ids[i] for i in order], [texts[i] for i in order], plan
        #: a null id has no order: such a document takes no part in comparison
        self.n_known = sum(i is not None for i in self.ids)
        self.cuts = list(slices(self.texts, part))
        self.only = WordIndex(self.texts) if len(self.cuts) == 1 else None
        bounds = [np.zeros(1, np.int64)]
        for _, _, index in self._parts():
            bounds.append(index.bounds[1:] + bounds[-1][-1])
        #: words of document d: bounds[d] to bounds[d + 1]
        self.bounds = np.concatenate(bounds)
        self.n = int(self.bounds[-1])

    def _parts(self):
        """First document, first word and index of each slice."""
        word = 0
        for a, b in self.cuts:
            index = self.only or WordIndex(self.texts[a:b])
            yield a, word, index
            word += index.n

    def anchors(self):
        """Rolling windows with the 32 bits sent, their buckets, and whether they are aligned blocks."""
        found = []
        for a, word, index in self._parts():
            start = index.windows(self.plan.block)
            start = start[index.doc[start] + a < self.n_known]
            h = index.hashes(start, self.plan.block)
            aligned = (start - index.bounds[index.doc[start]]) % self.plan.block == 0
            found.append((start + word, h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) % np.uint64(self.plan.buckets), aligned))
        return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, k) for k in (np.int64, np.uint64, np.uint64, bool)]

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Starts of windows that hold a hit; hit: per word, whether a hit starts there."""
        seen = np.concatenate(([0], np.cumsum(hit)))
        start = np.concatenate([np.zeros(0, np.int64), *(index.windows(self.plan.window) + word for _, word, index in self._parts())])
        return start[seen[start + self.plan.window - self.plan.block + 1] > seen[start]]

    def doc(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, start, "right") - 1

    def full(self, start: np.ndarray):
        """Distinct candidate windows (starts ascend): for each start its group; of each group bucket, hash, first document."""
        hashes = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
        for _, word, index in self._parts():
            own = start[np.searchsorted(start, word) : np.searchsorted(start, word + index.n)] - word
            if len(own):
                hashes.append(tuple(index.hashes(own, self.plan.window, seed) for seed in (1, 2)))
        h, other = (np.concatenate(x) for x in zip(*hashes, strict=True))
        bucket, doc = other % np.uint64(self.plan.buckets), self.doc(start)
        order = np.lexsort((doc, h, bucket))
        h, bucket, doc = h[order], bucket[order], doc[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return group, bucket[new], h[new], doc[new]


def _edges(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal values in a sorted array: value, start, end."""
    cut = np.flatnonzero(np.diff(buckets)) + 1
    starts = np.concatenate(([0], cut)) if len(buckets) else []
    ends = np.concatenate((cut, [len(buckets)]))
    return [(int(buckets[a]), int(a), int(b)) for a, b in zip(starts, ends, strict=False)]


def _table(rows: list[tuple], names: str) -> pa.Table:
    kinds = {"chunk": pa.int64(), "bucket": pa.int64(), "kind": pa.int32(), "n": pa.int32(), "data": pa.binary(), "more": pa.binary()}
    fields = [x.split()[0] for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({f: pa.array(c, kinds[f]) for f, c in zip(fields, columns, strict=True)})


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _probe(plan: Layout):
    def run(rows: pa.Table) -> pa.Table:
        chunk = rows["chunk"][0].as_py()
        _, low, bucket, aligned = _Chunk(rows, plan).anchors()
        keys, inverse, times = np.unique(bucket << np.uint64(32) | low, return_inverse=True, return_counts=True)
        block = np.zeros(len(keys), bool)
        block[inverse[aligned]] = True
        low = keys.astype(np.uint32)
        return _table(
            [(chunk, b, 0, e - a, low[a:e].tobytes(), _bits(np.concatenate((block[a:e], times[a:e] > 1)))) for b, a, e in _edges(keys >> np.uint64(32))], _SENT
        )

    return run


def _match(rows: pa.Table) -> pa.Table:
    """In one bucket: which values are blocks and occur at least twice."""
    sent = rows.to_pylist()
    values = np.concatenate([np.frombuffer(r["data"], np.uint32) for r in sent])
    flags = [_flags(r["more"], 2 * r["n"]) for r in sent]
    _, inverse, times = np.unique(values, return_inverse=True, return_counts=True)
    block = np.bincount(inverse, np.concatenate([f[: r["n"]] for f, r in zip(flags, sent, strict=True)])) > 0
    twice = (times > 1) | (np.bincount(inverse, np.concatenate([f[r["n"] :] for f, r in zip(flags, sent, strict=True)])) > 0)
    return _answer(sent, (block & twice)[inverse])


def _answer(sent: list[dict], flags: np.ndarray) -> pa.Table:
    ends = np.cumsum([r["n"] for r in sent])
    return _table([(r["chunk"], r["bucket"], r["kind"], r["n"], _bits(flags[e - r["n"] : e])) for r, e in zip(sent, ends, strict=True)], _BACK)


def _ordered(back: pa.Table, kind: int) -> np.ndarray:
    """A chunk's answers, bucket by bucket, in the order in which they were asked for."""
    rows = sorted((r for r in back.to_pylist() if r["kind"] == kind), key=lambda r: r["bucket"])
    return np.concatenate([_flags(r["data"], r["n"]) for r in rows]) if rows else np.zeros(0, bool)


def _extend(plan: Layout):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        if not docs.num_rows or not back.num_rows:
            return _table([], _SENT)
        number = docs["chunk"][0].as_py()
        chunk = _Chunk(docs, plan)
        start, low, bucket, _ = chunk.anchors()
        _, inverse = np.unique(bucket << np.uint64(32) | low, return_inverse=True)
        hit = np.zeros(chunk.n + 1, bool)
        hit[start] = _ordered(back, 0)[inverse]
        start = chunk.candidates(hit)
        mark = np.zeros(chunk.n, bool)
        mark[start] = True
        _, bucket, h, doc = chunk.full(start)
        ids = np.array(chunk.ids[: chunk.n_known] or [0], np.int64)[doc] if len(doc) else np.zeros(0, np.int64)
        rows = [(number, b, 0, e - a, h[a:e].tobytes(), ids[a:e].tobytes()) for b, a, e in _edges(bucket)]
        # which windows are candidates: passed through, so that the last pass needn't ask again
        return _table([*rows, (number, number % plan.buckets, 1, len(mark), _bits(mark), b"")], _SENT)

    return run


def _first(rows: pa.Table) -> pa.Table:
    """In one bucket: which windows start in a document with a smaller id than the chunk's first."""
    every = rows.to_pylist()
    sent = [r for r in every if r["kind"] == 0]
    passed = _table([(r["chunk"], r["bucket"], 1, r["n"], r["data"]) for r in every if r["kind"] == 1], _BACK)
    if not sent:
        return passed
    h = np.concatenate([np.frombuffer(r["data"], np.uint64) for r in sent])
    ids = np.concatenate([np.frombuffer(r["more"], np.int64) for r in sent])
    _, inverse = np.unique(h, return_inverse=True)
    least = np.full(inverse.max(initial=-1) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, ids)
    return pa.concat_tables([passed, _answer(sent, least[inverse] < ids)])


def _remove(plan: Layout):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        chunk = _Chunk(docs, plan) if docs.num_rows else None
        ids, n_words, n_removed, digests, kept_texts, spans = [], [], [], [], [], []
        if chunk:
            start = np.flatnonzero(_ordered(back, 1))
            group, _, _, first = chunk.full(start)
            doc = chunk.doc(start)
            known = np.array([*chunk.ids[: chunk.n_known], 0], np.int64)
            earlier = _ordered(back, 0)[group] if len(start) else np.zeros(0, bool)
            gone = start[earlier | (known[doc] > known[first[group]])] if len(start) else start
            edge = np.zeros(chunk.n + 1, np.int64)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + plan.window, -1)
            covered = np.cumsum(edge[:-1]) > 0
            for i, text in enumerate(chunk.texts):
                a, b = chunk.bounds[i], chunk.bounds[i + 1]
                words, out = text.split(), covered[a:b]
                if out.any():
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0]))))
                    runs = [(int(x), int(y)) for x, y in zip(turn[::2], turn[1::2], strict=True)]
                    words = [w for w, o in zip(words, out.tolist(), strict=True) if not o]
                else:
                    runs = []
                kept = b" ".join(words)
                ids.append(chunk.ids[i]), n_words.append(int(b - a)), n_removed.append(int(out.sum()))
                digests.append(hashlib.sha256(kept).hexdigest()), kept_texts.append(kept.decode()), spans.append([{"start": x, "end": y} for x, y in runs])
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(kept_texts, pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    return run


def repeated_passages(docs: DataFrame, window: int = 50, size: int | None = None) -> DataFrame:
    """Removes each word covered by a `window`-word passage that also starts in a document with a smaller doc_id.

    Input: doc_id (integer), text; other columns are ignored. Output, one row for each input row: doc_id, n_words,
    n_removed, kept_sha256, kept_text (kept words joined by a space), spans (removed runs, word numbers from 0).

    Null and empty texts have no words: n_words 0, nothing removed, the hash of the empty string. A null doc_id has no
    order: that document loses nothing and takes nothing from others. Rows of equal doc_id don't remove from each other.
    An empty table gives no rows.
    """
    if window < 2:
        raise ValueError("window must be 2 words or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plan = layout(text_bytes(docs) if size is None else size, window)
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(plan.chunks)).alias("chunk"), "doc_id", "text")
    asked = dealt.groupBy("chunk").applyInArrow(_probe(plan), _SENT)
    hits = asked.groupBy("bucket").applyInArrow(_match, _BACK)
    wide = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extend(plan), _SENT)
    known = wide.groupBy("bucket").applyInArrow(_first, _BACK)
    kept = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:long,end:long>>"
    return dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_remove(plan), kept)
