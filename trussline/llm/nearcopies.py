"""Near-duplicate documents by order MinHash, verified by banded alignment.

A document's k-mers are its runs of k raw words, each labelled with its number of occurrence. A sketch takes the `length` labelled
k-mers of smallest hash and keeps them in text order; documents that agree on one of `sketches` sketches are candidates.
At a Jaccard similarity of 0.8 one sketch of four k-mers agrees with probability 0.41 or so, and one of thirty with 1 - 1e-7.

Candidates of one sketch value form a bucket. Each member is first compared with the bucket's leader L, the member whose sketches are shared
most: work that is linear in the bucket's size and joins most members. What remains are links of a member that is apart from L to some other member of L. They are
found exactly, and no pair becomes a row: L's members are dealt by hash over blocks of some `BLOCK` bytes, and one task compares the members of two blocks. There a text y
that is within s of x shares one of the rarest |x| - s |x| + 1 shingles of x; then all shared shingles are counted, and what is alike as a set is aligned, unless both are of
one class by then. A task gives links that join classes only, fewer than it has members. So rows grow with the members, times the blocks of their leader.
Exact copies are one node from the start.

Where a task has met many texts of equal shingles in another order (blocks that were moved about), it first counts the shingles that an alignment could still match: those that stand no farther apart in two texts than what
either may leave out. Only where these are too few is a pair not aligned, so no link is lost; texts of different orders mostly have too few.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trussline.llm.bytetext import WordIndex, mix, parts
from trussline.llm.common import cut
from trussline.llm.graph import components

SKETCHES, LENGTH, WORDS, SIMILARITY = 30, 4, 5, 0.8
#: Hashes of one text that are permuted at once, and bytes of packed texts that are compared at once.
PERMUTED, COMPARED = 1 << 18, 1 << 21
#: Bytes of packed texts in a block of a leader's members, and alignments in vain from which on two blocks count what an alignment could match first.
BLOCK, IN_VAIN = 1 << 21, 256


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    top = np.iinfo(np.uint64).max
    return rng.integers(0, top, n, dtype=np.uint64), rng.integers(0, top, n, dtype=np.uint64) | np.uint64(1)


def _occurrence(keys: np.ndarray) -> np.ndarray:
    """How often a key has come before, in order."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.arange(len(keys))
    out = np.empty(len(keys), np.uint64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def sketch(texts: list[bytes], k: int = WORDS, sketches: int = SKETCHES, length: int = LENGTH) -> list[list[int]]:
    """Order MinHash sketches of texts; none for a text of fewer than k words."""
    index = WordIndex(texts)
    start = index.windows(k)
    return sketch_shingles(index.hashes(start, k), index.doc[start], len(texts), sketches, length)


def sketch_shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, sketches: int, length: int) -> list[list[int]]:
    """Of k-mer hashes in text order; doc: ascending numbers of their texts."""
    labelled = mix(h + _occurrence(mix(h + doc.astype(np.uint64))) * np.uint64(0x9E3779B97F4A7C15))
    cuts = np.searchsorted(doc, np.arange(n_docs + 1))
    flip, factor = _seeds(sketches)
    number = np.arange(1, sketches + 1, dtype=np.uint64)
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == b:
            out.append([])
            continue
        n = min(length, b - a)
        step = max(1, PERMUTED // (b - a))
        least = [np.argpartition((labelled[a:b] ^ flip[i : i + step, None]) * factor[i : i + step, None], n - 1, axis=1)[:, :n].copy() for i in range(0, sketches, step)]
        chosen = h[a:b][np.sort(np.concatenate(least), axis=1)]
        total = number * np.uint64(0xD6E8FEB86659FD93)
        for j in range(n):
            total = mix(total ^ chosen[:, j])
        out.append(total.view(np.int64).tolist())
    return out


def _print(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def _sketches(k: int, sketches: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch):
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(map(_print, texts), pa.binary()), pa.array(sketch(texts, k, sketches, length), pa.list_(pa.int64()))], ["doc_id", "print", "sketches"])

    return run


def _pack(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch):
                index = WordIndex(texts)
                start = index.windows(k)
                h, doc = (index.hashes(start, k) >> np.uint64(32)).astype(np.uint32), index.doc[start]
                cuts = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
                packed = [h[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(map(_print, texts), pa.binary()), pa.array(packed, pa.binary())], ["print", "packed"])

    return run


def banded_common(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence that only matches places at most `band` apart.

    One row of the alignment is one integer with a bit for each place of b; matches outside the band are masked.
    """
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, wide = full, (1 << 2 * band + 1) - 1
    for i, x in enumerate(a.tolist()):
        match = places.get(x, 0)
        if match:
            match &= wide << i - band if i >= band else wide >> band - i
            hit = row & match
            row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: Fraction, one: np.ndarray | None = None) -> bool:
    """Whether two shingle sequences share `least` of their distinct shingles, and keep that much of the shorter one in order. one: the distinct ones of a, if known."""
    if not len(a) or not len(b):
        return False
    one, two = np.unique(a) if one is None else one, np.unique(b)
    common = len(np.intersect1d(one, two, assume_unique=True))
    if common < least * (len(one) + len(two) - common):
        return False
    if len(a) < len(b):
        a, b = b, a
    need = -(-least.numerator * len(b) // least.denominator)
    band = len(a) + len(b) - 2 * need
    unlike = np.flatnonzero(a[: len(b)] != b)
    head = int(unlike[0]) if len(unlike) else len(b)
    unlike = np.flatnonzero(a[len(a) - len(b) + head :] != b[head:])
    tail = len(b) - head - 1 - int(unlike[-1]) if len(unlike) else len(b) - head
    if head + tail >= need:
        return True
    # the ends match, so a best alignment keeps them
    return head + tail + banded_common(a[head : len(a) - tail], b[head : len(b) - tail], band) >= need


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Batches by COMPARED bytes of packed_b, each with its pairs: a's shingles, a's distinct shingles, b's shingles. Rows of one a stand together, so a is unpacked once for many."""
    last = one = distinct = None

    def unpacked(part: pa.RecordBatch, texts: list[bytes]):
        nonlocal last, one, distinct
        column = part["packed_a"]
        for i, (number, text) in enumerate(zip(part["a"].to_pylist(), texts, strict=True)):
            if number != last:
                last, one = number, np.frombuffer(column[i].as_py(), np.uint32)
                distinct = np.unique(one)
            yield one, distinct, np.frombuffer(text, np.uint32)

    for batch in batches:
        for part, texts in parts(batch, "packed_b", COMPARED):
            yield part, unpacked(part, texts)


def _verify(least: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pairs in _pairs(batches):
            ok = [similar(x, y, least, distinct) for x, distinct, y in pairs]
            yield pa.RecordBatch.from_arrays([part["a"], part["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


class _Postings:
    """Which of some texts hold a shingle. one: the distinct shingles of each."""

    def __init__(self, one: list[np.ndarray]):
        self.size = np.array([len(x) for x in one])
        self.begin = np.cumsum(self.size) - self.size
        _, self.code, self.count = np.unique(np.concatenate(one), return_inverse=True, return_counts=True)
        self.start = np.cumsum(self.count) - self.count
        self.order = np.argsort(self.code, kind="stable")
        self.holder = np.repeat(np.arange(len(one)), self.size)[self.order]

    def of(self, x: int) -> np.ndarray:
        """The shingles of text x, rarest first."""
        mine = self.code[self.begin[x] : self.begin[x] + self.size[x]]
        return mine[np.argsort(self.count[mine], kind="stable")]

    def _at(self, codes: np.ndarray) -> np.ndarray:
        n = self.count[codes]
        return np.repeat(self.start[codes] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def holders(self, codes: np.ndarray) -> np.ndarray:
        """The texts of each of these shingles, one after the other."""
        return self.holder[self._at(codes)]


class _Places:
    """Where the shingles of some texts stand in them: the first and the last place of each distinct one and how often it comes."""

    def __init__(self, texts: list[np.ndarray], held: _Postings):
        self.held, self.n = held, np.array([len(t) for t in texts])
        seen = [np.unique(t, return_index=True, return_counts=True) for t in texts]
        self.first, self.times = (np.concatenate([s[i] for s in seen]) for i in (1, 2))
        self.last = np.concatenate([len(t) - 1 - np.unique(t[::-1], return_index=True)[1] for t in texts])

    def in_reach(self, x: int, others: np.ndarray, need: np.ndarray) -> np.ndarray:
        """For each text (0 where not of others) no fewer than a common subsequence of text x and it can have, if it has `need`.

        Before a place of x that is matched at most n - need places of either text are left out, so the two places are no farther apart than that; a shingle is matched no oftener than either text has it.
        """
        held = self.held
        own = np.arange(held.begin[x], held.begin[x] + held.size[x])
        at = held._at(held.code[own])
        own = np.repeat(own, held.count[held.code[own]])
        keep = others[held.holder[at]]
        at, own = at[keep], own[keep]
        y, its = held.holder[at], held.order[at]
        near = (self.first[its] - self.last[own] <= (self.n - need)[y]) & (self.first[own] - self.last[its] <= (self.n[x] - need)[y])
        return np.bincount(y[near], np.minimum(self.times[its], self.times[own])[near], len(self.n))


def _joins(least: Fraction):
    """Of the members of one or two blocks of a leader (a): pairs of labels (a, b) that a link between two members joins, as few as join all that are linked. Two members of one best leader are compared at that one alone."""

    def run(rows: pa.Table) -> pa.Table:
        leader, two_blocks = rows["a"][0].as_py(), rows["lo"][0].as_py() != rows["hi"][0].as_py()
        label, best, block = (rows[c].to_numpy() for c in ("label", "best", "block"))
        out: list[tuple[int, int]] = []
        if (label != label[0]).any():
            texts = [np.frombuffer(x.as_py(), np.uint32) for x in rows["packed"]]
            one = [np.unique(x) for x in texts]
            held = _Postings(one)
            own, at, places, in_vain = label.copy(), np.arange(len(texts)), None, 0
            num, den = least.numerator, least.denominator
            for x, size in enumerate(held.size.tolist()):
                open_ = (at > x) & (own != own[x]) & ((best != best[x]) | (best == leader)) & (den * held.size >= num * size) & (num * held.size <= den * size)
                if two_blocks:
                    open_ &= block != block[x]
                if not open_.any():
                    continue
                mine = held.of(x)
                met = np.zeros(len(texts), bool)
                met[held.holders(mine[: size - -(-num * size // den) + 1])] = True
                met &= open_
                if not met.any():
                    continue
                common = np.bincount(held.holders(mine), minlength=len(texts))
                met &= (den + num) * common >= num * (size + held.size)
                if in_vain >= IN_VAIN and met.any():
                    places = places or _Places(texts, held)
                    need = -(-num * np.minimum(places.n[x], places.n) // den)
                    met &= places.in_reach(x, met, need) >= need
                for y in np.flatnonzero(met).tolist():
                    if own[x] == own[y]:
                        continue
                    if similar(texts[x], texts[y], least, one[x]):
                        out.append((int(label[x]), int(label[y])))
                        own[own == own[y]] = own[x]
                    else:
                        in_vain += 1
        return pa.table({"a": pa.array([p for p, _ in out], pa.int64()), "b": pa.array([q for _, q in out], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, sketches: int = SKETCHES, length: int = LENGTH
) -> DataFrame:
    """Classes of exact and near copies: one row for each input row with an id.

    Input: doc_id (integer), text; other columns are ignored. Two texts are linked if the Jaccard similarity of their sets of
    `words`-word shingles is at least `similarity` and a banded alignment keeps at least as much of the shorter text's shingles in
    order. Classes are the connected components. Output: doc_id, class_id (smallest doc_id of the class), n_copies (rows with the same words, itself included), kept (doc_id = class_id).

    Texts of the same words (white space aside) are copies, null and empty ones among themselves. Texts shorter than `words` words have no other links. Rows of
    equal doc_id count as one document: each of their texts finds its own links, and their classes are one. Rows without doc_id are left out; an empty table gives no rows.
    """
    least = Fraction(similarity).limit_denominator(1000)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    every = cut(docs.mapInArrow(_sketches(words, sketches, length), "doc_id long, print binary, sketches array<long>"))
    # a node is a print; its number is written, so it doesn't change
    texts = every.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"), F.any_value("sketches").alias("sketches"))
    texts = cut(texts.withColumn("node", F.monotonically_increasing_id()))
    nodes = texts.select("node", F.explode(F.array_distinct("sketches")).alias("bucket"))
    shared = cut(nodes.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut(nodes.join(shared, "bucket"))
    # candidates for a leader are ordered by support, then by a hash of their text
    support = cut(members.groupBy("node").agg(F.sum("n").alias("n")).join(texts.select("node", "print", "first"), "node").select("node", "first", F.struct("n", F.xxhash64("print").alias("tie")).alias("support")))
    known = texts.select("print", "node")
    packed = docs.join(support.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_pack(words), "print binary, packed binary")
    packed = cut(packed.join(known, "print").groupBy("node").agg(F.any_value("packed").alias("packed")))

    def both(pairs: DataFrame) -> DataFrame:
        """pairs (a, b, ...) with packed_a and packed_b; a may be the same in very many rows, whose partition Spark then splits."""
        right = pairs.join(packed.select(F.col("node").alias("b"), F.col("packed").alias("packed_b")), "b")
        return right.join(packed.select(F.col("node").alias("a"), F.col("packed").alias("packed_a")), "a")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) those that are linked."""
        return cut(both(pairs).select("a", "b", "packed_a", "packed_b").mapInArrow(_verify(least), "a long, b long"))

    def led_by(members: DataFrame) -> DataFrame:
        """bucket, a: each bucket's member of most support."""
        return members.join(support.select("node", "support"), "node").groupBy("bucket").agg(F.max_by("node", "support").alias("a"))

    first = cut(members.join(led_by(members), "bucket").select("a", F.col("node").alias("b")).where("a <> b").distinct())
    links = verified(first)
    same_id = every.groupBy("doc_id").agg(F.min("print").alias("p"), F.max("print").alias("q")).where("p < q").select("doc_id", "p")
    if same_id.head(1):
        same_id = every.select("doc_id", "print").join(same_id, "doc_id").where("p <> print").join(known, "print").select(F.col("node").alias("b"), F.col("p").alias("print")).join(known, "print")
        links = links.unionByName(cut(same_id.select(F.col("node").alias("a"), "b")))
    labels = components(links)

    # what leaders have not settled: members apart from their leader, against others of the same leader
    of = labels.select(F.col("node").alias("b"), "label")
    # of a member's leaders the one of most support is its best; two members of the same best one are looked at there alone
    best = first.join(support.select(F.col("node").alias("a"), "support"), "a").groupBy("b").agg(F.max_by("a", "support").alias("best"))
    led = first.join(best, "b").join(of, "b", "left").join(labels.select(F.col("node").alias("a"), F.col("label").alias("lead")), "a", "left")
    led = cut(led.select("a", "b", "best", F.coalesce("label", "b").alias("label"), (F.coalesce("label", "b") != F.coalesce("lead", "a")).alias("apart")))
    sizes = packed.select(F.col("node").alias("b"), F.octet_length("packed").alias("bytes"))
    mixed = led.join(sizes, "b").groupBy("a").agg(F.max("apart").alias("any"), F.count("*").alias("n"), F.ceil(F.sum("bytes") / BLOCK).cast("int").alias("blocks")).where("any and n > 1")
    dealt = led.join(mixed.select("a", "blocks"), "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(packed.withColumnRenamed("node", "b"), "b")
    dealt = dealt.select("a", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "label", "best", "packed")
    joins = cut(dealt.groupBy("a", "lo", "hi").applyInArrow(_joins(least), "a long, b long"))
    if joins.head(1):
        further = components(joins).select(F.col("node").alias("label"), F.col("label").alias("further"))
        # a node without links is its own label
        alone = further.select(F.col("label").alias("node"), "further").join(labels, "node", "left_anti").select("node", F.col("further").alias("label"))
        labels = labels.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label")).union(alone)
    placed = cut(texts.select("print", "node", "first", "n_copies").join(labels, "node", "left").select("print", "first", "n_copies", F.coalesce("label", "node").alias("label")))
    classes = placed.groupBy("label").agg(F.min("first").alias("class_id"))
    placed = placed.join(classes, "label").select("print", "n_copies", "class_id")
    return every.select("doc_id", "print").join(placed, "print").select("doc_id", "class_id", "n_copies", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """docs without the rows whose class keeps another document, and one row of a kept doc_id; columns as they are.

    Of several rows of a kept doc_id that of the smallest text stays. Rows without doc_id have no name to be kept under: they all stay.
    """
    seen = cut(near_duplicates(docs, **settings).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    left = docs.join(seen.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    twice = seen.where("kept and n > 1").select("doc_id")
    if not twice.head(1):
        return left
    others = [F.col(c) for c, kind in docs.dtypes if not kind.startswith("map") and c != "doc_id"]
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*others)))
    again = left.join(twice, "doc_id", "left_semi").withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return left.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(again.select(docs.columns))
