"""Token-id shards with a minimal perfect hash index.

A shard is one row of a Parquet table, so Spark's own commit protocol, any store and lost executors are taken care
of. Its columns are the file format:

* shard, n_ids: its number and how many ids it holds; low, high: its smallest and greatest doc_id;
* payload: ids of its documents one after the other, raw little-endian unsigned 32-bit integers;
* keys: its document keys in order, raw 64-bit integers; for scans and re-builds only;
* displace, prints, begins, counts: the index. A key's slot is found from one displacement word; the slot's stored
  fingerprint tells whether the key is there at all; begins and counts give its ids in the payload.

A look-up of one key reads one displacement, one fingerprint and one slice, whatever the shard's size.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trussline.llm.bytetext import parts, span_hashes
from trussline.llm.common import cut, text_bytes

MASK = (1 << 64) - 1
#: Text bytes that a shard is made for, least and most; documents are never split.
SHARD_BYTES = (4 << 20, 64 << 20)
#: Shards whose 16-byte bases are broadcast; more (some 100 TB of text) are joined without.
MAX_BROADCAST_SHARDS = 2_000_000
#: Pieces of text whose ids a worker remembers, about 50 bytes each; beyond that it forgets the later half. Longer pieces than MAX_PIECE bytes aren't remembered.
MEMO_WORDS, MAX_PIECE = 600_000, 256


def _bytes_of(wanted: str) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(wanted.encode())] = True
    return flags


_SPACE, _SOLID = _bytes_of(" \t\n\x0b\x0c\r"), _bytes_of("".join(map(chr, range(0x21, 0x7F))))
_LETTER, _MARK = _bytes_of(string.ascii_letters), _bytes_of(string.punctuation.replace("'", ""))


def _scramble(x: np.ndarray, seed: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & MASK)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class PerfectHash:
    """Maps n distinct 64-bit keys one to one onto 0..n-1: keys share a displacement by groups of about three."""

    def __init__(self, displace: np.ndarray, n: int):
        self.displace, self.n = displace, n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        if len(np.unique(keys)) < n:
            raise ValueError("keys must be distinct")
        groups = max(1, n // 3)
        group = (_scramble(keys, 1) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(groups + 1))
        sizes = np.diff(cuts)
        displace, taken = np.zeros(groups, np.uint32), np.zeros(n, bool)
        tries = np.arange(1, 65, dtype=np.uint64)[:, None]
        for g in np.argsort(-sizes, kind="stable"):
            if not sizes[g]:
                break
            members = _scramble(keys[order[cuts[g] : cuts[g + 1]]], 2)
            first = 0
            while True:
                slots = cls._slot(members[None, :], tries + np.uint64(first), n)
                free = ~taken[slots].any(1)
                if sizes[g] > 1:
                    ranked = np.sort(slots, 1)
                    free &= (ranked[:, 1:] != ranked[:, :-1]).all(1)
                if free.any():
                    at = int(np.argmax(free))
                    displace[g] = first + at + 1
                    taken[slots[at]] = True
                    break
                first += 64
        return cls(displace, n)

    @staticmethod
    def _slot(members: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
        x = members + displacement * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ x >> np.uint64(32)) % np.uint64(n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        d = self.displace[(_scramble(keys, 1) % np.uint64(len(self.displace))).astype(np.int64)]
        return self._slot(_scramble(keys, 2), d.astype(np.uint64), self.n)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return _scramble(keys, 3).astype(np.uint32)


class Memo:
    """Ids of pieces by 64-bit hash: an open-addressed table of arrays, 60 bytes or so a piece. A second hash of each is held to tell pieces apart that share the first."""

    def __init__(self, limit: int):
        self.limit, self.n, self.used = limit, 0, 0
        self.mask = np.uint64((1 << (2 * limit).bit_length()) - 1)
        self.ends, self.ids, self.second = np.zeros(1024, np.int64), np.zeros(1024, np.uint32), np.zeros(1024, np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.place = np.zeros(int(self.mask) + 1, np.uint64), np.zeros(int(self.mask) + 1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash (never 0), -1 where it isn't known."""
        out, still, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), h & self.mask
        while len(still):
            held = self.keys[slot]
            hit = held == h[still]
            out[still[hit]] = self.place[slot[hit]]
            more = ~hit & (held != 0)
            still, slot = still[more], slot[more] + np.uint64(1) & self.mask
        return out

    def _insert(self, h: np.ndarray, number: np.ndarray) -> None:
        slot = h & self.mask
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            mine = free & (self.keys[slot] == h)
            self.place[slot[mine]] = number[mine]
            h, number, slot = h[~mine], number[~mine], slot[~mine] + np.uint64(1) & self.mask

    def add(self, h: np.ndarray, second: np.ndarray, ids: list[list[int]]) -> None:
        """New distinct hashes, their second hashes and their ids."""
        self._insert(h, np.arange(self.n, self.n + len(h)))
        ends = self.used + np.cumsum([len(x) for x in ids])
        self.ends, self.ids = grown(self.ends, self.n + len(h)), grown(self.ids, int(ends[-1]))
        self.second = grown(self.second, self.n + len(h))
        self.ends[self.n : self.n + len(h)], self.second[self.n : self.n + len(h)] = ends, second
        self.ids[self.used : int(ends[-1])] = np.fromiter(chain.from_iterable(ids), np.uint32, int(ends[-1]) - self.used)
        self.n, self.used = self.n + len(h), int(ends[-1])

    def trim(self) -> None:
        """Beyond the limit the later half is forgotten: what came first is mostly what comes often."""
        if self.n > self.limit or self.used > 8 * self.limit:
            self.n //= 2
            self.used = int(self.ends[self.n - 1]) if self.n else 0
            kept = (self.keys != 0) & (self.place < self.n)
            keys, place = self.keys[kept], self.place[kept]
            self._clear()
            self._insert(keys, place)
            self.ends, self.ids, self.second = self.ends[: self.n].copy(), self.ids[: self.used].copy(), self.second[: self.n].copy()

    def gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and the number of each piece's."""
        end = self.ends[number]
        begin = np.where(number > 0, self.ends[number - 1], 0)
        counts = end - begin
        at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return self.ids[at], counts


def grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) >= n else np.concatenate((x, np.zeros(max(n, len(x) + len(x) // 2) - len(x), x.dtype)))


def piece_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a byte-level tokenizer that splits by the common expression has a token boundary, whatever stands around it.

    These are: before white space that follows none, after a single newline inside words, and between a Latin letter and an ASCII mark other than
    an apostrophe. `first` are the starts of texts. Next to white space beyond ASCII there is no cut.
    """
    mark = np.zeros(len(data) + 1, bool)
    mark[first] = True
    at = np.flatnonzero(_SPACE[data])
    at = at[at > 2]
    last, second, third = data[at - 1], data[at - 2], data[at - 3]
    wide = (second == 0xC2) | (third >= 0xE1) & (third <= 0xE3) & ((second == 0x80) | (second == 0x81) | (second == 0x9A))
    mark[at[_SOLID[last] | (last >= 0x80) & ~wide]] = True
    at = np.flatnonzero(data[: max(0, len(data) - 1)] == 0x0A)
    at = at[at > 0]
    mark[at[_SOLID[data[at - 1]] & _SOLID[data[at + 1]]] + 1] = True
    at = np.flatnonzero(_MARK[data])
    at = at[at > 1]
    last = data[at - 1]
    mark[at[_LETTER[last] | (data[at - 2] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)]] = True  # 0xC3: U+00C0 to U+00FF, less two signs
    return np.flatnonzero(mark[:-1])


def splits_by_words(path: str) -> bool:
    """Whether a tokenizer file is a byte-level one of the kind that `piece_starts` is about."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    before = kind.get("pre_tokenizer") or {}
    plain = not kind.get("normalizer") and not kind.get("truncation") and not kind.get("padding") and not kind["model"].get("dropout")
    return plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)


class Encoder:
    """Ids of whole texts as raw bytes, each with end_id after it (None: without).

    With a byte-level tokenizer texts are cut where tokens always end (`piece_starts`), and a distinct piece is encoded once and remembered: all
    lookups and the laying out of ids are array work on many texts at a time. Texts with an added token or a piece of over MAX_PIECE bytes, texts with a piece that shares
    its hash with another (a second hash tells), and all texts of tokenizers of another kind, are encoded whole.
    """

    piece_starts = staticmethod(piece_starts)

    def __init__(self, path: str, end_id: int | None, memo_words: int = MEMO_WORDS):
        # a task has one core: threads of the library's own would take others' and hold memory each
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = splits_by_words(path)
        self.memo = Memo(memo_words if self.by_piece else 1)
        self.end = b"" if end_id is None else np.array([end_id], np.uint32).tobytes()
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids of tokens that begin with a space
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.marks = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece. Those of one space and no white space at the end are encoded many at a time: in such a run a piece begins where a token begins with a space."""
        out: list[list[int]] = [[]] * len(pieces)
        usual = [i for i, p in enumerate(pieces) if p[0] == " " and len(p) > 1 and not p[1].isspace() and not p[-1].isspace() and p.count(" ") == 1]
        runs = [usual[a : a + 256] for a in range(0, len(usual), 256)]
        rest = sorted(set(range(len(pieces))).difference(usual))
        for run, ids in zip(runs, self._ids(["".join([pieces[i] for i in run]) for run in runs]), strict=True):
            starts = np.flatnonzero(self.spaced[ids]).tolist()
            if len(starts) != len(run):
                rest += run
                continue
            for i, a, b in zip(run, starts, [*starts[1:], len(ids)], strict=True):
                out[i] = ids[a:b]
        for i, ids in zip(rest, self._ids([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        whole = np.array([not self.by_piece or any(m in t for m in self.marks) for t in texts], bool)
        laid = b"".join([b"" if w else t for t, w in zip(texts, whole.tolist(), strict=True)])
        ends = np.cumsum([0 if w else len(t) for t, w in zip(texts, whole.tolist(), strict=True)])
        starts = self.piece_starts(np.frombuffer(laid, np.uint8), np.concatenate(([0], ends[:-1])))
        sizes = np.diff(np.append(starts, len(laid)))
        of = np.searchsorted(starts, np.concatenate(([0], ends)))  # pieces of text i: of[i] to of[i + 1]
        short = sizes <= MAX_PIECE
        long_before = np.concatenate(([0], np.cumsum(~short)))
        whole |= long_before[of[1:]] > long_before[of[:-1]]
        self.memo.trim()
        h = span_hashes(np.frombuffer(laid, np.uint8), starts, sizes) | np.uint64(1)
        second = span_hashes(np.frombuffer(laid, np.uint8), starts, sizes, seed=5)
        number = self.memo.find(h)
        new = np.flatnonzero((number < 0) & short)
        if len(new):
            distinct, where = np.unique(h[new], return_index=True)
            pieces = [laid[a : a + n].decode("utf-8", "replace") for a, n in zip(starts[new[where]].tolist(), sizes[new[where]].tolist(), strict=True)]
            self.memo.add(distinct, second[new[where]], self._new_ids(pieces))
            number[new] = self.memo.find(h[new])
        unlike = np.zeros(len(sizes), bool)
        unlike[short] = self.memo.second[number[short]] != second[short]
        if unlike.any():
            before = np.concatenate(([0], np.cumsum(unlike)))
            whole |= before[of[1:]] > before[of[:-1]]
        ids, counts = self.memo.gather(number[short])
        spread = np.zeros(len(sizes), np.int64)
        spread[short] = counts
        bounds = np.concatenate(([0], np.cumsum(spread)))[of].tolist()
        rest = iter(self._ids([t.decode("utf-8", "replace") for t, w in zip(texts, whole.tolist(), strict=True) if w]))
        return [(np.array(next(rest), np.uint32) if w else ids[bounds[i] : bounds[i + 1]]).tobytes() + self.end for i, w in enumerate(whole.tolist())]


@lru_cache(1)
def _encoder(path: str, end_id: int, memo_words: int) -> Encoder:
    """One for each worker, kept from task to task. It is found through this module: what a task's function holds itself is sent, and made, anew with each task."""
    return Encoder(path, end_id, memo_words)


_SHARD = "shard int, n_ids long, low long, high long, payload binary, keys binary, displace binary, prints binary, begins binary, counts binary"


def _shards(path: str, end_id: int, memo_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, end_id, memo_words)
        keys: list[int] = []
        ids: list[bytes] = []
        shard = last = None
        times = 0

        def flush() -> pa.RecordBatch:
            key = np.array(keys, np.int64)
            index = PerfectHash.build(key.view(np.uint64))
            counts = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            slot = index.slots(key.view(np.uint64))
            prints, begins, sizes = np.zeros(len(key), np.uint32), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
            prints[slot], begins[slot], sizes[slot] = fingerprint(key.view(np.uint64)), np.cumsum(counts) - counts, counts
            row = (shard, int(counts.sum()), keys[0], last, b"".join(ids), key.tobytes(), index.displace.tobytes(), prints.tobytes(), begins.tobytes(), sizes.tobytes())
            kinds = [pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in _SHARD.split(", ")])

        for batch in batches:
            for part, texts in parts(batch):
                for number, key, x in zip(part["shard"].to_pylist(), part["key"].to_pylist(), encode(texts), strict=True):
                    if shard is not None and number != shard:
                        yield flush()
                        keys, ids, last = [], [], None
                    shard, times = number, times + 1 if key == last else 0
                    last = key
                    keys.append(repeat_key(key, times) if times else key), ids.append(x)
        if keys:
            yield flush()

    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_bytes: tuple[int, int] = SHARD_BYTES, memo_words: int = MEMO_WORDS) -> None:
    """Encodes whole texts and writes them as shards under `path`, in ascending doc_id order.

    Input: doc_id (integer, not null), text; other columns are ignored. A null text counts as empty and holds the end id
    alone. Rows of equal doc_id are all kept, those of a shard in the order of
    their texts: the key of the second and later ones of a shard is a hash of doc_id and their rank, so that keyed look-up of doc_id finds a first one. Rows without a doc_id have no key and are left out.
    Raises ValueError if two keys of a shard collide. A worker keeps its memory of memo_words words from task to task: where other work
    shares the workers, fewer words leave it more memory and cost CPU time.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    size = text_bytes(docs)
    n = max(1, size // min(shard_bytes[1], max(shard_bytes[0], size // 4096)))
    sorted_docs = docs.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    keyed = sorted_docs.select(F.spark_partition_id().alias("shard"), F.col("doc_id").alias("key"), "text")
    keyed.mapInArrow(_shards(tokenizer, end_id, memo_words), _SHARD).write.option("compression", "zstd").parquet(path)


def repeat_key(key: int, times: int) -> int:
    """The key of the times-th repeat of a document in its shard."""
    return int(_scramble(np.array([key], np.int64).view(np.uint64), 7 + times).view(np.int64)[0])


def originals(keys: np.ndarray) -> tuple[list[int], list[int]]:
    """doc_ids of a shard's keys in order, and the number of each repeat."""
    ids, repeat = keys.tolist(), [0] * len(keys)
    follows = _scramble(keys.view(np.uint64), 8).view(np.int64)[:-1] == keys[1:]
    for i in np.flatnonzero(follows).tolist():
        times, first = 1, ids[i]
        while i + times < len(keys) and int(keys[i + times]) == repeat_key(first, times):
            ids[i + times], repeat[i + times] = first, times
            times += 1
    return ids, repeat


class Shard:
    """Keyed access to one shard's row."""

    def __init__(self, row: dict):
        self.payload = row["payload"]
        self.prints, self.begins, self.counts = (np.frombuffer(row[x], k) for x, k in (("prints", np.uint32), ("begins", np.int64), ("counts", np.int64)))
        self.index = PerfectHash(np.frombuffer(row["displace"], np.uint32), len(self.prints))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each key: whether its fingerprint is there, its first id's place, its number of ids."""
        slot = self.index.slots(keys.view(np.uint64))
        return self.prints[slot] == fingerprint(keys.view(np.uint64)), self.begins[slot], self.counts[slot]

    def ids(self, begin: int, count: int) -> np.ndarray:
        return np.frombuffer(self.payload, np.uint32, count, 4 * begin)


def with_bases(shards: DataFrame) -> DataFrame:
    """Shard number and the ids before it: one small row for each shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("shard", "n_ids").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")).select("shard", "base")


_READ = "doc_id long, start long, n_tokens long, ids_crc32 long, repeat int"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards under `path`, each looked up by its key through the index.

    Columns: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, repeat (0, or the number of a repeated
    row in its shard). Raises ValueError where a key isn't found or its place isn't the one the payload's order gives.
    """
    shards = spark.read.schema(_SHARD).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows)):
            shard, keys = Shard(row), np.frombuffer(row["keys"], np.int64)
            there, begins, counts = shard.find(keys)
            if not there.all() or not (begins == np.cumsum(counts) - counts).all():
                raise ValueError(f"shard {row['shard']}: index and payload disagree")
            view = memoryview(shard.payload)
            crc = [zlib.crc32(view[4 * b : 4 * (b + c)]) for b, c in zip(begins.tolist(), counts.tolist(), strict=True)]
            ids, repeat = originals(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in ((ids, pa.int64()), (begins + row["base"], pa.int64()), (counts, pa.int64()), (crc, pa.int64()), (repeat, pa.int32()))],
                [x.split()[0] for x in _READ.split(", ")],
            )

    bases = with_bases(shards)
    few = shards.select("shard").count() <= MAX_BROADCAST_SHARDS
    return shards.join(F.broadcast(bases) if few else bases, "shard").mapInArrow(run, _READ)


#: Wanted keys that are sent to the shards' rows as they are; more are joined, and then the wanted shards' rows are shuffled once.
MAX_SENT_KEYS = 100_000
#: Wanted shards that are named in the filter on the files.
MAX_NAMED_SHARDS = 5_000


def look_up(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Ids of the documents named in keys.doc_id: doc_id, ids (array); keys that no shard holds give no row.

    Only the ranges of the shards are read to place the keys, and only wanted shards' rows after that: a file holds one shard, so others are skipped by
    their statistics. In a shard a key costs one displacement, one fingerprint and one slice of the payload. Of repeated doc_ids a first one is found.
    """
    shards = spark.read.schema(_SHARD).parquet(path)
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ranges = shards.select("shard", "low", "high")  # three numbers a shard, at most MAX_BROADCAST_SHARDS are sent
    ranges = F.broadcast(ranges) if ranges.count() <= MAX_BROADCAST_SHARDS else ranges
    # a doc_id whose rows are over two shards starts in the first of them
    placed = wanted.join(ranges, F.col("doc_id").between(F.col("low"), F.col("high"))).groupBy("doc_id").agg(F.min("shard").alias("shard"))
    per = cut(placed.groupBy("shard").agg(F.collect_list("doc_id").alias("wanted")))
    size = per.agg(F.sum(F.size("wanted")).alias("keys"), F.count("*").alias("shards")).first()
    if size.shards <= MAX_NAMED_SHARDS:
        shards = shards.where(F.col("shard").isin([r.shard for r in per.select("shard").collect()]))
    held = shards.join(F.broadcast(per) if (size["keys"] or 0) <= MAX_SENT_KEYS else per, "shard").select("payload", "displace", "prints", "begins", "counts", "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard, asked = Shard(row), np.array(row["wanted"], np.int64)
                found = [(k, shard.ids(b, c).tolist()) for k, ok, b, c in zip(asked.tolist(), *(x.tolist() for x in shard.find(asked)), strict=True) if ok]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return held.mapInArrow(fetch, "doc_id long, ids array<long>")
