"""Alignment of two tokenizers over whole texts: shared token ends, groups and links between them.

Both tokenizers encode the whole text. Where a token of either ends at the same byte and both next tokens begin with a space, the text is cut (an anchor): the ends are
taken from the tokens' own bytes, which are first held against the text. Between two anchors stands a window, a pair of id tuples. A window's groups and links depend on its
ids alone, so they are worked out once and remembered by the tuples (in arrays: found by a hash, then held against the ids); most windows are one word and come again and again.

Windows are cut, gathered and looked up by arrays over many texts at a time. A long text is encoded in slices that
end before a space between two solid bytes, where both tokenizers have a boundary, so memory is bounded by the slice and by the text's distinct links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trussline.llm.bytetext import id_hashes, mix, parts
from trussline.llm.common import cut
from trussline.llm.tokens import Encoder, Memo, grown

#: Windows and pieces that a worker remembers; bytes of text that are worked on at once.
MEMO_WINDOWS, MEMO_PIECES, SLICE = 400_000, 400_000, 1 << 19
#: Id pairs whose counts are sent to the workers as arrays (17 bytes each); more are joined.
MAX_SENT_PAIRS = 2_000_000
_SAFE = re.compile(rb"[\x21-\x7E](?= [^\x09-\x0D\x20])")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceEncoder(Encoder):
    """The same for a model of pieces in which a space is U+2581 and begins a piece: no piece goes on over a space, so texts are cut before one.

    Texts begin with a space, which the library itself adds and which is therefore not given to it.
    """

    def __init__(self, path: str, memo_words: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_piece = not any("▁" in p.lstrip("▁") for p in self.pieces)
        self.by_line = not any("\n" in p for p in self.pieces)
        self.space = self.model.piece_to_id("▁")
        self.memo, self.end, self.marks = Memo(memo_words if self.by_piece else 1), b"", []

    def piece_starts(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        mark = np.zeros(len(data) + 1, bool)
        space = data == 0x20
        mark[1:-1] = space[1:] & ~space[:-1]
        if self.by_line:
            mark[:-1] |= data == 0x0A
        mark[first] = True
        return np.flatnonzero(mark[:-1])

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """A text that begins with another byte than a space (a new line) gets the space that the library adds, as a token of its own, taken away."""
        given = self.model.encode([t.removeprefix(" ") for t in texts], num_threads=1)
        return [([self.space] if t == " " else ids) if t[:1] == " " else ids[1:] for t, ids in zip(texts, given, strict=True)]

    _new_ids = _ids


def token_bytes(path_a: str, b: PieceEncoder) -> tuple[list[bytes], list[bytes]]:
    """The bytes of each id of the byte-level tokenizer and of the piece model."""
    from tokenizers import Tokenizer

    alphabet, vocabulary = byte_alphabet(), Tokenizer.from_file(path_a).get_vocab()
    one = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for text, i in vocabulary.items():
        one[i] = bytes(alphabet[c] for c in text) if all(c in alphabet for c in text) else text.encode()
    two = [bytes([int(p[3:5], 16)]) if b.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(b.pieces)]
    return one, two


def align(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Alignment of windows laid end to end: two runs of ids that stand for the same bytes.

    Gives the groups' ends (how many tokens of a and of b stand before), and the links: of each a token in turn the b tokens that overlap it, and how many those are.
    """
    ends_a, ends_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
    low = np.searchsorted(ends_b, ends_a - size_a[a], "right")
    n = np.searchsorted(ends_b - size_b[b], ends_a, "left") - low
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.searchsorted(ends_a, shared) + 1, np.searchsorted(ends_b, shared) + 1, b[at], n


class Aligner:
    """Both encoders, and the windows that were aligned before."""

    def __init__(self, path_a: str, path_b: str, memo_windows: int = MEMO_WINDOWS):
        self.a, self.b = Encoder(path_a, None, MEMO_PIECES), PieceEncoder(path_b, MEMO_PIECES)
        self.a.tokenizer.encode_special_tokens, self.a.marks = True, []
        self.bytes_a, self.bytes_b = token_bytes(path_a, self.b)
        self.size_a, self.size_b = (np.array([len(x) for x in y]) for y in (self.bytes_a, self.bytes_b))
        self.spaced_a, self.spaced_b = (np.array([x[:1] == b" " for x in y]) for y in (self.bytes_a, self.bytes_b))
        size = max(len(self.bytes_a), len(self.bytes_b))
        #: an id's text before each of the marks
        self.marked = [[f"{i}{mark}" for i in range(size)] for mark in ",|;\n"]
        self.limit, self.seed = memo_windows, 7
        self._forget()

    def _forget(self) -> None:
        #: a window is found by its hash and known by its ids: how many of a, then those of a and of b
        self.memo = Memo(self.limit)
        self.text: list[str] = []
        self.n_groups, self.ends, self.links = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def _learn(self, h: np.ndarray, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        """Aligns new windows, laid end to end, all at once, and remembers them."""
        known = _keys(a, n_a, b, n_b)
        self.memo.add(h, np.zeros(len(h), np.uint64), np.split(known, np.cumsum(n_a + n_b + 1)[:-1]))
        group_a, group_b, other, n_links = align(a, b, self.size_a, self.size_b)
        # marks: a comma after a token, a bar after a group's last of a, a semicolon after its last of b, a new line after a window
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[group_a - 1], mark_b[group_b - 1], mark_b[np.cumsum(n_b) - 1] = 1, 2, 3
        order = np.argsort(np.concatenate((2 * np.searchsorted(group_a, np.arange(len(a)), "right"), 2 * np.searchsorted(group_b, np.arange(len(b)), "right") + 1)), kind="stable")
        marks, ids = np.concatenate((mark_a, mark_b))[order].tolist(), np.concatenate((a, b))[order].tolist()
        first, marked = len(self.text), self.marked
        self.text += "".join([marked[m][i] for m, i in zip(marks, ids, strict=True)]).split("\n")[:-1]
        last = len(self.text)
        used = int(self.ends[first - 1]) if first else 0
        ends = used + np.cumsum(np.add.reduceat(n_links, np.cumsum(n_a) - n_a))
        self.n_groups, self.ends, self.links = grown(self.n_groups, last), grown(self.ends, last), grown(self.links, int(ends[-1]))
        self.n_groups[first:last] = np.diff(np.append(0, np.searchsorted(group_a, np.cumsum(n_a), "right")))
        self.ends[first:last] = ends
        self.links[used : int(ends[-1])] = np.repeat(a, n_links) * len(self.bytes_b) + other

    def links_of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of windows one after the other, and the number of each window's."""
        begin = np.where(windows > 0, self.ends[windows - 1], 0)
        n = self.ends[windows] - begin
        return self.links[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())], n

    def encoded(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both for texts that begin with a space; None where the tokens' bytes aren't the text's."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, *both in zip(texts, self.a(texts), self.b(texts), strict=True):
            a, b = (np.frombuffer(x, np.uint32).astype(np.int64) for x in both)
            same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == text == b"".join(map(self.bytes_b.__getitem__, b.tolist()))
            out.append((a, b) if same else None)
        return out

    def windows(self, both: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the windows of texts, and how many each text has."""
        a, b = (np.concatenate(x) for x in zip(*both, strict=True))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        next_a, next_b = np.searchsorted(ends_a, shared) + 1, np.searchsorted(ends_b, shared) + 1
        last = np.zeros(len(a) + 1, bool)
        last[np.cumsum([len(x) for x, _ in both])] = True
        anchor = last[next_a] | np.append(self.spaced_a[a], True)[next_a] & np.append(self.spaced_b[b], True)[next_b]
        stop_a, stop_b = next_a[anchor], next_b[anchor]
        start_a, start_b = np.append(0, stop_a[:-1]), np.append(0, stop_b[:-1])
        n_a, n_b = stop_a - start_a, stop_b - start_b
        self.memo.trim()  # beyond the limit the later half is forgotten: what came first is mostly what comes often
        del self.text[self.memo.n :]
        while True:
            h = mix(id_hashes(a, start_a, n_a, self.seed) + mix(id_hashes(b, start_b, n_b, self.seed))) | np.uint64(1)
            distinct, first, of = np.unique(h, return_index=True, return_inverse=True)
            numbers = self.memo.find(distinct)
            old, new = first[numbers >= 0], first[numbers < 0]
            alike = _like_first(a, start_a, n_a, first[of]) and _like_first(b, start_b, n_b, first[of])
            if alike and np.array_equal(self.memo.gather(numbers[numbers >= 0])[0], _keys(_runs(a, start_a[old], n_a[old]), n_a[old], _runs(b, start_b[old], n_b[old]), n_b[old])):
                break
            # two windows share a hash: another one is taken, and all is learnt anew
            self.seed += 1
            self._forget()
        if len(new):
            self._learn(h[new], _runs(a, start_a[new], n_a[new]), n_a[new], _runs(b, start_b[new], n_b[new]), n_b[new])
            numbers = self.memo.find(distinct)
        return numbers[of], np.diff(np.append(0, np.flatnonzero(last[stop_a]) + 1))


def _runs(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of ids one after the other."""
    return ids[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


def _keys(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """For each of the windows laid end to end: how many ids of a it has, those of a, those of b."""
    out = np.empty(len(a) + len(b) + len(n_a), np.uint32)
    begin = np.cumsum(n_a + n_b + 1) - (n_a + n_b + 1)
    out[begin] = n_a
    out[np.repeat(begin + 1 - (np.cumsum(n_a) - n_a), n_a) + np.arange(len(a))] = a
    out[np.repeat(begin + 1 + n_a - (np.cumsum(n_b) - n_b), n_b) + np.arange(len(b))] = b
    return out


def _like_first(ids: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> bool:
    """Whether each run of ids, which together are all of them in order, is the same as that of number first."""
    return bool((size == size[first]).all()) and bool((ids[np.arange(len(ids)) + np.repeat(start[first] - start, size)] == ids).all())


def text_slices(text: bytes, limit: int = SLICE) -> Iterator[bytes]:
    """A text with a space before it, cut before spaces where either tokenizer has a boundary; slices are longer than `limit` only where there is none."""
    text, at = b" " + text, 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit)
        if not found:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:]


class _Sums:
    """What is known of one document so far."""

    def __init__(self):
        self.counts, self.sha, self.links, self.times = np.zeros(4, np.int64), None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ok = True

    def add(self, aligner: Aligner, ids: tuple[np.ndarray, np.ndarray], windows: np.ndarray) -> None:
        found, n = np.unique(windows, return_counts=True)
        links, sizes = aligner.links_of(found)
        times = np.repeat(n, sizes)
        self.counts += (len(ids[0]), len(ids[1]), int((aligner.n_groups[found] * n).sum()), int(times.sum()))
        every, of = np.unique(np.concatenate((self.links, links)), return_inverse=True)
        self.times = np.bincount(of, np.concatenate((self.times, times)), len(every)).astype(np.int64)
        self.links = every
        data = ";".join(map(aligner.text.__getitem__, windows.tolist())).encode()
        if self.sha is None:
            self.sha = hashlib.sha256(data)
        else:
            self.sha.update(b";" + data)


def _aligned(aligner: Aligner, texts: list[bytes]) -> list[_Sums]:
    sums = [_Sums() for _ in texts]
    slices: list[bytes] = []
    of: list[int] = []

    def flush() -> None:
        both = aligner.encoded(slices)
        for i, x in zip(of, both, strict=True):
            sums[i].ok &= x is not None
        known = [(i, x) for i, x in zip(of, both, strict=True) if x is not None]
        if known:
            windows, n = aligner.windows([x for _, x in known])
            for (i, x), own in zip(known, np.split(windows, np.cumsum(n)[:-1]), strict=True):
                sums[i].add(aligner, x, own)
        slices.clear(), of.clear()

    size = 0
    for i, text in enumerate(texts):
        for x in text_slices(text) if text else ():
            if size and size + len(x) > 2 * SLICE:
                flush()
                size = 0
            slices.append(x), of.append(i)
            size += len(x)
    if slices:
        flush()
    return [x if x.ok else _Sums() for x in sums]


@lru_cache(1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker, kept from task to task."""
    return Aligner(path_a, path_b)


_COLUMNS = ("n_a", "n_b", "n_groups", "n_links")


def _align(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            for part, texts in parts(batch):
                sums = _aligned(aligner, texts)
                counts = [pa.array([int(x.counts[k]) for x in sums], pa.int64()) for k in range(4)]
                shas = pa.array([x.sha.hexdigest() if x.sha else "" for x in sums])
                packed = [pa.array([x.astype(kind).tobytes() for x in column], pa.binary()) for column, kind in (([x.links for x in sums], np.int64), ([x.times for x in sums], np.int32))]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *counts, shas, *packed], ["doc_id", *_COLUMNS, "groups_sha256", "pairs", "times"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents of a part have a pair."""
    for batch in batches:
        for _, packed in parts(batch, "pairs"):
            found, n = np.unique(np.frombuffer(b"".join(packed), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["pair", "n"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, packed in parts(batch, "pairs"):
            pairs, times = (np.frombuffer(b"".join(x), kind) for x, kind in ((packed, np.int64), (part["times"].to_pylist(), np.int32)))
            row = np.repeat(part["row"].to_numpy(zero_copy_only=False), [len(x) // 8 for x in packed])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(pairs), pa.array(times)], ["row", "pair", "times"])


def _looked_up(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = sent.value
        for batch in batches:
            for part, packed in parts(batch, "pairs"):
                n_best, total = [], []
                for x, y in zip(packed, part["times"].to_pylist(), strict=True):
                    at, times = np.searchsorted(keys, np.frombuffer(x, np.int64)), np.frombuffer(y, np.int32).astype(np.int64)
                    n_best.append(int(times[best[at]].sum())), total.append(int((counts[at] * times).sum()))
                yield pa.RecordBatch.from_arrays([part[c] for c in ("doc_id", *_COLUMNS)] + [pa.array(n_best, pa.int64()), pa.array(total, pa.int64()), part["groups_sha256"]], ["doc_id", *_COLUMNS, "n_best", "count_sum", "groups_sha256"])

    return run


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """pair, n (documents that have it linked), best (no other pair of its first id has more). A first id has at most n_b pairs, so its window is small."""
    counts = aligned.select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return cut(counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / n_b)))))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, max_sent: int = MAX_SENT_PAIRS) -> DataFrame:
    """How two tokenizers cut each text: one row for each input row.

    Input: doc_id (integer), text; other columns are ignored. path_a: a byte-level tokenizer of the tokenizers library, which gets the text after a space; path_b: a piece model of
    sentencepiece, which adds the space. Output: doc_id, n_a and n_b (tokens), n_groups (runs between shared token ends), n_links (pairs of overlapping tokens), n_best (links
    whose pair of ids stands linked in as many documents as any of its first id), count_sum (over links: documents with that pair), groups_sha256 (of the groups' ids).

    Texts that are null or empty, or that the tokens of either don't give back byte by byte, have zeros and no hash. Each row is a document of its own, also where ids repeat or are null. Empty
    tables give no rows. Counts are taken over all rows; up to `max_sent` pairs are sent to the workers as arrays, more are joined.
    """
    n_b = _piece_count(path_b)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"{c} long" for c in _COLUMNS)
    aligned = cut(docs.mapInArrow(_align(path_a, path_b), f"doc_id long, {kinds}, groups_sha256 string, pairs binary, times binary").withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(aligned, n_b)
    out = ["doc_id", *_COLUMNS, "n_best", "count_sum", "groups_sha256"]
    if counts.count() <= max_sent:
        table = counts.toArrow().sort_by("pair")
        sent = aligned.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))
        return aligned.drop("row").mapInArrow(_looked_up(sent), f"doc_id long, {kinds}, n_best long, count_sum long, groups_sha256 string")
    links = aligned.select("row", "pairs", "times").mapInArrow(_unpacked, "row long, pair long, times int").join(counts, "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    return aligned.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select(out)


@lru_cache(4)
def _piece_count(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
