"""Byte-level words and span hashes, vectorised over a slice of documents.

Two word definitions are used by the operators:

* raw words: maximal runs of bytes other than 0x20 and 0x09-0x0D, unchanged;
* folded words: A-Z lower-cased, maximal runs of a-z, 0-9 and non-ASCII bytes.

Both delimiters are ASCII, so splitting UTF-8 bytes gives the same words as splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_FOLD = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else 0x20 for c in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = (1 << 64) - 1


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null reads as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def fold(text: bytes) -> bytes:
    """Folded words joined by single spaces."""
    return b" ".join(text.lower().translate(_FOLD).split())


def folded_words(text: bytes) -> list[bytes]:
    return text.lower().translate(_FOLD).split()


#: Text bytes that are worked on at once; arrays of words and hashes take some 50 times as much.
SLICE_BYTES = 1 << 19


def parts(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch by rows of about `limit` text bytes (one row at least), each with its texts as UTF-8 bytes.

    Only one part's texts are Python objects at a time, however large Spark's batches are.
    """
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch[column].cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, limit + (ends[start - 1] if start else 0), "right")))
        part = batch.slice(start, stop - start)
        yield part, utf8(part[column])
        start = stop


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about `limit` bytes (one text at least), so that arrays stay small."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.copy()
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.base = int(rng.integers(1 << 62)) * 2 + 1
        self.table = rng.integers(0, _MASK, 512, dtype=np.uint64, endpoint=True)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, step in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(n, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))


_HASHES: dict[int, _Powers] = {}


class WordIndex:
    """Raw words of several texts laid end to end, with hashes of any run of words.

    A run's hash depends on its words alone, not on the white space between them nor on where it stands.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        solid = ~_IS_SPACE[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        kept = np.flatnonzero(solid)
        at = first[kept]
        self._coded = data[kept].astype(np.uint16) + at * np.uint16(256)
        self._edges = np.append(np.flatnonzero(at), len(kept))
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        starts = np.flatnonzero(first)
        #: words of text d: bounds[d] to bounds[d + 1]
        self.bounds = np.searchsorted(starts, np.concatenate(([0], ends)))
        self.n = len(starts)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self._sums: dict[int, np.ndarray] = {}

    def word_edges(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte of each word."""
        return self._coded[self._edges[:-1]] & 255, self._coded[self._edges[1:] - 1] & 255

    def windows(self, k: int) -> np.ndarray:
        """Starts of all runs of k words inside one text."""
        if self.n < k:
            return np.zeros(0, np.int64)
        start = np.arange(self.n - k + 1)
        return start[self.bounds[1:][self.doc[: len(start)]] - start >= k]

    def hashes(self, start: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
        powers = _HASHES.setdefault(seed, _Powers(seed))
        powers.reach(len(self._coded) + 1)
        if seed not in self._sums:
            sums = np.zeros(len(self._coded) + 1, np.uint64)
            np.cumsum(powers.table[self._coded] * powers.up[: len(self._coded)], out=sums[1:])
            self._sums[seed] = sums
        sums, a, b = self._sums[seed], self._edges[start], self._edges[start + k]
        return mix((sums[b] - sums[a]) * powers.down[a])


def span_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 3) -> np.ndarray:
    """64-bit hashes of byte runs: of a run's bytes and length alone."""
    powers = _HASHES.setdefault(seed, _Powers(seed))
    powers.reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(powers.table[data] * powers.up[: len(data)], out=sums[1:])
    return mix((sums[start + size] - sums[start]) * powers.down[start] + size.astype(np.uint64))


def id_hashes(ids: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 7) -> np.ndarray:
    """64-bit hashes of runs of whole numbers: of a run's numbers and length alone."""
    powers = _HASHES.setdefault(seed, _Powers(seed))
    powers.reach(len(ids) + 1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(powers.base)) * powers.up[: len(ids)], out=sums[1:])
    return mix((sums[start + size] - sums[start]) * powers.down[start] + size.astype(np.uint64))
