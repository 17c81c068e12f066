"""Near duplicates by SimHash fingerprints, compared exactly tile by tile.

A fingerprint has 64 bits. Two of them at most `radius` bits apart are linked; components of links are the groups. Equal fingerprints are one node from the
start, so a group of copies of any size costs one comparison.

Distinct fingerprints are laid out in tiles by the population counts of their parts (four of 16 bits, say): a tile holds fingerprints of one vector of counts, TILE of
them or so. A differing bit changes one count by one, so two tiles whose vectors are more than `radius` apart (sum of differences) hold no link and are never
put side by side: of random fingerprints some 25 % of all pairs remain with two parts, 5 % with four, 0.2 % with eight. What remains is compared in full with numpy. A pair of tiles
gives a spanning forest of its links, never all of them, so a dense group gives rows in proportion to its fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.llm.bytetext import parts
from trussline.llm.common import cut
from trussline.llm.graph import components

WORDS, RADIUS, SEED, TILE = 3, 3, 42, 4096
#: Parts by which tiles are told apart, up to so many distinct fingerprints, else eight: more parts mean fewer comparisons and more pairs of tiles. Results are the same.
PARTS = {500_000: 2, 30_000_000: 4}
#: Bytes of one text whose words are Python objects at once, and fingerprints that a task remembers as joined.
BLOCK, REMEMBERED = 1 << 20, 1 << 19
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _blocks(text: bytes, words: int) -> Iterator[list[bytes]]:
    """Words of a text by blocks; the last words - 1 of a block come again before the next."""
    at, held = 0, []
    while at < len(text):
        end = _SPACE.search(text, min(len(text), at + BLOCK))
        stop = end.start() if end else len(text)
        found = held + text[at:stop].split()
        yield found
        at, held = stop, found[len(found) - words + 1 :] if len(found) >= words else found


def text_fingerprint(text: bytes, words: int = WORDS) -> int:
    """Unsigned 64 bits: a bit is set if over half of the shingles' hashes have it. Shorter texts are one shingle, texts without words give 0."""
    ones, n, last = np.zeros(64, np.int64), 0, []
    for found in _blocks(text.lower(), words):
        last = found
        if len(found) < words:
            continue
        joined = b" ".join(found)
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
        grams = [joined[a:b] for a, b in zip(starts, ends[words - 1 :], strict=False)]
        n += len(grams)
        columns = np.frombuffer(b"".join(map(xxhash.xxh64_digest, grams, repeat(SEED))), np.uint8).reshape(-1, 8)  # the highest byte first
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(columns[:, 7 - k], minlength=256) @ _BITS
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(last), SEED) if last else 0
    return sum(1 << j for j in np.flatnonzero(2 * ones > n).tolist())


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in parts(batch):
                prints = np.array([text_fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(prints)], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, print (the 64 bits as a signed long) of each row's whole text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_fingerprints(words), "doc_id long, print long")


class _Joined:
    """Which fingerprints a task has joined already. It forgets all when it is full: then a link may be given twice, which changes nothing."""

    def __init__(self):
        self.of: dict[int, int] = {}

    def root(self, x: int) -> int:
        of = self.of
        while (up := of.get(x, x)) != x:
            of[x] = x = of.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether this is news."""
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        if len(self.of) > REMEMBERED:
            self.of.clear()
        self.of[max(x, y)] = min(x, y)
        return True


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Pairs of places of a and b at most `radius` bits apart: as many as it takes to connect what all such pairs connect."""
    one, two, label = [], [], np.arange(len(b))
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        for i in np.flatnonzero(near.any(1)).tolist():
            hits = np.flatnonzero(near[i])
            own = label[hits]
            if (own == own[0]).all():
                one.append(at + i), two.append(int(hits[0]))
                continue
            found, where = np.unique(own, return_index=True)
            one += [at + i] * len(found)
            two += hits[where].tolist()
            label[np.isin(label, found[1:])] = found[0]
    return one, two


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Joined()
        for batch in batches:
            left, right = [], []
            for i in range(batch.num_rows):
                a, b = (batch[c][i].values.to_numpy(zero_copy_only=False) for c in ("prints_a", "prints_b"))
                places = forest(a.view(np.uint64), b.view(np.uint64), radius)
                for x, y in zip(a[places[0]].tolist(), b[places[1]].tolist(), strict=True):
                    if x != y and joined.join(x, y):
                        left.append(x), right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _steps(n_parts: int, radius: int) -> list[int]:
    """Differences of count vectors at most `radius` apart, one of each pair of opposites, as differences of cell numbers (a byte for each part's count)."""
    found = [()]
    for _ in range(n_parts):
        found = [(*x, d) for x, d in product(found, range(-radius, radius + 1)) if sum(map(abs, x)) + abs(d) <= radius]
    return [sum(d << 8 * j for j, d in enumerate(x)) for x in found if x >= (0,) * n_parts]


def near_pairs(prints: DataFrame, radius: int = RADIUS, n_parts: int | None = None, tile: int = TILE) -> DataFrame:
    """Links a, b (longs) that connect distinct fingerprints (column print) as all pairs at most `radius` bits apart do.

    n_parts: 1, 2, 4 or 8 parts of the fingerprint whose population counts tell tiles apart; by default more for more fingerprints.
    """
    if not n_parts:
        n = prints.count()
        n_parts = min((p for most, p in PARTS.items() if n <= most), default=8)
    width = 64 // n_parts
    part = [F.bit_count(F.shiftrightunsigned("print", width * j).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))).cast("long") for j in range(n_parts)]
    cell = sum((F.shiftleft(p, 8 * j) for j, p in enumerate(part[1:], 1)), part[0])
    placed = prints.select("print", cell.alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("n_tiles"))
    tiles = placed.join(sizes, "cell").groupBy("cell", F.pmod(F.xxhash64("print"), "n_tiles").alias("tile"))
    tiles = cut(tiles.agg(F.collect_list("print").alias("prints")))
    other = tiles.select(F.col("cell").alias("cell_b"), F.col("tile").alias("tile_b"))
    steps = F.explode(F.array(*[F.lit(x).cast("long") for x in _steps(n_parts, radius)]))
    meets = tiles.select("cell", "tile", steps.alias("step")).withColumn("cell_b", F.col("cell") + F.col("step")).join(other, "cell_b")
    meets = meets.where("step <> 0 or tile <= tile_b").select("cell", "tile", "cell_b", "tile_b")
    with_b = meets.join(tiles.select(F.col("cell").alias("cell_b"), F.col("tile").alias("tile_b"), F.col("prints").alias("prints_b")), ["cell_b", "tile_b"])
    both = with_b.join(tiles.withColumnRenamed("prints", "prints_a"), ["cell", "tile"])
    return both.select("prints_a", "prints_b").mapInArrow(_compare(radius), "a long, b long")


def simhash_groups(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, n_parts: int | None = None, tile: int = TILE) -> DataFrame:
    """Groups of near duplicates: one row for each input row.

    Input: doc_id (integer), text; other columns are ignored. Output: doc_id, print (signed long), component_id: the smallest doc_id of the rows that can be
    reached by links of at most `radius` bits.

    Words are runs of other than white space, A-Z lower-cased; shingles of `words` words count as often as they stand there. A text of fewer words is one shingle; null and empty
    texts have fingerprint 0 and are linked like any other. Rows of equal doc_id are rows of their own, which share a component only by links. Rows
    without doc_id link others and are returned; a component of such rows alone has no component_id. An empty table gives no rows.
    """
    seen = cut(fingerprints(docs, words))
    nodes = cut(seen.groupBy("print").agg(F.min("doc_id").alias("first")))
    labels = components(near_pairs(nodes.select("print"), radius, n_parts, tile))
    placed = cut(nodes.join(labels.withColumnRenamed("node", "print"), "print", "left").select("print", "first", F.coalesce("label", "print").alias("label")))
    named = placed.join(placed.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("print", "component_id")
    return seen.join(named, "print").select("doc_id", "print", "component_id")


def as_hex(column: str = "print"):
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
