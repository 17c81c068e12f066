"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are of two families of equal weight: hashed byte trigrams, and hashed pairs of word shapes (kinds of a word's first and last byte,
and whether it repeats the word before), which show how a text is laid out. A bounded sample of labelled rows (`max_labelled`, a parameter) gives the terms' idf weights and, by a truncated
SVD of the weighted term matrix, a latent space of `rank` dimensions. The sample's unit vectors and labels are broadcast:
rank * max_labelled floats, whatever the corpus. Every document is folded into that space, its cosine products with all labelled
vectors are computed block by block (no index, no pruning), and its `neighbours` nearest vote with their similarity as weight. A text never
votes on itself: labelled rows of the same text are left out of its neighbours, so its own label is no input of its score.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.llm.bytetext import WordIndex, parts, slices

#: Bins of hashed trigrams, and all bins.
LEXICAL, TERMS = 2048, 2560


class NeighbourModel(NamedTuple):
    weight: np.ndarray  # TERMS
    basis: np.ndarray  # TERMS x rank
    vectors: np.ndarray  # labelled x rank, unit rows
    labels: np.ndarray
    keys: np.ndarray  # a 64-bit hash of each labelled text
    neighbours: int
    prior: float


def _kinds() -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 other ASCII, 4 the rest."""
    kinds = np.full(256, 3, np.int64)
    for n, group in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789")):
        kinds[list(group)] = n
    kinds[128:] = 4
    return kinds


_KIND = _kinds()


def _trigrams(text: bytes) -> np.ndarray:
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(LEXICAL, np.float32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
    return np.bincount(h, minlength=LEXICAL).astype(np.float32)


def term_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed trigrams, then of hashed shape pairs; one row a text, all zeros for an empty one."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for a, b in slices(texts):
        index = WordIndex(texts[a:b])
        if index.n:
            word = index.hashes(np.arange(index.n), 1)
            first, last = index.word_edges()
            same = np.concatenate(([False], (word[1:] == word[:-1]) & (index.doc[1:] == index.doc[:-1])))
            shape = (_KIND[first] * 5 + _KIND[last]) * 2 + same
            pair = np.concatenate(([50], np.where(index.doc[1:] == index.doc[:-1], shape[:-1], 50))) * 50 + shape
            bins = (pair.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(23)).astype(np.int64)
            counts = np.bincount(index.doc * (TERMS - LEXICAL) + bins, minlength=(b - a) * (TERMS - LEXICAL))
            out[a:b, LEXICAL:] = counts.reshape(b - a, -1)
        for i in range(a, b):
            out[i, :LEXICAL] = _trigrams(texts[i])
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _weighted(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log counts times idf, each family of unit length; zero rows stay zero."""
    x = np.log1p(counts) * weight
    return np.concatenate((_unit(x[:, :LEXICAL]), _unit(x[:, LEXICAL:])), 1)


def fit(labelled: DataFrame, max_labelled: int = 3000, rank: int = 32, neighbours: int = 15) -> NeighbourModel:
    """Fits on at most `max_labelled` rows of labelled (text, label 0/1), chosen by a hash of the text.

    Null texts count as empty, rows with a null label are left out. Without any labelled row the model knows only the prior 0.5, and a text that is the only labelled one gets 0.5.
    """
    clean = labelled.where("label is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    # counted where the texts are: only rows of fixed size meet
    counted = clean.select(F.xxhash64("text").alias("order"), "text", "label").mapInArrow(_count_rows, "order long, key long, terms binary, label int")
    rows = counted.orderBy("order", "label", "key").limit(max_labelled).collect()  # at most max_labelled rows of TERMS half floats
    labels = np.array([r.label for r in rows], np.float32)
    logs = np.frombuffer(b"".join([r.terms for r in rows]), np.float16).reshape(len(rows), TERMS)
    keys = np.array([r.key for r in rows], np.int64)
    n_rows, n_with = len(rows), (logs > 0).sum(0)
    del rows, counted
    weight = (np.log((1 + n_rows) / (1 + n_with)) + 1).astype(np.float32)
    # by blocks of rows: the driver holds the half floats and one matrix, no copies of it
    x = np.zeros((n_rows, TERMS), np.float32)
    for a in range(0, n_rows, 128):
        x[a : a + 128] = _weighted(np.expm1(logs[a : a + 128].astype(np.float32)), weight)
    del logs
    # truncated SVD by subspace iteration
    y = np.random.default_rng(7).standard_normal((TERMS, min(rank, TERMS))).astype(np.float32)
    for _ in range(6):
        y, _r = np.linalg.qr(x.T @ (x @ y))
    return NeighbourModel(weight, y.astype(np.float32), _unit(x @ y).astype(np.float32), labels, keys, neighbours, float(labels.mean()) if n_rows else 0.5)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in parts(batch):
            terms = [row.astype(np.float16).tobytes() for row in np.log1p(term_counts(texts))]
            yield pa.RecordBatch.from_arrays([part["order"], pa.array(text_keys(texts)), pa.array(terms, pa.binary()), part["label"]], ["order", "key", "terms", "label"])


def text_keys(texts: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in texts], np.int64)


def vote(model: NeighbourModel, texts: list[bytes], block: int = 256) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest other texts; the prior (without the text's own labels) where nothing is similar."""
    out = np.full(len(texts), model.prior)
    k = min(model.neighbours, len(model.labels))
    if not k:
        return out
    known = set(model.keys.tolist())
    for a in range(0, len(texts), block):
        cosine = _unit(_weighted(term_counts(texts[a : a + block]), model.weight) @ model.basis) @ model.vectors.T
        prior = np.full(len(cosine), model.prior)
        for i, key in enumerate(text_keys(texts[a : a + block]).tolist()):
            if key in known:
                own = model.keys == key
                cosine[i, own] = -1
                prior[i] = model.labels[~own].mean() if not own.all() else 0.5
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64)
        total = weight.sum(1)
        share = (weight * model.labels[near]).sum(1) / np.where(total > 0, total, 1)
        out[a : a + block] = np.where(total > 0, share, prior)
    return np.clip(out, 0, 1)


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [vote(shared.value, texts) for _, texts in parts(batch)]
            kept = {n: batch[n] for n in batch.schema.names if n != "score"}
            yield pa.RecordBatch.from_pydict(kept | {"score": pa.array(np.concatenate([np.zeros(0), *votes]), pa.float64())})

    return run


def score(docs: DataFrame, model: NeighbourModel) -> DataFrame:
    """docs with a column score in 0..1, higher where label 1 is likelier; a column of that name is replaced.

    Only the whole text counts. Null and empty texts, and texts like nothing labelled, get the labelled sample's share of label 1.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("score")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "score double"])
    return kept.mapInArrow(_scores(shared), fields)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int = 3000) -> DataFrame:
    """Rows to learn from: text and label of documents whose crc32(doc_id as text) mod 5 isn't 0.

    At most `max_labelled` labels, in the order of a hash, are joined to the documents; they are few by that bound and broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).where("doc_id is not null and label is not null")
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").select("text", "label")
