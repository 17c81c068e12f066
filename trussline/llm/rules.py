"""Quality rules: fixed text statistics and a hashed n-gram logistic regression.

The regression sees hashed word unigrams and character 3- and 4-grams. It is fitted on a bounded sample of labelled rows, its margin is
calibrated on rows that it has not been fitted on (Platt's sigmoid), and texts are scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussline.llm.bytetext import WordIndex, mix, parts

#: Hash bins: the first half for words, the second for character n-grams.
BINS = 8192
#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW, SYMBOLS = 20, 30, 8, b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def word_bins(index: WordIndex) -> np.ndarray:
    return (index.hashes(np.arange(index.n), 1) % np.uint64(BINS // 2)).astype(np.int64)


def features(text: bytes, words: np.ndarray) -> np.ndarray:
    """Log counts of hashed words (their bins are given) and character n-grams, of unit length."""
    half = BINS // 2
    counts = np.zeros(BINS, np.float32)
    counts[:half] = np.bincount(words, minlength=half)
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
        counts[half:] += np.bincount(h >> np.uint32(20), minlength=half)
        if len(b) >= 4:
            counts[half:] += np.bincount((h[:-1] + b[3:] * np.uint32(0x27D4EB2F)) * np.uint32(0x9E3779B1) >> np.uint32(20), minlength=half)
    counts = np.log1p(counts)
    norm = np.linalg.norm(counts)
    return counts / norm if norm else counts


class QualityModel(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float  # of the calibration
    shift: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = x @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the mean log loss plus ridge; classes weigh alike."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    beta = np.zeros(x.shape[1] + 1, np.float32)
    look, rate = beta.copy(), 4.0
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ look[:-1] + look[-1], -30, 30)))
        e = w * (p - y) / len(y)
        grad = np.append(x.T @ e + ridge * look[:-1], e.sum())
        new = look - rate * grad / 2
        look, beta = new + t / (t + 3) * (new - beta), new
    return beta[:-1], float(beta[-1])


def fit_quality(labelled: DataFrame, max_labelled: int = 3000, ridge: float = 1e-4, steps: int = 300) -> QualityModel:
    """Fits on at most `max_labelled` rows (text, label 0/1), chosen by a hash of the text; a quarter of them calibrates.

    Null texts count as empty; null labels are left out. With fewer than eight rows or one class all texts get that class's share.
    """
    clean = labelled.where("label is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    # features are made where the texts are: only rows of fixed size meet
    made = clean.select(F.xxhash64("text").alias("order"), "text", "label").mapInArrow(_feature_rows, "order long, x binary, label int")
    rows = made.orderBy("order", "label", "x").limit(max_labelled).collect()  # at most max_labelled rows of BINS half floats
    y = np.array([r.label for r in rows], np.float32)
    if len(rows) < 8 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(rows) else 0.5, 0.01, 0.99))
        return QualityModel(np.zeros(BINS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    x = np.array([np.frombuffer(r.x, np.float16) for r in rows], np.float32)
    held = np.arange(len(y)) % 4 == 3
    weights, bias = _logistic(x[~held], y[~held], ridge, steps)
    margin = x[held] @ weights + bias
    # Platt: smoothed targets keep the sigmoid finite where classes are apart
    n1, n0 = y[held].sum(), (1 - y[held]).sum()
    target = np.where(y[held] > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r, v = p - target, p * (1 - p) + 1e-6
        g = np.array([(r * margin).sum() + 1e-3 * a, r.sum()])
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum()]])
        a, b = np.array([a, b]) - np.linalg.solve(h + 1e-6 * np.eye(2), g)
    return QualityModel(weights, bias, float(a), float(b))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in parts(batch):
            x = [features(t, word_bins(WordIndex([t]))).astype(np.float16).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([part["order"], pa.array(x, pa.binary()), part["label"]], ["order", "x", "label"])


def repeat_words(index: WordIndex, n_docs: int, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text that stand in a window found twice or more in that text."""
    start = index.windows(window)
    if not len(start):
        return np.zeros(n_docs, np.int64)
    key = mix(index.hashes(start, window) + index.doc[start].astype(np.uint64))
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(index.n + 1, np.int64)
    twice = start[times[inverse] > 1]
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + window, -1)
    return np.bincount(index.doc[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def apply_rules(docs: DataFrame, model: QualityModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Adds to each row of docs the base statistics, base_failed, quality (calibrated probability) and kept.

    Words are runs of characters other than space and 0x09-0x0D. base_failed: fewer than 20 words, or over 30 % of the words in 8-word
    windows that occur twice or more in the text. kept: not base_failed, and quality >= threshold. Null and empty texts have
    no words and fail. Columns of these names are replaced; other columns and all rows stay.
    """
    names = [x.split()[0] for x in _OUT.split(", ")]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for _, part in parts(batch, text):
                index = WordIndex(part)
                n_words = np.diff(index.bounds)
                repeats = repeat_words(index, len(part))
                bins = word_bins(index)
                for i, t in enumerate(part):
                    raw = np.frombuffer(t, np.uint8)
                    points = int(np.count_nonzero((raw & 0xC0) != 0x80))
                    spaces = int(np.count_nonzero((raw == 0x20) | (raw >= 0x09) & (raw <= 0x0D)))
                    n, r = int(n_words[i]), int(repeats[i])
                    failed = n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n
                    x = features(t, bins[index.bounds[i] : index.bounds[i + 1]])
                    quality = float(shared.value.probability(x))
                    for column, v in zip(columns, (n, points - spaces, int(_SYMBOL[raw].sum()), duplicate_lines(t), r, failed, not failed and quality >= threshold, quality), strict=True):
                        column.append(v)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_pydict({n: batch[n] for n in batch.schema.names} | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join([*carried, _OUT]))
