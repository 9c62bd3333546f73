"""Toxicity: a character n-gram linear classifier with naive Bayes scaling.

Features are the character n-grams that occur in a text, hashed. Each is scaled by its
naive Bayes log-count ratio, log of its smoothed share among toxic over its smoothed
share among other documents, and a logistic regression learns one weight per scaled
feature. Scoring adds, for every distinct feature of a text, ratio times weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import pieces, saved, small_batches, utf8
from gaugeflow.llm.compression import one_label, one_text, sampled_labels

#: Lengths of the character n-grams, and bits of a hashed feature.
ORDERS = (4, 5, 6)
FEATURE_BITS = 20
#: Labelled documents learnt from, at most.
TRAIN_DOCS = 8_000
#: Features that get a weight, at most, and documents one must occur in.
MOST_FEATURES = 1 << 13
LEAST_DOCS = 3
#: Characters hashed at a time.
CHUNK = 1 << 20

_MIX = 0x9E3779B97F4A7C15


def _codes(data: np.ndarray) -> np.ndarray:
    """Code points of UTF-8 text, A-Z in lower case."""
    text = data.tobytes().decode("utf-8", "replace")
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return codes + ((codes >= 65) & (codes <= 90)) * np.uint64(32)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hashed feature for every window of ``n`` characters."""
    count = max(0, len(codes) - n + 1)
    h = np.full(count, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h + codes[i : i + count]) * np.uint64(_MIX)
            h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - FEATURE_BITS)).astype(np.uint32)


def _chunks(codes: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that overlap, so that every n-gram lies in one."""
    step = CHUNK - max(ORDERS)
    for at in range(0, max(1, len(codes)), step):
        yield codes[at : at + CHUNK]


def distinct_features(codes: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """The hashed features that occur in a text, of those ``wanted``, each once."""
    found = []
    for part in _chunks(codes):
        for n in ORDERS:
            h = gram_hashes(part, n)
            found.append(np.unique(h if wanted is None else h[wanted[h]]))
    return np.unique(np.concatenate(found))


@dataclass(frozen=True)
class ToxicityModel:
    """Ratio times weight of every hashed feature, and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each text. Texts are hashed together; a window that reaches
        into the next text is dropped."""
        used = self.weights != 0
        out = np.empty(len(offsets) - 1)
        for a, b in pieces(np.diff(offsets), CHUNK):
            if b - a == 1:
                own = distinct_features(_codes(data[offsets[a] : offsets[b]]), used)
                out[a] = self.weights[own].sum()
            else:
                out[a:b] = self._together(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], used)
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.intercept, -35, 35)))

    def _together(self, data: np.ndarray, offsets: np.ndarray, used: np.ndarray) -> np.ndarray:
        codes = _codes(data)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        ends = lead[offsets]  # in characters
        n_texts = len(offsets) - 1
        keys = []
        for n in ORDERS:
            h = gram_hashes(codes, n)
            at = np.flatnonzero(used[h])
            text = np.searchsorted(ends, at, "right") - 1
            inside = at + n <= ends[text + 1]
            keys.append(text[inside] * (1 << FEATURE_BITS) + h[at[inside]])
        keys = np.unique(np.concatenate(keys))
        return np.bincount(keys >> FEATURE_BITS, self.weights[keys & ((1 << FEATURE_BITS) - 1)], n_texts)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        found = [
            distinct_features(_codes(data[a:b])).tobytes() for a, b in zip(offsets[:-1], offsets[1:])
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.binary())],
            names=["doc_id", "y", "features"],
        )


#: Counters of one row when the counts of a task are handed on.
_SLICE = 1 << 14


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that hold each feature, in slices."""
    counts = np.zeros((2, 1 << FEATURE_BITS), np.int32)
    for batch in batches:
        for y, features in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[y][np.frombuffer(features.as_buffer(), np.uint32)] += 1
    parts = range(0, 1 << FEATURE_BITS, _SLICE)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([y * (1 << FEATURE_BITS) + at for y in (0, 1) for at in parts], pa.int64()),
            pa.array([counts[y][at : at + _SLICE].tobytes() for y in (0, 1) for at in parts], pa.binary()),
        ],
        names=["slice", "counts"],
    )


def _picked_rows(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for features in batch.column(2):
                own = np.frombuffer(features.as_buffer(), np.uint32)
                kept.append(own[wanted[own]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(kept, pa.binary())],
                names=["doc_id", "y", "features"],
            )

    return run


def fit_sparse(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, l2: float, steps: int):
    """Logistic regression on binary features times ``scale``, by Nesterov's gradient
    descent; weights of the scaled features and the intercept."""
    lengths = np.array([len(r) for r in rows])
    column = np.concatenate(rows) if rows else np.empty(0, np.int64)
    value = scale[column]
    row = np.repeat(np.arange(len(rows)), lengths)
    w = np.zeros(len(scale))
    b = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    # Curvature is at most a quarter of the largest row or, by the rows' mean, less.
    norm = np.bincount(row, value * value, len(rows))
    lipschitz = 0.25 * (np.percentile(norm, 99) + 1) * len(rows) / 4 + l2
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        z = np.bincount(row, ahead_w[column] * value, len(rows)) + ahead_b
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        off = p - y
        gradient = np.bincount(column, off[row] * value, len(scale)) + l2 * ahead_w
        new_w = ahead_w - gradient / lipschitz
        new_b = ahead_b - off.sum() / lipschitz
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w = new_w + (t - 1) / t_next * (new_w - w)
        ahead_b = new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new_w, new_b, t_next
    return w, b


def log_count_ratio(counts: np.ndarray, docs: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log of the feature's smoothed share in class 1 over that in class 0."""
    share = (counts + alpha) / (docs[:, None] + 2 * alpha)
    return np.log(share[1]) - np.log(share[0])


def train(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    label: str = "toxic",
    train_docs: int = TRAIN_DOCS,
    most_features: int = MOST_FEATURES,
    l2: float = 1.0,
    steps: int = 120,
) -> ToxicityModel:
    """Fit on ``labels`` (doc_id, label) where ``held_out``, a condition on doc_id, is
    false; on at most ``train_docs`` documents, drawn by a fixed hash.

    Their features are counted on the executors; the driver holds one counter per
    hashed feature and class, and the chosen features of the sample. With labels of one
    class only, or none, every score is the smoothed share of toxic ones. Of several
    labels of a document the greatest counts, of several texts under one doc_id the least
    is learnt from.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ids = F.broadcast(sampled_labels(one_label(labels, label), label, held_out, train_docs, 6))  # train_docs rows
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sample = one_text(texts.join(ids, "doc_id"))
    rows = saved(sample.mapInArrow(_feature_rows, "doc_id long, y int, features binary"), "features")
    size = 1 << FEATURE_BITS
    parts = rows.select("y", "features").coalesce(8).mapInArrow(_count_rows, "slice long, counts binary")
    counts = np.zeros(2 * size, np.int64)
    for r in parts.toLocalIterator():  # 8 tasks of 8 MB
        counts[r["slice"] : r["slice"] + _SLICE] += np.frombuffer(r["counts"], np.int32)
    counts = counts.reshape(2, size)
    by_class = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    there = np.array([by_class.get(0, 0), by_class.get(1, 0)])
    if not there.all():
        b = float(np.log((there[1] + 1) / (there[0] + 1)))
        return ToxicityModel(np.zeros(size), b)
    ratio = log_count_ratio(counts, there)
    total = counts.sum(0)
    # How far a feature's toxic count is from what its total lets expect.
    expected = total * there[1] / there.sum()
    gain = np.where(total >= LEAST_DOCS, np.abs(counts[1] - expected) / np.sqrt(expected + 1), 0)
    chosen = np.argsort(-gain, kind="stable")[:most_features]
    chosen = np.sort(chosen[gain[chosen] > 0])
    wanted = np.zeros(size, bool)
    wanted[chosen] = True
    place = np.zeros(size, np.int64)
    place[chosen] = np.arange(len(chosen))
    picked = rows.mapInArrow(_picked_rows(wanted), "doc_id long, y int, features binary").collect()
    picked.sort(key=lambda r: r["doc_id"])
    own = [place[np.frombuffer(r["features"], np.uint32)] for r in picked]
    y = np.array([r["y"] for r in picked], float)
    w, b = fit_sparse(own, y, ratio[chosen], l2, steps)
    weights = np.zeros(size)
    weights[chosen] = w * ratio[chosen]
    return ToxicityModel(weights, b)


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """doc_id and the toxicity of every whole text; null counts as empty.

    No shuffle; one pass with an 8 MB broadcast. The result has a row per input row.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own.score(*utf8(batch.column(1))))], names=["doc_id", name]
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0.0).alias(name)).schema)
