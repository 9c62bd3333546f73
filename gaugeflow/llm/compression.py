"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled text, one from good and one from bad
documents. Every text is compressed with each in pieces, so that the dictionary counts
throughout a long text and not only at its start; the difference of the two compressed
sizes, relative to their sum, is calibrated to a probability by logistic regression on
labelled documents that no dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import _give_back, small_batches, tidy, utf8

#: Labelled documents of each class that a dictionary is built from, at most.
DICTIONARY_DOCS = 3000
#: Labelled documents that the score is calibrated on, at most.
CALIBRATION_DOCS = 6000
#: Bytes of one piece, pieces sampled from one document, bytes of a dictionary.
PIECE_BYTES = 1024
SAMPLED_PIECES = 3
DICTIONARY_BYTES = 64 << 10
LEVEL = 1


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries of both classes and the weights of the calibrated score."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]

    def score(self, features: np.ndarray) -> np.ndarray:
        x = _expand(features)
        z = (x - np.array(self.center)) / np.array(self.scale)
        z = self.weights[0] + z @ np.array(self.weights[1:])
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def _expand(features: np.ndarray) -> np.ndarray:
    """Difference of sizes, with the compression rate that says how to read it."""
    difference, rate = features[:, 0], features[:, 1]
    return np.column_stack([difference, rate, rate * rate, difference * rate, difference * np.abs(difference)])


@lru_cache(maxsize=8)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if data:
        data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False
    )


def _sizes(text: memoryview, compressor) -> int:
    return sum(
        len(compressor.compress(text[at : at + PIECE_BYTES])) for at in range(0, max(1, len(text)), PIECE_BYTES)
    )


def _features(data: np.ndarray, offsets: np.ndarray, good: bytes, bad: bytes) -> np.ndarray:
    """(size difference over size sum, size sum over bytes) of every text."""
    one, two = _compressor(good), _compressor(bad)
    view = memoryview(data)
    ends = offsets.tolist()
    out = np.zeros((len(ends) - 1, 2))
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        x, y = _sizes(view[a:b], one), _sizes(view[a:b], two)
        out[i] = (y - x) / (x + y), (x + y) / (2.0 * (b - a + 16))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 60) -> np.ndarray:
    """Intercept and weights by Newton's method; ``x`` is standardised by the caller."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def one_label(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) with one row per document: of several labels the greatest."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias(label))


def one_text(rows: DataFrame) -> DataFrame:
    """(doc_id, y, text) with one row per document: of several texts the least."""
    least = F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), "y"))
    return rows.groupBy("doc_id").agg(least.alias("one")).select("doc_id", "one.y", "one.text")


def sampled_labels(labels: DataFrame, label: str, held_out: Column, docs: int, seed: int) -> DataFrame:
    """(doc_id, y) of at most ``docs`` labelled rows that may be learnt from.

    ``labels`` has one row per document. A fixed hash of doc_id orders the rows, so reruns
    draw the same ones.
    """
    known = labels.where(~held_out & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    return (
        known.select("doc_id", F.col(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(docs)
    )


def _piece_sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Seeded pieces from all over each text."""
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        ids, ys, pieces = [], [], []
        for i, (doc_id, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            text = data[offsets[i] : offsets[i + 1]]
            starts = np.arange(0, max(1, len(text)), PIECE_BYTES)
            drawn = np.random.default_rng(abs(doc_id)).permutation(starts)[:SAMPLED_PIECES]
            for at in drawn.tolist():
                ids.append(doc_id)
                ys.append(y)
                pieces.append(text[at : at + PIECE_BYTES].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(ys, pa.int32()), pa.array(pieces, pa.binary())],
            names=["doc_id", "y", "piece"],
        )


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def train(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column,
    label: str = "quality",
    dictionary_docs: int = DICTIONARY_DOCS,
    calibration_docs: int = CALIBRATION_DOCS,
) -> CompressionModel:
    """Fit on ``labels`` (doc_id, label) where ``held_out``, a condition on doc_id, is
    false. Reads at most ``2 * dictionary_docs + calibration_docs`` documents, bounded
    for any number of labels. Without labels of both classes every score is their
    share of good ones (0.5 without any). Of several labels of a document the greatest
    counts, of several texts under one doc_id the least is learnt from.
    """
    spark = docs.sparkSession
    labels = one_label(labels, label)
    small_batches(spark)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # One half of the labels is for the dictionaries, the other for the calibration.
    half = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(2)) == 0
    drawn = None
    for y in (0, 1):
        own = labels.where(half & (F.col(label) == y))
        one = sampled_labels(own, label, held_out, dictionary_docs, 4)
        drawn = one if drawn is None else drawn.union(one)
    ids = F.broadcast(drawn)  # 2 * dictionary_docs rows at most
    chosen = one_text(texts.join(ids, "doc_id"))
    pieces = chosen.mapInArrow(_piece_sampler, "doc_id long, y int, piece binary").collect()
    pieces.sort(key=lambda r: (r["doc_id"], bytes(r["piece"])))
    by_class = {y: [bytes(r["piece"]) for r in pieces if r["y"] == y] for y in (0, 1)}
    good, bad = (_dictionary(by_class[y], DICTIONARY_BYTES) if by_class[y] else b"" for y in (1, 0))
    del pieces, by_class
    _give_back()  # the driver has other uses for what the training took
    ids = F.broadcast(sampled_labels(labels.where(~half), label, held_out, calibration_docs, 5))
    sample = one_text(texts.join(ids, "doc_id"))
    rows = sample.mapInArrow(_feature_rows(good, bad), "doc_id long, y int, difference double, rate double").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return CompressionModel(good, bad, (float(np.log(share / (1 - share))), 0, 0, 0, 0, 0), (0.0,) * 5, (1.0,) * 5)
    x = _expand(np.array([[r["difference"], r["rate"]] for r in rows]))
    center, scale = x.mean(0), x.std(0) + 1e-9
    w = fit_logistic((x - center) / scale, y)
    return CompressionModel(good, bad, tuple(w.tolist()), tuple(center.tolist()), tuple(scale.tolist()))


def _feature_rows(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _features(*utf8(batch.column(2)), good, bad)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found[:, 0]), pa.array(found[:, 1])],
                names=["doc_id", "y", "difference", "rate"],
            )

    return run


def score(docs: DataFrame, model: CompressionModel, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """``columns`` of ``docs`` (default doc_id) and the score of every whole text.

    Null and empty texts get the score of an empty text. No shuffle; one pass.
    """
    small_batches(docs.sparkSession)
    columns = columns or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries, 128 KB
    text = columns.index("text") if "text" in columns else len(columns)
    picked = docs.select(*columns, *([] if "text" in columns else ["text"]))
    kept = picked.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = own.score(_features(*utf8(batch.column(text)), own.good, own.bad))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], pa.array(found)], names=[*columns, name]
            )

    schema = kept.withColumn(name, F.lit(0.0)).schema
    return picked.mapInArrow(tidy(run), schema)
