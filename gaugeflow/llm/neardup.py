"""Near-duplicate documents by improved consistent weighted sampling.

A text is the multiset of its shingles of five words, weighted by count and by inverse
document frequency. Improved consistent weighted sampling draws shingles so that two
texts agree in a draw with the probability of their weighted Jaccard similarity. Bands
of draws give candidates; a candidate link counts only if the weighted Jaccard
similarity of the two texts, computed in full, reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import pieces, saved, small_batches, tidy, utf8
from gaugeflow.llm.components import connected_components
from gaugeflow.llm.words import find_words, mix64

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: A link of similarity 0.8 is met in a band with probability 1 - (1 - 0.8^8)^32 = 0.997,
#: one of 0.85 with 0.99996; a pair of similarity 0.5 with 0.12.
BANDS = 32
ROWS = 8
#: Draws of a signature, by which pairs of a bucket are sieved, and bits kept of each.
SIGN_DRAWS = 1024
SIGN_BITS = 2
#: Standard deviations below a link's expected agreement that a pair may have.
SIGN_SLACK = 4.0
#: How much rarer shingles count more: a shingle of every text weighs 1, the rarest
#: up to 1 + this.
IDF_WEIGHT = 0.25
#: Counters of the document frequencies, as a power of two.
SKETCH_BITS = 20
#: Distinct weights of a shingle's rarity.
IDF_LEVELS = 8
#: Entries of the table of variates, as a power of two, and weights it is made for.
TABLE_BITS = 17
TABLE_WEIGHTS = 16
#: Texts of more distinct shingles than this, an eighth of the table, have bands from
#: variates of their own as well: they would use up the table's least entries.
LONG_TEXT = 1 << (TABLE_BITS - 3)
CHUNK_BYTES = 1 << 20
#: Bits of a sieve for each of its ids, as a power of two, and bits at most (8 MB).
SIEVE_BITS = 4
MOST_SIEVE_BITS = 1 << 26
#: Bits of one of Spark's bitmaps.
_BITMAP = 1 << 15

_SLICE = 1 << 13


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the bounds of each text's.

    A text of fewer words than a shingle is one shingle of all its words.
    """
    _, _, words, bounds = find_words(data, offsets)
    lengths = np.diff(bounds)
    counts = np.where(lengths >= SHINGLE_WORDS, lengths - SHINGLE_WORDS + 1, np.minimum(lengths, 1))
    ends = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], counts)
    padded = np.concatenate([words, np.zeros(SHINGLE_WORDS, np.uint64)])
    stop = np.repeat(bounds[1:], counts)
    h = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE_WORDS):
            word = np.where(first + k < stop, padded[first + k], np.uint64(0))
            h = mix64(h * np.uint64(3) + word + np.uint64(k))
    return h, ends


def distinct_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text in a row, their counts, and the bounds."""
    h, ends = shingles(data, offsets)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.argsort(h)
    order = order[np.argsort(text[order], kind="stable")]
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    return h[at], counts, np.searchsorted(text[at], np.arange(len(ends)))


def _counter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold a shingle of each counter: counters above 0 and their values, in
    slices; the number of texts is slice -1."""
    counters, texts = np.zeros(1 << SKETCH_BITS, np.uint32), 0
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        texts += batch.num_rows
        for a, b in pieces(np.diff(offsets), CHUNK_BYTES):
            h, _, _ = distinct_shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            counters += np.bincount(at, minlength=1 << SKETCH_BITS).astype(np.uint32)
    yield _slices(counters, texts)


def _slices(counters: np.ndarray, texts: int) -> pa.RecordBatch:
    used = np.flatnonzero(counters)
    bounds = np.searchsorted(used, np.arange(0, len(counters) + 1, _SLICE))
    rows = [(-1, b"", np.array([texts], "<u8").tobytes())]
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if a < b:
            own = used[a:b]
            rows.append((k, (own - k * _SLICE).astype("<u2").tobytes(), counters[own].astype("<u4").tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))],
        names=["slice", "at", "counts"],
    )


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of every slice, in full."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, at, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if k < 0:
                own = np.frombuffer(counts.as_buffer(), "<u8").astype(np.int64)
                sums[k] = sums.get(k, 0) + own
            else:
                own = sums.setdefault(k, np.zeros(_SLICE, np.int64))
                own[np.frombuffer(at.as_buffer(), "<u2")] += np.frombuffer(counts.as_buffer(), "<u4")
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
        names=["slice", "counts"],
    )


@dataclass(frozen=True)
class Rarity:
    """Weights by document frequency, one per counter of hashed shingles.

    Every document is counted. A counter also holds the shingles that share its hash,
    the same share of all texts at any size, so the rarest shingles are about equally
    rare, and only common ones stand out. Levels are rounded, both to keep the weights
    few and so that a few documents more do not change them.
    """

    levels: np.ndarray

    @classmethod
    def of(cls, docs: DataFrame, text: str = "text") -> Rarity:
        small_batches(docs.sparkSession)
        parts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(
            tidy(_counter_rows), "slice long, at binary, counts binary"
        )
        sums = parts.repartition(32, "slice").mapInArrow(tidy(_sum_rows), "slice long, counts binary")
        counters, texts = np.zeros(1 << SKETCH_BITS, np.int64), 0
        for row in sums.collect():  # one 64-bit counter each, 8 MB in all
            own = np.frombuffer(row["counts"], np.int64)
            if row["slice"] < 0:
                texts = int(own[0])
            else:
                counters[row["slice"] * _SLICE : row["slice"] * _SLICE + len(own)] = own
        return cls.from_counters(counters, texts)

    @classmethod
    def from_counters(cls, counters: np.ndarray, texts: int) -> Rarity:
        rare = np.log(max(texts, 2) / np.maximum(counters, 1)).clip(0) / np.log(max(texts, 2))
        return cls(np.rint(rare * (IDF_LEVELS - 1)).astype(np.uint8))

    def level(self, hashes: np.ndarray) -> np.ndarray:
        return self.levels[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]

    @staticmethod
    def weight(level: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return counts * (1.0 + IDF_WEIGHT * level / (IDF_LEVELS - 1))


@lru_cache(maxsize=1)
def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r from Gamma(2, 1), ln c with c from Gamma(2, 1), and beta from (0, 1)."""
    rng = np.random.default_rng(2016)
    shape = 1 << TABLE_BITS
    return rng.gamma(2.0, 1.0, shape), np.log(rng.gamma(2.0, 1.0, shape)), rng.random(shape)


def _rank(log_weight: np.ndarray, r: np.ndarray, log_c: np.ndarray, beta: np.ndarray):
    """ln a and t: t = floor(ln S / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r."""
    t = np.floor(log_weight / r + beta)
    return (log_c - r * (t - beta) - r).astype(np.float32), t.astype(np.int64)


@lru_cache(maxsize=2 * TABLE_WEIGHTS)
def _entries_of(weight: float) -> np.ndarray:
    """ln a of every entry of the table, for shingles of one weight."""
    return _rank(np.log(weight), *_variates())[0]


def draws(
    hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, count: int, begin: int = 0
) -> np.ndarray:
    """``count`` consistent weighted samples of each text, hashed, from the draw numbered
    ``begin`` on; every text must have shingles.

    The draw is the (k, t) of least a over the text's shingles k. r, c and beta are
    functions of k and the draw: an entry of a table of independent variates, picked by
    a hash of both. Ties go to the least hash.
    """
    r, log_c, beta = _variates()
    values, inverse, often = np.unique(weights, return_inverse=True, return_counts=True)
    # Few weights occur often: for them ln a and t of every entry are known beforehand.
    common = np.argsort(-often, kind="stable")[:TABLE_WEIGHTS]
    flat_a = np.concatenate([_entries_of(v) for v in values[common].tolist()])
    row = np.full(len(values), -1)
    row[common] = np.arange(len(common))
    base = row[inverse] << TABLE_BITS
    odd = np.flatnonzero(base < 0)
    base[odd] = 0
    log_odd = np.log(weights[odd])
    starts, repeats = bounds[:-1], np.diff(bounds)
    out = np.zeros((len(starts), count), np.uint64)
    mask = np.uint64((1 << TABLE_BITS) - 1)
    per_mix = 64 // TABLE_BITS
    for j in range(begin, begin + count):
        if j == begin or j % per_mix == 0:
            mixed = mix64(hashes + np.uint64((0x9E3779B97F4A7C15 * (j // per_mix * per_mix + 1)) % (1 << 64)))
            mixed = mixed >> np.uint64(j % per_mix * TABLE_BITS)
        place = (mixed & mask).astype(np.int64)
        mixed = mixed >> np.uint64(TABLE_BITS)
        entry = base + place
        a = flat_a[entry]
        if len(odd):
            e = place[odd]
            a[odd] = _rank(log_odd, r[e], log_c[e], beta[e])[0]
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == np.repeat(least, repeats))
        # Of ties the first: shingles stand in the order of their hash.
        owner = np.searchsorted(bounds, at, "right") - 1
        first = np.ones(len(at), bool)
        first[1:] = owner[1:] != owner[:-1]
        at = at[first]
        e = place[at]
        t = _rank(np.log(weights[at]), r[e], log_c[e], beta[e])[1]
        out[:, j - begin] = mix64(hashes[at] + t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _uniforms(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers from (0, 1) of the halves of 64 bits."""
    low = (mixed & np.uint64(0xFFFFFFFF)).astype(np.float64)
    high = (mixed >> np.uint64(32)).astype(np.float64)
    return (low + 0.5) / 2.0**32, (high + 0.5) / 2.0**32


def long_draws(hashes: np.ndarray, weights: np.ndarray, count: int) -> np.ndarray:
    """``count`` samples of one text of any length: as :func:`draws`, but r, c and beta are
    made from hash bits of the shingle and the draw, without a table."""
    log_weight, out = np.log(weights), np.zeros(count, np.uint64)
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for j in range(count):
            mixed = [mix64(hashes ^ mix64(np.uint64([3 * j + k + 1]) * step)) for k in range(3)]
            (u1, u2), (u3, u4), (beta, _) = map(_uniforms, mixed)
            r, log_c = -np.log(u1 * u2), np.log(-np.log(u3 * u4))
            t = np.floor(log_weight / r + beta)
            at = int(np.argmin(log_c - r * (t - beta) - r))
            out[j] = mix64(hashes[at : at + 1] + np.uint64(int(t[at]) % (1 << 64)) * step)[0]
    return out


def _weighed(data, offsets, rarity: Rarity):
    h, counts, bounds = distinct_shingles(data, offsets)
    level = rarity.level(h)
    return h, counts, level, bounds


def _band_rows(shared, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            keys: list = []
            for a, b in pieces(np.diff(offsets), CHUNK_BYTES):
                h, counts, level, bounds = _weighed(
                    data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], rarity
                )
                some = np.flatnonzero(np.diff(bounds))
                own: list = [[]] * (b - a)
                if len(some):
                    kept = np.append(bounds[some], bounds[-1])
                    weights = rarity.weight(level, counts)
                    drawn = draws(h, weights, kept, bands * rows)
                    for i, row in zip(some.tolist(), _bands(drawn, bands, rows).tolist()):
                        own[i] = row
                    for i in np.flatnonzero(np.diff(bounds) > LONG_TEXT).tolist():
                        of = slice(bounds[i], bounds[i + 1])
                        drawn = long_draws(h[of], weights[of], bands * rows)[None, :]
                        own[i] = own[i] + _bands(drawn, bands, rows, first=bands).tolist()[0]
                keys += own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "bands"]
            )

    return run


def _bands(drawn: np.ndarray, bands: int, rows: int, first: int = 0) -> np.ndarray:
    key = np.tile(np.arange(first, first + bands, dtype=np.uint64), (len(drawn), 1))
    with np.errstate(over="ignore"):
        for k in range(rows):
            key = mix64(key * np.uint64(5) + drawn[:, k::rows][:, :bands])
    return key.view(np.int64)


def _signature(drawn: np.ndarray) -> np.ndarray:
    """The lowest bits of all draws, packed into 64-bit words."""
    per_word = 64 // SIGN_BITS
    draws_there = -(-drawn.shape[1] // per_word) * per_word
    bits = np.zeros((len(drawn), draws_there), np.uint64)
    bits[:, : drawn.shape[1]] = drawn & np.uint64((1 << SIGN_BITS) - 1)
    bits = bits.reshape(len(drawn), -1, per_word) << (np.arange(per_word, dtype=np.uint64) * np.uint64(SIGN_BITS))
    return np.bitwise_or.reduce(bits, axis=2).view(np.int64)


def _sign_rows(begin: int):
    """Signatures of profiles, from draws that the bands have not used; null for long
    texts, which are not sieved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            weights = [np.frombuffer(x.as_buffer(), np.float32) for x in batch.column(2)]
            signs: list = []
            for a, b in pieces(np.array([8 * len(h) for h in hashes]), CHUNK_BYTES):
                short = [i for i in range(a, b) if len(hashes[i]) <= LONG_TEXT]
                own: list = [None] * (b - a)
                if short:
                    bounds = np.concatenate([[0], np.cumsum([len(hashes[i]) for i in short])])
                    h = np.concatenate([hashes[i] for i in short])
                    w = np.concatenate([weights[i] for i in short]).astype(np.float64)
                    for i, sign in zip(short, _signature(draws(h, w, bounds, SIGN_DRAWS, begin)).tolist()):
                        own[i - a] = sign
                signs += own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(signs, pa.list_(pa.int64()))], names=["doc_id", "signature"]
            )

    return run


def _agreeing(words: int, count: int, threshold: float) -> Column:
    """Whether two signatures, columns signature and signature_x of so many words, agree as
    often as a link may.

    Draws agree with the probability of the similarity, and other draws in their few
    bits by chance. The bound lies ``SIGN_SLACK`` standard deviations below that, so a
    link at the threshold fails with probability 3e-5, a hundredth of the bands' own
    miss. A text without a signature agrees with every other.
    """
    ones = int("1" * (64 // SIGN_BITS), 1 << SIGN_BITS)
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones
    differing = F.lit(0)
    for i in range(words):
        x = F.col("signature")[i].bitwiseXOR(F.col("signature_x")[i])
        any_bit = x
        for k in range(1, SIGN_BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        differing = differing + F.bit_count(any_bit.bitwiseAND(F.lit(ones)))
    agree = threshold + (1 - threshold) / (1 << SIGN_BITS)
    least = count * agree - SIGN_SLACK * (count * agree * (1 - agree)) ** 0.5
    return F.coalesce(differing <= F.lit(int(count - least)), F.lit(True))


def _profile_rows(shared):
    """Hashes and weights of each text, sorted by hash, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            hashes, weights = [], []
            for a, b in pieces(np.diff(offsets), CHUNK_BYTES):
                h, counts, level, bounds = _weighed(
                    data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], rarity
                )
                w = rarity.weight(level, counts).astype(np.float32)
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    hashes.append(h[s:e].tobytes())
                    weights.append(w[s:e].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hashes, pa.binary()), pa.array(weights, pa.binary())],
                names=["doc_id", "hashes", "weights"],
            )

    return run


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Sum of the lesser weights over the sum of the greater ones."""
    if not len(h1) or not len(h2):
        return 0.0
    at = np.minimum(np.searchsorted(h2, h1), len(h2) - 1)
    same = h2[at] == h1
    shared = np.minimum(w1[same], w2[at[same]]).sum(dtype=np.float64)
    return float(shared / (w1.sum(dtype=np.float64) + w2.sum(dtype=np.float64) - shared))


def _similarity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def arrays(column, kind):
        return [np.frombuffer(x.as_buffer(), kind) for x in column]

    for batch in batches:
        h1, w1, h2, w2 = (arrays(batch.column(i), k) for i, k in zip(range(2, 6), (np.uint64, np.float32) * 2))
        found = [weighted_jaccard(*four) for four in zip(h1, w1, h2, w2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "similarity"]
        )


def _sieved(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id may be one of ``ids``: all that are, and of others about every
    sixteenth.

    A bitmap of hashed ids is broadcast, so that a join with few ids need not move all
    rows. Beyond ``MOST_SIEVE_BITS`` it lets more of the others pass.
    """
    bits = _BITMAP
    least = min(ids.count() << SIEVE_BITS, MOST_SIEVE_BITS)
    while bits < least:
        bits *= 2
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    bitmap, bit = F.floor(place / _BITMAP).alias("_bitmap"), (place % _BITMAP).alias("_bit")
    bitmaps = ids.select(bitmap, bit).groupBy("_bitmap").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.expr("substring(_bits, int(_bit div 8) + 1, 1)")), 16, 10).cast("int")
    return (
        rows.withColumns({"_bitmap": bitmap, "_bit": bit})
        .join(F.broadcast(bitmaps), "_bitmap")
        .where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1)
        .select(*rows.columns)
    )


def _similarities(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs. A text with very many partners is a key that
    adaptive execution may split."""
    left = profiles.select(F.col("doc_id").alias("a"), F.col("hashes").alias("h1"), F.col("weights").alias("w1"))
    right = profiles.select(F.col("doc_id").alias("b"), F.col("hashes").alias("h2"), F.col("weights").alias("w2"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "h1", "w1", "h2", "w2")
    return saved(both.mapInArrow(tidy(_similarity_rows), "a long, b long, similarity double"), "similarities")


def _classes(links: DataFrame, node: str) -> DataFrame:
    return connected_components(links.select("a", "b")).withColumnRenamed("node", node)


def _pairs_left(
    members: DataFrame, star: DataFrame, profiles: DataFrame, threshold: float, count: int
) -> DataFrame:
    """Pairs of a bucket that may be links beside those with its leader.

    One minus the weighted Jaccard similarity is a metric. So two texts whose distances
    to the leader differ by more than a link's own distance are no link, and texts
    within that distance of the leader are of its class already. Left are pairs of
    different classes, one of them farther from the leader, in the same or the next
    ring of that width around it, whose signatures agree often enough. Only texts of
    buckets with several classes get a signature; it begins after ``count`` draws.
    """
    words = -(-SIGN_DRAWS * SIGN_BITS // 64)
    reach = 1.0 - threshold
    rings = members.join(
        star.select(F.col("a").alias("leader"), F.col("b").alias("doc_id"), (1 - F.col("similarity")).alias("far")),
        ["leader", "doc_id"],
    )
    classes = _classes(star.where(F.col("similarity") >= threshold), "doc_id")
    rings = rings.join(classes, "doc_id", "left").select(
        "bucket",
        "doc_id",
        "far",
        F.coalesce("component", "doc_id").alias("class"),
        F.when(F.col("far") <= reach, 0).otherwise(1 + F.floor((F.col("far") - reach) / reach)).alias("ring"),
    )
    mixed = rings.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    mixed = mixed.where("low < high").select("bucket")
    rings = saved(rings.join(mixed, "bucket", "left_semi"), "mixed")
    signs = (
        _sieved(profiles, rings.select("doc_id"))
        .join(rings.select("doc_id").distinct(), "doc_id", "left_semi")
        .dropDuplicates(["doc_id"])
        .mapInArrow(tidy(_sign_rows(count)), "doc_id long, signature array<long>")
    )
    # At most one bucket for each band.
    common = rings.groupBy("doc_id").agg(F.collect_list("bucket").alias("buckets"))
    rings = saved(rings.join(signs.join(common, "doc_id"), "doc_id"), "rings")
    outer = rings.where("ring > 0").select(
        "bucket",
        F.explode(F.array(F.col("ring") - 1, F.col("ring"))).alias("ring"),
        F.col("ring").alias("ring_x"),
        F.col("doc_id").alias("x"),
        F.col("far").alias("far_x"),
        F.col("class").alias("class_x"),
        F.col("buckets").alias("buckets_x"),
        F.col("signature").alias("signature_x"),
    )
    near = F.abs(F.col("far") - F.col("far_x")) <= reach + 1e-6
    # A link passes in all buckets that both are in, so one of them will do.
    first = F.col("bucket") == F.array_min(F.array_intersect("buckets", "buckets_x"))
    # Two of one ring meet from both sides.
    once = (F.col("ring") != F.col("ring_x")) | (F.col("doc_id") < F.col("x"))
    return (
        rings.join(outer, ["bucket", "ring"])
        .where((F.col("class") != F.col("class_x")) & near & once & _agreeing(words, SIGN_DRAWS, threshold) & first)
        .select(F.least("doc_id", "x").alias("a"), F.greatest("doc_id", "x").alias("b"))
        .distinct()
    )


def _one_of_each(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each doc_id of ``ids``, which ``rows`` hold all; rows of one number are
    equal, or count as one document. Without repeats nothing is moved."""
    if rows.count() == ids.count():
        return rows
    others = [c for c in rows.columns if c != "doc_id"]
    return saved(rows.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in others]), "once")


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Class of near-duplicates of every document.

    ``docs`` needs ``doc_id`` and ``text``. Returns doc_id, class_id (smallest doc_id of the
    class), class_size, kept (doc_id is class_id) and text_id (smallest doc_id with
    exactly this text), one row for each of ``docs``. Different texts under one doc_id
    count as one document. Rows without doc_id are as good as others, but stand behind
    them: a class or text of such rows alone has a null class_id or text_id, and the
    rows of its smallest text digest are kept. Null and empty texts, and texts without a
    word, have no shingles: they are of one class only with rows of exactly the same text.

    Exact copies are folded into one text first. In a band's bucket, texts are not
    paired with each other: each is compared with the bucket's smallest, which joins
    all of a group of near copies. Then only the pairs of different classes are
    compared that their distances to it and their signatures leave possible. So no link
    is lost but by the chance that draws leave, and no bucket is cut, yet a group of
    copies never makes all its pairs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    # Texts without a doc_id are known by a negative number from their digest.
    number = -F.conv(F.substring("digest", 1, 15), 16, 10).cast("long") - 1
    base = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(Rarity.of(base))  # 1 MB
    ids = base.select("own_id", digest.alias("digest"))
    texts = ids.groupBy("digest").agg(F.min("own_id").alias("text_id"), F.count("*").alias("copies"))
    texts = saved(texts.withColumn("node", F.coalesce("text_id", number)), "texts")
    base = base.withColumn("digest", digest).select(F.coalesce("own_id", number).alias("doc_id"), "text")
    banded = base.mapInArrow(tidy(_band_rows(shared, bands, rows)), "doc_id long, bands array<long>")
    banded = saved(banded, "bands")
    firsts = texts.select(F.col("node").alias("doc_id")).distinct()
    once = _one_of_each(banded.join(firsts, "doc_id", "left_semi"), firsts)
    members = once.select(F.explode(F.array_distinct("bands")).alias("bucket"), "doc_id")
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("leader"))
    members = saved(members.join(buckets.where("n > 1"), "bucket").drop("n"), "members")
    candidates = saved(members.select("doc_id").distinct(), "candidates")
    profiles = _sieved(base.select("doc_id", "text"), candidates).join(candidates, "doc_id", "left_semi")
    profiles = profiles.mapInArrow(tidy(_profile_rows(shared)), "doc_id long, hashes binary, weights binary")
    profiles = _one_of_each(saved(profiles, "profiles"), candidates)
    pairs = members.where("leader < doc_id").select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
    star = _similarities(pairs.distinct(), profiles)
    pairs = saved(_pairs_left(members, star, profiles, threshold, bands * rows), "pairs")
    paired = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    rest = _similarities(pairs, _sieved(profiles, paired))
    classes = _classes(star.union(rest).where(F.col("similarity") >= threshold), "node")
    by_text = texts.join(classes, "node", "left").select(
        "digest", "text_id", "copies", F.coalesce("component", "node").alias("class")
    )
    by_text = saved(by_text, "classes")
    of_class = by_text.groupBy("class").agg(
        F.sum("copies").alias("class_size"), F.min("text_id").alias("class_id"), F.min("digest").alias("least")
    )
    by_text = by_text.join(of_class, "class").select("digest", "text_id", "class_id", "class_size", "least")
    kept = F.col("doc_id") == F.col("class_id")
    alone = F.col("class_id").isNull() & (F.col("digest") == F.col("least"))
    return (
        ids.withColumnRenamed("own_id", "doc_id")
        .join(by_text, "digest")
        .select("doc_id", "class_id", "class_size", F.coalesce(kept, alone, F.lit(False)).alias("kept"), "text_id")
    )
