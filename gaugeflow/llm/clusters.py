"""Centroid clustering by Lloyd's rounds with Shallot's search for the nearest centroid.

Vectors and centroids are integers, so sums and comparisons are exact and a rerun gives
the same clusters. Every vector keeps bounds and its second-nearest centroid from round
to round, so most vectors are settled without any distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.llm.common import scratch

#: Bounds are kept in doubles, widened by this share; double arithmetic on 64 components
#: errs by far less.
_SLACK = 1e-9

_STATE = "cluster int, second int, upper double, lower double, distance long"


def most_component(dims: int) -> int:
    """Components below this keep squared distances within a 64-bit integer."""
    return 1 << (62 - max(dims - 1, 1).bit_length()) // 2 - 1


def whole_vector(column: str, dims: int, scale: int) -> Column:
    """The components as integers, floor(scale * x); null where one is null or not
    finite or where there are not ``dims`` of them."""
    vector, most = F.col(column), most_component(dims)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fits = (F.size(vector) == dims) & ~bad

    def whole(x: Column) -> Column:
        scaled = F.floor(F.lit(float(scale)) * x.cast("double"))
        too_large = F.raise_error(F.lit(f"a component is beyond {most}")).cast("int")
        return F.when(F.abs(scaled) < most, scaled.cast("int")).otherwise(too_large)

    return F.when(fits, F.transform(vector, whole))


@dataclass(frozen=True)
class Centroids:
    """Integer centroids and what the search needs of them: every centroid's
    neighbours by distance, and these distances."""

    at: np.ndarray
    neighbours: np.ndarray
    gaps: np.ndarray

    @classmethod
    def of(cls, at: np.ndarray) -> Centroids:
        squares = ((at[:, None, :] - at[None, :, :]) ** 2).sum(2)
        np.fill_diagonal(squares, -1)  # a centroid comes before others in its place
        order = np.argsort(squares, axis=1, kind="stable")
        gaps = np.sqrt(np.maximum(np.take_along_axis(squares, order, 1), 0))
        return cls(at, order, gaps * (1 - _SLACK))


def _squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    off = vectors - centroid
    return np.einsum("ij,ij->i", off, off)


def nearest_two(
    vectors: np.ndarray, cluster: np.ndarray, second: np.ndarray, centroids: Centroids
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest and second-nearest centroids and their squared distances, all exact.

    The scan starts from the closer one of the two given centroids and goes through its
    neighbours in order of distance. A centroid closer to the vector than the second so
    far lies in the ball around the start with radius start distance + second distance;
    the ball shrinks as the second comes closer, and the scan ends where a neighbour is
    outside it. Equal distances go to the smaller number.
    """
    at, k = centroids.at, len(centroids.at)
    rows = np.arange(len(vectors))
    a, b = cluster, second
    d_a, d_b = _squared(vectors, at[a]), _squared(vectors, at[b])
    swap = (d_b < d_a) | (d_b == d_a) & (b < a)
    best, d_best = np.where(swap, b, a), np.where(swap, d_b, d_a)
    other, d_other = np.where(swap, a, b), np.where(swap, d_a, d_b)
    start, known = best.copy(), other.copy()
    reach = np.sqrt(d_best)
    for step in range(1, k):
        radius = (reach[rows] + np.sqrt(d_other[rows])) * (1 + _SLACK)
        rows = rows[centroids.gaps[start[rows], step] <= radius]
        if not len(rows):
            break
        j = centroids.neighbours[start[rows], step]
        new = j != known[rows]
        look, j = rows[new], j[new]
        d = _squared(vectors[look], at[j])
        wins = (d < d_best[look]) | (d == d_best[look]) & (j < best[look])
        place = ~wins & (d < d_other[look])
        won, placed = look[wins], look[place]
        other[won], d_other[won] = best[won], d_best[won]
        best[won], d_best[won] = j[wins], d[wins]
        other[placed], d_other[placed] = j[place], d[place]
    return best, other, d_best, d_other


def _assigner(centroids: Centroids, moved: np.ndarray, last: bool):
    """One round: vectors with the state of the round before, to their new state.

    ``moved`` is how far each centroid has gone since the state was made. With ``last``
    the squared distance of every vector is computed, for settled ones too.
    """
    k = len(centroids.at)
    half_gap = centroids.gaps[:, 1] / 2 if k > 1 else np.full(k, np.inf)
    wide = moved * (1 + _SLACK)
    # How far any centroid but the own one has gone.
    order = np.argsort(wide)
    others = np.where(np.arange(k) == order[-1], wide[order[-2]] if k > 1 else 0.0, wide[order[-1]])

    def settle(vectors, cluster, second, upper, lower):
        upper = (upper + wide[cluster]) * (1 + _SLACK)
        lower = (lower - others[cluster]) * (1 - _SLACK)
        bound = np.maximum(lower, half_gap[cluster])
        open_ = np.flatnonzero(upper >= bound)
        if k > 1 and len(open_):  # the exact distance settles some of them
            d = _squared(vectors[open_], centroids.at[cluster[open_]])
            upper[open_] = np.sqrt(d) * (1 + _SLACK)
            open_ = open_[upper[open_] >= bound[open_]]
        if k > 1 and len(open_):
            best, other, d_best, d_other = nearest_two(vectors[open_], cluster[open_], second[open_], centroids)
            cluster[open_], second[open_] = best, other
            upper[open_], lower[open_] = np.sqrt(d_best) * (1 + _SLACK), np.sqrt(d_other) * (1 - _SLACK)
        distance = _squared(vectors, centroids.at[cluster]) if last else np.zeros(len(vectors), np.int64)
        return cluster, second, upper, lower, distance

    def assign(batches: Iterable) -> Iterator:
        import pyarrow as pa

        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
        names = [c.split()[0] for c in _STATE.split(", ")]
        for batch in batches:
            vectors = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(len(batch), -1)
            state = [batch.column(n).to_numpy(zero_copy_only=False).copy() for n in names[:-1]]
            found = settle(vectors, *state) if len(batch) else [*state, np.zeros(0, np.int64)]
            arrays = [batch.column("vec_id"), batch.column("v"), *[pa.array(x, t) for x, t in zip(found, kinds)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "v", *names])

    return assign


def _means(states: DataFrame, dims: int, before: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of every cluster; empty ones stay. One row per
    cluster comes to the driver."""
    sums = [F.sum(F.element_at("v", i + 1).cast("long")).alias(f"s{i}") for i in range(dims)]
    after = before.copy()
    for row in states.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    return after


class _Rounds:
    """The state of the rounds as tables in the shared folder; the one before the
    newest is removed when a newer one is complete."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, f"round-{len(self.paths)}")
        df.write.parquet(path)
        for old in self.paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = [path]
        return self.spark.read.schema(df.schema).parquet(path)


def shallot_clusters(
    vectors: DataFrame,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: int = 1024,
    seed: int = 3,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """Every whole vector's cluster after ``rounds`` rounds and one more assignment.

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256. Centroids start as the ``k`` vectors with the smallest SHA-256 of
    "seed:id" (then the smallest components; rows without id last). Vectors that have
    not ``dims`` components or have a null, NaN or infinite one are left out; a repeated
    row is a vector of its own. With fewer than ``k`` vectors there are as many centroids
    as vectors; an empty table gives no rows. Components beyond ``most_component`` after
    scaling raise an error, since their distances would not be exact. Other columns are
    left out.

    Every round writes vectors and bounds to the shared folder, so a lost executor costs
    its tasks of one round, and the table of the round before is then removed. What
    reaches the driver and the tasks are the ``k`` centroids. Rounds end early when no
    centroid moves, since all later ones would change nothing.
    """
    spark = vectors.sparkSession
    tables = _Rounds(spark)
    whole = (
        vectors.select(F.col(id_column).alias("vec_id"), whole_vector(vector_column, dims, scale).alias("v"))
        .where("v IS NOT NULL")
        .select(
            "vec_id",
            "v",
            F.lit(0).alias("cluster"),
            F.lit(1).alias("second"),
            F.lit(float("inf")).alias("upper"),
            F.lit(0.0).alias("lower"),
        )
    )
    states = tables.write(whole)
    name = F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string"))
    first = states.select("v", F.sha2(name, 256).alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return _with_inertia(states.withColumn("distance", F.lit(0).cast("long")), np.zeros((1, dims), np.int64))
    at = np.array([row["v"] for row in first], np.int64)
    moved = np.zeros(len(at))
    schema = T.StructType([states.schema["vec_id"], states.schema["v"], *T.StructType.fromDDL(_STATE).fields])
    for _ in range(rounds):
        states = tables.write(states.mapInArrow(_assigner(Centroids.of(at), moved, last=False), schema))
        after = _means(states, dims, at)
        moved = np.sqrt(((after - at) ** 2).sum(1))
        at = after
        if not moved.any():
            break
    states = tables.write(states.mapInArrow(_assigner(Centroids.of(at), moved, last=True), schema))
    return _with_inertia(states, at)


def _with_inertia(states: DataFrame, at: np.ndarray) -> DataFrame:
    """Sums and digests of the clusters as constants: one of each per centroid."""
    sums = {r["cluster"]: r["d"] for r in states.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    own = [sums.get(i, 0) for i in range(len(at))]

    def by_cluster(values, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)

    return states.select(
        "vec_id",
        "cluster",
        "distance",
        by_cluster(own, "long").alias("cluster_inertia"),
        F.lit(sum(own)).cast("long").alias("inertia"),
        by_cluster(digests, "string").alias("centroid_sha256"),
    )
