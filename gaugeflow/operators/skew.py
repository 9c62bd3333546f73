"""Heavy keys: finding them, and cutting their rows into ordered slices.

A key with a large share of all rows must not end up in one task. Its rows are
range-partitioned on a total order instead, which cuts inside the key, and
checkpointed to the shared folder: from then on the slices are fixed, survive the
loss of an executor and can be read as often as needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.session import shared_dir
from gaugeflow.settings import SkewSettings

SLICE = "_slice"


@dataclass(frozen=True)
class HeavyKeys:
    """Keys above the row limit: at most ``max_heavy``, or all when there are more."""

    frame: DataFrame | None
    columns: tuple[str, ...]
    rows: int

    def _matches(self, df: DataFrame) -> Column:
        condition = F.lit(True)
        for name in self.columns:
            condition = condition & df[name].eqNullSafe(self.frame[f"_heavy_{name}"])
        return condition

    def split(self, df: DataFrame) -> tuple[DataFrame | None, DataFrame]:
        """(rows of light keys, rows of heavy keys); no light part if all are heavy.

        The broadcast side holds at most ``max_heavy`` rows by construction.
        """
        if self.frame is None:
            return None, df
        small = F.broadcast(self.frame)
        light = df.join(small, self._matches(df), "left_anti")
        heavy = df.join(small, self._matches(df), "left_semi")
        return light, heavy


def find_heavy(
    df: DataFrame,
    columns: Sequence[str],
    skew: SkewSettings | None,
    limit_for: Callable[[int], int],
) -> HeavyKeys | None:
    """Keys that need slicing, or None when there are none.

    ``limit_for`` gives the row limit of a key from the total number of rows.
    Runs one count, which a columnar table answers from its footers, and only when
    the total exceeds the limit a second, map-side combined count by key over the
    key columns alone.
    """
    if skew is None or df.isStreaming:
        return None
    total = df.count()
    limit = limit_for(total)
    if total <= limit:
        return None
    counts = (
        df.groupBy(*[F.col(c).alias(f"_heavy_{c}") for c in columns])
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > limit)
    )
    found = counts.limit(skew.max_heavy + 1).collect()
    if not found:
        return None
    if len(found) > skew.max_heavy:
        return HeavyKeys(None, tuple(columns), total)
    frame = df.sparkSession.createDataFrame(found, counts.schema).drop("_rows")
    return HeavyKeys(frame, tuple(columns), sum(r["_rows"] for r in found))


def sorted_slices(df: DataFrame, order: Sequence[str], rows: int, skew: SkewSettings) -> DataFrame:
    """``df`` globally sorted on ``order`` and cut into checkpointed slices.

    Adds ``_slice``, ascending along the order. A position within the input is
    the last sort key, so even full copies of one row can be cut apart.
    """
    shared_dir(df.sparkSession)
    keys = [*order, "_position"]
    return (
        df.withColumn("_position", F.monotonically_increasing_id())
        .repartitionByRange(skew.slice_count(rows), *keys)
        .sortWithinPartitions(*keys)
        .withColumn(SLICE, F.spark_partition_id())
        .drop("_position")
        .checkpoint()
    )
