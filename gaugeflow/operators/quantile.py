"""Exact nearest-rank quantiles of groups of any size.

The quantile aggregate of Spark keeps a group's distinct values in memory. Groups that are
too large for it are ranked in two passes without a sort of their rows: a sketch of fixed
size, combined map-side, gives two values that certainly enclose the rank; then the
values below are counted and only those between, a few of ten thousand, are ranked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.skew import HeavyKeys, find_heavy
from gaugeflow.settings import SkewSettings

#: An exact quantile keeps the values of a group in memory up to so many rows.
BRACKET_ROWS = 100_000
_ACCURACY = 10_000


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of ``keys`` with the columns of the other side that begin with
    an underscore."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[f"_{k}"])
    return condition


def rank_of(share: float, rows: Column) -> Column:
    """The rank ceil(share * rows), 1 at least."""
    return F.greatest(F.ceil(rows.cast("double") * F.lit(share)), F.lit(1))


def plain_quantile(value: str, share: float, name: str) -> Column:
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY `{value}`)").alias(name)


def ranked_cells(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    share: float,
    heavy: HeavyKeys,
    sums: Mapping[str, Column] = MappingProxyType({}),
) -> DataFrame:
    """Few rows per group: one for each value near the rank and one for all others.

    Adds ``near`` (the value, null for others), ``values`` (how many rows with a value it
    stands for), ``reaches`` (whether the rank is reached with it) and the aggregates
    ``sums``. The quantile is the least ``near`` that reaches the rank.
    """
    margin = 3 / _ACCURACY
    shares = F.array(F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin)))
    bounds = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.percentile_approx(value, shares, _ACCURACY).alias("_bounds")
    )
    if heavy.frame is not None:
        bounds = F.broadcast(bounds)  # one row per heavy group, at most ``max_heavy``
    v, low, high = F.col(value), F.col("_bounds")[0], F.col("_bounds")[1]
    cells = (
        rows.join(bounds, same_keys(rows, bounds, keys))
        .groupBy(*keys, F.when((v >= low) & (v <= high), v).alias("near"))
        .agg(
            F.count(value).alias("values"),
            F.count_if(v < low).alias("below"),
            *[column.alias(name) for name, column in sums.items()],
        )
    )
    group = Window.partitionBy(*keys)
    upto = group.orderBy("near").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near_upto = F.sum(F.when(F.col("near").isNotNull(), F.col("values")).otherwise(0)).over(upto)
    reached = F.sum("below").over(group) + near_upto
    return cells.withColumn("reaches", reached >= rank_of(share, F.sum("values").over(group)))


def least_reaching() -> Column:
    return F.min(F.when(F.col("reaches"), F.col("near")))


def group_quantile(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    share: float,
    name: str = "quantile",
    skew: SkewSettings | None = SkewSettings(),
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """The value at rank ceil(share * n) of each group, without interpolation. Nulls are
    not counted; a group of nulls alone has a null; null keys are groups."""
    heavy = find_heavy(rows, keys, skew, lambda _: bracket_rows)
    plain = plain_quantile(value, share, name)
    if heavy is None:
        return rows.groupBy(*keys).agg(plain)
    light_rows, heavy_rows = heavy.split(rows)
    found = ranked_cells(heavy_rows, keys, value, share, heavy).groupBy(*keys).agg(least_reaching().alias(name))
    return found if light_rows is None else light_rows.groupBy(*keys).agg(plain).unionByName(found)
