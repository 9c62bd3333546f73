"""Tumbling-window metrics by sensor type and location."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.timeparts import AsOf, as_of_column, minute_start, minutes_before
from gaugeflow.operators.quantile import BRACKET_ROWS, least_reaching, plain_quantile, rank_of, ranked_cells
from gaugeflow.operators.skew import HeavyKeys, find_heavy
from gaugeflow.schemas import WINDOW_COLUMNS
from gaugeflow.settings import SkewSettings

DEFAULT_WIDTH = "1 minute"
RETAIN_MINUTES = 60
_KEYS = ("window_start", "window_end", "sensor_type", "location")
_QUANTILE = 0.99

def _keyed(events: DataFrame, width: str) -> DataFrame:
    bucket = F.window("recorded_at", width)
    return events.select(
        bucket.alias("_window"), "sensor_type", "location", "value"
    ).select(
        F.col("_window.start").alias("window_start"),
        F.col("_window.end").alias("window_end"),
        "sensor_type",
        "location",
        "value",
    )


def _plain_metrics() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("count"),
        F.sum("value").alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("avg"),
    ]


def _nearest_rank(approx: bool, accuracy: int) -> Column:
    """The value at rank ceil(0.99 n), without interpolation."""
    if approx:
        return F.percentile_approx("value", _QUANTILE, accuracy).alias("p99")
    return plain_quantile("value", _QUANTILE, "p99")


def window_metrics(
    events: DataFrame,
    width: str = DEFAULT_WIDTH,
    *,
    watermark: str | None = None,
    approx: bool = False,
    accuracy: int = 10_000,
    skew: SkewSettings | None = SkewSettings(),
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """Count, sum, min, max, avg and p99 of each (window, sensor type, location).

    Works on batch and streaming frames; a stream takes the lateness it tolerates
    as ``watermark``. The exact p99 keeps the distinct values of a group; of groups
    above ``bracket_rows`` only the values near the rank are kept (batch), or use
    ``approx=True``, a sketch of fixed size (wide windows on streams). ``skew=None``
    leaves out the search for large groups.
    """
    if events.isStreaming:
        if watermark is not None:
            events = events.withWatermark("recorded_at", watermark)
        grouped = events.groupBy(F.window("recorded_at", width), "sensor_type", "location")
        metrics = grouped.agg(*_plain_metrics(), _nearest_rank(approx, accuracy))
        return metrics.select(
            "sensor_type",
            "location",
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            *WINDOW_COLUMNS[4:],
        )

    keyed = _keyed(events, width)
    if approx or skew is None:
        return _aggregate(keyed, approx, accuracy)
    heavy = find_heavy(keyed, _KEYS, skew, lambda _: bracket_rows)
    if heavy is None:
        return _aggregate(keyed, approx, accuracy)
    light_rows, heavy_rows = heavy.split(keyed)
    ranked = _bracketed_metrics(heavy_rows, heavy)
    if light_rows is None:
        return ranked
    return _aggregate(light_rows, approx, accuracy).unionByName(ranked)


def _aggregate(keyed: DataFrame, approx: bool, accuracy: int) -> DataFrame:
    metrics = keyed.groupBy(*_KEYS).agg(*_plain_metrics(), _nearest_rank(approx, accuracy))
    return metrics.select(*WINDOW_COLUMNS)


def p99_rank(rows: Column) -> Column:
    return rank_of(_QUANTILE, rows)


def _bracketed_metrics(rows: DataFrame, heavy: HeavyKeys) -> DataFrame:
    """Groups of any size: the pass that counts the values near the rank takes the other
    metrics along."""
    cells = ranked_cells(
        rows,
        _KEYS,
        "value",
        _QUANTILE,
        heavy,
        {
            "rows": F.count(F.lit(1)),
            "sum": F.sum("value"),
            "min": F.min("value"),
            "max": F.max("value"),
        },
    )
    return (
        cells.groupBy(*_KEYS)
        .agg(
            F.sum("rows").alias("count"),
            F.sum("sum").alias("sum"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            (F.sum("sum") / F.sum("values")).alias("avg"),
            least_reaching().alias("p99"),
        )
        .select(*WINDOW_COLUMNS)
    )


def _minute(as_of: AsOf) -> Column:
    if isinstance(as_of, dt.datetime):
        return as_of_column(as_of.replace(second=0, microsecond=0))
    return minute_start(as_of_column(as_of))


def in_progress(metrics: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Windows starting in the minute of ``as_of`` or later."""
    return metrics.filter(F.col("window_start") >= _minute(as_of))


def completed(metrics: DataFrame, as_of: AsOf = None) -> DataFrame:
    """Windows starting before the minute of ``as_of``."""
    return metrics.filter(F.col("window_start") < _minute(as_of))


def retained(metrics: DataFrame, as_of: AsOf = None, minutes: int = RETAIN_MINUTES) -> DataFrame:
    """Windows starting no earlier than ``minutes`` before ``as_of``'s minute."""
    return metrics.filter(F.col("window_start") >= minutes_before(_minute(as_of), minutes))


# The same three views, reading only the events that can be in such a window: a
# window that starts at a cutoff or later holds no earlier event, and one that
# starts before it holds none later than a width after it. The bound reaches the
# scan, where it prunes days and row groups.


def current_window_metrics(
    events: DataFrame, as_of: AsOf = None, width: str = DEFAULT_WIDTH, **options
) -> DataFrame:
    """:func:`in_progress` windows of ``events``."""
    recent = events.filter(F.col("recorded_at") >= _minute(as_of))
    return in_progress(window_metrics(recent, width, **options), as_of)


def completed_window_metrics(
    events: DataFrame, as_of: AsOf = None, width: str = DEFAULT_WIDTH, **options
) -> DataFrame:
    """:func:`completed` windows of ``events``."""
    bound = _minute(as_of) + F.expr(f"INTERVAL {width}")
    earlier = events.filter(F.col("recorded_at") < bound)
    return completed(window_metrics(earlier, width, **options), as_of)


def retained_window_metrics(
    events: DataFrame,
    as_of: AsOf = None,
    minutes: int = RETAIN_MINUTES,
    width: str = DEFAULT_WIDTH,
    **options,
) -> DataFrame:
    """:func:`retained` windows of ``events``."""
    recent = events.filter(F.col("recorded_at") >= minutes_before(_minute(as_of), minutes))
    return retained(window_metrics(recent, width, **options), as_of, minutes)


def newest_windows(metrics: DataFrame, limit: int = 8) -> DataFrame:
    """The short list of a live view, in a fixed order."""
    return metrics.orderBy(F.desc("window_start"), "sensor_type", "location").limit(limit)


def events_per_interval(
    events: DataFrame, width: str = DEFAULT_WIDTH, points: int = 60
) -> DataFrame:
    """Event counts of the newest non-empty intervals, newest first."""
    counts = events.groupBy(F.window("recorded_at", width)).agg(F.count(F.lit(1)).alias("events"))
    return (
        counts.select(F.col("window.start").alias("window_start"), "events")
        .orderBy(F.desc("window_start"))
        .limit(points)
    )
