"""Scores against a sensor's usual value at that time of its season.

The baseline of a sensor and phase (by default the hour of the day) is the median of its
readings there, the spread their median absolute deviation: neither is moved by the
anomalies themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.functions.severity import z_severity
from gaugeflow.operators.quantile import group_quantile, same_keys
from gaugeflow.settings import SkewSettings

_KEYS = ("sensor_id", "phase")
#: Deviations of a normal variable to its median absolute one. Fixed value.
_NORMAL = 1.4826


def season_phase(hours: int = 24, at: str = "recorded_at") -> Column:
    """Which hour of a season of ``hours`` a reading falls into, counted from the epoch."""
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    return F.pmod(F.floor(seconds / 3_600_000_000), F.lit(hours)).cast("int")


def seasonal_scores(
    events: DataFrame, hours: int = 24, skew: SkewSettings | None = SkewSettings(), bracket_rows: int | None = None
) -> DataFrame:
    """Every reading with ``phase``, ``baseline``, ``residual`` and ``seasonal_score``.

    The baseline is the lower median of the sensor's readings of that phase, the score the
    residual's distance in 1.4826 median absolute deviations, or in units where
    that deviation is 0. Readings without value or time have no score and are left out;
    null sensors are one sensor. Sensors whose readings of one phase are too many for
    one task are ranked in two passes, see :func:`group_quantile`.
    """
    options = {"skew": skew, **({"bracket_rows": bracket_rows} if bracket_rows else {})}
    rows = events.withColumn("phase", season_phase(hours)).where("value IS NOT NULL AND phase IS NOT NULL")
    median = group_quantile(rows, _KEYS, "value", 0.5, name="baseline", **options)
    placed = _beside(rows, median).withColumn("residual", F.col("value") - F.col("baseline"))
    distances = placed.select(*_KEYS, F.abs("residual").alias("distance"))
    spread = group_quantile(distances, _KEYS, "distance", 0.5, name="_mad", **options)
    unit = F.when(F.col("_mad") > 0, F.col("_mad") * _NORMAL).otherwise(1.0)
    return _beside(placed, spread).withColumn("seasonal_score", F.abs("residual") / unit).drop("_mad")


def _beside(rows: DataFrame, of_group: DataFrame) -> DataFrame:
    """Rows with the columns of their group, null keys included."""
    renamed = of_group.withColumnsRenamed({k: f"_{k}" for k in _KEYS})
    return rows.join(renamed, same_keys(rows, renamed, _KEYS)).drop(*[f"_{k}" for k in _KEYS])


def seasonal_anomalies(events: DataFrame, threshold: float = 3.5, hours: int = 24, **options) -> DataFrame:
    """Readings at least ``threshold`` robust deviations from their season's baseline."""
    scored = seasonal_scores(events, hours, **options).where(F.col("seasonal_score") >= threshold)
    return scored.withColumn("severity", z_severity(F.col("seasonal_score")))
