"""Anomaly detection on batch frames.

All detectors look at the readings of one sensor in the order of
``recorded_at``, then the ``tiebreak`` columns, then ``value``. Pass a unique
tie-break (an event id, or partition and offset) if a sensor can report twice at
one instant. Rows without a value are not readings and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.severity import (
    ewma_rank,
    ewma_severity,
    raised,
    severity_at,
    z_rank,
    z_severity,
)
from gaugeflow.operators.fold import SCORE_COLUMNS, Scores, score_batches
from gaugeflow.operators.skew import SLICE, HeavyKeys, find_heavy, sorted_slices
from gaugeflow.operators.slices import carry_states
from gaugeflow.schemas import ANOMALY_COLUMNS
from gaugeflow.settings import DetectorSettings, SkewSettings

DEFAULTS = DetectorSettings()
SKEW = SkewSettings()

_BASE = ("sensor_id", "sensor_type", "location", "value", "recorded_at")
_SCORE_FIELDS = [
    T.StructField(SCORE_COLUMNS[0], T.LongType()),
    *[T.StructField(name, T.DoubleType()) for name in SCORE_COLUMNS[1:]],
]


def _order(tiebreak: Sequence[str]) -> list[str]:
    return ["sensor_id", "recorded_at", *tiebreak, "value"]


def _readings(events: DataFrame, tiebreak: Sequence[str]) -> DataFrame:
    """Only the columns the detectors use travel through the shuffle."""
    columns = dict.fromkeys([*_BASE, *tiebreak])
    return events.select(*columns).filter(F.col("value").isNotNull())


def _heavy_sensors(events: DataFrame, skew: SkewSettings | None) -> HeavyKeys | None:
    """Counted before rows without value are dropped, so only the key is read."""
    return find_heavy(events, ["sensor_id"], skew, skew.sensor_limit if skew else int)


# Which detector fired, as columns and as the equal numpy test that drops rows
# before they leave the Python worker. Written as "not below" so that a NaN score
# fires.


def z_fired(settings: DetectorSettings) -> Column:
    return (F.col("reading_no") >= settings.z_warmup) & ~(
        F.col("z_score") < settings.z_threshold
    )


def ewma_fired(settings: DetectorSettings) -> Column:
    return (F.col("reading_no") >= settings.ewma_warmup) & ~(
        F.col("ewma_deviation") <= settings.ewma_threshold
    )


def fired_mask(settings: DetectorSettings, z: bool, ewma: bool):
    def keep(scores: Scores) -> np.ndarray:
        mask = np.zeros(len(scores.reading_no), dtype=bool)
        if z:
            mask |= (scores.reading_no >= settings.z_warmup) & ~(
                scores.z_score < settings.z_threshold
            )
        if ewma:
            mask |= (scores.reading_no >= settings.ewma_warmup) & ~(
                scores.ewma_deviation <= settings.ewma_threshold
            )
        return mask

    return keep


def _score_light(readings: DataFrame, alpha: float, tiebreak: Sequence[str], keep) -> DataFrame:
    """One shuffle on the sensor, one sort, one constant-memory pass."""
    schema = T.StructType([*readings.schema.fields, *_SCORE_FIELDS])
    return (
        readings.repartition("sensor_id")
        .sortWithinPartitions(*_order(tiebreak))
        .mapInArrow(lambda it: score_batches(it, alpha, keep=keep), schema)
    )


def _score_heavy(
    readings: DataFrame, rows: int, alpha: float, tiebreak: Sequence[str], keep, skew: SkewSettings
) -> DataFrame:
    """One range shuffle that cuts inside a sensor, then narrow passes only."""
    slices = sorted_slices(readings, _order(tiebreak), rows, skew)
    starts = carry_states(slices, alpha)  # at most one state per slice
    schema = T.StructType([*slices.schema.fields, *_SCORE_FIELDS])

    def start_of(chunk):
        return starts.get(chunk.column(SLICE)[0].as_py())

    return slices.mapInArrow(
        lambda it: score_batches(it, alpha, start_of=start_of, keep=keep), schema
    ).drop(SLICE)


def _score(
    events: DataFrame,
    settings: DetectorSettings,
    tiebreak: Sequence[str],
    skew: SkewSettings | None,
    keep=None,
) -> DataFrame:
    readings = _readings(events, tiebreak)
    heavy = _heavy_sensors(events, skew)
    if heavy is None:
        return _score_light(readings, settings.alpha, tiebreak, keep)
    light_rows, heavy_rows = heavy.split(readings)
    sliced = _score_heavy(heavy_rows, heavy.rows, settings.alpha, tiebreak, keep, skew)
    if light_rows is None:
        return sliced
    return _score_light(light_rows, settings.alpha, tiebreak, keep).unionByName(sliced)


def score_readings(
    events: DataFrame,
    settings: DetectorSettings = DEFAULTS,
    tiebreak: Sequence[str] = (),
    skew: SkewSettings | None = SKEW,
) -> DataFrame:
    """Every reading with the scores of both detectors.

    Adds ``reading_no``, ``expected`` and ``z_score`` (running mean before the
    reading, distance in sample deviations that include it), ``ewma_expected``
    and ``ewma_deviation`` (moving mean before the reading, distance in moving
    deviations that exclude it).
    """
    return _score(events, settings, tiebreak, skew)


def z_scores(
    events: DataFrame,
    tiebreak: Sequence[str] = (),
    skew: SkewSettings | None = SKEW,
) -> DataFrame:
    """The z-score columns alone."""
    return _score(events, DEFAULTS, tiebreak, skew).drop("ewma_expected", "ewma_deviation")


def _anomaly(scored: DataFrame, expected: Column, z_score: Column, severity: Column, keep) -> DataFrame:
    return scored.select(
        "sensor_id",
        "sensor_type",
        "location",
        "value",
        expected.alias("expected"),
        z_score.alias("z_score"),
        severity.alias("severity"),
        F.col("recorded_at").alias("detected_at"),
        *[c for c in keep if c not in ANOMALY_COLUMNS],
    )


def z_anomalies(
    events: DataFrame,
    settings: DetectorSettings = DEFAULTS,
    tiebreak: Sequence[str] = (),
    skew: SkewSettings | None = SKEW,
) -> DataFrame:
    """Readings far from their sensor's running mean."""
    keep = fired_mask(settings, z=True, ewma=False)
    fired = _score(events, settings, tiebreak, skew, keep)
    z = F.col("z_score")
    return _anomaly(fired, F.col("expected"), z, z_severity(z), tiebreak)


def ewma_anomalies(
    events: DataFrame,
    settings: DetectorSettings = DEFAULTS,
    tiebreak: Sequence[str] = (),
    skew: SkewSettings | None = SKEW,
) -> DataFrame:
    """Readings far from their sensor's moving mean; ``z_score`` is the deviation."""
    keep = fired_mask(settings, z=False, ewma=True)
    fired = _score(events, settings, tiebreak, skew, keep)
    deviation = F.col("ewma_deviation")
    return _anomaly(
        fired, F.col("ewma_expected"), deviation, ewma_severity(deviation), tiebreak
    )


def merge_detectors(
    scored: DataFrame, settings: DetectorSettings = DEFAULTS, keep: Sequence[str] = ()
) -> DataFrame:
    """Anomalies from rows that carry both scores.

    One detector fired: its expectation, score and severity. Both fired: those
    of the z-score detector, with the graver severity raised by one tier.
    """
    z, deviation = F.col("z_score"), F.col("ewma_deviation")
    by_z, by_ewma = z_rank(z), ewma_rank(deviation)
    fired = scored.withColumn("_z", z_fired(settings)).withColumn("_e", ewma_fired(settings))
    fired = fired.filter(F.col("_z") | F.col("_e"))
    rank = (
        F.when(F.col("_z") & F.col("_e"), raised(F.greatest(by_z, by_ewma)))
        .when(F.col("_z"), by_z)
        .otherwise(by_ewma)
    )
    return _anomaly(
        fired,
        F.when(F.col("_z"), F.col("expected")).otherwise(F.col("ewma_expected")),
        F.when(F.col("_z"), z).otherwise(deviation),
        severity_at(rank),
        keep,
    )


def layered_anomalies(
    events: DataFrame,
    settings: DetectorSettings = DEFAULTS,
    tiebreak: Sequence[str] = (),
    skew: SkewSettings | None = SKEW,
) -> DataFrame:
    """Both detectors in one pass over the readings, merged per reading."""
    keep = fired_mask(settings, z=True, ewma=True)
    scored = _score(events, settings, tiebreak, skew, keep)
    return merge_detectors(scored, settings, tiebreak)
