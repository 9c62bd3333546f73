"""Views derived from stored readings, windows, anomalies and rejects."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.codec import struct_json
from gaugeflow.operators.detect import layered_anomalies
from gaugeflow.operators.windows import window_metrics
from gaugeflow.schemas import WINDOW_COLUMNS
from gaugeflow.settings import DetectorSettings

#: Where alerts of each severity go.
ROUTES: Mapping[str, Sequence[str]] = {
    "low": ("log",),
    "medium": ("log", "mail"),
    "high": ("log", "mail", "chat"),
    "critical": ("log", "mail", "chat", "pager"),
}


def rollup(minutes: DataFrame, events: DataFrame, width: str) -> DataFrame:
    """Wider windows: count, sum, min, max and avg from stored minute windows, p99 anew
    from the events, since it cannot be combined."""
    slot = F.window("window_start", width)
    keys = ["window_start", "window_end", "sensor_type", "location"]
    combined = (
        minutes.groupBy(slot.alias("_slot"), "sensor_type", "location")
        .agg(
            F.sum("count").alias("count"),
            F.sum("sum").alias("sum"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
        )
        .select(
            F.col("_slot.start").alias("window_start"),
            F.col("_slot.end").alias("window_end"),
            "sensor_type",
            "location",
            "count",
            "sum",
            "min",
            "max",
            (F.col("sum") / F.col("count")).alias("avg"),
        )
    )
    # Adding up both kinds of rows needs no join, so null types and locations meet too.
    no_p99 = combined.withColumn("p99", F.lit(None).cast("double"))
    p99 = window_metrics(events, width).select(*keys, "p99")
    both = no_p99.unionByName(p99, allowMissingColumns=True).groupBy(*keys)
    return both.agg(*[F.max(c).alias(c) for c in WINDOW_COLUMNS if c not in keys]).select(*WINDOW_COLUMNS)


def deduplicated_events(events: DataFrame, tiebreak: Sequence[str]) -> DataFrame:
    """The first event of each sensor and time; ``tiebreak`` says which is first."""
    order = Window.partitionBy("sensor_id", "recorded_at").orderBy(*tiebreak)
    return (
        events.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")
    )


def alert_episodes(anomalies: DataFrame, quiet: str = "1 hour", tiebreak: Sequence[str] = ()) -> DataFrame:
    """One alert for each run of a sensor's anomalies, with the number it stands for.

    A run ends when no anomaly follows within ``quiet``. The alert is the run's first
    anomaly; ``last_at`` and ``worst`` tell how it went on.
    """
    order = [F.col("detected_at"), *[F.col(c) for c in tiebreak]]
    by_sensor = Window.partitionBy("sensor_id").orderBy(*order)
    before = F.lag("detected_at").over(by_sensor)
    starts = before.isNull() | (F.col("detected_at") > before + F.expr(f"INTERVAL {quiet}"))
    upto = by_sensor.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.array_position(F.array(*[F.lit(s) for s in ROUTES]), F.col("severity"))
    numbered = anomalies.withColumn("_starts", starts.cast("int")).withColumn(
        "_run", F.sum("_starts").over(upto)
    )
    first = F.min_by(F.col("severity"), F.struct(*order))
    return (
        numbered.groupBy("sensor_id", "_run")
        .agg(
            F.min("detected_at").alias("detected_at"),
            F.max("detected_at").alias("last_at"),
            F.count(F.lit(1)).alias("anomalies"),
            first.alias("severity"),
            F.max_by("severity", rank).alias("worst"),
        )
        .drop("_run")
    )


def routed_alerts(anomalies: DataFrame, routes: Mapping[str, Sequence[str]] = ROUTES) -> DataFrame:
    """Every alert once for each channel its severity is routed to."""
    channels = F.lit(None)
    for severity, names in routes.items():
        own = F.array(*[F.lit(n) for n in names])
        channels = F.when(F.col("severity") == severity, own).otherwise(channels)
    return anomalies.withColumn("channel", F.explode(channels))


def alert_payload(link: str = "") -> Column:
    """What is sent of an alert, as JSON: the anomaly and, if given, a link to its sensor."""
    fields = ["sensor_id", "severity", "value", "expected", "z_score"]
    stamp = F.col("detected_at").cast("timestamp").alias("timestamp")
    shown = [F.concat(F.lit(link), F.col("sensor_id")).alias("link")] if link else []
    return struct_json(F.struct(*fields, stamp, *shown))


def reject_depth(rejects: DataFrame) -> DataFrame:
    """How many rejects wait, by reason."""
    return rejects.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("waiting"))


def failed_rules(rules: Mapping[str, Column]) -> Column:
    """Names of all rules that a row fails, in their order; a null counts as failing."""
    failed = [F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]
    return F.array_compact(F.array(*failed))


def replay_range(
    events: DataFrame,
    start: dt.datetime,
    end: dt.datetime,
    warm_up: dt.timedelta,
    settings: DetectorSettings = DetectorSettings(),
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Anomalies of a time range [start, end), the detectors warmed up on the readings
    of ``warm_up`` before it. Only these readings are read."""
    def moment(t: dt.datetime) -> Column:
        return F.lit(t.isoformat(sep=" ")).cast(events.schema["recorded_at"].dataType)

    at = F.col("recorded_at")
    rows = events.filter((at >= moment(start - warm_up)) & (at < moment(end)))
    found = layered_anomalies(rows, settings, tiebreak=tiebreak)
    return found.filter(F.col("detected_at") >= moment(start))
