"""Statistics records and the live snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.codec import struct_json
from gaugeflow.functions.timeparts import AsOf, as_of_column, seconds_between
from gaugeflow.operators.reads import recent_anomalies, recent_events, table_counters
from gaugeflow.operators.windows import current_window_metrics
from gaugeflow.schemas import ANOMALY_COLUMNS, EVENT_COLUMNS, WINDOW_COLUMNS

SNAPSHOT_TYPE = "pipeline_update"
SNAPSHOT_ROWS = 5


def _record(started_at: AsOf, as_of: AsOf, lag_ms: Column) -> Column:
    elapsed = seconds_between(as_of_column(started_at), as_of_column(as_of))
    rate = F.col("total_events") / elapsed
    return F.struct(
        F.col("total_events").alias("events_ingested"),
        F.when(elapsed > 0, rate).otherwise(F.lit(0.0)).alias("events_per_second"),
        F.col("total_anomalies").alias("anomalies_detected"),
        F.lit(0).cast("long").alias("active_sensors"),
        lag_ms.cast("long").alias("processor_lag_ms"),
    )


def pipeline_stats(
    events: DataFrame,
    anomalies: DataFrame,
    started_at: AsOf,
    as_of: AsOf = None,
    lag_ms: int = 0,
) -> DataFrame:
    """One row: running counters, table counters, active sensors.

    ``lag_ms`` is the handling time of the last micro-batch; see
    :func:`gaugeflow.streaming.progress.handling_ms`. The running counters do not
    know the active sensors: that field stays 0 there and is given besides.
    """
    counters = table_counters(events, anomalies, as_of)
    return counters.select(
        _record(started_at, as_of, F.lit(lag_ms)).alias("pipeline"),
        F.struct(*counters.columns).alias("database"),
        "active_sensors",
    )


def _listed(rows: DataFrame, columns: Sequence[str], order: str, tiebreak: Sequence[str]) -> Column:
    """Few rows as an array of structs, newest first."""
    maps = [c for c in columns if isinstance(rows.schema[c].dataType, T.MapType)]
    # A map has no order, so it is sorted along as its entries and rebuilt after.
    row = F.struct(*[F.map_entries(c).alias(c) if c in maps else F.col(c) for c in columns])
    listed = F.collect_list(F.struct(F.struct(order, *tiebreak).alias("at"), row.alias("row")))

    def rebuilt(item: Column) -> Column:
        value = item["row"]
        for name in maps:
            value = value.withField(name, F.map_from_entries(value[name]))
        return value

    items = rows.agg(F.sort_array(listed, asc=False).alias("items"))
    return items.select(F.transform("items", rebuilt)).scalar()


def pipeline_snapshot(
    events: DataFrame,
    anomalies: DataFrame,
    started_at: AsOf,
    as_of: AsOf = None,
    lag_ms: int = 0,
    tiebreak: Sequence[str] = (),
    counters: DataFrame | None = None,
) -> DataFrame:
    """One row for a live view: ``type`` and ``data``.

    ``data`` holds the counters, the newest five anomalies and events, and the
    windows in progress: one per sensor type and location seen since the minute
    of ``as_of`` began. ``counters`` is one row of total_events, total_anomalies and
    processor_lag_ms, as :func:`gaugeflow.streaming.progress.live_counters` gives it;
    without it both tables are counted.
    """
    if counters is None:
        counters = events.sparkSession.range(1).select(
            events.agg(F.count(F.lit(1))).scalar().alias("total_events"),
            anomalies.agg(F.count(F.lit(1))).scalar().alias("total_anomalies"),
            F.lit(lag_ms).alias("processor_lag_ms"),
        )
    newest_events = recent_events(events, SNAPSHOT_ROWS, tiebreak=tiebreak)
    newest_anomalies = recent_anomalies(anomalies, SNAPSHOT_ROWS, tiebreak)
    windows = current_window_metrics(events, as_of)
    data = F.struct(
        _record(started_at, as_of, F.col("processor_lag_ms")).alias("stats"),
        _listed(newest_anomalies, ANOMALY_COLUMNS, "detected_at", tiebreak).alias("anomalies"),
        _listed(newest_events, EVENT_COLUMNS, "recorded_at", tiebreak).alias("events"),
        _listed(windows, WINDOW_COLUMNS, "window_start", ("sensor_type", "location")).alias(
            "windows"
        ),
        as_of_column(as_of).alias("ts"),
    )
    return counters.select(F.lit(SNAPSHOT_TYPE).alias("type"), data.alias("data"))


def snapshot_json(snapshot: DataFrame) -> DataFrame:
    """The snapshot as one JSON text, times in RFC 3339."""
    return snapshot.select(struct_json(F.struct("type", "data")).alias("json"))
