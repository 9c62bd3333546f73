"""The read queries: recent rows, latest row per sensor, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.functions.timeparts import AsOf, as_of_column, minutes_before, seconds_between
from gaugeflow.schemas import EVENT_COLUMNS

# Default and largest list lengths.
EVENT_LIMIT = 100
EVENT_LIMIT_MAX = 1000
ANOMALY_LIMIT = 50
ANOMALY_LIMIT_MAX = 1000
ACTIVE_MINUTES = 5


def events_where(
    events: DataFrame, sensor_type: str | None = None, location: str | None = None
) -> DataFrame:
    """Equality filters, each added only when its value is given and not empty."""
    if sensor_type:
        events = events.filter(F.col("sensor_type") == sensor_type)
    if location:
        events = events.filter(F.col("location") == location)
    return events


def _newest_first(column: str, tiebreak: Sequence[str]) -> list:
    return [F.desc(column), *[F.desc(c) for c in tiebreak]]


def recent_events(
    events: DataFrame,
    limit: int = EVENT_LIMIT,
    sensor_type: str | None = None,
    location: str | None = None,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """The newest events, newest first. A limit outside 1..1000 counts as 100."""
    if limit <= 0 or limit > EVENT_LIMIT_MAX:
        limit = EVENT_LIMIT
    return (
        events_where(events, sensor_type, location)
        .select(*EVENT_COLUMNS, *tiebreak)
        .orderBy(*_newest_first("recorded_at", tiebreak))
        .limit(limit)
    )


def recent_anomalies(
    anomalies: DataFrame, limit: int = ANOMALY_LIMIT, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """The newest anomalies, newest first, never more than 1000.

    A limit below 1 means as many as there are, up to that bound.
    """
    if limit <= 0:
        limit = ANOMALY_LIMIT_MAX
    return anomalies.orderBy(*_newest_first("detected_at", tiebreak)).limit(
        min(limit, ANOMALY_LIMIT_MAX)
    )


def latest_per_sensor(events: DataFrame, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The newest event of each sensor.

    The rank limit is applied before the shuffle as well, so a map task sends at
    most one row per sensor.
    """
    newest = Window.partitionBy("sensor_id").orderBy(*_newest_first("recorded_at", tiebreak))
    return (
        events.select(*EVENT_COLUMNS, *tiebreak)
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def sensor_directory(
    events: DataFrame, scope: int | str = "all", tiebreak: Sequence[str] = ()
) -> DataFrame:
    """The newest event of each sensor: of all events, or of the newest ``scope``."""
    if scope != "all":
        columns = events.select(*EVENT_COLUMNS, *tiebreak)
        events = columns.orderBy(*_newest_first("recorded_at", tiebreak)).limit(int(scope))
    return latest_per_sensor(events, tiebreak)


def active_sensors(
    events: DataFrame, as_of: AsOf = None, minutes: int = ACTIVE_MINUTES
) -> DataFrame:
    """Distinct sensors heard from in the last ``minutes`` (exclusive bound)."""
    recent = events.filter(F.col("recorded_at") > minutes_before(as_of_column(as_of), minutes))
    return recent.agg(F.count_distinct("sensor_id").alias("active_sensors"))


def table_counters(events: DataFrame, anomalies: DataFrame, as_of: AsOf = None) -> DataFrame:
    """One row: total events, total anomalies, active sensors.

    Three scalar subqueries: both totals need no column at all, and the recency
    filter of the third reaches the scan.
    """
    one = events.sparkSession.range(1)
    return one.select(
        events.agg(F.count(F.lit(1))).scalar().alias("total_events"),
        anomalies.agg(F.count(F.lit(1))).scalar().alias("total_anomalies"),
        active_sensors(events, as_of).scalar().alias("active_sensors"),
    )


def throughput(events: DataFrame, started_at: AsOf, as_of: AsOf = None) -> DataFrame:
    """Events ingested and events per second since the start; 0 before it."""
    elapsed = seconds_between(as_of_column(started_at), as_of_column(as_of))
    ingested = F.col("events_ingested")
    return events.agg(F.count(F.lit(1)).alias("events_ingested")).select(
        ingested,
        F.when(elapsed > 0, ingested / elapsed).otherwise(F.lit(0.0)).alias("events_per_second"),
    )


def anomalies_by_severity(anomalies: DataFrame) -> DataFrame:
    """Anomaly counts per tier."""
    return anomalies.groupBy("severity").agg(F.count(F.lit(1)).alias("anomalies"))
