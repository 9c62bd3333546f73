"""Declared schemas. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

# One reading as the tables hold it.
EVENT = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("sensor_type", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("recorded_at", T.TimestampType()),
    ]
)

WINDOW_METRIC = T.StructType(
    [
        T.StructField("sensor_type", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("window_start", T.TimestampType()),
        T.StructField("window_end", T.TimestampType()),
        T.StructField("count", T.LongType()),
        T.StructField("sum", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("avg", T.DoubleType()),
        T.StructField("p99", T.DoubleType()),
    ]
)

ANOMALY = T.StructType(
    [
        T.StructField("sensor_id", T.StringType()),
        T.StructField("sensor_type", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("expected", T.DoubleType()),
        T.StructField("z_score", T.DoubleType()),
        T.StructField("severity", T.StringType()),
        T.StructField("detected_at", T.TimestampType()),
    ]
)

PIPELINE_STATS = T.StructType(
    [
        T.StructField("events_ingested", T.LongType()),
        T.StructField("events_per_second", T.DoubleType()),
        T.StructField("anomalies_detected", T.LongType()),
        T.StructField("active_sensors", T.LongType()),
        T.StructField("processor_lag_ms", T.LongType()),
    ]
)

EVENT_COLUMNS = EVENT.fieldNames()
WINDOW_COLUMNS = WINDOW_METRIC.fieldNames()
ANOMALY_COLUMNS = ANOMALY.fieldNames()
