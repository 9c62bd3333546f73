import datetime as dt
import json

import pytest
from helpers import START, event_frame, event_rows, wavy
from pyspark.sql import functions as F

from gaugeflow.operators import detect
from gaugeflow.plans import snapshot
from gaugeflow.plans.inputs import TIEBREAK
from gaugeflow.streaming.detect import alert_lines

AS_OF = START + dt.timedelta(minutes=2)


@pytest.fixture(scope="module")
def tables(spark):
    series = {f"s{i}": wavy(110) + [9999.0] + wavy(40) for i in range(8)}
    events = event_frame(spark, event_rows(series)).withColumn(
        "tags", F.create_map(F.lit("k"), F.col("sensor_id"))
    )
    return events, detect.layered_anomalies(events, tiebreak=TIEBREAK)


def test_stats(tables):
    events, anomalies = tables
    row = snapshot.pipeline_stats(events, anomalies, START, AS_OF, lag_ms=15).first()
    assert row.database.asDict() == {
        "total_events": 1208,
        "total_anomalies": 8,
        "active_sensors": 8,
    }
    assert row.active_sensors == 8
    pipeline = row.pipeline
    assert (pipeline.events_ingested, pipeline.anomalies_detected) == (1208, 8)
    assert pipeline.events_per_second == 1208 / 120
    assert (pipeline.active_sensors, pipeline.processor_lag_ms) == (0, 15)


def test_snapshot(tables):
    events, anomalies = tables
    frame = snapshot.pipeline_snapshot(events, anomalies, START, AS_OF, tiebreak=TIEBREAK)
    message = json.loads(snapshot.snapshot_json(frame).first()[0])
    assert message["type"] == "pipeline_update"
    data = message["data"]
    assert data["stats"]["events_ingested"] == 1208
    assert [e["sensor_id"] for e in data["events"]] == ["s7", "s6", "s5", "s4", "s3"]
    assert data["events"][0]["tags"] == {"k": "s7"}
    assert data["events"][0]["recorded_at"] == "2024-03-01T12:02:30.000000Z"
    assert [a["sensor_id"] for a in data["anomalies"]] == ["s7", "s6", "s5", "s4", "s3"]
    assert {a["severity"] for a in data["anomalies"]} == {"critical"}
    (window,) = data["windows"]
    assert window["count"] == 31 * 8
    assert window["window_start"] == "2024-03-01T12:02:00.000000Z"
    assert data["ts"] == "2024-03-01T12:02:00.000000Z"


def test_snapshot_of_empty_tables(spark, tables):
    events, anomalies = (t.limit(0) for t in tables)
    frame = snapshot.pipeline_snapshot(events, anomalies, START, AS_OF, tiebreak=TIEBREAK)
    data = frame.first().data
    assert data.stats.events_ingested == 0
    assert data.events == data.anomalies == data.windows == []


def test_alert_lines(tables):
    lines = alert_lines(tables[1])
    assert lines.columns == ["sensor_id", "severity", "z_score"] and lines.count() == 8
