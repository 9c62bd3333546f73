"""Alert suppression, in batch and on streams, and what is sent of an alert."""

import datetime as dt
import json
import random

import pytest
from helpers import START, event_frame, spiky
from pyspark.sql import functions as F

from gaugeflow.operators import alerts, derived, detect
from gaugeflow.sources.streams import parquet_stream
from gaugeflow.streaming import pipeline
from gaugeflow.streaming.detect import score_stream

POLICY = alerts.AlertPolicy(cooldowns={"slow": dt.timedelta(minutes=20), "none": dt.timedelta(0)})
SCHEMA = "sensor_id string, sensor_type string, reading_no long, detected_at timestamp, size string"


def _judge(rows, policy):
    """The rules, one reading after the other: normal readings are walked as well."""
    out, state = {}, {}
    for sensor, kind, number, at in sorted(rows, key=lambda r: (repr(r[0]), r[2])):
        last, alerted_at, armed, repeats = state.get(sensor, (0, None, True, 0))
        in_a_row = 0
        for _ in range(last + 1, number):
            in_a_row += 1
            armed = armed or in_a_row >= policy.normals
        wait = policy.cooldowns.get(kind, policy.cooldown)
        raises = armed and (alerted_at is None or at >= alerted_at + wait)
        alerted_at, armed, repeats = (at, policy.normals == 0, 0) if raises else (alerted_at, armed, repeats + 1)
        state[sensor] = (number, alerted_at, armed, repeats)
        out[sensor, number] = (raises, repeats)
    return out


def _anomalies(seed, sensors=9):
    rng, rows = random.Random(seed), []
    for s in range(sensors):
        number, at = 0, START
        for _ in range(rng.randrange(1, 60)):
            number += rng.choice([1, 1, 2, 3, 4, 9])
            at += dt.timedelta(seconds=rng.choice([1, 60, 299, 300, 301, 900]))
            rows.append((f"s{s}" if s else None, ["fast", "slow", "none", None][s % 4], number, at))
    return rows


@pytest.mark.parametrize("normals", [0, 1, 2, 5])
def test_alerts_follow_the_rules(spark, normals):
    policy = alerts.AlertPolicy(cooldowns=POLICY.cooldowns, normals=normals)
    rows = _anomalies(seed=normals)
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    judged = alerts.judged_alerts(frame, policy)
    assert judged.columns == [*frame.columns, "alerted", "repeats"]
    got = {(r.sensor_id, r.reading_no): (r.alerted, r.repeats) for r in judged.collect()}
    assert got == _judge(rows, policy)


def test_state_goes_on_in_the_next_chunk(spark, monkeypatch):
    rows = _anomalies(seed=3, sensors=3)
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        monkeypatch.setattr("gaugeflow.operators.fold.CHUNK_ROWS", 1)
        got = {(r.sensor_id, r.reading_no): (r.alerted, r.repeats) for r in alerts.judged_alerts(frame, POLICY).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == _judge(rows, POLICY)
    assert alerts.judged_alerts(frame.limit(0), POLICY).isEmpty()


def test_the_first_anomaly_alerts_and_a_flapping_sensor_is_silent(spark):
    minutes = [(1, 0), (3, 10), (5, 20), (8, 21), (9, 60)]  # one normal, one, two, none between
    rows = [("s", "fast", n, START + dt.timedelta(minutes=m), "") for n, m in minutes]
    judged = alerts.judged_alerts(spark.createDataFrame(rows, SCHEMA)).orderBy("reading_no").collect()
    assert [(r.alerted, r.repeats) for r in judged] == [(True, 0), (False, 1), (False, 2), (True, 0), (False, 1)]


def _zoned(spark, series):
    rows = [
        (i * 100 + s, f"s{s}" if s else None, ["fast", "slow"][s % 2], "lab", x, "u", None, START + dt.timedelta(minutes=2 * i))
        for s, values in enumerate(series)
        for i, x in enumerate(values)
    ]
    return event_frame(spark, rows).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))


def test_stream_alerts_equal_batch_across_a_restart(spark, tmp_path):
    events = _zoned(spark, [spiky(120, seed=s, share=0.2) for s in range(6)])
    folder, base = str(tmp_path / "in"), str(tmp_path / "base")
    cut = [START + dt.timedelta(minutes=m) for m in (0, 50, 100, 150, 200, 999)]
    for part, (low, high) in enumerate(zip(cut, cut[1:])):
        own = events.where((F.col("recorded_at") >= F.lit(low)) & (F.col("recorded_at") < F.lit(high)))
        own.coalesce(1).write.mode("append").parquet(folder)
        if part in (1, 4):  # the second run goes on from the checkpoint
            stream = parquet_stream(spark, events.schema, folder, max_files=1)
            scored = score_stream(stream, tiebreak=("event_id",), policy=POLICY, buckets=3)
            options = pipeline.PipelineOptions(base, base + "/ck", tiebreak=("event_id",))
            judged = detect.merge_detectors(scored, keep=("event_id", "reading_no", "alerted", "repeats"))
            writer = judged.writeStream.option("checkpointLocation", options.checkpoint("a")).trigger(availableNow=True)
            writer.foreachBatch(pipeline.store_changes(f"{base}/judged", "r")).start().awaitTermination()
    columns = ("event_id", "reading_no", "alerted", "repeats")
    got = sorted(spark.read.parquet(f"{base}/judged").select(*columns).collect())
    scores = detect.score_readings(events, tiebreak=("event_id",))
    batch = alerts.judged_alerts(detect.merge_detectors(scores, keep=("event_id", "reading_no")), POLICY)
    assert got == sorted(batch.select(*columns).collect())
    assert {r.alerted for r in got} == {True, False}


def test_alerts_are_stored_by_channel_once(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 12)
    rows = [("a", "t", "l", 9.5, 1.0, 4.0, "low", at, True), ("b", "t", "l", 9.0, 1.0, 8.0, "critical", at, True),
            ("c", "t", "l", 9.0, 1.0, 8.0, "critical", at, False)]
    schema = "sensor_id string, sensor_type string, location string, value double, expected double, z_score double, severity string, detected_at timestamp, alerted boolean"
    frame = spark.createDataFrame(rows, schema)
    write = pipeline.store_alerts(str(tmp_path), "run", link="https://board/")
    for _ in range(2):  # the second time as a retry
        write(frame, 0)
    write(frame.limit(0), 1)
    found = [(r.channel, json.loads(r.payload)) for r in pipeline.stored_alerts(spark, str(tmp_path)).collect()]
    assert sorted((c, p["sensor_id"]) for c, p in found) == sorted([("log", "a"), *((c, "b") for c in derived.ROUTES["critical"])])
    assert found[0][1].keys() == {"sensor_id", "severity", "value", "expected", "z_score", "timestamp", "link"}
    assert {p["link"] for _, p in found} == {"https://board/a", "https://board/b"}
