"""Views derived from stored rows, on a few rows each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.codec import decode, split
from gaugeflow.operators import derived, windows
from gaugeflow.schemas import EVENT, EVENT_COLUMNS
from gaugeflow.sources import tables
from gaugeflow.streaming import pipeline

EVENT_DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT.fields)
NOON = dt.datetime(2024, 1, 1, 12)


def _after(minutes):
    return NOON + dt.timedelta(minutes=minutes)


def _anomalies(spark, rows):
    return spark.createDataFrame(rows, "sensor_id string, detected_at timestamp, severity string, id long")


def test_one_alert_per_run(spark):
    rows = [
        ("a", _after(0), "low", 1),
        ("a", _after(60), "critical", 2),  # just within an hour
        ("a", _after(121), "high", 3),
        ("b", _after(5), "medium", 4),
        ("b", _after(5), "low", 5),
    ]
    got = derived.alert_episodes(_anomalies(spark, rows), tiebreak=("id",)).collect()
    told = {(r["sensor_id"], r["detected_at"], r["last_at"], r["anomalies"], r["severity"], r["worst"]) for r in got}
    assert told == {
        ("a", _after(0), _after(60), 2, "low", "critical"),
        ("a", _after(121), _after(121), 1, "high", "high"),
        ("b", _after(5), _after(5), 2, "medium", "medium"),
    }
    assert derived.alert_episodes(_anomalies(spark, [])).count() == 0


def test_alerts_go_where_their_severity_is_routed(spark):
    rows = [("a", NOON, "low", 1), ("a", NOON, "critical", 2), ("a", NOON, "unheard of", 3)]
    got = derived.routed_alerts(_anomalies(spark, rows)).select("id", "channel").collect()
    assert {tuple(r) for r in got} == {(1, "log"), *((2, c) for c in derived.ROUTES["critical"])}


def test_first_of_equal_events_stays(spark):
    rows = [("a", NOON, 2), ("a", NOON, 1), ("a", _after(1), 3), ("b", NOON, 4)]
    events = spark.createDataFrame(rows, "sensor_id string, recorded_at timestamp, id long")
    got = derived.deduplicated_events(events, ("id",))
    assert got.columns == events.columns
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 4]


def test_all_failed_rules_are_named(spark):
    rules = {"positive": F.col("x") > 0, "even": F.col("x") % 2 == 0}
    rows = spark.createDataFrame([(2,), (-3,), (3,), (None,)], "x int")
    got = [r[0] for r in rows.select(derived.failed_rules(rules)).collect()]
    assert got == [[], ["positive", "even"], ["even"], ["positive", "even"]]


def test_only_one_json_object_is_decoded(spark):
    good = '{"id":"1","sensor_id":"a","sensor_type":"t","location":"l","value":1.5,"unit":"u","timestamp":"2024-01-01T12:00:00Z"}'
    texts = {
        good: True,
        f"  {good} \n": True,
        good.replace('"u"', '"} x"'): True,
        good + " junk}": False,
        good + good: False,
        good + "]": False,
        good.replace('"', "'"): False,
        "": False,
    }
    lines = spark.createDataFrame([(t,) for t in texts], "line string")
    readings, rejects = split(decode(lines, "line", keep=("line",)))
    assert {r["line"] for r in readings.select("line").collect()} == {t for t, ok in texts.items() if ok}
    assert rejects.count() == sum(not ok for ok in texts.values())


def test_tables_of_several_versions_are_one(spark):
    old = spark.createDataFrame([("a", "t", "l", 1.0, "u", None, NOON, 7)], f"{EVENT_DDL}, id int")
    new = spark.createDataFrame([("b", 2, NOON, "ok")], "sensor_id string, value int, observed_at timestamp, quality string")
    merged = tables.merged_versions({2: new, 1: old})
    assert merged.columns == [*EVENT_COLUMNS, "id", "schema_version", "quality"]
    rows = {r.sensor_id: r for r in merged.collect()}
    assert (rows["a"].schema_version, rows["a"].id, rows["a"].quality) == (1, 7, None)
    assert (rows["b"].schema_version, rows["b"].value, rows["b"].recorded_at) == (2, 2.0, NOON)
    assert rows["b"].sensor_type is None and rows["b"].quality == "ok"
    with pytest.raises(ValueError):
        tables.merged_versions({})


def test_rollup_keeps_null_types_and_locations(spark):
    rows = [(kind, place, float(i), _after(i)) for i in range(12) for kind in ("t", None) for place in ("l", None)]
    events = spark.createDataFrame(rows, "sensor_type string, location string, value double, recorded_at timestamp")
    got = derived.rollup(windows.window_metrics(events), events, "5 minutes").collect()
    want = windows.window_metrics(events, "5 minutes").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 12
    assert all(r.p99 is not None for r in got)


def test_stored_rejects_are_read_back(spark, tmp_path):
    lines = spark.createDataFrame([("oops", 1), ("{}", 2), ("#{}", 3)], "value string, n int")
    _, rejects = split(decode(lines, keep=("n",)))
    pipeline.store_changes(f"{tmp_path}/{pipeline.REJECTS}", "run")(rejects, 4)
    stored = pipeline.stored_rejects(spark, str(tmp_path), [T.StructField("n", T.IntegerType())])
    assert {(r.raw, r.reject_reason, r.n) for r in stored.collect()} == {
        ("oops", "malformed", 1), ("{}", "missing_field", 2), ("#{}", "malformed", 3)
    }
    assert {tuple(r) for r in derived.reject_depth(stored).collect()} == {("malformed", 2), ("missing_field", 1)}
