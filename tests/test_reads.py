import datetime as dt

import pytest
from helpers import START, event_frame
from pyspark.sql import functions as F

from gaugeflow.operators import reads
from gaugeflow.schemas import EVENT_COLUMNS

MINUTE = dt.timedelta(minutes=1)


@pytest.fixture(scope="module")
def events(spark):
    rows = [
        (
            i,
            f"s{i % 7}",
            ("temperature", "pressure")[i % 2],
            f"zone-{i % 3}",
            float(i),
            "u",
            {"k": str(i)},
            START + dt.timedelta(seconds=i // 2),
        )
        for i in range(1500)
    ]
    return event_frame(spark, rows).repartition(3)


def test_newest_first_with_tiebreak(events):
    rows = reads.recent_events(events, 10, tiebreak=("event_id",)).collect()
    assert [r.event_id for r in rows] == list(range(1499, 1489, -1))
    assert rows[0].asDict().keys() >= set(EVENT_COLUMNS)


@pytest.mark.parametrize("limit,size", [(0, 100), (-5, 100), (1001, 100), (1000, 1000), (1, 1)])
def test_limit_outside_the_range_counts_as_default(events, limit, size):
    assert reads.recent_events(events, limit).count() == size


def test_filters_are_added_only_when_given(events):
    only = reads.events_where
    assert only(events).count() == only(events, "", "").count() == 1500
    assert only(events, "pressure").count() == 750
    assert only(events, location="zone-1").count() == 500
    both = reads.recent_events(events, 1000, "pressure", "zone-1")
    assert both.count() == 250
    assert both.filter("sensor_type <> 'pressure' OR location <> 'zone-1'").isEmpty()


def test_directory_over_everything_and_over_the_newest(spark, events):
    early = event_frame(
        spark, [(9999, "old", "temperature", "attic", 1.0, "u", None, START - 60 * MINUTE)]
    )
    together = events.unionByName(early)
    full = reads.sensor_directory(together, tiebreak=("event_id",)).collect()
    assert {r.sensor_id: r.event_id for r in full} == {
        **{f"s{i % 7}": i for i in range(1493, 1500)},
        "old": 9999,
    }
    recent = reads.sensor_directory(together, 1000, ("event_id",)).collect()
    assert {r.sensor_id for r in recent} == {f"s{i}" for i in range(7)}


def test_active_sensors_bound_is_exclusive(spark):
    as_of = START + 60 * MINUTE
    moments = {
        "exactly": as_of - 5 * MINUTE,
        "inside": as_of - 5 * MINUTE + dt.timedelta(microseconds=1),
        "later": as_of + MINUTE,
        "before": as_of - 6 * MINUTE,
    }
    rows = [(i, s, "t", "l", 1.0, "u", None, at) for i, (s, at) in enumerate(moments.items())]
    events = event_frame(spark, rows + rows)
    assert reads.active_sensors(events, as_of).first()[0] == 2


def _anomalies(spark, n):
    rows = [
        (f"s{i}", "t", "l", 1.0, 0.0, 3.0, ("low", "high")[i % 2], START + dt.timedelta(seconds=i))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "sensor_id string, sensor_type string, location string, value double, expected double, "
        "z_score double, severity string, detected_at timestamp_ntz",
    )


def test_recent_anomalies(spark):
    anomalies = _anomalies(spark, 1200)
    assert reads.recent_anomalies(anomalies).count() == 50
    assert reads.recent_anomalies(anomalies, 0).count() == 1000
    assert reads.recent_anomalies(anomalies, 5000).count() == 1000
    newest = reads.recent_anomalies(anomalies, 2).collect()
    assert [r.sensor_id for r in newest] == ["s1199", "s1198"]
    few = reads.recent_anomalies(_anomalies(spark, 3), 0)
    assert few.count() == 3


def test_counters(spark, events):
    as_of = START + dt.timedelta(seconds=749)
    row = reads.table_counters(events, _anomalies(spark, 12), as_of).first()
    assert row.asDict() == {"total_events": 1500, "total_anomalies": 12, "active_sensors": 7}
    tiers = reads.anomalies_by_severity(_anomalies(spark, 12))
    assert {r.severity: r.anomalies for r in tiers.collect()} == {"low": 6, "high": 6}


def test_throughput(events):
    row = reads.throughput(events, START, START + 10 * MINUTE).first()
    assert (row.events_ingested, row.events_per_second) == (1500, 2.5)
    for as_of in (START, START - MINUTE):
        assert reads.throughput(events, START, as_of).first().events_per_second == 0.0
    live = reads.throughput(events, F.lit(START)).first()
    assert 0 < live.events_per_second < 1
