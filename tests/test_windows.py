import datetime as dt
import math

import pytest
from helpers import START, event_frame
from pyspark.sql import functions as F

from gaugeflow.operators import windows
from gaugeflow.plans.inputs import readings

AS_OF = dt.datetime(2024, 3, 1, 12, 30, 20)


def _row(value, at, sensor_type="temperature", location="lab"):
    return (0, "s1", sensor_type, location, float(value), "u", None, at)


def _metrics(spark, rows, **options):
    return windows.window_metrics(event_frame(spark, rows), **options).collect()


def test_no_events_no_windows(spark):
    assert _metrics(spark, []) == []


def test_one_window(spark):
    (m,) = _metrics(spark, [_row(v, START) for v in (20, 30, 25)])
    assert (m["count"], m.min, m.max, m.avg, m.sum, m.p99) == (3, 20.0, 30.0, 25.0, 75.0, 30.0)
    assert m.window_start == START
    assert m.window_end - m.window_start == dt.timedelta(minutes=1)


@pytest.mark.parametrize("n", [1, 2, 50, 99, 100, 101, 199, 200, 201, 700, 1000])
def test_p99_is_nearest_rank(spark, n):
    (m,) = _metrics(spark, [_row(v, START) for v in range(1, n + 1)])
    assert m.p99 == max(1, math.ceil(n * 0.99))


def test_one_window_per_key(spark):
    rows = [
        _row(20, START, "temperature", "floor-1"),
        _row(21, START, "temperature", "floor-2"),
        _row(1000, START, "pressure", "lab"),
        _row(1001, START, "pressure", "lab"),
    ]
    found = _metrics(spark, rows)
    assert len(found) == 3
    assert sorted(m["count"] for m in found) == [1, 1, 2]


def test_single_value(spark):
    (m,) = _metrics(spark, [_row(1010, START, "pressure", "roof")])
    assert m.min == m.max == m.avg == m.p99 == 1010.0


def test_bucket_edges(spark):
    edge = dt.timedelta(microseconds=1)
    minute = dt.timedelta(minutes=1)
    found = _metrics(spark, [_row(1, START + minute - edge), _row(2, START + minute)])
    assert sorted(m.window_start for m in found) == [START, START + minute]


def test_completed_in_progress_and_retained(spark):
    minute = dt.timedelta(minutes=1)
    moments = [
        AS_OF - 5 * 60 * minute,
        AS_OF - 60 * minute,
        AS_OF - 2 * minute,
        AS_OF.replace(second=0),
        AS_OF,
        AS_OF + 3 * minute,
    ]
    events = event_frame(spark, [_row(i, at) for i, at in enumerate(moments)])
    metrics = windows.window_metrics(events)
    starts = lambda df: sorted(r.window_start for r in df.collect())
    now = AS_OF.replace(second=0)
    assert starts(windows.in_progress(metrics, AS_OF)) == [now, now + 3 * minute]
    assert starts(windows.current_window_metrics(events, AS_OF)) == [now, now + 3 * minute]
    assert starts(windows.completed(metrics, AS_OF)) == [
        now - 300 * minute,
        now - 60 * minute,
        now - 2 * minute,
    ]
    assert starts(windows.retained(metrics, AS_OF)) == [
        now - 60 * minute,
        now - 2 * minute,
        now,
        now + 3 * minute,
    ]
    for view, from_events in (
        (windows.completed, windows.completed_window_metrics),
        (windows.retained, windows.retained_window_metrics),
    ):
        assert starts(view(metrics, AS_OF)) == starts(from_events(events, AS_OF))
        wide = windows.window_metrics(events, "1 hour")
        assert starts(view(wide, AS_OF)) == starts(from_events(events, AS_OF, width="1 hour"))
    as_column = windows.in_progress(metrics, F.lit(AS_OF))
    assert starts(as_column) == [now, now + 3 * minute]


def test_wall_clock_is_the_default(spark):
    events = event_frame(spark, [_row(1, START)])
    metrics = windows.window_metrics(events)
    assert windows.in_progress(metrics).count() == 0
    assert windows.completed(metrics).count() == 1


def test_properties_on_the_event_table(spark, medium):
    metrics = windows.window_metrics(readings(spark, medium), "1 day")
    broken = metrics.filter(
        (F.col("min") > F.col("p99"))
        | (F.col("p99") > F.col("max"))
        | (F.col("min") > F.col("avg") + 1e-9)
        | (F.col("avg") > F.col("max") + 1e-9)
        | (F.abs(F.col("sum") - F.col("avg") * F.col("count")) > 1e-6)
    )
    assert broken.isEmpty()
    assert metrics.agg(F.sum("count")).first()[0] == 10_000


def test_approximate_p99_is_close(spark):
    rows = [_row(v, START) for v in range(1, 2001)]
    (m,) = _metrics(spark, rows, approx=True)
    assert abs(m.p99 - 1980) <= 1


def test_newest_windows_and_interval_counts(spark):
    minute = dt.timedelta(minutes=1)
    rows = [_row(i, START + (i // 2) * minute, location=f"zone-{i % 2}") for i in range(40)]
    events = event_frame(spark, rows)
    newest = windows.newest_windows(windows.window_metrics(events)).collect()
    assert len(newest) == 8
    assert newest[0].window_start == START + 19 * minute
    assert [newest[0].location, newest[1].location] == ["zone-0", "zone-1"]
    counts = windows.events_per_interval(events, points=5).collect()
    assert [(r.window_start, r.events) for r in counts] == [
        (START + (19 - i) * minute, 2) for i in range(5)
    ]
