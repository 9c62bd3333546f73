"""Heavy keys: sliced results must equal those of the plain route."""

import datetime as dt
import math

import numpy as np
import pytest
from helpers import START, event_frame, event_rows, sequential_scores, spiky
from pyspark.sql import functions as F

from gaugeflow.operators import detect, windows
from gaugeflow.operators.fold import SCORE_COLUMNS, advance, empty_states
from gaugeflow.operators.skew import SLICE, find_heavy, sorted_slices
from gaugeflow.operators.slices import repeat_value
from gaugeflow.settings import DetectorSettings, SkewSettings

TIGHT = SkewSettings(heavy_rows=100, slice_rows=150, max_heavy=1000)


def _find(df, skew):
    return find_heavy(df, ["sensor_id"], skew, skew.sensor_limit if skew else int)


def _mixed_series():
    return {
        "varied": spiky(2500),
        "flat": [0.1] * 1500,
        "shift_then_flat": spiky(300, seed=5) + [123.456] * 1700,
        "two_levels": [22.0 + 0.1 * (i % 2) for i in range(900)],
        "steps": [float(i // 211) for i in range(1300)],
        **{f"light-{i}": spiky(30 + i, seed=i) for i in range(20)},
    }


@pytest.fixture(scope="module")
def series():
    return _mixed_series()


@pytest.fixture(scope="module")
def events(spark, series):
    return event_frame(spark, event_rows(series)).repartition(5)


def test_heavy_keys_are_found_and_split(events):
    heavy = _find(events, TIGHT)
    assert {r[0] for r in heavy.frame.collect()} == {
        "varied",
        "flat",
        "shift_then_flat",
        "two_levels",
        "steps",
    }
    light, hot = heavy.split(events)
    assert light.count() + hot.count() == events.count()
    assert hot.count() == heavy.rows == 8200


def test_no_heavy_key_means_no_second_count(events):
    assert _find(events, SkewSettings()) is None
    assert _find(events, None) is None


def test_null_keys_are_kept(spark):
    rows = event_rows({None: spiky(300), "a": spiky(40), "b": spiky(250)})
    events = event_frame(spark, rows)
    scored = detect.score_readings(events, tiebreak=("event_id",), skew=TIGHT)
    assert scored.count() == 590
    assert scored.filter("sensor_id IS NULL").agg(F.max("reading_no")).first()[0] == 300


def test_slices_cut_inside_a_series_and_inside_copies(spark):
    copies = [(1, "s", "t", "l", 5.0, "u", None, START)] * 1000
    sliced = sorted_slices(
        event_frame(spark, copies).repartition(4),
        ["sensor_id", "recorded_at", "event_id", "value"],
        1000,
        SkewSettings(heavy_rows=10, slice_rows=100),
    )
    sizes = [r["count"] for r in sliced.groupBy(SLICE).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) < 400


def _pairs(events, alpha, skew):
    settings = DetectorSettings(alpha=alpha)
    columns = ["event_id", "sensor_id", *SCORE_COLUMNS]
    sliced = detect.score_readings(events, settings, ("event_id",), skew)
    plain = detect.score_readings(events, settings, ("event_id",), None)
    left, right = sorted(sliced.select(columns).collect()), sorted(plain.select(columns).collect())
    assert len(left) == len(right) == events.count()
    for a, b in zip(left, right):
        assert a[:3] == b[:3]
        assert (a.expected, a.z_score) == (b.expected, b.z_score)
    return zip(left, right)


@pytest.mark.parametrize("alpha", [0.1, 0.001])
def test_sliced_scores_where_a_slice_does_not_forget(events, alpha):
    """Slices of 150 readings: the state still depends on where a slice started, and more
    slices than there are exact rounds follow each other."""
    for a, b in _pairs(events, alpha, TIGHT):
        assert math.isclose(a.ewma_expected, b.ewma_expected, rel_tol=1e-10)
        assert math.isclose(a.ewma_deviation, b.ewma_deviation, rel_tol=1e-8, abs_tol=1e-9)


def test_sliced_scores_where_a_slice_forgets(events):
    """Slices of 600: all is the same to the last bit, flat stretches included."""
    for a, b in _pairs(events, 0.1, SkewSettings(heavy_rows=100, slice_rows=600, max_heavy=1000)):
        assert (a.ewma_expected, a.ewma_deviation) == (b.ewma_expected, b.ewma_deviation)


def test_plain_route_equals_the_sequential_model(events, series):
    plain = detect.score_readings(events, tiebreak=("event_id",), skew=None)
    got = {}
    for row in plain.orderBy("sensor_id", "reading_no").collect():
        got.setdefault(row.sensor_id, []).append(tuple(row[c] for c in SCORE_COLUMNS))
    assert got == {name: sequential_scores(values) for name, values in series.items()}


def test_sliced_anomalies_equal_plain_anomalies(events):
    for detector in (detect.z_anomalies, detect.ewma_anomalies, detect.layered_anomalies):
        sliced = detector(events, tiebreak=("event_id",), skew=TIGHT)
        plain = detector(events, tiebreak=("event_id",), skew=None)
        key = ["event_id", "sensor_id", "severity"]
        assert sorted(sliced.select(key).collect()) == sorted(plain.select(key).collect())


@pytest.mark.parametrize("alpha", [0.01, 0.1, 0.5])
def test_repeating_a_value_matches_walking_it(alpha):
    state = advance(np.array(spiky(100)), empty_states(1)[0], alpha)
    walked = advance(np.full(30_000, 7.3), state, alpha)
    jumped = repeat_value(7.3, 30_000, state, alpha)
    assert jumped[6:].tolist() == walked[6:].tolist()


def _window_rows(spark):
    rows = []
    for i in range(3000):  # one hot minute, many ties
        rows.append((i, "s", "temperature", "lab", float((i * 7919) % 1000), "", None, START))
    for i in range(500):  # one hot minute of copies
        rows.append((i, "s", "humidity", "lab", 3.25, "", None, START))
    for i in range(400):
        at = START + dt.timedelta(seconds=i * 20)
        rows.append((i, "s", "pressure", f"zone-{i % 3}", float(i % 17), "", None, at))
    for i in range(150):  # NULL keys
        rows.append((i, "s", None, "lab", i / 7, "", None, START))
    return event_frame(spark, rows).repartition(6)


# Some groups heavy; all groups heavy; more heavy groups than are kept in a list.
@pytest.mark.parametrize("limit,max_heavy", [(100, 1000), (1, 1000), (1, 5)])
def test_heavy_windows_equal_plain_windows(spark, limit, max_heavy):
    events = _window_rows(spark)
    skew = SkewSettings(max_heavy=max_heavy)
    sliced = windows.window_metrics(events, skew=skew, bracket_rows=limit)
    plain = windows.window_metrics(events, skew=None)
    assert sliced.columns == plain.columns
    key = lambda r: (str(r.sensor_type), r.location, r.window_start)
    left, right = sorted(sliced.collect(), key=key), sorted(plain.collect(), key=key)
    for a, b in zip(left, right, strict=True):
        for name in a.asDict():
            close = name in ("sum", "avg")
            assert math.isclose(a[name], b[name], rel_tol=1e-13) if close else a[name] == b[name]
    assert max(r["count"] for r in left) == 3000


def test_large_windows_are_ranked_near_the_rank_only(spark):
    """More values than the sketch keeps, many of them equal, some null or not a number."""
    n = 400_000
    value = F.when(F.col("id") % 7 == 0, F.lit(3.5)).otherwise(F.hash("id") / 1e6)
    value = F.when(F.col("id") % 1000 == 1, None).when(F.col("id") % 5000 == 2, float("nan")).otherwise(value)
    events = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("a")).alias("sensor_type"),
        F.lit("lab").alias("location"),
        value.alias("value"),
        F.lit(START).cast("timestamp_ntz").alias("recorded_at"),
    )
    got = windows.window_metrics(events, bracket_rows=1000).collect()
    want = windows.window_metrics(events, skew=None).collect()
    key = lambda r: str(r.sensor_type)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert (a["count"], a["min"], a["p99"]) == (b["count"], b["min"], b["p99"])
        assert math.isnan(a["max"]) and math.isnan(b["max"])
