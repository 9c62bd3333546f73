"""Seasonal scores and the exact quantiles below them, against plain Python."""

import datetime as dt
import math
import random

import pytest
from helpers import START, event_frame
from pyspark.sql import functions as F

from gaugeflow.operators import seasonal
from gaugeflow.operators.quantile import group_quantile
from gaugeflow.settings import SkewSettings


def _lower_median(values):
    return sorted(values)[math.ceil(0.5 * len(values)) - 1]


def _rows(days=12, seed=4):
    rng, rows = random.Random(seed), []
    for sensor in ("a", "b", None):
        for hour in range(24 * days):
            at = START + dt.timedelta(hours=hour, minutes=rng.randrange(60))
            usual = 20 + 8 * math.sin(math.tau * at.hour / 24)
            value = usual + (0 if sensor == "b" else rng.gauss(0, 1)) + (50 if rng.random() < 0.02 else 0)
            rows.append((len(rows), sensor, "heat", "lab", value, "", None, at))
    rows.append((len(rows), "a", "heat", "lab", None, "", None, START))
    rows.append((len(rows), "a", "heat", "lab", 3.0, "", None, None))
    return rows


@pytest.mark.parametrize("bracket_rows", [None, 5])
def test_seasonal_scores(spark, bracket_rows):
    rows = _rows()
    groups = {}
    for row in rows:
        if row[4] is not None and row[7] is not None:
            groups.setdefault((row[1], row[7].hour), []).append(row[4])
    expected = {}
    for i, sensor, _, _, value, _, _, at in rows:
        if value is None or at is None:
            continue
        own = groups[sensor, at.hour]
        base = _lower_median(own)
        mad = _lower_median([abs(v - base) for v in own])
        expected[i] = (at.hour, base, value - base, abs(value - base) / (mad * 1.4826 or 1.0))
    events = event_frame(spark, rows)
    scored = seasonal.seasonal_scores(events, bracket_rows=bracket_rows, skew=SkewSettings(max_heavy=50))
    got = {r.event_id: (r.phase, r.baseline, r.residual, r.seasonal_score) for r in scored.collect()}
    assert got == expected
    assert scored.columns == [*events.columns, "phase", "baseline", "residual", "seasonal_score"]
    found = {r.event_id: r.severity for r in seasonal.seasonal_anomalies(events).collect()}
    assert set(found) == {i for i, s in expected.items() if s[3] >= 3.5}
    assert {found[i] for i in found if expected[i][3] >= 5} == {"critical"}


def test_other_seasons(spark):
    week = spark.createDataFrame([(START + dt.timedelta(hours=h),) for h in (0, 1, 168)], "recorded_at timestamp_ntz")
    phases = [r[0] for r in week.select(seasonal.season_phase(168)).collect()]
    assert phases[1] == (phases[0] + 1) % 168 and phases[2] == phases[0]


@pytest.mark.parametrize("share", [0.0, 0.01, 0.5, 0.99, 1.0])
def test_quantiles_near_the_rank_equal_plain_ones(spark, share):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("k"),
        F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 5 == 0, 1.5).otherwise(F.hash("id") / 1e5).alias("x"),
    )
    rows = rows.union(spark.sql("SELECT 9L, CAST(NULL AS DOUBLE) FROM range(50)"))
    near = group_quantile(rows, ["k"], "x", share, bracket_rows=10).collect()
    plain = group_quantile(rows, ["k"], "x", share, skew=None).collect()
    assert sorted(map(repr, near)) == sorted(map(repr, plain)) and len(near) == 5
