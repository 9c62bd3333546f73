import math

import pytest
from helpers import SequentialDetectors, event_frame, event_rows, spiky
from pyspark.sql import functions as F

from gaugeflow import DetectorSettings
from gaugeflow.functions import severity as sv
from gaugeflow.operators import detect
from gaugeflow.plans.inputs import TIEBREAK, readings

LEVEL = 64.0
NUDGE = 1e-9


def _run(spark, detector, series, settings=DetectorSettings()):
    events = event_frame(spark, event_rows(series))
    return detector(events, settings, TIEBREAK).orderBy("event_id").collect()


def _swinging(n):
    """Mean LEVEL and a square distance of one from it after every even number."""
    return [LEVEL + (-1) ** i for i in range(n)]


def _at_z(score, before=60):
    """A swinging series and a reading that scores ``score`` after it.

    With ``before`` readings of square distance one, a reading at distance t has the
    z-score t / sqrt(1 + t^2 / (before + 1)).
    """
    return [*_swinging(before), LEVEL + score / math.sqrt(1 - score * score / (before + 1))]


def _at_deviation(score, before=30, alpha=0.1):
    """A flat series, whose moving variance is what is left of one, and a reading that
    deviates by ``score``."""
    return [*[LEVEL] * before, LEVEL + score * math.sqrt((1 - alpha) ** (before - 1))]


def _tiers_of_last(spark, detector, scores, series_of):
    """The severity of each series' last reading, None where it is silent."""
    series = {f"s{i}": series_of(score) for i, score in enumerate(scores)}
    last = {}
    for r in _run(spark, detector, series):
        if r.value == series[r.sensor_id][-1]:
            last[r.sensor_id] = r.severity
    return [last.get(sensor) for sensor in series]


# The bounds of the tiers; the z-score's count as reached, those of the
# EWMA must be exceeded.
Z_BOUNDS = [(2.0, None, "low"), (3.0, "low", "medium"), (4.0, "medium", "high"), (5.0, "high", "critical")]
EWMA_BOUNDS = [(3.0, None, "low"), (4.0, "low", "medium"), (5.0, "medium", "high"), (7.0, "high", "critical")]


@pytest.mark.parametrize(
    "detector,bounds,series_of",
    [(detect.z_anomalies, Z_BOUNDS, _at_z), (detect.ewma_anomalies, EWMA_BOUNDS, _at_deviation)],
)
def test_tiers_change_at_their_bounds(spark, detector, bounds, series_of):
    scores = [bound * (1 + sign * NUDGE) for bound, _, _ in bounds for sign in (-1, 1)]
    expected = [tier for _, below, above in bounds for tier in (below, above)]
    assert _tiers_of_last(spark, detector, scores, series_of) == expected


def test_a_z_score_at_the_threshold_fires(spark):
    alone = {"s": [*[LEVEL] * 15, LEVEL + 1.0]}  # sqrt(16) after a flat stretch
    for threshold, fires in ((4.0, True), (4.0 + NUDGE, False)):
        found = _run(spark, detect.z_anomalies, alone, DetectorSettings(z_threshold=threshold))
        assert bool(found) == fires


def test_a_deviation_at_the_threshold_is_silent(spark):
    # A moving variance of 2^-24 and a distance of 2^-11: exactly two deviations.
    values = {"s": [*[LEVEL] * 25, LEVEL + 2.0**-11]}
    for threshold, fires in ((2.0, False), (2.0 - NUDGE, True)):
        settings = DetectorSettings(ewma_threshold=threshold, alpha=0.5)
        assert bool(_run(spark, detect.ewma_anomalies, values, settings)) == fires


@pytest.mark.parametrize("detector,first_active", [(detect.z_anomalies, 10), (detect.ewma_anomalies, 20)])
def test_detectors_warm_up(spark, detector, first_active):
    """A jump is silent as the last reading of the warm-up and fires as the next one."""
    series = {f"s{n}": [*_swinging(n - 1), LEVEL + 1e6] for n in (first_active - 1, first_active)}
    found = {r.sensor_id for r in _run(spark, detector, series) if r.value == LEVEL + 1e6}
    assert found == {f"s{first_active}"}


def test_sensors_do_not_affect_each_other(spark):
    series = {"loud": [*_swinging(40), LEVEL + 1e4], "calm": [*_swinging(40), LEVEL]}
    for detector in (detect.z_anomalies, detect.ewma_anomalies, detect.layered_anomalies):
        assert {r.sensor_id for r in _run(spark, detector, series)} == {"loud"}


def test_event_fields_are_copied(spark):
    values = [*_swinging(40), LEVEL + 1e4]
    events = event_frame(spark, event_rows({"s1": values}, sensor_type="flow", location="dock"))
    (found,) = detect.z_anomalies(events, tiebreak=TIEBREAK).collect()
    source = events.filter(f"event_id = {len(values) - 1}").first()
    for name in ("sensor_id", "sensor_type", "location", "value"):
        assert found[name] == source[name]
    assert found.detected_at == source.recorded_at
    assert found.expected == LEVEL


@pytest.mark.parametrize("z_score", [1.9, 2.5, 3.5, 4.5, 6.0])
def test_one_detector_keeps_its_tier_and_both_raise_the_graver(spark, z_score):
    (tier,) = _tiers_of_last(spark, detect.layered_anomalies, [z_score], _at_z)
    alone = _tiers_of_last(spark, detect.z_anomalies, [z_score], _at_z)[0]
    moving = _tiers_of_last(spark, detect.ewma_anomalies, [z_score], _at_z)[0]
    rank = {None: 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
    names = {v: k for k, v in rank.items()}
    both = min(4, max(rank[alone], rank[moving]) + 1) if alone and moving else rank[alone or moving]
    assert tier == names[both]


@pytest.mark.parametrize(
    "settings",
    [
        DetectorSettings(),
        DetectorSettings(z_threshold=1.2, alpha=0.4, ewma_threshold=0.8),
        DetectorSettings(z_threshold=4.5, alpha=0.02, ewma_threshold=6.5),
    ],
)
def test_layered_equals_sequential_model(spark, settings):
    series = {f"s{i}": spiky(120 + 7 * i, seed=i) for i in range(8)}
    model = SequentialDetectors(settings.z_threshold, settings.alpha, settings.ewma_threshold)
    expected, event_id = {}, 0
    for sensor, values in series.items():
        for value in values:
            verdict = model.check(sensor, value)
            if verdict:
                expected[event_id] = verdict
            event_id += 1
    found = _run(spark, detect.layered_anomalies, series, settings)
    assert {r.event_id: (r.expected, r.z_score, r.severity) for r in found} == expected
    assert len(expected) > 10


@pytest.mark.parametrize("sf,counts", [("sf0.01", (503, 242, 515)), ("sf0.1", (5064, 2415, 5163))])
def test_known_counts(spark, sf, counts):
    events = readings(spark, f"/root/testdata/{sf}")
    z = detect.z_anomalies(events, tiebreak=TIEBREAK)
    ewma = detect.ewma_anomalies(events, tiebreak=TIEBREAK)
    layered = detect.layered_anomalies(events, tiebreak=TIEBREAK)
    assert (z.count(), ewma.count(), layered.count()) == counts
    union = z.select("event_id").union(ewma.select("event_id")).distinct()
    assert union.exceptAll(layered.select("event_id")).isEmpty()
    assert union.count() == layered.count()


def test_merged_tier_is_no_lower_than_either(spark, medium):
    events = readings(spark, medium)
    names = ("event_id", "severity")
    merged = detect.layered_anomalies(events, tiebreak=TIEBREAK).select(*names)
    for detector in (detect.z_anomalies, detect.ewma_anomalies):
        single = detector(events, tiebreak=TIEBREAK).select("event_id", F.col("severity").alias("one"))
        lower = merged.join(single, "event_id").filter(
            sv.severity_rank(F.col("severity")) < sv.severity_rank(F.col("one"))
        )
        assert lower.isEmpty()


def test_rows_without_value_are_no_readings(spark):
    rows = event_rows({"s1": [20.0] * 30})
    rows.insert(10, (*rows[10][:4], None, *rows[10][5:]))
    scored = detect.score_readings(event_frame(spark, rows), tiebreak=TIEBREAK)
    assert scored.agg(F.max("reading_no")).first()[0] == 30


def test_settings_are_checked():
    for alpha in (0.0, 1.0, -0.1, 1.5):
        with pytest.raises(ValueError):
            DetectorSettings(alpha=alpha)


def test_severity_functions(spark):
    scores = [2.0, 2.999, 3.0, 3.5, 4.0, 4.0001, 5.0, 5.1, 7.0, 7.1, float("nan")]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select(
        sv.z_severity(F.col("s")), sv.ewma_severity(F.col("s"))
    )
    low, medium, high, critical = sv.TIERS
    assert [tuple(r) for r in rows.collect()] == [
        (low, low),
        (low, low),
        (medium, low),
        (medium, low),
        (high, low),
        (high, medium),
        (critical, medium),
        (critical, high),
        (critical, high),
        (critical, critical),
        (low, low),
    ]
    names = spark.createDataFrame([(n,) for n in [*sv.TIERS, "odd", None]], "n string").select(
        sv.severity_rank(F.col("n")),
        sv.escalate(F.col("n")),
        sv.higher(F.col("n"), F.lit("medium")),
        sv.severity_at(sv.severity_rank(F.col("n"))),
    )
    assert [tuple(r) for r in names.collect()] == [
        (1, "medium", "medium", "low"),
        (2, "high", "medium", "medium"),
        (3, "critical", "high", "high"),
        (4, "critical", "critical", "critical"),
        (0, "odd", "medium", None),
        (0, None, "medium", None),
    ]
