"""Hand-made inputs and a sequential model of the detectors."""

from __future__ import annotations

import datetime as dt
import math
import random
from fractions import Fraction

START = dt.datetime(2024, 3, 1, 12, 0, 0)


class SequentialDetectors:
    """One reading at a time, as plainly as the rules can be written."""

    def __init__(self, z_threshold=2.0, alpha=0.1, ewma_threshold=3.0):
        self.z_threshold, self.alpha, self.ewma_threshold = z_threshold, alpha, ewma_threshold
        self.z_state, self.ewma_state = {}, {}

    def z(self, sensor, x):
        """In rationals; mean and variance are rounded once each."""
        count, total, squares = self.z_state.get(sensor, (0, Fraction(0), Fraction(0)))
        expected = float(total / count) if count else 0.0
        count, total, squares = count + 1, total + Fraction(x), squares + Fraction(x) ** 2
        self.z_state[sensor] = (count, total, squares)
        scatter = squares - total * total / count
        sd = 1.0 if count < 2 or scatter == 0 else math.sqrt(float(scatter / (count - 1)))
        return count, expected, abs(x - expected) / sd

    def ewma(self, sensor, x):
        count, mean, var = self.ewma_state.get(sensor, (0, 0.0, 0.0))
        expected, sd = mean, 1.0 if var <= 0 else math.sqrt(var)
        if count == 0:
            mean, var = x, 1.0
        else:
            diff = x - mean
            mean += self.alpha * diff
            var = (1 - self.alpha) * (var + self.alpha * diff * diff)
        self.ewma_state[sensor] = (count + 1, mean, var)
        return count + 1, expected, abs(x - expected) / sd

    def check(self, sensor, x):
        """(expected, score, severity) of an anomaly, or None."""
        names = ["low", "medium", "high", "critical"]
        n, z_expected, z = self.z(sensor, x)
        _, e_expected, dev = self.ewma(sensor, x)
        z_tier = e_tier = None
        if n >= 10 and z >= self.z_threshold:
            z_tier = sum(z >= bound for bound in (3, 4, 5))
        if n >= 20 and dev > self.ewma_threshold:
            e_tier = sum(dev > bound for bound in (4, 5, 7))
        if z_tier is None and e_tier is None:
            return None
        if e_tier is None:
            return z_expected, z, names[z_tier]
        if z_tier is None:
            return e_expected, dev, names[e_tier]
        return z_expected, z, names[min(max(z_tier, e_tier) + 1, 3)]


def sequential_scores(series):
    """Score rows (reading_no, expected, z, ewma expected, deviation) of one series."""
    model = SequentialDetectors()
    rows = []
    for x in series:
        n, expected, z = model.z("s", x)
        _, base, dev = model.ewma("s", x)
        rows.append((n, expected, z, base, dev))
    return rows


EVENT_DDL = (
    "event_id long, sensor_id string, sensor_type string, location string, value double, "
    "unit string, tags map<string,string>, recorded_at timestamp_ntz"
)


def event_rows(series_by_sensor, sensor_type="temperature", location="lab", step_ms=1000):
    """Rows of several series, one reading per step and sensor."""
    rows = []
    for sensor, series in series_by_sensor.items():
        for i, value in enumerate(series):
            at = START + dt.timedelta(milliseconds=step_ms * i)
            rows.append((len(rows), sensor, sensor_type, location, float(value), "u", None, at))
    return rows


def event_frame(spark, rows):
    return spark.createDataFrame(rows, EVENT_DDL)


def wavy(n, level=22.0, amplitude=0.05):
    return [level + (i % 3) * amplitude for i in range(n)]


def spiky(n, seed=7, share=0.05):
    rng = random.Random(seed)
    return [
        rng.gauss(50, 4) * (rng.choice((3, 10)) if rng.random() < share else 1) for _ in range(n)
    ]
