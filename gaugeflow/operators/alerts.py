"""Which anomalies raise an alert, and which repeat one.

A sensor's first anomaly raises an alert. Another does when all of this holds: the
cooldown of its sensor type has passed since the last alert, and after that alert the sensor
has had a number of normal readings in a row, so that one that flaps stays silent.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.operators.fold import rechunk, run_bounds


@dataclass(frozen=True)
class AlertPolicy:
    """``cooldown`` after an alert, other ones by sensor type, and ``normals`` in a row."""

    # Five minutes, two normal readings.
    cooldown: dt.timedelta = dt.timedelta(minutes=5)
    cooldowns: Mapping[str, dt.timedelta] = field(default_factory=dict)
    normals: int = 2

    def micros(self, sensor_type: str | None) -> int:
        return int(self.cooldowns.get(sensor_type, self.cooldown) / dt.timedelta(microseconds=1))


@dataclass
class AlertState:
    """What is carried from one anomaly of a sensor to the next."""

    last_no: int | None = None
    alerted_at: int | None = None
    armed: bool = True
    repeats: int = 0

    def take(self, number: int, at: int, cooldown: int, normals: int) -> tuple[bool, int]:
        """Whether the anomaly, the sensor's reading ``number``, raises an alert; and how
        many repeats the alert before it or this one has had so far."""
        if self.last_no is not None and number - self.last_no - 1 >= normals:
            self.armed = True
        self.last_no = number
        if self.armed and (self.alerted_at is None or at >= self.alerted_at + cooldown):
            self.alerted_at, self.armed, self.repeats = at, normals == 0, 0
            return True, 0
        self.repeats += 1
        return False, self.repeats


def judge_runs(
    keys: Iterable, lengths: np.ndarray, numbers: list, at: list, cooldowns: list, state_of, normals: int
) -> tuple[list, list]:
    """Alerts and repeats of anomalies that are sorted by sensor and reading."""
    raised, repeats, row = [], [], 0
    for key, length in zip(keys, lengths.tolist()):
        state = state_of(key)
        for i in range(row, row + length):
            alert, count = state.take(numbers[i], at[i], cooldowns[i], normals)
            raised.append(alert)
            repeats.append(count)
        row += length
    return raised, repeats


def judged_alerts(anomalies: DataFrame, policy: AlertPolicy = AlertPolicy()) -> DataFrame:
    """Every anomaly with ``alerted`` and ``repeats`` (since the last alert).

    ``anomalies`` needs ``reading_no``, the sensor's count of readings, which tells how
    many normal ones lie between two anomalies: see ``keep`` of ``merge_detectors``.
    One shuffle of the anomalies by sensor; a task walks them in order with one state in
    hand. Anomalies without a number or time do not count as readings and are left out.
    """
    wire = anomalies.where("reading_no IS NOT NULL AND detected_at IS NOT NULL").withColumn(
        "_at", F.unix_micros(F.col("detected_at").cast("timestamp"))
    )
    schema = T.StructType(
        [*wire.schema.fields, T.StructField("alerted", T.BooleanType()), T.StructField("repeats", T.LongType())]
    )

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_state, begun = None, None, False
        for chunk in rechunk(batches):
            starts, lengths = run_bounds(chunk.column("sensor_id"))
            keys = [chunk.column("sensor_id")[int(i)].as_py() for i in starts]
            states = [AlertState() for _ in keys]
            if begun and keys[0] == open_key:
                states[0] = open_state
            of_key = iter(states)
            cooldowns = [policy.micros(kind) for kind in chunk.column("sensor_type").to_pylist()]
            judged = judge_runs(
                keys, lengths, chunk.column("reading_no").to_pylist(), chunk.column("_at").to_pylist(),
                cooldowns, lambda _: next(of_key), policy.normals,
            )
            open_key, open_state, begun = keys[-1], states[-1], True
            columns = [*chunk.columns, pa.array(judged[0], pa.bool_()), pa.array(judged[1], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*chunk.schema.names, "alerted", "repeats"])

    sorted_rows = wire.repartition("sensor_id").sortWithinPartitions("sensor_id", "reading_no")
    return sorted_rows.mapInArrow(judge, schema).drop("_at")
