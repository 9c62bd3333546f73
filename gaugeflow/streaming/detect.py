"""The detectors on a stream: the states of many sensors in one bucket, kept by the
state store."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gaugeflow.functions.codec import tags_from_json, tags_to_json
from gaugeflow.operators.alerts import AlertPolicy, AlertState, judge_runs
from gaugeflow.operators.detect import fired_mask, merge_detectors
from gaugeflow.operators.fold import SCORE_COLUMNS, STATE_FIELDS, Scores, empty_states, score_runs
from gaugeflow.settings import DetectorSettings

#: Buckets that the sensors are hashed to; part of the state's key, so fixed for the life
#: of a checkpoint. A bucket's states are read and written together, some 80 bytes each.
BUCKETS = 64

_STATE = "sensors array<string>, numbers binary, last_at array<long>, seen_ms array<long>, alerts binary"
_SCORE_TYPES = ("Int64", *["Float64"] * (len(SCORE_COLUMNS) - 1))
_NEVER = np.iinfo(np.int64).min


class _Bucket:
    """States of a bucket's sensors: a row of numbers for each, the newest time scored, when
    the sensor was last heard of, and its last alert."""

    _ALERT = np.dtype([("last_no", np.int64), ("alerted_at", np.int64), ("armed", np.int64), ("repeats", np.int64)])
    _SILENT = (-1, _NEVER, 1, 0)

    def __init__(self, stored: tuple | None):
        sensors, numbers, last_at, seen, alerts = stored or ([], b"", [], [], b"")
        self.sensors = list(sensors)
        self.numbers = np.frombuffer(numbers).reshape(-1, len(STATE_FIELDS)).copy()
        self.last_at, self.seen = np.array(last_at, np.int64), np.array(seen, np.int64)
        self.alerts = np.frombuffer(alerts, self._ALERT).copy()

    def forget(self, before_ms: int) -> None:
        kept = self.seen > before_ms
        if not kept.all():
            self.sensors = [s for s, stays in zip(self.sensors, kept) if stays]
            self.numbers, self.last_at, self.seen, self.alerts = (
                x[kept] for x in (self.numbers, self.last_at, self.seen, self.alerts)
            )

    def places(self, sensors: Sequence) -> np.ndarray:
        """Rows of the given sensors; new ones are added."""
        place = {s: i for i, s in enumerate(self.sensors)}
        new = [s for s in sensors if s not in place]
        place |= {s: len(self.sensors) + i for i, s in enumerate(new)}
        self.sensors += new
        self.numbers = np.concatenate([self.numbers, empty_states(len(new))])
        self.last_at = np.concatenate([self.last_at, np.full(len(new), _NEVER)])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.alerts = np.concatenate([self.alerts, np.array([self._SILENT] * len(new), self._ALERT)])
        return np.array([place[s] for s in sensors], np.int64)

    def alert_state(self, place: int) -> AlertState:
        last_no, alerted_at, armed, repeats = self.alerts[place].tolist()
        return AlertState(
            None if last_no < 0 else last_no, None if alerted_at == _NEVER else alerted_at, bool(armed), repeats
        )

    def keep_alert(self, place: int, s: AlertState) -> None:
        self.alerts[place] = (s.last_no, _NEVER if s.alerted_at is None else s.alerted_at, s.armed, s.repeats)

    def stored(self) -> tuple:
        return self.sensors, self.numbers.tobytes(), self.last_at.tolist(), self.seen.tolist(), self.alerts.tobytes()


def _judged(bucket: _Bucket, policy: AlertPolicy, place: np.ndarray, number, at, kinds) -> tuple[list, list]:
    """Alerts and repeats of a bucket's anomalies, sorted by sensor and reading."""
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    own = place[starts].tolist()
    states = {p: bucket.alert_state(p) for p in own}
    cooldowns = [policy.micros(None if pd.isna(kind) else kind) for kind in kinds]
    lengths = np.diff(np.append(starts, len(place)))
    judged = judge_runs(own, lengths, number.tolist(), at.tolist(), cooldowns, states.get, policy.normals)
    for p, state in states.items():
        bucket.keep_alert(p, state)
    return judged


def _score_bucket(
    rows: pd.DataFrame, bucket: _Bucket, settings: DetectorSettings, order: list[str], policy: AlertPolicy | None, now: int
) -> pd.DataFrame:
    """The rows of all sensors of a bucket, sorted by sensor and time, with their scores."""
    codes, sensors = pd.factorize(rows["sensor_id"], use_na_sentinel=False)
    sensors = [None if pd.isna(s) else s for s in sensors]
    rows = rows.assign(_code=codes).sort_values(["_code", *order], kind="stable", ignore_index=True)
    codes, at = rows["_code"].to_numpy(), rows["_at"].to_numpy()
    place = bucket.places(sensors)
    out_of_order = at < bucket.last_at[place][codes]

    # A reading without a value keeps its row, without scores.
    there = np.flatnonzero(rows["value"].notna().to_numpy())
    own = codes[there]
    starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    at_place = place[own[starts]]
    values = rows["value"].to_numpy(np.float64)[there]
    if len(there):
        lengths = np.diff(np.append(starts, len(own)))
        scored, bucket.numbers[at_place] = score_runs(values, starts, lengths, bucket.numbers[at_place], settings.alpha)
    else:
        scored = Scores(*[np.zeros(0)] * len(SCORE_COLUMNS))
    new = {name: (there, column, kind) for name, kind, column in zip(SCORE_COLUMNS, _SCORE_TYPES, scored)}
    if policy:
        fired = np.flatnonzero(fired_mask(settings, z=True, ewma=True)(scored))
        odd = there[fired]
        kinds = rows["sensor_type"].to_numpy()[odd]
        raised, repeats = _judged(bucket, policy, place[codes[odd]], scored.reading_no[fired], at[odd], kinds) if len(odd) else ([], [])
        new |= {"alerted": (odd, raised, "boolean"), "repeats": (odd, repeats, "Int64")}
    np.maximum.at(bucket.last_at, place[codes], at)
    bucket.seen[place] = now
    columns = {
        name: pd.Series(pd.array(column, dtype=kind), index=index).reindex(rows.index)
        for name, (index, column, kind) in new.items()
    }
    return rows.drop(columns="_code").assign(**columns, out_of_order=out_of_order)


def _stepper(settings: DetectorSettings, order: list[str], ttl_ms: int | None, policy: AlertPolicy | None):
    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bucket = _Bucket(state.get if state.exists else None)
        now = state.getCurrentProcessingTimeMs() if ttl_ms is not None else 0
        if ttl_ms is not None:
            bucket.forget(now - ttl_ms)
        if not state.hasTimedOut:
            # A bucket's share of one micro-batch, bounded by the source's trigger cap.
            rows = pd.concat(list(frames), ignore_index=True).drop(columns="_bucket")
            yield _score_bucket(rows, bucket, settings, order, policy, now)
        if not bucket.sensors:
            state.remove()
            return
        state.update(bucket.stored())
        if ttl_ms is not None:
            state.setTimeoutDuration(max(1, int(bucket.seen.min()) + ttl_ms - now + 1))

    return step


def score_stream(
    events: DataFrame,
    settings: DetectorSettings = DetectorSettings(),
    tiebreak: Sequence[str] = (),
    state_ttl_ms: int | None = None,
    buckets: int = BUCKETS,
    policy: AlertPolicy | None = None,
) -> DataFrame:
    """Every event with the scores of both detectors, in append mode.

    The readings of one sensor in one micro-batch are scored in time order. A
    reading older than one scored in an earlier micro-batch is scored when it
    arrives and marked ``out_of_order``. The columns equal those of the batch
    operator, plus the event's unit and tags. ``state_ttl_ms`` forgets sensors
    that stay silent that long; by default none is forgotten. Expiry needs a trigger
    that keeps ticking, not ``availableNow``, which would wait for it for ever.

    Sensors are hashed to ``buckets``, and one call scores all readings that a bucket
    has in a micro-batch. Take so many that a bucket holds some thousand sensors; a
    checkpoint keeps the number it began with.

    With ``policy``, anomalous readings also have ``alerted`` and ``repeats``, as
    :func:`gaugeflow.operators.alerts.judged_alerts` gives them; both are null for others.
    """
    # Times travel as microseconds and tags as text: plain columns for pandas.
    wire = events.select(
        "sensor_id",
        "sensor_type",
        "location",
        "value",
        "unit",
        tags_to_json(F.col("tags")).alias("_tags"),
        F.unix_micros("recorded_at").alias("_at"),
        *tiebreak,
    )
    schema = T.StructType(
        [
            *wire.schema.fields,
            T.StructField(SCORE_COLUMNS[0], T.LongType()),
            *[T.StructField(name, T.DoubleType()) for name in SCORE_COLUMNS[1:]],
            *([T.StructField("alerted", T.BooleanType()), T.StructField("repeats", T.LongType())] if policy else []),
            T.StructField("out_of_order", T.BooleanType()),
        ]
    )
    timeout = (
        GroupStateTimeout.NoTimeout
        if state_ttl_ms is None
        else GroupStateTimeout.ProcessingTimeTimeout
    )
    bucketed = wire.withColumn("_bucket", F.pmod(F.xxhash64("sensor_id"), F.lit(buckets)))
    scored = bucketed.groupBy("_bucket").applyInPandasWithState(
        _stepper(settings, ["_at", *tiebreak, "value"], state_ttl_ms, policy),
        schema,
        _STATE,
        "append",
        timeout,
    )
    return scored.select(
        "sensor_id",
        "sensor_type",
        "location",
        "value",
        "unit",
        tags_from_json(F.col("_tags")).alias("tags"),
        F.timestamp_micros("_at").alias("recorded_at"),
        *tiebreak,
        *SCORE_COLUMNS,
        *(("alerted", "repeats") if policy else ()),
        "out_of_order",
    )


def anomaly_stream(
    events: DataFrame,
    settings: DetectorSettings = DetectorSettings(),
    tiebreak: Sequence[str] = (),
    state_ttl_ms: int | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Layered anomalies of a stream."""
    scored = score_stream(events, settings, tiebreak, state_ttl_ms, buckets)
    return merge_detectors(scored, settings, tiebreak)


def deduplicated_stream(
    events: DataFrame, within: str = "60 minutes", keys: Sequence[str] = ("sensor_id", "recorded_at")
) -> DataFrame:
    """The first event to arrive of each sensor and time.

    Repeats are recognised as long as they come before the newest event is ``within``
    ahead of them; the keys seen are state until then, and an event that comes later
    than that is dropped, since it could be a repeat.
    :func:`gaugeflow.operators.derived.deduplicated_events` does the same to a stored
    table without a limit.
    """
    return events.withWatermark("recorded_at", within).dropDuplicatesWithinWatermark(list(keys))


def alert_lines(anomalies: DataFrame) -> DataFrame:
    """What an alert says: sensor, severity, score."""
    return anomalies.select("sensor_id", "severity", "z_score")
