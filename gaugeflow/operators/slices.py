"""Scoring heavy sensors: carrying the state across slices of one series.

A heavy sensor's series lies in several consecutive slices (see
:mod:`gaugeflow.operators.skew`). Each slice needs the state its first series
starts in:

* The sums of two adjacent stretches combine by formula, with so much precision that
  the scores are those of one pass; so one pass over all slices in parallel is enough.
* The exponentially weighted part forgets: after one slice its state hardly ever
  depends on where it started. So each slice is first folded from scratch, then again
  from the end of its predecessor, until every slice has met the exact state it starts
  in. Every round settles at least one more slice of each series, normally all of them
  in the first; slices holding a single constant value, where forgetting can stall, are
  advanced arithmetically without reading them. Series that forget too slowly for
  ``EXACT_ROUNDS`` rounds are held to ``_TOLERANCE`` from then on.

What passes through the driver is two states per slice, and the number of slices
is bounded by ``SkewSettings.max_slices``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.operators.fold import STATE_FIELDS, advance, combine, empty_states, rechunk, run_bounds, walk
from gaugeflow.operators.skew import SLICE

_NUMBERS = (*STATE_FIELDS, "low", "high")
EDGE_SCHEMA = f"{SLICE} int, opens boolean, closes boolean, sensor_id string, " + ", ".join(
    f"{name} double" for name in _NUMBERS
)
EXACT_ROUNDS = 8
_TOLERANCE = 1e-12
_MEAN, _VAR = STATE_FIELDS.index("ewma_mean"), STATE_FIELDS.index("ewma_var")


@dataclass
class Edge:
    """One series stretch that touches the start or the end of a slice."""

    slice_no: int
    opens: bool
    closes: bool
    sensor_id: str | None
    end: np.ndarray
    low: float
    high: float


class _Stretch:
    def __init__(self, key: str | None, state: np.ndarray | None = None) -> None:
        self.key, self.state = key, empty_states(1)[0] if state is None else state
        self.low, self.high = math.inf, -math.inf

    def extend(self, values: pa.Array, alpha: float) -> None:
        bounds = pc.min_max(values)
        self.low = min(self.low, bounds["min"].as_py())
        self.high = max(self.high, bounds["max"].as_py())
        self.state = advance(values.to_numpy(zero_copy_only=False), self.state, alpha)


def edge_batches(
    batches: Iterable[pa.RecordBatch], alpha: float, starts: dict[int, np.ndarray]
) -> Iterator[pa.RecordBatch]:
    """At most two rows per slice: its first and its last series stretch."""
    slice_no, first, current = None, None, None
    for chunk in rechunk(batches):
        keys, values = chunk.column("sensor_id"), chunk.column("value")
        run_starts, run_lengths = run_bounds(keys)
        if current is None:
            slice_no = chunk.column(SLICE)[0].as_py()
            first = current = _Stretch(keys[0].as_py(), starts.get(slice_no))
        # Only the chunk's first run can belong to the stretch in hand, and only
        # its last run can still be open when the chunk ends.
        if keys[0].as_py() == current.key:
            current.extend(values.slice(0, run_lengths[0]), alpha)
        if len(run_starts) > 1 or keys[0].as_py() != current.key:
            tail = run_starts[-1]
            current = _Stretch(keys[int(tail)].as_py())
            current.extend(values.slice(tail, run_lengths[-1]), alpha)
    if current is None:
        return
    stretches = [first] if first is current else [first, current]
    rows = [
        {
            SLICE: slice_no,
            "opens": s is first,
            "closes": s is current,
            "sensor_id": s.key,
            **dict(zip(STATE_FIELDS, s.state.tolist())),
            "low": s.low,
            "high": s.high,
        }
        for s in stretches
    ]
    yield pa.RecordBatch.from_pylist(rows, schema=_EDGE_ARROW)


_EDGE_ARROW = pa.schema(
    [
        (SLICE, pa.int32()),
        ("opens", pa.bool_()),
        ("closes", pa.bool_()),
        ("sensor_id", pa.string()),
        *[(name, pa.float64()) for name in _NUMBERS],
    ]
)


def read_edges(
    slices: DataFrame, alpha: float, starts: dict[int, np.ndarray], only: list[int] | None = None
) -> list[Edge]:
    source = slices.select(SLICE, "sensor_id", "value")
    if only is not None:
        source = source.filter(F.col(SLICE).isin(only))
    rows = source.mapInArrow(lambda it: edge_batches(it, alpha, starts), EDGE_SCHEMA).collect()
    edges = [
        Edge(
            r[SLICE],
            r["opens"],
            r["closes"],
            r["sensor_id"],
            np.array([r[name] for name in STATE_FIELDS]),
            r["low"],
            r["high"],
        )
        for r in rows
    ]
    return sorted(edges, key=lambda e: (e.slice_no, not e.opens))


def repeat_value(x: float, times: int, state: np.ndarray, alpha: float) -> np.ndarray:
    """The state after ``times`` readings of ``x``, EWMA part only.

    Stops early once a reading no longer changes anything.
    """
    mean, var, fresh = float(state[_MEAN]), float(state[_VAR]), bool(state[0] == 0)
    for _ in range(times):
        (_, new_mean), (_, new_var) = walk([x], mean, var, fresh, alpha)
        if not fresh and (new_mean, new_var) == (mean, var):
            break
        mean, var, fresh = new_mean, new_var, False
    after = state.copy()
    after[_MEAN], after[_VAR] = mean, var
    return after


def _settled(a: np.ndarray | None, b: np.ndarray, exact: bool) -> bool:
    """Whether two EWMA states give the same scores for whatever follows."""
    if a is None:
        return False
    if np.array_equal(a[[_MEAN, _VAR]], b[[_MEAN, _VAR]], equal_nan=True):
        return True
    if exact or not (a[_VAR] > 0 and b[_VAR] > 0):
        return False
    least = min(a[_VAR], b[_VAR])
    return bool(
        abs(a[_MEAN] - b[_MEAN]) <= _TOLERANCE * math.sqrt(least) and abs(a[_VAR] - b[_VAR]) <= _TOLERANCE * least
    )


def carry_states(slices: DataFrame, alpha: float) -> dict[int, np.ndarray]:
    """For each slice that opens in mid-series, the state its first row meets."""
    edges = read_edges(slices, alpha, {})
    folded_from: dict[int, np.ndarray] = {}  # start used for the EWMA end of a slice
    folded_end: dict[int, np.ndarray] = {}
    rounds = 0

    while True:
        starts: dict[int, np.ndarray] = {}
        stale: list[int] = []
        previous: tuple[str | None, np.ndarray] | None = None
        for edge, following in zip(edges, [*edges[1:], None]):
            continues = edge.opens and previous is not None and previous[0] == edge.sensor_id
            if not continues:
                end = edge.end
            else:
                start = starts[edge.slice_no] = previous[1]
                end = combine(start, edge.end)
                if edge.low == edge.high:
                    moved = repeat_value(edge.low, int(edge.end[0]), start, alpha)
                else:
                    moved = folded_end.get(edge.slice_no, edge.end)
                    feeds = edge.closes and following and following.sensor_id == edge.sensor_id
                    if feeds and not _settled(folded_from.get(edge.slice_no), start, rounds < EXACT_ROUNDS):
                        stale.append(edge.slice_no)
                end[[_MEAN, _VAR]] = moved[[_MEAN, _VAR]]
            if edge.closes:
                previous = (edge.sensor_id, end)
        if not stale:
            return starts
        rounds += 1
        for edge in read_edges(slices, alpha, starts, only=stale):
            if edge.opens:
                folded_from[edge.slice_no] = starts[edge.slice_no]
                folded_end[edge.slice_no] = edge.end
