"""The per-sensor recurrences of both detectors.

A state is what a sensor carries from one reading to the next: its number of readings,
the first of them, the sums of the distances from it and of their squares (z-score), and
an exponentially weighted mean and variance (EWMA). Both detectors see every reading, so
one count serves both.

The sums have twice the precision of a double, so mean and deviation are those of exact
arithmetic, rounded once, wherever a series is cut and however long it is. The EWMA is
the plain recurrence, bit by bit: long series are cut into blocks that advance side by
side, each after as many earlier readings as make it forget where it started; a block
that does not meet the end of the one before is walked again from there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from gaugeflow.operators.twofold import add, divide, multiply, negated, running_sums, two_product, two_sum

CHUNK_ROWS = 1 << 17
#: Fewer lanes than this are walked one by one.
MIN_LANES = 64
#: Readings of a long series that one lane scores.
LANE_ROWS = 256

SCORE_COLUMNS = ("reading_no", "expected", "z_score", "ewma_expected", "ewma_deviation")
STATE_FIELDS = ("n", "first", "sum_high", "sum_low", "square_high", "square_low", "ewma_mean", "ewma_var")
_N, _FIRST, _SUM, _SQUARE, _MEAN, _VAR = 0, 1, slice(2, 4), slice(4, 6), 6, 7


def empty_states(count: int) -> np.ndarray:
    """States before the first reading, a row each."""
    return np.zeros((count, len(STATE_FIELDS)))


class Scores(NamedTuple):
    """One entry per reading."""

    reading_no: np.ndarray
    expected: np.ndarray
    z_score: np.ndarray
    ewma_expected: np.ndarray
    ewma_deviation: np.ndarray


class _Runs(NamedTuple):
    """Series laid end to end in ``values``, with the states they start in."""

    values: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    states: np.ndarray

    def spread(self, column: np.ndarray) -> np.ndarray:
        return np.repeat(column, self.lengths)


def _sums(runs: _Runs):
    """For every reading the series' first one, and both sums with the reading in them."""
    known = runs.states[:, _N] > 0
    first = runs.spread(np.where(known, runs.states[:, _FIRST], runs.values[runs.starts]))
    gap = two_sum(runs.values, -first)
    square = two_product(gap[0], gap[0])
    square = two_sum(square[0], square[1] + 2 * gap[0] * gap[1])
    sums = running_sums(np.stack([gap[0], square[0]]), np.stack([gap[1], square[1]]), runs.starts, runs.lengths)
    if known.any():
        before = runs.states[:, 2:6].T
        sums = add([np.repeat(before[i::2], runs.lengths, axis=1) for i in (0, 1)], sums)
    return first, (sums[0][0], sums[1][0]), (sums[0][1], sums[1][1])


def _forgets(alpha: float) -> int:
    """Readings after which less than 2^-80 is left of the state before them."""
    return math.ceil(80 * math.log(2) / -math.log1p(-alpha))


def walk(values: list, mean: float, var: float, fresh: bool, alpha: float) -> tuple[list, list]:
    """Mean and variance before each reading, and after the last."""
    decay = 1.0 - alpha
    means, variances = [mean], [var]
    for x in values:
        if fresh:
            mean, var, fresh = x, 1.0, False
        else:
            drift = x - mean
            step = alpha * drift
            mean, var = mean + step, decay * (var + step * drift)
        means.append(mean)
        variances.append(var)
    return means, variances


def _same(a: float, b: float) -> bool:
    return a == b or (a != a and b != b)


def _lanes(runs: _Runs, alpha: float):
    """Where each lane starts reading, starts scoring and ends, and its series.

    Long series make several lanes if there are then enough to advance together.
    """
    warm = _forgets(alpha)
    blocks = np.where(runs.lengths > warm + 2 * LANE_ROWS, -(-runs.lengths // LANE_ROWS), 1)
    if blocks[blocks > 1].sum() < MIN_LANES:
        blocks[:] = 1
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    within = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
    series = np.repeat(np.arange(len(blocks)), blocks)
    size = np.where(blocks > 1, LANE_ROWS, runs.lengths)
    scores_from = runs.starts[series] + within * size[series]
    ends = np.minimum(scores_from + size[series], (runs.starts + runs.lengths)[series])
    reads_from = np.maximum(runs.starts[series], scores_from - np.where(within > 0, warm, 0))
    return reads_from, scores_from, ends, series


def _moving(runs: _Runs, alpha: float):
    """EWMA mean and variance before every reading, and after each series."""
    reads_from, scores_from, ends, series = _lanes(runs, alpha)
    lanes, decay = len(series), 1.0 - alpha
    order = np.argsort(reads_from - ends, kind="stable")
    begin, steps = reads_from[order], (ends - reads_from)[order]
    warm = (scores_from - reads_from)[order]
    # A lane that starts in mid-series has no state; its first reading sets one.
    own = reads_from[order] == runs.starts[series[order]]
    start = np.where(own[:, None], runs.states[series[order]], 0.0)
    mean, var, fresh = start[:, _MEAN].copy(), start[:, _VAR].copy(), start[:, _N] == 0
    means, variances = np.empty(len(runs.values)), np.empty(len(runs.values))
    together = int(steps[MIN_LANES - 1]) if lanes >= MIN_LANES else 0
    running = np.searchsorted(-steps, -np.arange(together), side="left")
    for step_no, k in enumerate(running):
        at = begin[:k] + step_no
        x = runs.values[at]
        scored = warm[:k] <= step_no
        means[at[scored]], variances[at[scored]] = mean[:k][scored], var[:k][scored]
        drift = x - mean[:k]
        step = alpha * drift
        new_mean, new_var = mean[:k] + step, decay * (var[:k] + step * drift)
        if step_no == 0:
            new_mean, new_var = np.where(fresh[:k], x, new_mean), np.where(fresh[:k], 1.0, new_var)
        mean[:k], var[:k] = new_mean, new_var
    for lane in np.flatnonzero(steps > together):
        lo, hi = begin[lane] + together, begin[lane] + steps[lane]
        walked = walk(runs.values[lo:hi].tolist(), mean[lane], var[lane], bool(fresh[lane]) and not together, alpha)
        skip = max(0, warm[lane] - together)
        means[lo + skip : hi], variances[lo + skip : hi] = (w[skip:-1] for w in walked)
        mean[lane], var[lane] = walked[0][-1], walked[1][-1]
    after = np.empty((lanes, 2))
    after[order, 0], after[order, 1] = mean, var

    for lane in np.flatnonzero(series[1:] == series[:-1]) + 1:
        lo, hi = scores_from[lane], ends[lane]
        mean_now, var_now = after[lane - 1].tolist()
        if _same(mean_now, means[lo]) and _same(var_now, variances[lo]):
            continue
        walked = walk(runs.values[lo:hi].tolist(), mean_now, var_now, False, alpha)
        means[lo:hi], variances[lo:hi] = walked[0][:-1], walked[1][:-1]
        after[lane] = walked[0][-1], walked[1][-1]
    last = np.flatnonzero(np.append(series[1:] != series[:-1], True))
    return means, variances, after[last]


def _after(runs: _Runs, sums, squares, first, moved) -> np.ndarray:
    last = runs.starts + runs.lengths - 1
    counts = runs.states[:, _N] + runs.lengths
    return np.column_stack([counts, first[last], *(part[last] for part in (*sums, *squares)), moved])


def advance(values: np.ndarray, state: np.ndarray, alpha: float) -> np.ndarray:
    """The state after one stretch of a series, without scores."""
    if not len(values):
        return state
    runs = _Runs(values, np.array([0]), np.array([len(values)]), state[None, :])
    with np.errstate(all="ignore"):
        first, sums, squares = _sums(runs)
        return _after(runs, sums, squares, first, _moving(runs, alpha)[2])[0]


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The state after two stretches, the second of them folded on its own; the EWMA
    part is the second's."""
    if left[_N] == 0:
        return right
    with np.errstate(all="ignore"):
        gap = two_sum(right[_FIRST], -left[_FIRST])
        moved = multiply(gap, (right[_N], 0.0))
        sums = add(add(left[_SUM], right[_SUM]), moved)
        cross = multiply(gap, add(right[_SUM], add(right[_SUM], moved)))
        squares = add(add(left[_SQUARE], right[_SQUARE]), cross)
    return np.array([left[_N] + right[_N], left[_FIRST], *sums, *squares, right[_MEAN], right[_VAR]])


def score_runs(
    values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray, alpha: float
) -> tuple[Scores, np.ndarray]:
    """Score series laid end to end, each from its state; returns the states after them.

    The z-score's centre leaves the reading out, its spread has it in; centre and spread
    of the EWMA both leave it out. A spread of nothing counts as one. Readings so far
    apart that a square overflows have no number for a score.
    """
    runs = _Runs(values, starts, lengths, states)
    with np.errstate(all="ignore"):
        first, sums, squares = _sums(runs)
        number = np.arange(len(values)) - runs.spread(starts) + runs.spread(states[:, _N]) + 1
        earlier = [np.concatenate(([0.0], part[:-1])) for part in sums]
        for part, before in zip(earlier, states[:, _SUM].T):
            part[starts] = before
        centre = divide(earlier, np.maximum(number - 1, 1))
        high, low = two_sum(first, centre[0])
        expected = np.where(number > 1, high + (low + centre[1]), 0.0)
        scatter = add(squares, negated(divide(multiply(sums, sums), number)))
        spread = np.sqrt(sum(divide(scatter, np.maximum(number - 1, 1))))
        spread[(number < 2) | (scatter[0] == 0)] = 1.0
        z_score = np.abs(values - expected) / spread
        mean, var, moved = _moving(runs, alpha)
        deviation = np.abs(values - mean) / np.where(var <= 0, 1.0, np.sqrt(var))
    scores = Scores(number.astype(np.int64), expected, z_score, mean, deviation)
    return scores, _after(runs, sums, squares, first, moved)


def rechunk(batches: Iterable[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Join small Arrow batches into chunks of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def run_bounds(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys (NULL equals NULL)."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    starts = np.concatenate(([0], np.flatnonzero(codes[1:] != codes[:-1]) + 1))
    return starts, np.diff(np.append(starts, len(codes)))


Keep = Callable[[Scores], np.ndarray]


def score_batches(
    batches: Iterable[pa.RecordBatch],
    alpha: float,
    start_of: Callable[[pa.RecordBatch], np.ndarray | None] | None = None,
    keep: Keep | None = None,
) -> Iterator[pa.RecordBatch]:
    """Append the score columns to batches sorted by sensor and time.

    The state of the last sensor of a chunk is carried into the next chunk, so
    memory does not depend on the length of a series. ``start_of`` gives the
    state in which the very first series starts; ``keep`` may drop scored rows
    before they travel back to the JVM.
    """
    open_key, open_state, begun = None, None, False
    for chunk in rechunk(batches):
        keys = chunk.column("sensor_id")
        starts, lengths = run_bounds(keys)
        states = empty_states(len(starts))
        if begun:
            start = open_state if keys[0].as_py() == open_key else None
        else:
            start, begun = start_of(chunk) if start_of else None, True
        if start is not None:
            states[0] = start
        values = chunk.column("value").to_numpy(zero_copy_only=False)
        scores, ends = score_runs(values, starts, lengths, states, alpha)
        open_key, open_state = keys[len(keys) - 1].as_py(), ends[-1]
        if keep is not None:
            mask = keep(scores)
            chunk = chunk.filter(pa.array(mask))
            scores = Scores(*(column[mask] for column in scores))
        if chunk.num_rows:
            yield pa.RecordBatch.from_arrays(
                [*chunk.columns, *map(pa.array, scores)],
                names=[*chunk.schema.names, *SCORE_COLUMNS],
            )
