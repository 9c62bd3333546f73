import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from helpers import sequential_scores, spiky, wavy

from gaugeflow.operators import fold, twofold
from gaugeflow.operators.fold import SCORE_COLUMNS, advance, combine, empty_states, score_batches, score_runs

SERIES = {
    "constant": [20.0] * 3000,
    "constant_inexact": [0.1] * 3000,
    "shift_then_flat": spiky(500) + [123.456] * 2500,
    "long_varied": spiky(20_000, seed=3),
    "long_at_1e9": [1e9 + x for x in spiky(20_000, seed=11)],
    "first_far_off": [0.0] + [1e9 + x for x in spiky(3000, seed=12)],
    "tiny_spread": [1e9 + (i % 2) * 1e-3 for i in range(2000)],
    "small_numbers": [x * 1e-9 for x in spiky(2000, seed=13)],
    "two_levels": [22.0 + 0.1 * (i % 2) for i in range(30_000)],
    "short": wavy(5),
    "one": [7.0],
}
EMPTY = empty_states(1)[0]


def _scored(values, state=EMPTY, alpha=0.1):
    values = np.asarray(values, np.float64)
    scores, ends = score_runs(values, np.array([0]), np.array([len(values)]), state[None, :], alpha)
    return list(zip(*[c.tolist() for c in scores])), ends[0]


@pytest.mark.parametrize("name", SERIES)
def test_scores_equal_the_sequential_model_to_the_last_bit(name):
    rows, state = _scored(SERIES[name])
    assert rows == sequential_scores(SERIES[name])
    assert np.array_equal(state, advance(np.array(SERIES[name]), EMPTY, 0.1))


@pytest.mark.parametrize("alpha", [0.01, 0.1, 0.9])
@pytest.mark.parametrize("name", ["long_varied", "shift_then_flat", "two_levels"])
def test_scores_do_not_depend_on_where_a_series_is_cut(name, alpha):
    whole, end = _scored(SERIES[name], alpha=alpha)
    rng = random.Random(5)
    cuts = sorted(rng.randrange(len(SERIES[name])) for _ in range(9))
    state, rows = EMPTY, []
    for lo, hi in zip([0, *cuts], [*cuts, None]):
        piece = SERIES[name][lo:hi]
        if piece:
            scored, state = _scored(piece, state, alpha)
            rows += scored
    assert rows == whole
    assert np.array_equal(state[[0, 1, 2, 6, 7]], end[[0, 1, 2, 6, 7]])


def test_many_series_in_step_equal_each_alone():
    rng = random.Random(1)
    series = [spiky(rng.randint(1, 300), seed=i) for i in range(150)]
    series += [[0.1] * 400, spiky(3000), [20.0] * 50 + [9999.0], spiky(30_000, seed=2)]
    rng.shuffle(series)
    # Some series resume from an earlier state.
    earlier = advance(np.array(spiky(40, seed=9)), EMPTY, 0.1)
    states = np.array([earlier if i % 5 == 0 else EMPTY for i in range(len(series))])
    lengths = np.array([len(s) for s in series])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    scores, ends = score_runs(np.concatenate([np.array(s) for s in series]), starts, lengths, states, 0.1)
    for i, one in enumerate(series):
        rows, end = _scored(one, states[i])
        lo, hi = starts[i], starts[i] + lengths[i]
        for column, expected in zip(scores, zip(*rows)):
            assert column[lo:hi].tolist() == list(expected)
        assert np.array_equal(ends[i][[0, 1, 2, 4, 6, 7]], end[[0, 1, 2, 4, 6, 7]])


def test_states_of_stretches_combine():
    whole = np.array(SERIES["long_at_1e9"])
    state = EMPTY
    for piece in np.array_split(whole, 13):
        state = combine(state, advance(piece, EMPTY, 0.1))
    once = advance(whole, EMPTY, 0.1)
    exact = [sum((Fraction(x) - Fraction(whole[0])) ** k for x in whole.tolist()) for k in (1, 2)]
    for got in (state, once):
        assert got[0] == len(whole) and got[1] == whole[0]
        for k in (0, 1):
            high, low = got[2 + 2 * k : 4 + 2 * k].tolist()
            assert abs(Fraction(high) + Fraction(low) - exact[k]) <= abs(exact[k]) * Fraction(1, 2**90)
    assert np.array_equal(state[6:], once[6:])


def test_state_is_carried_across_batches(monkeypatch):
    monkeypatch.setattr("gaugeflow.operators.fold.CHUNK_ROWS", 1)
    data = {"a": spiky(777), "b": wavy(1), None: spiky(50, seed=2), "c": spiky(1600, seed=4)}
    keys = [k for k, series in data.items() for _ in series]
    values = [v for series in data.values() for v in series]
    table = pa.table({"sensor_id": pa.array(keys, pa.string()), "value": values})
    out = pa.Table.from_batches(score_batches(table.to_batches(max_chunksize=500), 0.1))
    expected = [row for series in data.values() for row in sequential_scores(series)]
    assert list(zip(*[out.column(c).to_pylist() for c in SCORE_COLUMNS])) == expected


def test_a_block_that_forgot_wrongly_is_walked_again(monkeypatch):
    monkeypatch.setattr(fold, "_forgets", lambda alpha: 3)  # far too few
    rows, _ = _scored(SERIES["long_varied"])
    assert rows == sequential_scores(SERIES["long_varied"])


def test_overflowing_scores_are_not_numbers_and_others_go_on():
    rows, state = _scored([1e308, -1e308, 1e308])
    assert rows[0][1:3] == (0.0, 1e308) and math.isnan(rows[2][2])
    assert math.isnan(state[4])
    for odd in (math.nan, math.inf):
        rows, _ = _scored([1.0, odd, 2.0])
        assert rows[0][2] == 1.0 and math.isnan(rows[2][2])


def test_z_never_exceeds_root_of_reading_number():
    # The first reading is measured from zero in units of one.
    rows, _ = _scored([20.0] * 200 + [1e6] + [20.0] * 50 + [-1e7])
    for n, _, z, _, _ in rows[1:]:
        assert z <= math.sqrt(n) * (1 + 1e-12)


def test_twofold_arithmetic():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (tuple(sorted(((x := rng.gauss(0, 1) * 10.0 ** rng.randint(-9, 9)), x * rng.random() * 2**-54), key=abs, reverse=True)) for _ in "ab")
        exact = [Fraction(x[0]) + Fraction(x[1]) for x in (a, b)]
        for got, want in (
            (twofold.add(a, b), exact[0] + exact[1]),
            (twofold.multiply(a, b), exact[0] * exact[1]),
            (twofold.divide(a, 7.0), exact[0] / 7),
        ):
            error = abs(Fraction(got[0]) + Fraction(got[1]) - want)
            assert error <= (abs(exact[0]) + abs(exact[1]) + abs(want)) * Fraction(1, 2**98)


@pytest.mark.parametrize("lengths", [[1], [5, 1, 40], [4000], [17, 3000, 2, 900]])
def test_running_sums(lengths):
    values = np.array(spiky(sum(lengths), seed=8))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    high, low = twofold.running_sums(values[None, :], np.zeros((1, len(values))), starts, np.array(lengths))
    for start, length in zip(starts, lengths):
        total = Fraction(0)
        for i in range(start, start + length):
            total += Fraction(values[i])
            assert abs(Fraction(high[0, i]) + Fraction(low[0, i]) - total) < Fraction(1, 2**80)
