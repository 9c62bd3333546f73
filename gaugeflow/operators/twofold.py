"""Sums of doubles with twice their precision, for many series at once.

A number is held as a pair (high, low): the double nearest to it, and what is left.
Sums in this form do not depend, in any bit of their leading double, on how a series was
cut into stretches, as long as some 100 bits tell its readings' sum from its rounding.
"""

from __future__ import annotations

import numpy as np

# Fixed value: 2^27 + 1 splits a double into halves whose products are exact.
_SPLITTER = 134217729.0

#: Runs are cut into blocks of about the root of the longest run, but no shorter ones.
_LEAST_BLOCK = 16


def two_sum(a, b):
    total = a + b
    shadow = total - a
    return total, (a - (total - shadow)) + (b - shadow)


def _ordered_sum(a, b):
    """As ``two_sum`` where a is the larger or b is tiny."""
    total = a + b
    return total, b - (total - a)


def two_product(a, b):
    product = a * b
    wide_a, wide_b = _SPLITTER * a, _SPLITTER * b
    a_high, b_high = wide_a - (wide_a - a), wide_b - (wide_b - b)
    a_low, b_low = a - a_high, b - b_high
    return product, ((a_high * b_high - product) + a_high * b_low + a_low * b_high) + a_low * b_low


def add(a, b):
    high, rest = two_sum(a[0], b[0])
    low, last = two_sum(a[1], b[1])
    high, rest = _ordered_sum(high, rest + low)
    return _ordered_sum(high, rest + last)


def negated(a):
    return -a[0], -a[1]


def multiply(a, b):
    high, rest = two_product(a[0], b[0])
    return _ordered_sum(high, rest + (a[0] * b[1] + a[1] * b[0]))


def divide(a, n):
    """By a double."""
    quotient = a[0] / n
    back, rest = two_product(quotient, n)
    return _ordered_sum(quotient, (((a[0] - back) - rest) + a[1]) / n)


def running_sums(high: np.ndarray, low: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Sums of each run up to and with each of its elements.

    ``high`` and ``low`` hold one or more rows of numbers; the runs lie end to end
    along them. All runs are cut into blocks, which advance together; then the blocks'
    totals are summed up in the same way and added.
    """
    longest = int(lengths.max(initial=0))
    block = max(_LEAST_BLOCK, int(longest**0.5))
    blocks = -(-lengths // block)
    first_block = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    within = np.arange(int(blocks.sum())) - np.repeat(first_block, blocks)
    begin = np.repeat(starts, blocks) + within * block
    length = np.minimum(np.repeat(starts + lengths, blocks) - begin, block)

    order = np.argsort(-length, kind="stable")
    ordered, sizes = begin[order], length[order]
    out = high.copy(), low.copy()
    so_far = out[0][:, ordered], out[1][:, ordered]
    for step in range(1, min(block, longest)):
        k = np.searchsorted(-sizes, -step, side="left")  # blocks longer than step
        at = ordered[:k] + step
        so_far = add((so_far[0][:, :k], so_far[1][:, :k]), (out[0][:, at], out[1][:, at]))
        out[0][:, at], out[1][:, at] = so_far
    if longest <= block:
        return out
    ends = begin + length - 1
    totals = running_sums(out[0][:, ends], out[1][:, ends], first_block, blocks)
    later = np.flatnonzero(within > 0)
    rows = np.repeat(begin[later] - np.concatenate(([0], np.cumsum(length[later])[:-1])), length[later])
    rows += np.arange(len(rows))
    before = [np.repeat(t[:, later - 1], length[later], axis=1) for t in totals]
    out[0][:, rows], out[1][:, rows] = add(before, (out[0][:, rows], out[1][:, rows]))
    return out
