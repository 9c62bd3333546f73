"""Words of many texts at once, as arrays.

A word is a run of ASCII letters and digits and of all other characters beyond ASCII,
with A-Z in lower case. Words are represented by 64-bit hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """The byte as it counts in a word, 0 for bytes that separate words."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        if 0x41 <= b <= 0x5A:
            out[b] = b + 32
        elif 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            out[b] = b
    return out


class _Powers:
    """Powers of the base and of its inverse, modulo 2^64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.known = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.known) < n:
            step = np.uint64(pow(self.base, len(self.known), 1 << 64))
            with np.errstate(over="ignore"):
                self.known = np.concatenate([self.known, self.known * step])
        return self.known[:n]


_POWERS = _Powers(_BASE)
_INVERSES = _Powers(pow(_BASE, -1, 1 << 64))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the whole word."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values`` (bytes or wider), by prefix sums of a
    polynomial. Spans of the same content have the same hash wherever they are."""
    n = len(values)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _POWERS.upto(n), out=prefix[1:])
        inverse = _INVERSES.upto(n + 1)
        return mix64((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words, and how many words precede each text."""
    lower = _lower()[data]
    inside = np.zeros(len(data) + 1, bool)
    np.not_equal(lower, 0, out=inside[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offsets] = False  # a word ends where its text does
    starts = np.flatnonzero(inside & ~before)
    ends_here = before & ~inside
    last = offsets[1:][offsets[1:] > 0]
    ends_here[last[inside[last - 1]]] = True
    ends = np.flatnonzero(ends_here)
    return starts, ends, span_hashes(lower, starts, ends), np.searchsorted(starts, offsets)
