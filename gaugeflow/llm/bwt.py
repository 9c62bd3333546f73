"""Burrows-Wheeler transforms of sets of short strings, and their merge.

The transform of a set lists, for all suffixes in order, the symbol before each. Every
string ends in its own mark, symbol 0; marks are ordered as their strings are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Transform:
    """``symbols``: the transform; ``suffixes``: where each suffix starts in the text;
    ``strings``: how many strings, and so marks, the set has."""

    symbols: np.ndarray
    suffixes: np.ndarray
    strings: int


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and how long it is."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def _unfinished(sizes: np.ndarray, starts: np.ndarray, owners: np.ndarray | None) -> np.ndarray:
    """For each run whether it has more than one member, and of more than one owner."""
    more = sizes > 1
    if owners is not None and more.any():
        more &= np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts)
    return more


def refine(
    interval: np.ndarray,
    places: np.ndarray,
    depth: int,
    known: int,
    successor: Callable[[np.ndarray, int], np.ndarray],
    owner: np.ndarray | None = None,
) -> None:
    """Refine intervals of suffixes with ``known`` equal symbols to ``depth`` symbols, in place.

    ``interval`` has, for every suffix, the place in the order at which its interval
    begins. A pass orders the suffixes of each interval by the intervals of the suffixes
    ``step`` symbols further, so h equal symbols become h + step, at most twice as many.
    An interval of one suffix, or of suffixes of one ``owner``, is finished: it keeps its
    range for good and leaves the later passes. ``places`` are the suffixes of
    unfinished intervals.
    """
    while known < depth and len(places):
        step = min(known, depth - known)
        here, there = interval[places], interval[successor(places, step)]
        order = np.argsort(here * np.int64(len(interval)) + there)
        places, here, there = places[order], here[order], there[order]
        starts, _ = _runs(here)
        new = np.zeros(len(places), bool)
        new[starts] = True
        inner = new.copy()
        inner[1:] |= there[1:] != there[:-1]
        begins = np.flatnonzero(inner)
        sizes = np.diff(np.append(begins, len(places)))
        # An interval's parts follow each other in its range.
        offset = begins - np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))[begins]
        interval[places] = np.repeat(here[begins] + offset, sizes)
        more = _unfinished(sizes, begins, owner[places] if owner is not None else None)
        places = places[np.repeat(more, sizes)]
        known += step


def _start(interval: np.ndarray, order: np.ndarray, owner: np.ndarray | None) -> np.ndarray:
    """Suffixes of unfinished intervals, those being in ``order``."""
    starts, sizes = _runs(interval[order])
    more = _unfinished(sizes, starts, owner[order] if owner is not None else None)
    return order[np.repeat(more, sizes)]


def transform(text: np.ndarray, ends: np.ndarray) -> Transform:
    """Transform of strings laid out one after the other, each with a 0 at its end.

    ``ends``: the places of the marks. Suffixes are ranked by their first 8 symbols and
    then by doubling, as long as they are not told apart; suffixes that are equal up to
    the mark stand in text order, since the marks do.
    """
    n = len(text)
    if not n:
        return Transform(np.empty(0, np.uint8), np.empty(0, np.int64), 0)
    left = np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(n)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    for k in range(8):
        key = (key << np.uint64(8)) | np.where(left >= k, padded[k : k + n], 0).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    starts, sizes = _runs(key[order])
    interval = np.empty(n, np.int64)
    interval[order] = np.repeat(starts, sizes)
    # Suffixes whose mark is among the first 8 symbols are in order already.
    whole = left[order] < 8
    interval[order[whole]] = np.flatnonzero(whole)
    refine(interval, _start(interval, order, None), int(left.max()) + 1, 8, lambda at, step: at + step)
    order = np.argsort(interval, kind="stable")
    symbols = np.where(order > 0, text[order - 1], 0).astype(np.uint8)
    return Transform(symbols, order, len(ends))


def merge(shards: list[Transform], depth: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms by refining how they interleave, up to prefixes of ``depth``.

    The symbols of a transform, sorted, are the first symbols of its suffixes in order; so
    counting them gives the interleave by one symbol. Each pass then refines it by as
    many symbols as are known, from the interleave itself (see :func:`refine`): no
    suffix is compared again, and finished intervals take no part. Marks differ from each
    other, and stand in the order of the shards and their strings.

    ``owner`` may give, for every place in the shards laid end to end, a number; intervals
    of places of one number need not be told apart, and may stay one interval.

    Returns, for the merged order, the place in the shards laid end to end, and the
    number of the interval of suffixes whose first ``depth`` symbols are the same.
    """
    sizes = np.array([len(s.symbols) for s in shards])
    base = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    # The text place of each suffix, and the place of the suffix at each text place.
    at = np.concatenate([s.suffixes + b for s, b in zip(shards, base)])
    place_at = np.empty(n, np.int64)
    place_at[at] = np.arange(n)
    first = np.concatenate([np.repeat(np.arange(256, dtype=np.uint8), np.bincount(s.symbols, minlength=256)) for s in shards])
    order = np.argsort(first, kind="stable")
    starts, runs = _runs(first[order])
    interval = np.empty(n, np.int64)
    interval[order] = np.repeat(starts, runs)
    marks = int((first == 0).sum())
    interval[order[:marks]] = np.arange(marks)
    refine(interval, _start(interval, order, owner), depth, 1, lambda p, step: place_at[at[p] + step], owner)
    source = np.argsort(interval, kind="stable")
    return source, np.cumsum(np.diff(interval[source], prepend=-1) != 0) - 1
