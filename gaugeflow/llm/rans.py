"""Static range asymmetric numeral system over arrays of token ids.

A table gives every symbol a share of 2^``SCALE_BITS`` slots. A block is coded by
``LANES`` interleaved states that advance together, one symbol each per step. A
checkpoint notes the states and the place in the words every ``CHECK_STEPS`` steps, so
a decoder may start there; each part between two checkpoints has a checksum.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SCALE_BITS = 18
LANES = 1024
#: Steps between two checkpoints, and parts of a block.
CHECK_STEPS = 128
BLOCK_PARTS = 4
#: Symbols of a block.
BLOCK_IDS = LANES * CHECK_STEPS * BLOCK_PARTS

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_SCALE = np.uint64(SCALE_BITS)


class Corrupt(ValueError):
    """A block or table does not have the checksum it was written with."""


def _varints(values: np.ndarray) -> bytes:
    """Non-negative numbers below 2^35 in groups of seven bits, lowest first."""
    values = values.astype(np.uint64)
    parts = np.stack([(values >> np.uint64(7 * k)) & np.uint64(127) for k in range(5)], 1)
    sizes = 1 + sum((values >> np.uint64(7 * k) > 0).astype(int) for k in range(1, 5))
    used = np.arange(5) < sizes[:, None]
    parts |= np.where(np.arange(5) < sizes[:, None] - 1, np.uint64(128), np.uint64(0))
    return parts.astype(np.uint8)[used].tobytes()


def _from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    out = np.zeros(len(last), np.uint64)
    for k in range(5):
        at = first + k
        use = at <= last
        out[use] |= (raw[at[use]].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out


@dataclass
class Table:
    """Symbols in rising order with their share of slots and where it begins."""

    symbols: np.ndarray
    share: np.ndarray

    def __post_init__(self) -> None:
        self.begin = np.concatenate([[0], np.cumsum(self.share)])[:-1].astype(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        """The table that fits the counts of ``ids``; every symbol gets a slot."""
        symbols, counts = np.unique(ids, return_counts=True)
        slots = 1 << SCALE_BITS
        if len(symbols) > slots:
            raise ValueError(f"more than {slots} symbols in one table")
        share = np.maximum(1, counts * (slots - len(symbols)) // max(1, counts.sum()) + 1)
        # What rounding leaves goes to, or comes from, the largest shares.
        if len(symbols):
            share[np.argmax(share)] += slots - share.sum()
        return cls(symbols.astype(np.uint32), share.astype(np.uint64))

    def to_bytes(self) -> bytes:
        gaps = np.diff(self.symbols.astype(np.int64), prepend=-1)
        body = zlib.compress(_varints(np.concatenate([gaps, self.share.astype(np.int64)])), 6)
        return zlib.crc32(body).to_bytes(4, "little") + body

    @classmethod
    def from_bytes(cls, data: bytes) -> Table:
        if zlib.crc32(data[4:]) != int.from_bytes(data[:4], "little"):
            raise Corrupt("table")
        values = _from_varints(zlib.decompress(data[4:])).astype(np.int64)
        n = len(values) // 2
        return cls((np.cumsum(values[:n]) - 1).astype(np.uint32), values[n:].astype(np.uint64))

    def slots(self) -> np.ndarray:
        """The index of the symbol of every slot."""
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.share.astype(np.int64))


@dataclass
class Block:
    """Up to ``BLOCK_IDS`` ids: coded words and, for each part, a checkpoint.

    ``states``: a row of lane states per part, where its decoding starts.
    ``places``: the word at which each part starts, and the number of words.
    ``checks``: crc32 of each part's ids as little-endian unsigned 32-bit integers.
    """

    n_ids: int
    words: np.ndarray
    states: np.ndarray
    places: np.ndarray
    checks: np.ndarray

    def to_bytes(self) -> bytes:
        head = np.array([self.n_ids, len(self.words), len(self.checks)], "<u8")
        parts = (head, self.places.astype("<u8"), self.checks.astype("<u8"), self.states.astype("<u8"))
        return b"".join(p.tobytes() for p in parts) + self.words.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Block:
        n_ids, n_words, parts = np.frombuffer(data, "<u8", 3).tolist()
        at = 24
        places = np.frombuffer(data, "<u8", parts + 1, at)
        checks = np.frombuffer(data, "<u8", parts, at + 8 * (parts + 1))
        at += 8 * (2 * parts + 1)
        states = np.frombuffer(data, "<u8", parts * LANES, at).reshape(parts, LANES)
        return cls(n_ids, np.frombuffer(data, "<u4", n_words, at + 8 * parts * LANES), states, places, checks)


def _parts(n_ids: int) -> list[tuple[int, int]]:
    size = LANES * CHECK_STEPS
    return [(at, min(n_ids, at + size)) for at in range(0, n_ids, size)]


def encode_block(ids: np.ndarray, table: Table) -> Block:
    """Code ids, last step first; a decoder then reads forward."""
    n = len(ids)
    spots = np.searchsorted(table.symbols, ids)
    share, begin = table.share[spots], table.begin[spots]
    state = np.full(LANES, _LOW, np.uint64)
    words, states, counts = [], [], []
    steps_of = [range(a, b, LANES) for a, b in _parts(n)]
    for steps in reversed(steps_of):
        count = 0
        for at in reversed(steps):
            end = min(at + LANES, n)
            f, x = share[at:end], state[: end - at]
            full = x >= f << np.uint64(63 - SCALE_BITS)
            if full.any():
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                count += len(words[-1])
                x[full] >>= _WORD
            whole = x // f
            state[: end - at] = (whole << _SCALE) + (x - whole * f) + begin[at:end]
        states.append(state.copy())
        counts.append(count)
    words.reverse()
    checks = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in _parts(n)]
    return Block(
        n,
        np.concatenate(words) if words else np.empty(0, np.uint32),
        np.array(states[::-1], np.uint64).reshape(len(states), LANES),
        np.concatenate([[0], np.cumsum(counts[::-1])]).astype(np.uint64),
        np.array(checks, np.uint64),
    )


def decode_part(block: Block, part: int, table: Table, slots: np.ndarray) -> np.ndarray:
    """The ids between one checkpoint and the next, whatever else was decoded."""
    a, b = _parts(block.n_ids)[part]
    state = block.states[part].astype(np.uint64)
    place, end_place = int(block.places[part]), int(block.places[part + 1])
    out = np.empty(b - a, np.uint32)
    mask = np.uint64((1 << SCALE_BITS) - 1)
    share, begin, words = table.share, table.begin, block.words
    for at in range(0, b - a, LANES):
        x = state[: min(LANES, b - a - at)]
        slot = x & mask
        spot = slots[slot]
        out[at : at + len(x)] = spot
        x = share[spot] * (x >> _SCALE) + slot - begin[spot]
        low = x < _LOW
        n = int(np.count_nonzero(low))
        if n:
            if place + n > end_place:
                raise Corrupt("words")
            x[low] = x[low] << _WORD | words[place : place + n]
            place += n
        state[: len(x)] = x
    ids = table.symbols[out]
    if zlib.crc32(ids.astype("<u4").tobytes()) != int(block.checks[part]):
        raise Corrupt(f"part {part}")
    return ids


def decode_block(block: Block, table: Table, slots: np.ndarray | None = None) -> np.ndarray:
    slots = table.slots() if slots is None else slots
    parts = [decode_part(block, k, table, slots) for k in range(len(block.checks))]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)
