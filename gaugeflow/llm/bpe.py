"""Token ids of many texts, with a memory of words already encoded.

The tokenizer first cuts a text into words and marks, then encodes each on its own. So
a text may be cut where it certainly would: before a single blank between visible
characters, and between a letter and a mark. Pieces of letters only are encoded once
per task and looked up after that; the ids are the same as those of the whole text.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from gaugeflow.llm.common import pieces
from gaugeflow.llm.words import span_hashes

#: Pieces remembered before the memory starts anew.
MOST_PIECES = 1 << 20
CHUNK_BYTES = 1 << 20
#: The tokenizer is fed marks and runs in batches of so many.
BATCH = 4096


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Visible ASCII, ASCII letters, marks that end a word, and the visible character
    that stands for each byte in a byte-level vocabulary."""
    visible = np.zeros(256, bool)
    visible[0x21:0x7F] = True
    letter = np.zeros(256, bool)
    letter[0x41:0x5B] = letter[0x61:0x7B] = True
    mark = np.zeros(256, bool)
    mark[[ord(c) for c in ".,;:!?"]] = True
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shown, extra = [], 0
    for b in range(256):
        shown.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return visible, letter, mark, shown


class PieceEncoder:
    """Token ids of texts by one tokenizer; one per Python worker."""

    def __init__(self, path: str):
        # A task has one core; threads of the tokenizer's own would each keep memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._clear()

    def _clear(self) -> None:
        # Hashes of the pieces in rising order, and each one's place in ``starts``: arrays,
        # since a dictionary of as many takes ten times their memory.
        self.known = np.empty(0, np.uint64)
        self.places = np.empty(0, np.int32)
        self.flat = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's ids."""
        ids, counts = [], []
        for a, b in pieces(np.diff(offsets), CHUNK_BYTES):
            i, n = self._encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids.append(i)
            counts.append(n)
        if not ids:
            return np.empty(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts, plain = _cut(data, offsets)
        ends = np.append(starts[1:], n)
        hashes = span_hashes(data, starts, ends)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > MOST_PIECES:
            self._clear()
        at = np.searchsorted(self.known, unique)
        there = at < len(self.known)
        there[there] = self.known[at[there]] == unique[there]
        slots = np.zeros(len(unique), np.int64)
        slots[there] = self.places[at[there]]
        new = np.flatnonzero(~there)
        if len(new):
            slots[new] = self._learn(data, starts[first[new]], ends[first[new]], plain[first[new]], unique[new])
        lengths = np.diff(self.starts)[slots]
        counts = lengths[inverse]
        at = self.starts[slots][inverse]
        total = int(counts.sum())
        ends_out = np.cumsum(counts)
        index = np.arange(total) + np.repeat(at - (ends_out - counts), counts)
        before = np.concatenate([[0], ends_out])
        bounds = before[np.searchsorted(starts, offsets)]
        return self.flat[index], np.diff(bounds)

    def _learn(self, data, starts, ends, plain, hashes) -> np.ndarray:
        shown = _tables()[3]
        raw = [data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())]
        found: list = [None] * len(raw)
        tokenize = self.model.tokenize
        rest = []
        for i, (piece, simple) in enumerate(zip(raw, plain.tolist())):
            if simple:
                found[i] = [t.id for t in tokenize("".join([shown[b] for b in piece]))]
            else:
                rest.append(i)
        for at in range(0, len(rest), BATCH):
            some = rest[at : at + BATCH]
            texts = [raw[i].decode("utf-8", "replace") for i in some]
            for i, e in zip(some, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                found[i] = e.ids
        first = len(self.known)
        places = np.arange(first, first + len(raw))
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.places = np.insert(self.places, at, places)
        lengths = np.array([len(x) for x in found], np.int64)
        ids = np.array([t for x in found for t in x], np.uint32)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, ids])
        return places


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces, and whether a piece has letters only, after a blank.

    Beyond ASCII only two-byte characters from U+00C0 to U+00FF are taken for letters
    (two of them are signs), so that no other white space or mark is misread.
    """
    visible, letter, mark, _ = _tables()
    n = len(data)
    lead = data == 0xC3
    second = np.zeros(n, bool)
    second[1:] = lead[:-1]
    sign = second & ((data == 0x97) | (data == 0xB7))
    latin_end = second & ~sign
    latin_lead = lead.copy()
    latin_lead[:-1] &= ~sign[1:]
    is_letter = letter[data] | latin_end | latin_lead
    solid_end = visible[data] | latin_end
    solid_start = visible[data] | latin_lead
    cut = np.zeros(n + 1, bool)
    if n > 2:
        blank = data[1:-1] == 0x20
        cut[1 : n - 1] = blank & solid_end[:-2] & solid_start[2:]
    if n > 1:
        cut[1:n] |= mark[data[1:]] & (letter[data[:-1]] | latin_end[:-1])
    cut[offsets] = True
    starts = np.flatnonzero(cut[:n])
    other = np.concatenate([[0], np.cumsum(~is_letter)])
    ends = np.append(starts[1:], n)
    after_blank = starts + (data[starts] == 0x20)
    plain = (other[ends] == other[after_blank]) & (ends > after_blank)
    return starts, plain


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
