"""Repeated substrings across documents, by merged Burrows-Wheeler transforms.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts in a
document with a smaller doc_id. Which strings repeat is read off the intervals of a
merged Burrows-Wheeler transform. One transform of a whole corpus fits no machine, so
the corpus is first cut along its content:

* In each window of ``LENGTH`` bytes, the gram of ``GRAM`` bytes with the least hash is
  the window's anchor. Equal windows have equal anchors, so only windows of one anchor
  have to be compared. Neighbouring windows mostly share it and form one segment.
* Equal windows share the anchor and, on one side of it at least, half of what else is
  in a window. Segments neither of whose sides occurs twice in the corpus cannot repeat.
  What is left is grouped by the anchor's hash into buckets, distinct segments of
  each part of the documents once, with the least and greatest doc_id they occur in.
* In a bucket, segments that several parts have are taken once, and those that have no
  side in common with another are done. Of the others, each part's are a shard with a transform
  of its own. The transforms are merged; an interval of the merged order is one repeated
  string, and the least doc_id in it is its first document.
* What was found goes back to the parts and is marked in the documents.

Between the steps small rows of packed arrays are shuffled, not a row per anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.bwt import merge, transform
from gaugeflow.llm.common import pieces, saved, small_batches, utf8
from gaugeflow.llm.words import mix64, span_hashes

LENGTH = 50
GRAM = 16
#: Parts of the documents and buckets of anchors, at least, and bytes of text of each.
LEAST_PARTS = 64
PART_BYTES = 16 << 20
#: Bytes of text looked at together, and symbols of the segments merged together.
CHUNK_BYTES = 2 << 20
MERGED_SYMBOLS = 2 << 20
#: Sides of anchors that a task gathers before it hands them on.
GATHERED = 4 << 20
#: A missing doc_id comes after all others.
NO_ID = np.iinfo(np.int64).max

_PLACE_BITS = np.uint64(24)


def _least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """Runs of windows with one anchor: first and last start, anchor's hash and place, text.

    The hash's upper bits decide; of equal ones the leftmost gram is the anchor. Very
    long texts are looked at in overlapping stretches, which only cuts runs.
    """
    gram = min(GRAM, length)
    found = []
    step = (1 << 23) if len(data) > 1 << 23 else max(1, len(data))
    for low in range(0, len(data), step):
        part = data[low : low + step + length - 1]
        n = len(part) - length + 1
        if n <= 0:
            continue
        at = np.arange(len(part) - gram + 1)
        hashes = span_hashes(part, at, at + gram)
        keyed = (hashes >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
        least = _least_in_window(keyed, length - gram + 1)[:n]
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        text = np.searchsorted(offsets, np.arange(low, low + n), "right") - 1
        inside = np.arange(low, low + n) + length <= offsets[text + 1]
        start = np.flatnonzero(inside)
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        own, anchors = text[start], anchor[start]
        new[1:] = (anchors[1:] != anchors[:-1]) | (start[1:] != start[:-1] + 1) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        at_anchor = anchors[first]
        found.append((start[first] + low, start[last] + low, hashes[at_anchor], at_anchor + low, own[first]))
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, np.uint64), empty, empty
    return tuple(np.concatenate(x) for x in zip(*found))


def sides(data: np.ndarray, first, last, at, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each segment's anchor with what precedes and with what follows it, and
    whose segments these are; a side that is too short for half a window is left out."""
    gram = min(GRAM, length)
    half = -(-(length - gram) // 2)
    before, after = np.flatnonzero(at - half >= first), np.flatnonzero(at + gram + half <= last + length)
    begin = np.concatenate([at[before] - half, at[after]])
    hashes = span_hashes(data, begin, begin + gram + half)
    # The same bytes to the left of one anchor and to the right of another are no pair.
    hashes[len(before) :] = mix64(hashes[len(before) :])
    return hashes, np.concatenate([before, after])


def _bytes(array: np.ndarray, kind: str) -> bytes:
    return array.astype(kind).tobytes()


def _array(value, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _batch(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(kinds))])


def _bounds(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.append(np.flatnonzero(new), len(keys))


def _chunks(batch: pa.RecordBatch, text: int):
    """Bytes, offsets and the range of rows, some at a time."""
    data, offsets = utf8(batch.column(text))
    for a, b in pieces(np.diff(offsets), CHUNK_BYTES):
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, b


# Step 1: sides of all anchors, by bucket. In a bucket, which has about as many at any
# size of the corpus, 32 bits tell them apart but for one in some thousand; segments
# that are kept for such a one in vain are found to be alone later.
_SIDES_DDL = "bucket int, parts binary, counts binary, sides binary"
_SIDES = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _bucket_of(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's bucket and its 32 bits there."""
    return (hashes % np.uint64(buckets)).astype(np.int64), (hashes >> np.uint64(32)).astype(np.uint32)


def _side_rows(buckets: int, length: int):
    def handed_on(hashes: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
        bucket, bits = _bucket_of(hashes, buckets)
        order = np.lexsort((bits, parts, bucket))
        bits, parts, bucket = bits[order], parts[order], bucket[order]
        # Two of a kind tell as much as more.
        third = np.zeros(len(bits), bool)
        third[2:] = (bits[2:] == bits[:-2]) & (parts[2:] == parts[:-2]) & (bucket[2:] == bucket[:-2])
        bits, parts, bucket = bits[~third], parts[~third], bucket[~third]
        bounds, rows = _bounds(bucket), []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            inner = _bounds(parts[a:b])
            rows.append(
                (
                    int(bucket[a]),
                    _bytes(parts[a:b][inner[:-1]], "<u4"),
                    _bytes(np.diff(inner), "<u4"),
                    _bytes(bits[a:b], "<u4"),
                )
            )
        return _batch(rows, _SIDES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, size = [], [], 0
        for batch in batches:
            part = batch.column(0).to_numpy(zero_copy_only=False)
            for data, offsets, a, b in _chunks(batch, 2):
                first, last, _, at, text = segments(data, offsets, length)
                hashes, of = sides(data, first, last, at, length)
                held.append(hashes)
                parts.append(part[a:b][text[of]])
                size += len(hashes)
            if size > GATHERED:
                yield handed_on(np.concatenate(held), np.concatenate(parts))
                held, parts, size = [], [], 0
        if size:
            yield handed_on(np.concatenate(held), np.concatenate(parts))

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows by their first column, in whose order they come."""
    key, rows = None, []
    for batch in batches:
        for own, *row in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
            if own != key and rows:
                yield key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield key, rows


# Step 2: sides that occur again, sent back to the parts that have them.
_REPEATED_DDL = "part int, sides binary"


def _repeated_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, rows in _groups(batches):
        parts = np.concatenate([np.repeat(_array(p, "<u4"), _array(c, "<u4")) for p, c, _ in rows])
        bits = np.concatenate([_array(a, "<u4") for _, _, a in rows])
        order = np.argsort(bits)
        bits, parts = bits[order], parts[order]
        bounds = _bounds(bits)
        again = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
        bits, parts = bits[again], parts[again]
        if not len(parts):
            continue
        order = np.lexsort((bits, parts))
        bits, parts = bits[order].astype(np.uint64), parts[order]
        inner = _bounds(parts)
        known = np.uint64(bucket) << np.uint64(32) | bits
        yield _batch(
            [
                (int(parts[a]), _bytes(np.unique(known[a:b]), "<u8"))
                for a, b in zip(inner[:-1].tolist(), inner[1:].tolist())
            ],
            [pa.int32(), pa.binary()],
        )


# Step 3: distinct segments with such a side in each part.
# Anchors and keys are hashes of the text and made anew from it; the columns are
# compressed together, row by row.
_SEGMENTS_DDL = "bucket int, part int, segments int, anchors binary, sizes binary, least binary, most binary, text binary"
_SEGMENTS = [pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 5]


def _squeezed(array: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: what is alike stands together."""
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(len(array), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueezed(value, kind: str, count: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(value.as_py()), np.uint8)
    planes = raw.reshape(np.dtype(kind).itemsize, count)
    return np.ascontiguousarray(planes.T).view(kind).reshape(count)


def _part_rows(batches: Iterator[pa.RecordBatch]):
    """Per part what was sent to it, then its documents in batches.

    Rows: (part, kind, doc_id, text, packed); kind 0 rows come first in their part.
    """
    part, sent, closed = None, [], False
    for batch in batches:
        owners = batch.column(0).to_numpy(zero_copy_only=False)
        bounds = _bounds(owners)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if owners[a] != part:
                part, sent, closed = int(owners[a]), [], False
            own = batch.slice(a, b - a)
            kinds = own.column(1).to_numpy(zero_copy_only=False)
            texts = int(np.searchsorted(kinds, 1))
            sent += [own.column(4)[i] for i in range(texts)]
            if texts < b - a:
                yield part, (sent if not closed else None), own.slice(texts)
                closed = True


def _doc_ids(column) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(column, int(NO_ID)).to_numpy(zero_copy_only=False)


def _segment_rows(buckets: int, length: int):
    def handed_on(part: int, held: list) -> Iterator[pa.RecordBatch]:
        anchors, places, keys, sizes, docs, texts = (np.concatenate(x) for x in zip(*held))
        starts = np.cumsum(sizes) - sizes
        order = np.lexsort((keys, anchors, anchors % np.uint64(buckets)))
        bounds = _bounds(keys[order])
        first = order[bounds[:-1]]
        least = np.minimum.reduceat(docs[order], bounds[:-1])
        most = np.maximum.reduceat(docs[order], bounds[:-1])
        bucket = (anchors[first] % np.uint64(buckets)).astype(np.int64)
        of_bucket = _bounds(bucket)
        for a, b in zip(of_bucket[:-1].tolist(), of_bucket[1:].tolist()):
            own = first[a:b]
            text = texts[_spread(starts[own], sizes[own])]
            row = (
                int(bucket[a]), part, b - a, _squeezed(places[own].astype("<u4")), _squeezed(sizes[own].astype("<u4")),
                _squeezed(least[a:b].astype("<i8")), _squeezed((most - least)[a:b].astype("<u8")), _squeezed(text),
            )
            yield _batch([row], _SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, wanted, owner = [], 0, None, None
        for part, sent, batch in _part_rows(batches):
            if held and (part != owner or size > GATHERED * 8):
                yield from handed_on(owner, held)
                held, size = [], 0
            owner = part
            if sent is not None:
                wanted = np.unique(np.concatenate([_array(s, "<u8") for s in sent])) if sent else None
            if wanted is None:
                continue
            ids = _doc_ids(batch.column(2))
            for data, offsets, a, b in _chunks(batch, 3):
                first, last, anchors, at, text = segments(data, offsets, length)
                hashes, of = sides(data, first, last, at, length)
                bucket, bits = _bucket_of(hashes, buckets)
                known = bucket.astype(np.uint64) << np.uint64(32) | bits
                place = np.minimum(np.searchsorted(wanted, known), len(wanted) - 1)
                kept = np.unique(of[wanted[place] == known])
                if not len(kept):
                    continue
                first, sizes = first[kept], last[kept] - first[kept] + length
                keys = span_hashes(data, first, first + sizes)
                texts = data[_spread(first, sizes)]
                held.append((anchors[kept], at[kept] - first, keys, sizes, ids[a:b][text[kept]], texts))
                size += len(texts)
        if held:
            yield from handed_on(owner, held)

    return run


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


# Step 4: merge the transforms of a bucket; first documents of repeated strings.
_FOUND_DDL = "part int, found binary"
#: Segment, range of starts in it, first document of the strings that start there.
_FOUND = np.dtype([("key", "<u8"), ("low", "<u2"), ("high", "<u2"), ("first", "<i8")])


def _shard(texts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments as strings of symbols with their marks, and the places of the marks.

    UTF-8 has no byte 255, so a byte's symbol is one more than the byte.
    """
    marks = np.cumsum(sizes + 1) - 1
    out = np.zeros(int(marks[-1]) + 1, np.uint8)
    body = np.ones(len(out), bool)
    body[marks] = False
    out[body] = texts + np.uint8(1)
    return out, marks


class _Distinct:
    """The distinct segments of a bucket, and which parts have them.

    Segments are sorted by anchor and known by their hash. ``least`` is the first document
    that has one, in any part. An entry is a segment in a part: ``entry_of`` its segment,
    ``part`` and ``most``, the part's last document that has it.
    """

    def __init__(self, rows: list, length: int):
        own = [self._unpacked(row, length) for row in rows]
        anchor, key, size, start, sides_of, least, most, texts = (list(x) for x in zip(*own))
        base = np.cumsum([0] + [len(t) for t in texts])[:-1]
        part = np.repeat([r[0].as_py() for r in rows], [len(s) for s in size])
        start = np.concatenate([s + b for s, b in zip(start, base)])
        anchor, key, size, least, most, self.text = map(np.concatenate, (anchor, key, size, least, most, texts))
        order = np.lexsort((part, size, key, anchor))
        new = np.ones(len(order), bool)
        new[1:] = False
        for column in (anchor, key, size):
            new[1:] |= column[order][1:] != column[order][:-1]
        heads = np.flatnonzero(new)
        first = order[heads]
        self.anchor, self.key, self.size, self.start = anchor[first], key[first], size[first], start[first]
        self.shard = part[first]
        self.least = np.minimum.reduceat(least[order], heads)
        self.entry_of, self.part, self.most = np.cumsum(new) - 1, part[order], most[order]
        self.meets = self._meets(np.concatenate(sides_of)[first])

    @staticmethod
    def _unpacked(row: list, length: int) -> tuple[np.ndarray, ...]:
        """The segments of one part: anchor, key, size, start in the text, hashes of both
        sides (0 for none), documents, text."""
        count = row[1].as_py()
        size = _unsqueezed(row[3], "<u4", count).astype(np.int64)
        start = np.cumsum(size) - size
        text = _unsqueezed(row[6], "<u1", int(size.sum()))
        at = start + _unsqueezed(row[2], "<u4", count)
        least = _unsqueezed(row[4], "<i8", count)
        most = (least.view(np.uint64) + _unsqueezed(row[5], "<u8", count)).view(np.int64)
        anchor = span_hashes(text, at, at + min(GRAM, length))
        hashes, of = sides(text, start, start + size - length, at, length)
        both = np.zeros((count, 2), np.uint64)
        new = np.append(False, of[1:] <= of[:-1])  # the second side begins anew
        both[of, np.cumsum(new)] = hashes
        return anchor, span_hashes(text, start, start + size), size, start, both, least, most, text

    @staticmethod
    def _meets(both: np.ndarray) -> np.ndarray:
        """Which segments have a side in common with another: only these share a window."""
        hashes = both.ravel()
        order = np.argsort(hashes)
        ordered = hashes[order]
        again = np.zeros(len(hashes), bool)
        same = (ordered[1:] == ordered[:-1]) & (ordered[1:] != 0)
        again[order[1:][same]] = again[order[:-1][same]] = True
        return again.reshape(-1, 2).any(axis=1)

    def groups(self, symbols: int) -> Iterator[np.ndarray]:
        """Segments that meet others, by anchors, about ``symbols`` at a time."""
        several = np.flatnonzero(self.meets)
        if not len(several):
            return
        anchors = self.anchor[several]
        total = np.cumsum(self.size[several] + 1)
        cuts = np.searchsorted(total, np.arange(symbols, int(total[-1]), symbols))
        cuts = np.unique(np.searchsorted(anchors, anchors[cuts], "left"))
        yield from (g for g in np.split(several, cuts[cuts > 0]) if len(g))

    def alone(self) -> np.ndarray:
        """Segments that share no window with another."""
        return np.flatnonzero(~self.meets)


def _merged(own: _Distinct, group: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Segment, lowest and highest start, and first document of the strings of a group.

    Each part's segments are a shard, a segment that several parts have is in the first's.
    """
    group = group[np.argsort(own.shard[group], kind="stable")]
    bounds = _bounds(own.shard[group])
    shards, start, offset = [], [], 0
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        sizes = own.size[group[a:b]]
        text, marks = _shard(own.text[_spread(own.start[group[a:b]], sizes)], sizes)
        shards.append(transform(text, marks))
        start.append(offset + marks - sizes)
        offset += len(text)
    start = np.concatenate(start)
    base = np.cumsum([0] + [len(s.suffixes) for s in shards])[:-1]
    places = np.concatenate([s.suffixes + b for s, b in zip(shards, base)])
    segment = np.searchsorted(start, places, "right") - 1
    source, interval = merge(shards, length, segment)
    least, segment, places = own.least[group], segment[source], places[source]
    bounds = np.append(np.flatnonzero(np.diff(interval, prepend=-1)), len(interval))
    first = np.minimum.reduceat(least[segment], bounds[:-1])
    by_place = np.empty(offset, np.int64)
    by_place[places] = np.repeat(first, np.diff(bounds))
    # Strings of the full length, in text order, in runs with one first document.
    windows = own.size[group] - length + 1
    at = _spread(start, windows)
    segment = np.repeat(np.arange(len(start)), windows)
    first = by_place[at]
    new = np.ones(len(at), bool)
    new[1:] = (segment[1:] != segment[:-1]) | (first[1:] != first[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    of = segment[head]
    return group[of], at[head] - start[of], at[tail] - start[of], first[head]


def _found_of(own: _Distinct, length: int) -> tuple[np.ndarray, np.ndarray]:
    """What is found in a bucket and the part it goes to, by parts.

    All windows of a segment that shares none with others occur where it does.
    """
    alone = own.alone()
    made = [(alone, np.zeros(len(alone), np.int64), own.size[alone] - length, own.least[alone])]
    made += [_merged(own, group, length) for group in own.groups(MERGED_SYMBOLS)]
    segment, low, high, first = (np.concatenate(x) for x in zip(*made))
    order = np.argsort(segment, kind="stable")
    segment, low, high, first = segment[order], low[order], high[order], first[order]
    # Every entry gets what its segment has, as far as a document of its part is later.
    begin = np.searchsorted(segment, own.entry_of, "left")
    many = np.searchsorted(segment, own.entry_of, "right") - begin
    row, entry = _spread(begin, many), np.repeat(np.arange(len(many)), many)
    useful = first[row] < own.most[entry]
    row, entry = row[useful], entry[useful]
    by_part = np.argsort(own.part[entry], kind="stable")
    row, entry = row[by_part], entry[by_part]
    found = np.empty(len(row), _FOUND)
    found["key"], found["low"], found["high"], found["first"] = own.key[segment[row]], low[row], high[row], first[row]
    return found, own.part[entry]


def _found_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            found, part = _found_of(_Distinct(rows, length), length)
            if not len(found):
                continue
            bounds = _bounds(part)
            sent = [(int(part[a]), found[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield _batch(sent, [pa.int32(), pa.binary()])

    return run


# Step 5: mark what repeats in the documents.
_MARKED_DDL = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _marked_rows(length: int):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.empty(0, _FOUND)
        for _, sent, batch in _part_rows(batches):
            if sent is not None:
                found = np.concatenate([np.empty(0, _FOUND), *[_array(s, _FOUND) for s in sent]])
                found = found[np.argsort(found["key"], kind="stable")]
                keys = np.ascontiguousarray(found["key"])
            ids = _doc_ids(batch.column(2))
            spans, kept, sizes = [], [], []
            for data, offsets, a, b in _chunks(batch, 3):
                covered = np.zeros(len(data) + 1, np.int32)
                if len(found):
                    first, last, _, _, text = segments(data, offsets, length)
                    own = span_hashes(data, first, last + length)
                    low = np.searchsorted(keys, own, "left")
                    many = np.searchsorted(keys, own, "right") - low
                    hit = _spread(low, many)
                    of = np.repeat(np.arange(len(own)), many)
                    earlier = found["first"][hit] < ids[a:b][text[of]]
                    hit, of = hit[earlier], of[earlier]
                    np.add.at(covered, first[of] + found["low"][hit], 1)
                    np.add.at(covered, first[of] + found["high"][hit] + length, -1)
                    covered = np.cumsum(covered)
                gone = covered[:-1] > 0
                before = np.zeros(len(data) + 1, bool)
                before[1:] = gone
                before[offsets] = False
                heads = np.flatnonzero(gone & ~before[:-1])
                after = np.append(gone[1:], False)
                after[offsets[1:][offsets[1:] > 0] - 1] = False
                tails = np.flatnonzero(gone & ~after) + 1
                at = np.searchsorted(heads, offsets)
                for i in range(b - a):
                    s, e = int(offsets[i]), int(offsets[i + 1])
                    x, y = int(at[i]), int(at[i + 1])
                    sizes.append(e - s)
                    spans.append(
                        [{"start": p - s, "end": q - s} for p, q in zip(heads[x:y].tolist(), tails[x:y].tolist())]
                    )
                    kept.append(data[s:e].tobytes() if x == y else data[s:e][~gone[s:e]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(sizes, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, parts: int | None = None) -> DataFrame:
    """Cut every byte covered by ``length`` bytes that start in an earlier document too.

    ``docs`` needs ``doc_id`` and ``text``, taken as UTF-8 bytes. Returns doc_id,
    n_bytes, spans (maximal removed runs) and kept (remaining bytes). Strings are
    judged on the input and never cross documents. Null and empty texts have no bytes.
    Documents with one doc_id do not cut each other; a null doc_id comes last. An empty
    table gives no rows.

    Documents are dealt to parts by a hash, anchors to buckets. Memory is bounded by a
    part's repeated segments and by ``MERGED_SYMBOLS``, but for a gram that anchors very
    many different segments. A passage that many documents share costs a part and a
    bucket one entry for each part that has it.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if parts is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(parts)).cast("int").alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text.alias("text"),
    )

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartitionById(parts, "bucket").sortWithinPartitions("bucket")

    def to_parts(sent: DataFrame) -> DataFrame:
        tagged = sent.select(
            "part", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("string").alias("text"), sent.columns[1],
        ).toDF("part", "kind", "doc_id", "text", "packed")
        own = rows.select("part", F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("packed"))
        return tagged.union(own).repartitionById(parts, "part").sortWithinPartitions("part", "kind")

    known = rows.select("part", "doc_id", "text").mapInArrow(_side_rows(parts, length), _SIDES_DDL)
    repeated = saved(by_bucket(known).mapInArrow(_repeated_rows, _REPEATED_DDL), "sides")
    distinct = to_parts(repeated).mapInArrow(_segment_rows(parts, length), _SEGMENTS_DDL)
    found = saved(by_bucket(distinct).mapInArrow(_found_rows(length), _FOUND_DDL), "found")
    return to_parts(found).mapInArrow(_marked_rows(length), _MARKED_DDL)
