"""Sharding by minimax contiguous partition.

The atomic groups (equal texts) stand in the order of a 64-bit hash of their text.
The smallest capacity with which a greedy walk needs no more than the given number
of shards is found by binary search, and the order is cut there.

The walk needs prefix sums of the group sizes only near its cuts. So the ordered
groups are first summed over equal ranges of the hash (one aggregation, a bounded
number of rows), which brackets the capacity and every cut from below and above;
only ranges that a cut may fall into are summed again, finer, until nothing is open.
The result is exact for any number of groups, and what the driver holds is bounded
by ``SEGMENTS`` rows a round.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeflow.llm.common import saved, whole_text

#: Most ranges summed in one round, as a power of two.
SEGMENT_BITS = 16
#: Bytes every document costs besides its text.
OVERHEAD = 8
#: Rows numbered by one task, about.
SLOT_ROWS = 50_000

_LOWEST = -(1 << 63)


@dataclass
class _Segment:
    """Consecutive groups: those whose hash shares all but the lowest ``width`` bits."""

    start: int
    width: int
    size: int
    groups: int

    @property
    def atomic(self) -> bool:
        return self.groups <= 1 or self.width == 0


class _Line:
    """The segments in order with their prefix sums."""

    def __init__(self, segments: list[_Segment]):
        self.segments = sorted(segments, key=lambda s: s.start)
        self.ends = [0]
        for s in self.segments:
            self.ends.append(self.ends[-1] + s.size)
        self.total = self.ends[-1]

    def below(self, x: int) -> int:
        """The largest known boundary up to ``x``."""
        return self.ends[bisect_right(self.ends, x) - 1]

    def within(self, x: int) -> int:
        """The largest value up to ``x`` that may be a boundary."""
        if x >= self.total:
            return self.total
        at = bisect_right(self.ends, x) - 1
        return self.ends[at] if self.segments[at].atomic else x

    def walk(self, capacity: int, shards: int, step, start: int = 0) -> list[int]:
        cuts = [start]
        for _ in range(shards):
            cuts.append(step(cuts[-1] + capacity))
        return cuts

    def smallest(self, shards: int, step) -> int:
        """The smallest capacity whose walk reaches the end."""
        low, high = -(-self.total // shards) - 1, self.total
        while high - low > 1:
            middle = (low + high) // 2
            if self.walk(middle, shards, step)[-1] >= self.total:
                high = middle
            else:
                low = middle
        return high

    def open_segments(self, shards: int) -> tuple[list[_Segment], int]:
        """Segments a cut of the smallest capacity may fall into, and that capacity."""
        high = self.smallest(shards, self.below)
        low = self.smallest(shards, self.within)
        found: dict[int, _Segment] = {}
        nearest = self.walk(low, shards, self.below)
        farthest = self.walk(high, shards, self.within)
        for a, b in zip(nearest[1:], farthest[1:]):
            at = max(0, bisect_right(self.ends, a) - 1)
            while at < len(self.segments) and self.ends[at] <= b:
                if not self.segments[at].atomic and a < self.ends[at + 1]:
                    found[self.segments[at].start] = self.segments[at]
                at += 1
        return list(found.values()), high

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Ends of the shards: as even as the capacity allows, else the greedy walk's.

        Every shard but the last ends at the boundary nearest to an equal share of
        the rest, if what remains still fits the remaining shards.
        """
        ends = [0]
        for left in range(shards, 1, -1):
            here = ends[-1]
            ideal = here + -(-(self.total - here) // left)
            lower = self.below(ideal)
            upper = self.ends[min(bisect_right(self.ends, ideal), len(self.ends) - 1)]
            tries = sorted({lower, upper, self.below(here + capacity)}, key=lambda p: abs(p - ideal))
            for p in tries:
                fits = here <= p <= here + capacity
                if fits and self.walk(capacity, left - 1, self.below, p)[-1] >= self.total:
                    ends.append(p)
                    break
            else:
                return self.walk(capacity, shards, self.below)[1:]
        return [*ends[1:], self.total]


def _segments(groups: DataFrame, width: int, within: list[_Segment] | None) -> list[_Segment]:
    """Sums over the hash ranges of ``width`` bits, of all or of the given segments."""
    if within is not None:
        parent = within[0].width
        wanted = groups.sparkSession.createDataFrame(
            [(s.start >> parent,) for s in within], "parent long"
        )
        groups = groups.withColumn("parent", F.shiftright("key", parent)).join(
            F.broadcast(wanted), "parent", "left_semi"
        )
    sums = groups.groupBy(F.shiftright("key", width).alias("range")).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("groups")
    )
    return [_Segment(r["range"] << width, width, r["bytes"], r["groups"]) for r in sums.collect()]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity and the first hash of every shard but the first.

    ``groups``: (key long, bytes long), one row per atomic group. A shard without
    groups has no first hash, so the list may be shorter.
    """
    width = 64 - SEGMENT_BITS
    line = _Line(_segments(groups, width, None))
    if not line.total:
        return 0, []
    while True:
        todo, capacity = line.open_segments(shards)
        if not todo:
            break
        # Segments differ in width once some are refined: take the widest first.
        widest = max(s.width for s in todo)
        todo = [s for s in todo if s.width == widest]
        room = (1 << SEGMENT_BITS) // len(todo)
        finer = max(0, widest - max(1, room.bit_length() - 1))
        gone = {s.start for s in todo}
        rest = [s for s in line.segments if not (s.width == widest and s.start in gone)]
        line = _Line(rest + _segments(groups, finer, todo))
    starts = dict(zip(line.ends, (s.start for s in line.segments)))
    ends = [e for e in line.cuts(capacity, shards)[:-1] if e < line.total]
    return capacity, [_LOWEST if e == 0 else starts[e] for e in ends]


def minimax_shards(docs: DataFrame, shards: int = 24, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Shard and slot of every document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Returns
    doc_id, size (UTF-8 bytes and ``OVERHEAD``), text_crc32, shard (0 to shards - 1)
    and slot (0, 1, ... in each shard). Equal texts share a shard; null counts as
    the empty text. A group larger than an equal share fills a shard of its own
    size, others stay as even as that allows. Repeated rows each get a slot. An
    empty table gives no rows.

    Only one row per distinct text and 40 bytes per document are shuffled. Slots
    are numbered in parts of about ``slot_rows`` rows, dealt by the hash of the
    document's id, so that neither a shard nor a group of copies meets in one task.
    """
    text = whole_text()
    rows = saved(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "rows",
    )
    groups = saved(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    _, firsts = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for first in firsts:
        shard = shard + (F.col("key") >= F.lit(first)).cast("int")
    count = rows.count()
    parts = max(1, -(-count // (slot_rows * shards)))
    placed = rows.select(
        "doc_id",
        "size",
        "text_crc32",
        shard.cast("int").alias("shard"),
        F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(parts)).cast("int").alias("part"),
    )
    by_shard = Window.partitionBy("shard").orderBy("part")
    offsets = (
        placed.groupBy("shard", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(by_shard) - F.col("n"))
        .drop("n")
    )
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("row", F.row_number().over(order))
        .join(offsets, ["shard", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            "shard",
            (F.col("before") + F.col("row") - 1).cast("long").alias("slot"),
        )
    )
