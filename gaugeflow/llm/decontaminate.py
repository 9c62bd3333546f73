"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items form one suffix automaton. The words of a document are
streamed through it; the state tells the longest item substring that ends at each word.
Where it is as long as a window, the window is an occurrence: its words are hit, and
the items that hold it are reported.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.llm.common import fresh_name, pieces, saved, small_batches, tidy, utf8
from gaugeflow.llm.words import find_words, mix64

WINDOW = 13
#: A document is contaminated if so many of its words are hit, at least.
COVERAGE = 0.05
#: Words of the items that one automaton holds, about.
AUTOMATON_WORDS = 2_000_000
#: Bytes of text whose words are found together.
CHUNK_BYTES = 1 << 20


class SuffixAutomaton:
    """Suffix automaton of several word sequences, built word by word."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the strings of q that p reaches by word, set apart from q."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, word: int) -> int:
        """Append a word to the sequence that ends in state ``last``."""
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            # The split may renumber what p reaches, so link afterwards.
            self.link[new] = self._split(p, word, self.next[p][word])
        return new


@dataclass
class ItemIndex:
    """The automaton of the items' words with what a match has to be told.

    ``owners``: for states whose strings reach a window, the items that hold them.
    ``short``: for the state of a whole item of fewer words, its items.
    ``short_link``: the nearest state of that kind up the suffix links, or -1.
    """

    window: int
    words: np.ndarray
    grams: np.ndarray
    gram: int
    least: int
    automaton: SuffixAutomaton
    owners: dict[int, list[int]] = field(default_factory=dict)
    short: dict[int, list[int]] = field(default_factory=dict)
    short_link: list[int] = field(default_factory=list)

    @classmethod
    def build(cls, items: list[np.ndarray], window: int = WINDOW) -> ItemIndex:
        """``items``: word hashes of each item; items without words are ignored."""
        words = np.unique(np.concatenate(items)) if items else np.empty(0, np.uint64)
        coded = [np.searchsorted(words, item) for item in items]
        sizes = [len(c) for c in coded if len(c)]
        least = min([window, *sizes])
        gram = min(3, least)
        grams = [_gram_codes(c, gram) for c in coded if len(c) >= gram]
        sam, ends = SuffixAutomaton(), []
        for item in coded:
            last = 0
            for word in item.tolist():
                last = sam.extend(last, word)
            ends.append(last)
        grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)
        self = cls(window, words, _bits(grams), gram, least, sam)
        for i, item in enumerate(coded):
            if len(item) >= window:
                self._own(i, item.tolist())
            elif len(item):
                self.short.setdefault(ends[i], []).append(i)
        self._link_short()
        return self

    def _own(self, item: int, words: list[int]) -> None:
        """Note the item at every state that holds one of its windows."""
        sam, state = self.automaton, 0
        for word in words:
            state = sam.next[state][word]
            at = state
            # The window that ends here is in the lowest state longer than it.
            while sam.length[sam.link[at]] >= self.window:
                at = sam.link[at]
            if sam.length[at] >= self.window:
                own = self.owners.setdefault(at, [])
                if not own or own[-1] != item:
                    own.append(item)

    def _link_short(self) -> None:
        sam = self.automaton
        self.short_link = [-1] * len(sam.length)
        for state in sorted(range(1, len(sam.length)), key=sam.length.__getitem__):
            link = sam.link[state]
            self.short_link[state] = state if state in self.short else self.short_link[link]

    def walk(self, words: list[int], hit: np.ndarray, found: set[int]) -> None:
        """Stream words; mark those in an occurrence and collect the items."""
        sam, window = self.automaton, self.window
        state, length = 0, 0
        for i, word in enumerate(words):
            while state and word not in sam.next[state]:
                state = sam.link[state]
                length = sam.length[state]
            state = sam.next[state].get(word, 0)
            length = length + 1 if state else 0
            if length >= window:
                at = state
                while sam.length[sam.link[at]] >= window:
                    at = sam.link[at]
                hit[i + 1 - window : i + 1] = True
                found.update(self.owners[at])
            at = self.short_link[state]
            # Only the state itself may hold strings longer than the match.
            if at == state and at >= 0 and sam.length[at] > length:
                at = self.short_link[sam.link[at]]
            while at > 0:
                hit[i + 1 - sam.length[at] : i + 1] = True
                found.update(self.short[at])
                at = self.short_link[sam.link[at]]

    def candidates(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of words that may hold an occurrence.

        Every occurrence has ``least`` words or more, and all its short grams are grams
        of items; so only runs of such grams need the automaton. No run crosses a text.
        """
        n, g = len(codes), self.gram
        if n < g:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        known = codes >= 0
        ok = known[: n - g + 1].copy()
        for k in range(1, g):
            ok &= known[k : n - g + 1 + k]
        for cut in range(1, g):
            # Grams that reach over the start of a text.
            at = bounds[1:-1] - cut
            ok[at[(at >= 0) & (at < len(ok))]] = False
        ok[ok] = _has(self.grams, _gram_codes_at(codes, g, np.flatnonzero(ok)))
        # Runs also end at a text's start, which a gram of one word does not see.
        edge = np.zeros(len(ok) + 1, bool)
        edge[bounds[(bounds >= 0) & (bounds <= len(ok))]] = True
        previous = np.concatenate([[False], ok])
        current = np.concatenate([ok, [False]])
        starts = np.flatnonzero(current & (~previous | edge))
        ends = np.flatnonzero(previous & (~current | edge))
        long = ends - starts >= self.least - g + 1
        return starts[long], ends[long] + g - 1


_GRAM_BITS = 22


def _gram_codes(codes: np.ndarray, g: int) -> np.ndarray:
    return _gram_codes_at(codes, g, np.arange(len(codes) - g + 1))


def _gram_codes_at(codes: np.ndarray, g: int, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), np.uint64)
    for k in range(g):
        h = mix64(h + codes[at + k].astype(np.uint64) + np.uint64(1))
    return h


def _bits(grams: np.ndarray) -> np.ndarray:
    """A bitmap of hashed grams: some that are no item's may pass, none is missed."""
    table = np.zeros(1 << _GRAM_BITS, bool)
    table[grams >> np.uint64(64 - _GRAM_BITS)] = True
    return table


def _has(table: np.ndarray, grams: np.ndarray) -> np.ndarray:
    return table[grams >> np.uint64(64 - _GRAM_BITS)]


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edges[0::2], edges[1::2]


_OUT = [
    ("n_words", pa.int64()),
    ("n_hit", pa.int64()),
    ("item_ids", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))),
]
_OUT_DDL = (
    "n_words long, n_hit long, item_ids array<string>, "
    "spans array<struct<start: long, end: long, words: long>>"
)


#: What one automaton's pass hands on to the next: runs of hit words, and items.
_CARRIED = [
    ("hits", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ("items", pa.list_(pa.string())),
]
_CARRIED_DDL = "array<struct<first: long, last: long>>", "array<string>"

Automaton = tuple[ItemIndex, list[str]]


def _judge(text_column: int, automaton: Automaton | None, carried: bool, last: bool):
    """One pass of whole texts through one automaton. With ``carried``, the last two columns
    are what the pass before has found; the ``last`` pass gives the result."""
    kinds = [kind for _, kind in (_OUT if last else _CARRIED)]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = utf8(batch.column(text_column))
        before = [batch.column(i).to_pylist() for i in (-2, -1)] if carried else None
        rows: list[tuple] = []
        for a, b in pieces(np.diff(offsets), CHUNK_BYTES):
            own = offsets[a : b + 1] - offsets[a]
            found = [x[a:b] for x in before] if before else None
            rows += _judge_texts(data[offsets[a] : offsets[b]], own, automaton, found, last)
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    return run


def _judge_texts(data: np.ndarray, offsets: np.ndarray, automaton, before, last: bool) -> list[tuple]:
    starts, ends, hashes, bounds = find_words(data, offsets)
    hit = np.zeros(len(hashes), bool)
    found: dict[int, set[str]] = {}
    for text, (runs, items) in enumerate(zip(*before) if before else ()):
        for run in runs:
            hit[bounds[text] + run["first"] : bounds[text] + run["last"]] = True
        if items:
            found[text] = set(items)
    if automaton and len(automaton[0].words):
        index, ids = automaton
        at = np.minimum(np.searchsorted(index.words, hashes), len(index.words) - 1)
        codes = np.where(index.words[at] == hashes, at, -1)
        runs = index.candidates(codes, bounds)
        texts = np.searchsorted(bounds, runs[0], "right") - 1
        for s, e, text in zip(*(x.tolist() for x in runs), texts.tolist()):
            own: set[int] = set()
            index.walk(codes[s:e].tolist(), hit[s:e], own)
            if own:
                found.setdefault(text, set()).update(ids[i] for i in own)
    rows = []
    for text, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        first, end = _spans(hit[s:e]) if text in found else (np.empty(0, np.int64),) * 2
        items = sorted(found.get(text, ()))
        if not last:
            rows.append(([{"first": x, "last": y} for x, y in zip(first.tolist(), end.tolist())], items))
            continue
        spans = [
            {
                "start": int(starts[s + x] - offsets[text]),
                "end": int(ends[s + y - 1] - offsets[text]),
                "words": int(y - x),
            }
            for x, y in zip(first.tolist(), end.tolist())
        ]
        rows.append((e - s, int(hit[s:e].sum()), items, spans))
    return rows


def _built(window: int):
    """Automata of the items of each part, which come sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, ids = None, [], []

        def made() -> pa.RecordBatch:
            blob = pickle.dumps((ItemIndex.build(held, window), ids), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=["part", "automaton"])

        for batch in batches:
            data, offsets = utf8(batch.column(2))
            _, _, hashes, bounds = find_words(data, offsets)
            for i, (own, item) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if own != part and ids:
                    yield made()
                    held, ids = [], []
                part = own
                held.append(hashes[bounds[i] : bounds[i + 1]])
                ids.append(item)
        if ids:
            yield made()

    return run


def item_automata(items: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """(part, automaton): automata over all items of (item_id, text), each of about
    ``most_words`` words, built by executor tasks and kept in the shared folder.

    Items are dealt to as many automata as their words need. Null texts have no words; a
    null id counts as ``null``.
    """
    rows = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    words = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    parts = max(1, -(-words // most_words))
    dealt = rows.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int").alias("part"), "item_id", "text")
    ordered = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "item_id", "text")
    return saved(ordered.mapInArrow(_built(window), "part int, automaton binary"), "automata")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    coverage: float = COVERAGE,
    columns=None,
    most_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """Benchmark passages in every document.

    ``docs`` needs ``text`` and ``columns`` (default doc_id); ``items``: item_id, text.
    Returns ``columns``, n_words, n_hit (words in an occurrence of a window), item_ids
    (of occurring windows, sorted, each once), spans (bytes and words of the runs of
    hit words) and contaminated: some words are hit, and at least the share
    ``coverage``. A window is ``window`` consecutive words of an item, or a whole item
    of fewer. Null and empty texts have no words; without items nothing is hit.
    Repeated rows each get a row.

    A pass over the documents for each automaton (see ``item_automata``), no shuffle. One
    automaton of about ``most_words`` words, bounded, is broadcast at a time; between
    passes the documents and what was found are written to the shared folder.
    """
    spark = docs.sparkSession
    small_batches(spark)
    automata = item_automata(items, window, most_words)
    parts = sorted(r["part"] for r in automata.select("part").collect()) or [None]
    columns = list(columns or ["doc_id"])
    picked = docs.select(*columns, *([] if "text" in columns else ["text"]))
    place = picked.columns.index("text")
    hits, found = (fresh_name(picked.columns, n) for n in ("_hits", "_items"))
    own = picked.schema.fields
    carried = T.StructType([*own, *T.StructType.fromDDL(f"`{hits}` {_CARRIED_DDL[0]}, `{found}` {_CARRIED_DDL[1]}").fields])
    final = T.StructType([*own, *T.StructType.fromDDL(_OUT_DDL).fields])
    rows = picked
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        blob = None if part is None else bytes(automata.where(F.col("part") == part).first()["automaton"])
        shared = spark.sparkContext.broadcast(pickle.loads(blob) if blob else None)
        schema = final if last else carried
        passed = rows.mapInArrow(tidy(_pass(shared, place, len(own), i > 0, last, schema.names)), schema)
        rows = passed if last else saved(passed, f"pass-{i}")
        if not last:
            shared.destroy()
    share = F.col("n_hit") >= F.lit(coverage) * F.col("n_words")
    if coverage == COVERAGE:
        share = 20 * F.col("n_hit") >= F.col("n_words")
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & share).drop(
        *([] if "text" in columns else ["text"])
    )


def _pass(shared, place: int, own: int, carried: bool, last: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(place, shared.value, carried, last)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *judge(batch)], names=names)

    return run


def without_spans(text: Column, spans: Column) -> Column:
    """The text with its spans (see ``contamination``) cut out, as an expression."""
    raw = text.cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(raw).cast("long")))
    kept = F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda g: F.decode(
            F.substring(raw, (g["s"] + 1).cast("int"), (g["e"] - g["s"]).cast("int")), "UTF-8"
        ),
    )
    return F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(text)


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, text) of every document, the hit spans cut out of contaminated ones."""
    found = contamination(docs, items, window, coverage, ["doc_id", "text"])
    cut = without_spans(F.col("text"), F.col("spans"))
    return found.select("doc_id", F.when(F.col("contaminated"), cut).otherwise(F.col("text")).alias("text"))
