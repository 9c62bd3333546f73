"""What each of several filters removes, alone and with the others.

Every document is judged by all filters once; the failed ones are a bit mask. Counts per
part and mask give the removals of all coalitions of filters. Their differences are the
steps of every order of the filters, and the Shapley values are the solution of the
kernel-weighted least squares problem over the coalitions under the efficiency
constraint, solved in rationals.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import WORD, saved, whole_text

#: Names of the filters of ``failed_filters``, in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS = 200

_STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def failed_filters(docs: DataFrame) -> DataFrame:
    """doc_id, part and ``failed``, the mask of the filters that a document fails.

    Bit 0 (A): under 200 words. Bit 1 (B): 100 * distinct words < 50 * words. Bit 2 (C):
    100 * letters A-Z > 2 * code points. Bit 3 (D): one of ``#$%&*|``. Bit 4 (E): equal to
    the text of a row with a smaller doc_id. Null texts are empty, null sources the part
    ''. A row without doc_id has none before it and is before none, so it does not fail E;
    of rows with one doc_id and one text, none is before the other.

    Texts are equal if their SHA-256 is. The rows that come first among their like are
    found by (text, doc_id), so that a text held by very many rows is spread.
    """
    text = whole_text()
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    judged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.size(words).alias("n_words"),
        F.size(F.array_distinct(words)).alias("n_distinct"),
        capitals.alias("capitals"),
        F.length(text).alias("points"),
        text.rlike(r"[#$%&*|]").alias("marked"),
    )
    bits = [
        F.col("n_words") < LEAST_WORDS,
        F.col("n_distinct").cast("long") * 100 < F.col("n_words").cast("long") * 50,
        F.col("capitals").cast("long") * 100 > F.col("points").cast("long") * 2,
        F.col("marked"),
    ]
    judged = saved(judged.select("doc_id", "part", "digest", _mask(bits).alias("failed")), "judged")
    firsts = judged.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    later = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return judged.join(firsts.withColumn("first", F.lit(1)), ["digest", "doc_id"], "left").select(
        "doc_id", "part", (F.col("failed") + F.when(later, 16).otherwise(0)).alias("failed")
    )


def _mask(bits: Sequence[Column]) -> Column:
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def coalition_removals(failed: DataFrame, n: int = len(FILTERS)) -> DataFrame:
    """part, documents, and what every coalition of filters removes of it.

    ``failed`` needs part, failed (mask) and the flags good and toxic. ``removed``, ``good``
    and ``toxic`` are arrays of 2^n counts; the coalition's mask is the place in the array.
    """
    cells = failed.groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("good").cast("long")).alias("good"),
        F.sum(F.col("toxic").cast("long")).alias("toxic"),
    )
    hit = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    removals = (
        cells.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
        .groupBy("part", "coalition")
        .agg(
            F.sum("n").alias("documents"),
            *[F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(c) for c in ("n", "good", "toxic")],
        )
    )
    rows = F.sort_array(F.collect_list(F.struct("coalition", "n", "good", "toxic")))  # 2^n of them
    table = removals.groupBy("part").agg(F.first("documents").alias("documents"), rows.alias("rows"))
    return table.select(
        "part",
        "documents",
        *[F.col(f"rows.{c}").alias(name) for c, name in (("n", "removed"), ("good", "good"), ("toxic", "toxic"))],
    )


def _eliminated(matrix: list[list[Fraction]]) -> list[list[Fraction]]:
    """The inverse of a regular matrix, by Gauss-Jordan elimination in rationals."""
    n = len(matrix)
    rows = [row + [Fraction(int(i == j)) for j in range(n)] for i, row in enumerate(matrix)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                factor = rows[r][i]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


def _kernel(n: int, size: int) -> Fraction:
    return Fraction(n - 1, math.comb(n, size) * size * (n - size))


@lru_cache(maxsize=8)
def _normal_inverse(n: int) -> list[list[Fraction]]:
    """Inverse of the normal equations' matrix, bordered by the efficiency constraint."""
    inner = [s for s in range(1, (1 << n) - 1)]
    weight = {s: _kernel(n, s.bit_count()) for s in inner}
    matrix = [
        [sum((weight[s] for s in inner if s >> i & 1 and s >> j & 1), Fraction(0)) for j in range(n)]
        + [Fraction(1)]
        for i in range(n)
    ]
    return _eliminated([*matrix, [Fraction(1)] * n + [Fraction(0)]])


def shapley_values(values: Sequence[int], n: int) -> list[Fraction]:
    """The game's Shapley values: weights x that minimise the kernel-weighted squares of
    values[S] - sum of x over S, summed over all coalitions S but none and all, given
    that x adds up to values[all]. ``values[0]`` is 0."""
    if n == 1:
        return [Fraction(values[1])]
    right = [
        sum((_kernel(n, s.bit_count()) * values[s] for s in range(1, (1 << n) - 1) if s >> i & 1), Fraction(0))
        for i in range(n)
    ] + [Fraction(values[-1])]
    return [sum((a * b for a, b in zip(row, right)), Fraction(0)) for row in _normal_inverse(n)[:n]]


def audit_rows(part: str, documents: int, removed, good, toxic, names: str = FILTERS) -> Iterator[tuple]:
    """A row for each order of the filters and each step of it."""
    n = len(names)
    everyone = (1 << n) - 1
    orders = math.factorial(n)
    shares = [int(x * orders) for x in shapley_values(removed, n)]  # whole: sums over orders
    unique = [removed[everyone] - removed[everyone & ~(1 << i)] for i in range(n)]
    for order in itertools.permutations(range(n)):
        label = "".join(names[i] for i in order)
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = removed[after] - removed[before]
            yield (
                part, label, step, documents - removed[after], gone, removed[1 << i] - gone,
                unique[i], good[after] - good[before], toxic[after] - toxic[before], shares[i],
            )
            before = after


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every step of every order of the five filters, for each part of ``docs``.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley (the filter's removals summed over all orders). Of several labels
    of one document, one with quality 1 makes it good and one with toxic 1 makes it toxic;
    labels without doc_id are left out. A repeated row counts each time. Documents
    without text fail A. Other columns play no part. An empty table has no parts, so no
    rows.
    """
    flags = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"),
            F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
        )
    )
    flagged = (
        failed_filters(docs)
        .join(flags, "doc_id", "left")
        .select("part", "failed", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    )

    def steps(batches):
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():  # one per part
                columns = list(zip(*audit_rows(**row)))
                schema = _arrow_steps()
                arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return coalition_removals(flagged).mapInArrow(steps, _STEPS)


def _arrow_steps():
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in _STEPS.split(", "))])
