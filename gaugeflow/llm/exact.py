"""Exact deduplication with an extendible-hash index on shared files.

Texts are normalised and hashed to 64 bits. A directory maps the leading bits of the
hash to buckets; it doubles until no bucket holds more distinct hashes than its
capacity. A bucket is a range of hashes and each task owns a larger range: it walks its
entries in hash order, keeps the distinct texts of a hash as a chain, compares bytes,
and writes one index entry per distinct text to its own file in the shared folder.
The documents then look themselves up in the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeflow.llm.common import SPACE, saved, small_batches, whole_text

#: Distinct hashes a bucket holds before it splits.
BUCKET_CAPACITY = 4096
#: Bytes of text a task combines before it passes them on.
COMBINE_BYTES = 32 << 20
#: Buckets of one owner task.
OWNED_BUCKETS = 2
#: Leading bits of a hash that the directory can tell apart: enough for 10^13 texts.
DIRECTORY_BITS = 32

_ENTRY = pa.schema(
    [
        ("bucket", pa.int64()),
        ("key", pa.int64()),
        ("norm", pa.large_binary()),
        ("keep_id", pa.int64()),
        ("group_size", pa.int64()),
    ]
)
_ENTRY_DDL = "bucket long, key long, norm binary, keep_id long, group_size long"


def normalised(column: str = "text") -> Column:
    """Each run of white space as one blank; null counts as empty."""
    return F.regexp_replace(whole_text(column), SPACE, " ")


def hash_key(norm: Column, hash_bits: int = 64) -> Column:
    """The leading ``hash_bits`` bits of a 64-bit hash; fewer only to test collisions."""
    key = F.xxhash64(norm)
    return key if hash_bits == 64 else F.shiftleft(F.shiftright(key, 64 - hash_bits), 64 - hash_bits)


def directory(keys: DataFrame, capacity: int = BUCKET_CAPACITY) -> DataFrame:
    """Buckets (depth, prefix, bucket) of an extendible-hash directory over ``key``.

    A bucket of local depth d holds the hashes with one d-bit prefix. Starting from
    the empty prefix, buckets above ``capacity`` split into two while the directory
    doubles. One hash stays in one bucket whatever its number of copies: only distinct
    hashes count. Buckets are numbered in hash order. The directory holds about two
    rows per ``capacity`` distinct hashes, and splits are found by aggregations over
    the leaves that are still open, so it never needs the driver's memory.
    """
    # Counts of prefixes finer than any bucket.
    fine = saved(
        keys.select("key")
        .distinct()
        .groupBy(F.shiftright("key", 64 - DIRECTORY_BITS).alias("fine"))
        .agg(F.count("*").alias("n")),
        "fine",
    )
    depth, leaves, full = 0, None, None
    while True:
        prefix = F.shiftright("fine", DIRECTORY_BITS - depth) if depth else F.lit(0).cast("long")
        load = fine.groupBy(prefix.alias("prefix")).agg(
            F.sum("n").alias("n"), F.count("*").alias("fines")
        )
        load = saved(
            load.select("prefix", ((F.col("n") > capacity) & (F.col("fines") > 1)).alias("full")), "load"
        )
        done = load.where(~F.col("full"))
        if full is not None:
            parent = F.shiftright("prefix", 1) if depth > 1 else F.lit(0).cast("long")
            done = done.withColumn("parent", parent).join(full, "parent", "left_semi")
        done = done.select(F.lit(depth).alias("depth"), "prefix")
        leaves = done if leaves is None else leaves.union(done)
        full = load.where("full").select(F.col("prefix").alias("parent"))
        if full.isEmpty():
            return leaves
        depth += 1


def bucket_of(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Add ``bucket``: the first hash of the row's bucket, a multiple of its range."""
    depths = [r[0] for r in leaves.select("depth").distinct().collect()]  # few, as hashes are even
    bucket = F.lit(0).cast("long") if not depths else None
    for i, depth in enumerate(sorted(depths)):
        prefix = F.shiftright("key", 64 - depth) if depth else F.lit(0).cast("long")
        first = F.shiftleft(prefix, 64 - depth) if depth else F.lit(0).cast("long")
        if len(depths) == 1:
            return rows.withColumn("bucket", first)
        own = leaves.where(F.col("depth") == depth).select(F.col("prefix").alias("_p"), F.lit(1).alias(f"_at{i}"))
        rows = rows.withColumn("_p", prefix).join(own, "_p", "left").drop("_p")
        here = F.when(F.col(f"_at{i}").isNotNull(), first)
        bucket = here if bucket is None else F.coalesce(bucket, here)
    return rows.withColumn("bucket", bucket).drop(*[f"_at{i}" for i in range(len(depths))])


def owner_of(bucket: Column, bits: int) -> Column:
    """The owner task of a bucket, one of 2^``bits``: owners have equal ranges of hashes."""
    return F.shiftrightunsigned(bucket, 64 - bits).cast("int") if bits else F.lit(0)


def _chain(chains: dict, key: int, text, doc_id, size: int, bucket: int) -> int:
    """Put one text into its hash's chain; returns the bytes this adds."""
    chain = chains.setdefault(key, [])
    for link in chain:
        if link[0] == text:
            if doc_id is not None and (link[1] is None or doc_id < link[1]):
                link[1] = doc_id
            link[2] += size
            return 0
    chain.append([text, doc_id, size, bucket])
    return len(text) + 200


def _entries(chains: dict) -> pa.RecordBatch:
    rows = [(bucket, key, text, doc, n) for key, chain in chains.items() for text, doc, n, bucket in chain]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], field.type) for i, field in enumerate(_ENTRY)], schema=_ENTRY
    )


def _combine(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """One entry for equal texts that meet in a task, before the shuffle."""
    chains, held = {}, 0
    for batch in batches:
        for doc_id, key, text, bucket in zip(*(batch.column(i).to_pylist() for i in range(4))):
            held += _chain(chains, key, text, doc_id, 1, bucket)
            if held > limit:
                yield _entries(chains)
                chains, held = {}, 0
    if chains:
        yield _entries(chains)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Close the chains of an owner's entries, which come in the order of their hash."""
    chains, held = {}, 0
    for batch in batches:
        for bucket, key, text, doc_id, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if key not in chains and held > 4 << 20:
                yield _entries(chains)
                chains, held = {}, 0
            held += _chain(chains, key, text, doc_id, n, bucket)
    if chains:
        yield _entries(chains)


def exact_groups(
    docs: DataFrame,
    capacity: int = BUCKET_CAPACITY,
    hash_bits: int = 64,
    combine_bytes: int = COMBINE_BYTES,
) -> DataFrame:
    """Group of equal texts of every document.

    ``docs`` needs ``doc_id`` and ``text``. Texts are equal when their bytes are, after
    each run of white space became one blank; null counts as empty. Returns doc_id,
    keep_id (smallest doc_id of the group), group_size, kept, text_sha256. Of rows that
    repeat a doc_id and its text one is kept. A null doc_id is never kept beside
    another id. An empty table gives no rows.

    Texts are shuffled once, after equal ones were combined in each task, so a text
    with very many copies costs its owner one entry per task. The look-up joins on the
    hash, and adaptive execution may split a hash that a third of all rows have.
    """
    small_batches(docs.sparkSession)
    base = docs.select("doc_id", normalised().alias("norm"))
    base = base.withColumn("key", hash_key(F.col("norm"), hash_bits))
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    repeats = Window.partitionBy("doc_id", "key", "text_sha256").orderBy("doc_id")
    rows = saved(
        base.select("doc_id", "key", digest.alias("text_sha256")).withColumn(
            "again", F.row_number().over(repeats) > 1
        ),
        "rows",
    )
    leaves = saved(directory(rows, capacity), "directory")
    located = bucket_of(base, leaves).select("doc_id", "key", F.col("norm").cast("binary").alias("norm"), "bucket")
    owner_bits = (max(1, -(-leaves.count() // OWNED_BUCKETS)) - 1).bit_length()
    entries = located.mapInArrow(partial(_combine, limit=combine_bytes), _ENTRY_DDL)
    entries = entries.withColumn("owner", owner_of(F.col("bucket"), owner_bits))
    owned = entries.repartitionById(1 << owner_bits, "owner").drop("owner").sortWithinPartitions("bucket", "key")
    index = owned.mapInArrow(_walk, _ENTRY_DDL).select(
        "bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"
    )
    index = saved(index, "index")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("again")
    return rows.join(index.drop("bucket"), ["key", "text_sha256"], "left").select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"
    )
