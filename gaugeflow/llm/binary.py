"""Token ids of a corpus in files, entropy coded.

Documents are put in ascending doc_id order, tokenised, and written as segments: whole
documents of together some millions of ids, with one frequency table over all their ids
and independent coded blocks (see ``rans``). A file is Parquet, one segment a row, in
the shared folder; the coded columns are not compressed again.

    part, segment    place in the order: files by part, rows by segment
    doc_ids, counts  documents of the segment and their numbers of ids
    n_ids            all ids
    table            frequency table
    blocks           coded blocks, each with checkpoints and checksums
    crc32            of the segment's ids as little-endian unsigned 32-bit integers
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeflow.llm import rans
from gaugeflow.llm.bpe import encoder
from gaugeflow.llm.common import scratch, small_batches, tidy, utf8

#: Ids of a segment, at least, unless the part ends.
SEGMENT_IDS = 1 << 20

_SEGMENT = pa.schema(
    [
        ("part", pa.int32()),
        ("segment", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
        ("n_ids", pa.int64()),
        ("table", pa.binary()),
        ("blocks", pa.list_(pa.binary())),
        ("crc32", pa.int64()),
    ]
)
_SEGMENT_DDL = (
    "part int, segment int, doc_ids array<long>, counts array<long>, n_ids long, "
    "table binary, blocks array<binary>, crc32 long"
)


def _segment(part: int, number: int, doc_ids: list, counts: list[int], ids: np.ndarray) -> pa.RecordBatch:
    table = rans.Table.of(ids)
    blocks = [
        rans.encode_block(ids[at : at + rans.BLOCK_IDS], table).to_bytes()
        for at in range(0, len(ids), rans.BLOCK_IDS)
    ]
    values = (
        part, number, doc_ids, counts, len(ids), table.to_bytes(), blocks,
        zlib.crc32(ids.astype("<u4").tobytes()),
    )
    return pa.RecordBatch.from_arrays(
        [pa.array([v], f.type) for v, f in zip(values, _SEGMENT)], schema=_SEGMENT
    )


def _encode(path: str, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = encoder(path)
        part, number = TaskContext.get().partitionId(), 0
        held, doc_ids, counts, size = [], [], [], 0
        for batch in batches:
            ids, lengths = own.encode(*utf8(batch.column(1)))
            # The end id goes behind each document.
            ids = np.insert(ids, np.cumsum(lengths), end_id).astype(np.uint32)
            ends = np.cumsum(lengths + 1)
            names, first = batch.column(0).to_pylist(), 0
            while first < len(names):
                # Whole documents until the segment is full.
                start = int(ends[first - 1]) if first else 0
                last = int(np.searchsorted(ends, start + segment_ids - size)) + 1
                last = min(len(names), last)
                end = int(ends[last - 1])
                held.append(ids[start:end])
                doc_ids += names[first:last]
                counts += (lengths[first:last] + 1).tolist()
                size += end - start
                first = last
                if size >= segment_ids:
                    yield _segment(part, number, doc_ids, counts, np.concatenate(held))
                    number += 1
                    held, doc_ids, counts, size = [], [], [], 0
        if doc_ids:
            yield _segment(part, number, doc_ids, counts, np.concatenate(held))

    return run


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, segment_ids: int = SEGMENT_IDS
) -> str:
    """Write the ids of every whole text of ``docs`` (doc_id, text) and return the path.

    ``tokenizer``: a tokenizer file that the executors can open. Null and empty texts
    have the end id only. Documents with the same doc_id stand next to each other, by
    their text. An empty table gives files without segments. One shuffle, by ranges of
    doc_id, whose number adaptive execution fits to their size; a task holds one
    segment and the longest document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or scratch(spark, "tokens")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    segments = ordered.mapInArrow(tidy(_encode(tokenizer, end_id, segment_ids)), _SEGMENT_DDL)
    segments.write.option("compression", "none").parquet(path)
    return path


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            table = rans.Table.from_bytes(row["table"])
            slots = table.slots()
            blocks = [rans.decode_block(rans.Block.from_bytes(b), table, slots) for b in row["blocks"]]
            ids = np.concatenate(blocks) if blocks else np.empty(0, np.uint32)
            if zlib.crc32(ids.astype("<u4").tobytes()) != row["crc32"]:
                raise rans.Corrupt(f"segment {row['part']}/{row['segment']}")
            counts = np.array(row["counts"], np.int64)
            starts = np.cumsum(counts) - counts
            own = [ids[s : s + n].tobytes() for s, n in zip(starts.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["part"]] * len(own), pa.int32()),
                    pa.array([row["segment"]] * len(own), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(starts),
                    pa.array(counts),
                    pa.array(own, pa.binary()),
                ],
                names=["part", "segment", "doc_id", "place", "n_tokens", "ids"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: part, segment, doc_id, place (ids of the segment before
    it), n_tokens and ids (little-endian unsigned 32-bit integers).

    Each segment is decoded on its own and checked against its checksums.
    """
    small_batches(spark)
    return spark.read.schema(_SEGMENT_DDL).parquet(path).mapInArrow(
        tidy(_decode), "part int, segment int, doc_id long, place long, n_tokens long, ids binary"
    )


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, segment, first): the ids of all segments before each; reads no blocks.

    Only one row per part is ordered in one task; segments are ordered within theirs.
    """
    sizes = spark.read.schema(_SEGMENT_DDL).parquet(path).select("part", "segment", "n_ids")
    by_part = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = by_part.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    inside = Window.partitionBy("part").orderBy("segment")
    return (
        sizes.withColumn("inside", F.sum("n_ids").over(inside) - F.col("n_ids"))
        .join(parts, "part")
        .select("part", "segment", (F.col("before") + F.col("inside")).alias("first"))
    )


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every
    document, decoded from the files."""
    rows = read_tokens(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return rows.join(segment_starts(spark, path), ["part", "segment"]).select(
        "doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )
