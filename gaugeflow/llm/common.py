"""What the corpus operators share: intermediate tables, batches, small helpers."""

from __future__ import annotations

import ctypes
import uuid
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeflow.session import shared_dir

#: White space of the contracts: blank, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share, removed when the session ends."""
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame written to the shared folder and read back: a cut of the lineage
    that survives lost executors, and lets later readers prune columns."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Records in one Arrow batch: texts are long, so far fewer than Spark's default.
BATCH_RECORDS = 256


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, unless the user chose a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_RECORDS))


def pieces(lengths: np.ndarray, most: int):
    """Ranges of consecutive texts of together at most ``most`` bytes, or of one text."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


def _give_back() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def tidy(rows):
    """A function for ``mapInArrow`` that, at the end of a task, gives the memory it has freed
    back to the system. Python workers live on from task to task and stage to stage, idle
    ones too, and would keep it beside the executor's heap."""

    @wraps(rows)
    def run(batches):
        yield from rows(batches)
        _give_back()

    return run


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array, and the offset of each text and the end.

    Null counts as empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    if buffers[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def fresh_name(columns, base: str) -> str:
    """``base``, with as many underscores as make it none of ``columns``."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def with_row_ids(docs: DataFrame, name: str = "_row") -> DataFrame:
    """Add a long that is different for every row and the same in reruns.

    It is doc_id where that is there and not repeated. Other rows get a negative number
    from their doc_id, text and count among their like. ``name`` must be none of the
    columns of ``docs``, see :func:`fresh_name`.
    """
    odd_id, is_odd, key, nth = (fresh_name([*docs.columns, name], f"_{n}") for n in ("odd", "is_odd", "key", "nth"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").count()
    odd = saved(ids.where((F.col("count") > 1) | F.col("doc_id").isNull()).select("doc_id"), "odd")
    if odd.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    flagged = docs.join(odd.select(F.col("doc_id").alias(odd_id), F.lit(1).alias(is_odd)),
                        F.col("doc_id").eqNullSafe(F.col(odd_id)), "left").drop(odd_id)
    like = Window.partitionBy(key).orderBy("doc_id")
    plain = flagged.where(F.col(is_odd).isNull()).drop(is_odd).withColumn(name, F.col("doc_id").cast("long"))
    other = (
        flagged.where(F.col(is_odd).isNotNull())
        .drop(is_odd)
        .withColumn(key, F.xxhash64(F.col("doc_id"), whole_text()))
        .withColumn(nth, F.row_number().over(like))
        .withColumn(name, -F.abs(F.shiftright(F.xxhash64(key, nth), 1)) - 1)
        .drop(key, nth)
    )
    return plain.unionByName(other)
