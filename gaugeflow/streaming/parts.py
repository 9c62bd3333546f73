"""Windows kept up by micro-batch: mergeable parts, merged on read and compacted.

A part is what one micro-batch has for one window, sensor type and location: count, sum,
least and greatest value, and the run of its values with how often each occurs. A late
reading of any age makes a part like any other, so no stored event is read again. The
parts of a window add up to its exact metrics, p99 from the joined runs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.operators.windows import DEFAULT_WIDTH, p99_rank
from gaugeflow.schemas import WINDOW_COLUMNS, WINDOW_METRIC
from gaugeflow.sources.tables import BATCH, RUN

PARTS = "window_parts"
COMPACTED = "window_parts_compacted"
COVERED = "window_parts_covered"
_STEP = "compaction"

_KEYS = ("window_start", "window_end", "sensor_type", "location")
_RUN_ITEM = T.StructType([T.StructField("value", T.DoubleType()), T.StructField("times", T.LongType())])
_OF_WINDOW = {f.name: f for f in WINDOW_METRIC.fields}
PART = T.StructType(
    [
        *[_OF_WINDOW[name] for name in (*_KEYS, "count", "sum", "min", "max")],
        T.StructField("run", T.ArrayType(_RUN_ITEM)),
    ]
)


def _gathered(rows: DataFrame) -> DataFrame:
    """Parts from rows of (keys, value, times, count, sum)."""
    run = F.when(F.col("value").isNotNull(), F.struct("value", "times"))
    return rows.groupBy(*_KEYS).agg(
        F.sum("count").alias("count"),
        F.sum("sum").alias("sum"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        # Bounded by the rows of a micro-batch, after compaction by those of a window.
        F.sort_array(F.collect_list(run)).alias("run"),
    )


def window_parts(events: DataFrame, width: str = DEFAULT_WIDTH) -> DataFrame:
    """One part for each window, sensor type and location of ``events``; null types and
    locations are groups of their own."""
    slot = F.window("recorded_at", width)
    keyed = events.select(slot.alias("_slot"), "sensor_type", "location", "value").select(
        F.col("_slot.start").alias("window_start"), F.col("_slot.end").alias("window_end"), "sensor_type", "location", "value"
    )
    counted = keyed.groupBy(*_KEYS, "value").agg(F.count(F.lit(1)).alias("times"), F.sum("value").alias("sum"))
    return _gathered(counted.withColumn("count", F.col("times")))


def _values(parts: DataFrame) -> DataFrame:
    """The joined runs: every value of a group once, with how often it occurs."""
    runs = parts.select(*_KEYS, F.explode("run").alias("r")).select(*_KEYS, "r.value", "r.times")
    return runs.groupBy(*_KEYS, "value").agg(F.sum("times").alias("times"))


def merged_parts(parts: DataFrame) -> DataFrame:
    """The metrics of all windows that have parts."""
    group = Window.partitionBy(*_KEYS)
    upto = group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reaches = F.sum("times").over(upto) >= p99_rank(F.sum("times").over(group))
    ranked = _values(parts).withColumn("reaches", reaches).select(
        *_KEYS,
        F.lit(0).cast("long").alias("count"),
        F.col("times").alias("values"),
        *[F.lit(None).cast("double").alias(c) for c in ("sum", "min", "max")],
        F.when(F.col("reaches"), F.col("value")).alias("p99"),
    )
    plain = parts.select(
        *_KEYS, "count", F.lit(0).cast("long").alias("values"), "sum", "min", "max", F.lit(None).cast("double").alias("p99")
    )
    # Adding up both kinds of rows needs no join, so null keys meet as well.
    return (
        plain.unionByName(ranked)
        .groupBy(*_KEYS)
        .agg(
            F.sum("count").alias("count"),
            F.sum("sum").alias("sum"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            (F.sum("sum") / F.sum("values")).alias("avg"),
            F.min("p99").alias("p99"),
        )
        .select(*WINDOW_COLUMNS)
    )


def store_parts(base: str, run: str, width: str = DEFAULT_WIDTH):
    """Sink of one micro-batch's parts, in a folder of its own that a retry replaces."""

    def write(batch: DataFrame, batch_id: int) -> None:
        path = f"{base.rstrip('/')}/{PARTS}/{RUN}={run}/{BATCH}={batch_id}"
        window_parts(batch, width).write.mode("overwrite").parquet(path)

    return write


def _table(spark: SparkSession, base: str, name: str, *columns: T.StructField) -> DataFrame:
    """A table of parts or of batches; empty where its folder does not exist yet."""
    schema = T.StructType([*(PART.fields if name != COVERED else ()), *columns])
    try:
        return spark.read.schema(schema).parquet(f"{base.rstrip('/')}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _newest_compaction(spark: SparkSession, base: str) -> tuple[int, DataFrame]:
    """Number and batches of the last finished compaction; -1 where there is none."""
    covered = _table(
        spark, base, COVERED, T.StructField("of_run", T.StringType()), T.StructField("of_batch", T.LongType()),
        T.StructField(_STEP, T.LongType()),
    )
    newest = covered.agg(F.max(_STEP)).first()[0]
    return (-1, covered) if newest is None else (newest, covered.where(F.col(_STEP) == newest))


def _open_batches(spark: SparkSession, base: str, covered: DataFrame) -> DataFrame:
    """Parts of batches that no compaction holds; the list of batches prunes folders."""
    parts = _table(spark, base, PARTS, T.StructField(RUN, T.StringType()), T.StructField(BATCH, T.LongType()))
    batch = (F.col(RUN) == F.col("of_run")) & (F.col(BATCH) == F.col("of_batch"))
    return parts.join(covered.select("of_run", "of_batch"), batch, "left_anti")


def stored_parts(spark: SparkSession, base: str) -> DataFrame:
    """All parts of all windows, compacted ones and those since."""
    step, covered = _newest_compaction(spark, base)
    recent = _open_batches(spark, base, covered).select(*PART.names)
    if step < 0:
        return recent
    compacted = _table(spark, base, COMPACTED, T.StructField(_STEP, T.LongType()))
    return compacted.where(F.col(_STEP) == step).select(*PART.names).unionByName(recent)


def live_windows(spark: SparkSession, base: str) -> DataFrame:
    """The metrics of each window from all readings stored so far."""
    return merged_parts(stored_parts(spark, base))


def compact_windows(spark: SparkSession, base: str, clean: bool = True) -> int:
    """Merge the parts of all batches but each run's newest, which may yet be retried.

    Returns the number of the compaction, or -1 if there was nothing to merge. The
    list of merged batches is written last and is what readers go by, so a compaction
    that breaks off changes nothing; ``clean`` then removes what it has replaced. One
    compaction at a time.
    """
    base = base.rstrip("/")
    step, covered = _newest_compaction(spark, base)
    parts = _table(spark, base, PARTS, T.StructField(RUN, T.StringType()), T.StructField(BATCH, T.LongType()))
    there = parts.select(F.col(RUN).alias("of_run"), F.col(BATCH).alias("of_batch")).distinct()
    newest = Window.partitionBy("of_run").orderBy(F.desc("of_batch"))
    closed = there.withColumn("_age", F.row_number().over(newest)).where("_age > 1").drop("_age")
    new = [tuple(r) for r in closed.join(covered.select("of_run", "of_batch"), ["of_run", "of_batch"], "left_anti").collect()]
    if not new:
        return -1
    batch = (F.col(RUN) == F.col("of_run")) & (F.col(BATCH) == F.col("of_batch"))
    chosen = spark.createDataFrame(new, "of_run string, of_batch long")
    old = _table(spark, base, COMPACTED, T.StructField(_STEP, T.LongType())).where(F.col(_STEP) == step)
    merged = old.select(*PART.names).unionByName(parts.join(chosen, batch, "left_semi").select(*PART.names))
    no_sum, none = F.lit(None).cast("double"), F.lit(0).cast("long")
    values = _values(merged).select(*_KEYS, "value", "times", none.alias("count"), no_sum.alias("sum"))
    # Counts and sums come from the parts: they are of readings without a value too.
    plain = merged.select(*_KEYS, no_sum.alias("value"), none.alias("times"), "count", "sum")
    gathered = _gathered(values.unionByName(plain))
    gathered.write.mode("overwrite").parquet(f"{base}/{COMPACTED}/{_STEP}={step + 1}")
    listed = covered.select("of_run", "of_batch").join(there, ["of_run", "of_batch"], "left_semi").unionByName(chosen)
    listed.coalesce(1).write.mode("overwrite").parquet(f"{base}/{COVERED}/{_STEP}={step + 1}")
    if clean:
        replaced = [f"{base}/{PARTS}/{RUN}={run}/{BATCH}={number}" for run, number in new]
        if step >= 0:
            replaced += [f"{base}/{COMPACTED}/{_STEP}={step}", f"{base}/{COVERED}/{_STEP}={step}"]
        _remove(spark, replaced)
    return step + 1


def _remove(spark: SparkSession, paths: list[str]) -> None:
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    for path in map(path_of, paths):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
