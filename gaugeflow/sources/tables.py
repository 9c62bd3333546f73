"""The event and anomaly tables: Parquet, partitioned by day.

Rows are laid out for the read queries: a day per partition (time filters prune
directories), sorted by sensor type and time inside a file (type and time filters
skip row groups).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.codec import tags_to_json
from gaugeflow.schemas import ANOMALY, ANOMALY_COLUMNS, EVENT, EVENT_COLUMNS

EVENTS = "sensor_events"
ANOMALIES = "anomalies"
_TIME_COLUMN = {EVENTS: "recorded_at", ANOMALIES: "detected_at"}
_SORT = {EVENTS: ("sensor_type", "recorded_at"), ANOMALIES: ("severity", "detected_at")}
_SCHEMA = {EVENTS: EVENT, ANOMALIES: ANOMALY}
#: A micro-batch is known by its run and its number: after a checkpoint was lost the
#: numbers begin anew, in another run.
RUN = "run_id"
BATCH = "batch_id"
_PARTITIONS = (
    T.StructField("event_date", T.DateType()),
    T.StructField(RUN, T.StringType()),
    T.StructField(BATCH, T.LongType()),
)


def table_path(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}"


def _stored_schema(table: str) -> T.StructType:
    return T.StructType([*_SCHEMA[table].fields, *_PARTITIONS])


def ensure_tables(spark: SparkSession, base: str, database: str = "default") -> None:
    """Create both catalog tables over ``base``, and their folders, unless they exist."""
    for table in (EVENTS, ANOMALIES):
        empty = spark.createDataFrame([], _stored_schema(table))
        empty.write.mode("append").partitionBy("event_date", RUN, BATCH).parquet(
            table_path(base, table)
        )
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _stored_schema(table))
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{table} ({columns}) USING parquet "
            f"PARTITIONED BY (event_date, {RUN}, {BATCH}) LOCATION '{table_path(base, table)}'"
        )


def sync_partitions(spark: SparkSession, database: str = "default") -> None:
    """Let the catalog tables see the partitions written since the last call.

    Readers by path, :func:`read_table` among them, see them anyway.
    """
    for table in (EVENTS, ANOMALIES):
        spark.sql(f"MSCK REPAIR TABLE {database}.{table}")


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The run that a stream's checkpoint folder belongs to; kept in that folder.

    A stream that goes on from its checkpoint has the same run, one whose checkpoint
    was removed gets another.
    """
    path = f"{checkpoint.rstrip('/')}/run"
    try:
        return spark.read.text(path).first()[0]
    except AnalysisException:
        run = uuid.uuid4().hex
        spark.createDataFrame([(run,)], "value string").coalesce(1).write.text(path)
        return run


def append_batch(rows: DataFrame, base: str, table: str, batch_id: int, run: str = "") -> None:
    """Write one micro-batch; writing the same batch of the same run again replaces it.

    ``rebalance`` lets adaptive execution split a day that fills most of the
    batch and join small ones, so files come out evenly sized.
    """
    columns = EVENT_COLUMNS if table == EVENTS else ANOMALY_COLUMNS
    (
        rows.select(
            *columns,
            F.to_date(_TIME_COLUMN[table]).alias("event_date"),
            F.lit(run or "0").alias(RUN),
            F.lit(batch_id).cast("long").alias(BATCH),
        )
        .hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", *_SORT[table])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date", RUN, BATCH)
        .parquet(table_path(base, table))
    )


#: The run under which compacted rows stand.
COMPACTED_RUN = "compacted"


def compact_day(spark: SparkSession, base: str, table: str, day: dt.date) -> int:
    """Rewrite a day's rows of many micro-batches as one; returns how many it replaced.

    The newest batch of each run is left alone, since it may yet be retried. The new rows
    are written beside the table, then a list of what they replace; then they are moved
    in and the old folders are removed. A call that breaks off after the list is finished
    by the next one, before it no harm is done. Whoever reads while folders are exchanged
    may see rows twice. One compaction of a table at a time.
    """
    root, name = table_path(base, table), f"event_date={day.isoformat()}"
    staging, listed = f"{root}/_compacting", f"{root}/_replaced"
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    files = path_of(root).getFileSystem(conf)

    def finish() -> None:
        old = [r[0] for r in spark.read.text(listed).collect()]
        moved = path_of(f"{root}/{old[0]}").getParent()
        if files.exists(path_of(staging)):
            files.mkdirs(moved)
            files.rename(path_of(staging), path_of(f"{root}/{old[0]}"))
        for folder in old[1:]:
            files.delete(path_of(f"{root}/{folder}"), True)
        files.delete(path_of(listed), True)

    if files.exists(path_of(f"{listed}/_SUCCESS")):
        finish()
    for left in (listed, staging):
        files.delete(path_of(left), True)

    stored = spark.read.schema(_stored_schema(table)).parquet(root)
    newest = stored.groupBy(RUN).agg(F.max(BATCH).alias("newest"))  # from the folders' names
    there = stored.where(F.col("event_date") == F.lit(day)).select(RUN, BATCH).distinct()
    closed = there.join(newest, RUN).where(
        (F.col(BATCH) < F.col("newest")) | (F.col(RUN) == COMPACTED_RUN)
    )
    old = [(r[RUN], r[BATCH]) for r in closed.collect()]
    if len(old) < 2:
        return 0
    own = spark.createDataFrame(old, "_run string, _batch long")
    same = (F.col(RUN) == F.col("_run")) & (F.col(BATCH) == F.col("_batch"))
    rows = stored.where(F.col("event_date") == F.lit(day)).join(F.broadcast(own), same, "left_semi")
    rows = rows.drop("event_date", RUN, BATCH).hint("rebalance").sortWithinPartitions(*_SORT[table])
    rows.write.parquet(staging)
    step = 1 + max((batch for run, batch in old if run == COMPACTED_RUN), default=-1)
    folders = [f"{name}/{RUN}={run}/{BATCH}={batch}" for run, batch in [(COMPACTED_RUN, step), *old]]
    spark.createDataFrame([(f,) for f in folders], "value string").coalesce(1).write.text(listed)
    finish()
    return len(old)


def read_table(spark: SparkSession, base: str, table: str) -> DataFrame:
    """The table as a batch frame with its event or anomaly columns.

    ``event_date`` stays, for filters that prune days.
    """
    stored = spark.read.schema(_stored_schema(table)).parquet(table_path(base, table))
    return stored.drop(RUN, BATCH)


#: Names that stored versions of the event table have for columns of the newest one.
TABLE_RENAMES: Mapping[int, Mapping[str, str]] = {1: {}, 2: {"observed_at": "recorded_at", "kind": "sensor_type"}}


def merged_versions(
    frames: Mapping[int, DataFrame], renames: Mapping[int, Mapping[str, str]] = TABLE_RENAMES
) -> DataFrame:
    """Event tables of several versions as one, by column name.

    Adds ``schema_version``. A column that only some versions have is null in the
    others; the event's own columns are there in any case, in their types.
    """
    merged = None
    for version in sorted(frames):
        rows = frames[version].withColumnsRenamed(dict(renames.get(version, {})))
        own = [
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in EVENT.fields
        ]
        others = [c for c in rows.columns if c not in EVENT_COLUMNS]
        rows = rows.select(*own, *others, F.lit(version).alias("schema_version"))
        merged = rows if merged is None else merged.unionByName(rows, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no version is given")
    return merged


def since(rows: DataFrame, table: str, start) -> DataFrame:
    """Rows at or after ``start``, with the day filter that prunes partitions."""
    moment = F.lit(start)
    return rows.filter(
        (F.col("event_date") >= F.to_date(moment)) & (F.col(_TIME_COLUMN[table]) >= moment)
    )


def append_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Append to a relational table through the JDBC source; tags become JSON.

    The database's driver must be on the class path.
    """
    if "tags" in rows.columns:
        rows = rows.withColumn("tags", tags_to_json(F.col("tags")))
    rows.write.jdbc(url, table, mode="append", properties=properties)
