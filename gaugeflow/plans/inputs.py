"""The given event table as sensor readings.

One reading per event: the user is the sensor, the event type its type, four
zones stand for locations, the JSON properties are the tags, and ``event_id``
breaks ties.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import time
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import gaugeflow
from gaugeflow.sources.streams import parquet_stream

TIEBREAK = ("event_id",)

RAW_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def as_readings(raw: DataFrame, zoned: bool = False) -> DataFrame:
    """Map raw events to event columns; ``zoned`` for streams, which need TIMESTAMP."""
    recorded_at = F.col("ts").cast("timestamp") if zoned else F.col("ts")
    return raw.select(
        "event_id",
        F.concat(F.lit("sensor-"), F.col("user_id")).alias("sensor_id"),
        F.col("event_type").alias("sensor_type"),
        F.concat(F.lit("zone-"), F.col("user_id") % 4).alias("location"),
        "value",
        F.lit("").alias("unit"),
        F.from_json("props", "map<string,string>").alias("tags"),
        recorded_at.alias("recorded_at"),
    )


def readings(spark: SparkSession, sf_dir: str, zoned: bool = False) -> DataFrame:
    return as_readings(spark.read.parquet(f"{sf_dir}/events.parquet"), zoned)


def reading_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A glob, since a stream over a plain path expects a folder there.
    raw = parquet_stream(spark, RAW_EVENTS, f"{sf_dir}/events.parque[t]")
    return as_readings(raw, zoned=True)


#: Rows of one arrival file of the stream queries, at most.
ARRIVAL_ROWS = 1_000_000


def arriving_readings(
    spark: SparkSession, sf_dir: str, folder: str, newest_first: bool = False, least: int = 4
) -> DataFrame:
    """The event table as a stream of several files, one per micro-batch.

    The table is cut by time into ``least`` slices or more, which arrive in the order
    of time or, ``newest_first``, against it: every slice but the first is then late.
    """
    raw = spark.read.schema(RAW_EVENTS).parquet(f"{sf_dir}/events.parquet")
    slices = max(least, -(-raw.count() // ARRIVAL_ROWS))
    # One job; events without a time are in the first slice.
    raw.repartitionByRange(slices, F.col("ts").asc_nulls_first()).write.parquet(folder)
    _arrive_in_turn(spark, folder, newest_first)
    return as_readings(parquet_stream(spark, RAW_EVENTS, folder, max_files=1), zoned=True)


def repeated_arrivals(spark: SparkSession, sf_dir: str, folder: str, batches: int = 6) -> None:
    """The event table in ``batches`` folders by time, with repeats: every third event twice in
    its own folder, every fifth again in the next."""
    raw = spark.read.schema(RAW_EVENTS).parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = raw.agg(F.min(micros), F.max(micros)).first()
    width = max(1, -(-((last or 0) - (first or 0) + 1) // batches))
    arrival = F.coalesce(F.floor((micros - F.lit(first or 0)) / width).cast("int"), F.lit(0))
    own = raw.withColumn("arrival", arrival)
    again = own.where("event_id % 3 = 0").unionByName(
        own.where("event_id % 5 = 0").withColumn("arrival", F.least(F.col("arrival") + 1, F.lit(batches - 1)))
    )
    own.unionByName(again).repartition("arrival").write.partitionBy("arrival").parquet(folder)
    _arrive_in_turn(spark, folder, newest_first=False)


def _arrive_in_turn(spark: SparkSession, folder: str, newest_first: bool) -> None:
    """Let the files' times tell the order of their slices: streams read the oldest first."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts, listed = [], files.listFiles(path, True)
    while listed.hasNext():
        file = listed.next().getPath()
        if file.getName().startswith("part-"):
            parts.append(file.toString())
    parts.sort()
    began = int(time.time() * 1000) - 1000 * len(parts)
    for i, part in enumerate(reversed(parts) if newest_first else parts):
        files.setTimes(jvm.org.apache.hadoop.fs.Path(part), began + 1000 * i, -1)


def as_of_day_before_end(spark: SparkSession, sf_dir: str) -> dt.datetime:
    """The point in time the queries look from: a day before the last event."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.agg(F.max("ts") - F.expr("INTERVAL 1 DAY")).first()[0]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Put the package on the workers' path, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(gaugeflow.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="gaugeflow-")) / "gaugeflow.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
