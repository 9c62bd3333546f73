"""Stream inputs and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeflow.functions.codec import event_json

# Fixed value: the topic events travel on.
DEFAULT_TOPIC = "sensor-events"


def kafka_options(
    brokers: str,
    topic: str = DEFAULT_TOPIC,
    starting: str = "latest",
    max_offsets_per_trigger: int | None = 1_000_000,
) -> dict[str, str]:
    """Reader options. The cap per trigger bounds what one micro-batch holds."""
    options = {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": starting,
    }
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def kafka_lines(spark: SparkSession, brokers: str, topic: str = DEFAULT_TOPIC, **options) -> DataFrame:
    """JSON payloads with their partition and offset, the order of arrival."""
    reader = spark.readStream.format("kafka").options(**kafka_options(brokers, topic, **options))
    return reader.load().select("value", "partition", "offset")


def kafka_records(events: DataFrame) -> DataFrame:
    """Events as Kafka records. Keyed by sensor, so a sensor keeps to one partition."""
    return events.select(F.col("sensor_id").alias("key"), event_json().alias("value"))


def publish_kafka(events: DataFrame, brokers: str, topic: str = DEFAULT_TOPIC) -> None:
    """Publish a batch of events."""
    (
        kafka_records(events)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("topic", topic)
        .save()
    )


def publish_kafka_stream(
    events: DataFrame, brokers: str, checkpoint: str, topic: str = DEFAULT_TOPIC
):
    """Publish a stream of events; returns the running query."""
    return (
        kafka_records(events)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


# What one micro-batch of files may hold unless told otherwise: one sensor may own
# much of it, and its rows of one micro-batch are ordered by a single task.
MAX_BATCH_BYTES = 256 * 1024 * 1024


def _capped(reader, max_files: int | None, max_bytes: int):
    if max_files:
        return reader.option("maxFilesPerTrigger", max_files)
    return reader.option("maxBytesPerTrigger", max_bytes)


def parquet_stream(
    spark: SparkSession,
    schema: T.StructType,
    path: str,
    max_files: int | None = None,
    max_bytes: int = MAX_BATCH_BYTES,
) -> DataFrame:
    """New Parquet files under ``path`` (a folder or a glob) as a stream, so many files
    or bytes of them in a micro-batch."""
    return _capped(spark.readStream.schema(schema), max_files, max_bytes).parquet(path)


def text_stream(
    spark: SparkSession, path: str, max_files: int | None = None, max_bytes: int = MAX_BATCH_BYTES
) -> DataFrame:
    """JSON lines under ``path`` as a stream with a ``value`` column, for replay."""
    return _capped(spark.readStream, max_files, max_bytes).text(path)
