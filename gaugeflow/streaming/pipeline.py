"""The streams of a running installation.

One JSON stream feeds two queries, each with its own checkpoint:

* ``readings``: decode, score, then per micro-batch write the anomalies, after them
  the events, and last what the batch adds to the windows
  (:mod:`gaugeflow.streaming.parts`). So a reading of any age counts in its window, and
  nothing stored is read again. A batch that is retried replaces its own rows.
* ``rejects``: the records that could not be decoded, with the reason.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gaugeflow.functions.codec import decode, split
from gaugeflow.functions.timeparts import AsOf
from gaugeflow.operators.alerts import AlertPolicy
from gaugeflow.operators.derived import ROUTES, alert_payload, routed_alerts
from gaugeflow.operators.detect import merge_detectors
from gaugeflow.operators.windows import DEFAULT_WIDTH, window_metrics
from gaugeflow.plans.snapshot import pipeline_snapshot, snapshot_json
from gaugeflow.schemas import WINDOW_COLUMNS, WINDOW_METRIC
from gaugeflow.settings import DetectorSettings
from gaugeflow.sources.tables import ANOMALIES, BATCH, EVENTS, RUN, append_batch, run_of
from gaugeflow.streaming.detect import score_stream
from gaugeflow.streaming.parts import store_parts
from gaugeflow.streaming.progress import live_counters, observed, store_counters

CHANGED_WINDOWS = "changed_windows"
COMPLETED_WINDOWS = "completed_windows"
REJECTS = "rejects"
ALERTS = "alerts"
RETENTION = "60 minutes"


@dataclass(frozen=True)
class PipelineOptions:
    base: str
    checkpoints: str
    settings: DetectorSettings = field(default_factory=DetectorSettings)
    on_missing: str = "reject"
    watermark: str = RETENTION
    tiebreak: tuple[str, ...] = ()
    available_now: bool = False
    state_partitions: int | None = None
    #: Which anomalies raise an alert; None for no alerts.
    alerts: AlertPolicy | None = field(default_factory=AlertPolicy)

    def checkpoint(self, name: str) -> str:
        return f"{self.checkpoints.rstrip('/')}/{name}"

    def path(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}"


@contextmanager
def state_partitions(spark: SparkSession, count: int | None) -> Iterator[None]:
    """Number of state partitions of the stateful queries started inside.

    A query keeps the number it first started with. Each partition costs a state
    store commit per micro-batch, so a few per core are plenty.
    """
    if count is None:
        yield
        return
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, count)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _start(stream: DataFrame, name: str, mode: str, options: PipelineOptions, write) -> StreamingQuery:
    writer = (
        stream.writeStream.queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", options.checkpoint(name))
        .foreachBatch(write)
    )
    if options.available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


Sink = Callable[[DataFrame, int], None]


def store_scored(options: PipelineOptions, run: str) -> Sink:
    """Per micro-batch: alerts, if they are judged, and anomalies first, then all events, then
    how many they were and how long it took. The rows are counted while they are written."""
    alerts = store_alerts(options.base, run)

    def write(batch: DataFrame, batch_id: int) -> None:
        began = time.monotonic()
        batch.persist()
        try:
            judged = [c for c in ("alerted",) if c in batch.columns]
            found = merge_detectors(batch, options.settings, judged)
            if judged:
                alerts(found, batch_id)
            anomalies = observed(found, lambda rows: append_batch(rows, options.base, ANOMALIES, batch_id, run))
            events = observed(batch, lambda rows: append_batch(rows, options.base, EVENTS, batch_id, run))
        finally:
            batch.unpersist()
        took = max(1, round(1000 * (time.monotonic() - began)))
        store_counters(options.base, run, batch.sparkSession, batch_id, events, anomalies, took)

    return write


def store_changes(path: str, run: str) -> Sink:
    """Per micro-batch: a folder of its own, replaced when the batch is retried.

    Times of the batches order the states of a window across runs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("stored_at", F.current_timestamp())
        stamped.write.mode("overwrite").parquet(f"{path}/{RUN}={run}/{BATCH}={batch_id}")

    return write


def store_alerts(
    base: str, run: str, routes: Mapping[str, Sequence[str]] = ROUTES, link: str = ""
) -> Sink:
    """Per micro-batch of anomalies: the payload of each alert once in the folder of every
    channel that its severity goes to. Anomalies that repeat an alert, by a column
    ``alerted``, are not sent. A retry replaces the batch's own files."""

    def write(batch: DataFrame, batch_id: int) -> None:
        raised = batch.where("alerted") if "alerted" in batch.columns else batch
        sent = routed_alerts(raised, routes).select("channel", alert_payload(link).alias("payload"))
        path = f"{base.rstrip('/')}/{ALERTS}/{RUN}={run}/{BATCH}={batch_id}"
        sent.write.mode("overwrite").partitionBy("channel").parquet(path)

    return write


def stored_alerts(spark: SparkSession, base: str) -> DataFrame:
    """Payload and channel of all alerts stored."""
    schema = f"payload string, {RUN} string, {BATCH} long, channel string"
    return spark.read.schema(schema).parquet(f"{base.rstrip('/')}/{ALERTS}").select("channel", "payload")


def stored_rejects(spark: SparkSession, base: str, keep: Sequence[T.StructField] = ()) -> DataFrame:
    """The records that could not be decoded, as the rejects query stored them: raw text,
    reason, the columns kept, and when each was stored. Decode ``raw`` again to replay."""
    schema = T.StructType(
        [
            T.StructField("raw", T.StringType()),
            T.StructField("reject_reason", T.StringType()),
            *keep,
            T.StructField("stored_at", T.TimestampType()),
            T.StructField(RUN, T.StringType()),
            T.StructField(BATCH, T.LongType()),
        ]
    )
    return spark.read.schema(schema).parquet(f"{base.rstrip('/')}/{REJECTS}").drop(RUN, BATCH)


def in_turn(*sinks: Sink) -> Sink:
    """One sink after the other; a retry repeats all, each replacing its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return write


def store_events(options: PipelineOptions, run: str) -> Sink:
    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, options.base, EVENTS, batch_id, run)

    return write


def start_pipeline(
    lines: DataFrame, options: PipelineOptions, payload: str = "value", keep: Sequence[str] = ()
) -> dict[str, StreamingQuery]:
    """Start the two queries over a stream of JSON records.

    ``keep`` names the arrival-order columns to carry (partition, offset).
    """
    good, rejects = split(decode(lines, payload, tuple(keep)), options.on_missing)
    tiebreak = options.tiebreak or tuple(keep)
    scored = score_stream(good, options.settings, tiebreak, policy=options.alerts)
    spark = lines.sparkSession
    run = run_of(spark, options.checkpoint("readings"))
    readings_sink = in_turn(store_scored(options, run), store_parts(options.base, run))
    rejects_sink = store_changes(
        options.path(REJECTS), run_of(spark, options.checkpoint(REJECTS))
    )
    with state_partitions(spark, options.state_partitions):
        return {
            "readings": _start(scored, "readings", "append", options, readings_sink),
            REJECTS: _start(rejects, REJECTS, "append", options, rejects_sink),
        }


def _stored_changes(spark: SparkSession, base: str, name: str) -> DataFrame:
    schema = T.StructType(
        [
            *WINDOW_METRIC.fields,
            T.StructField("stored_at", T.TimestampType()),
            T.StructField(RUN, T.StringType()),
            T.StructField(BATCH, T.LongType()),
        ]
    )
    return spark.read.schema(schema).parquet(f"{base.rstrip('/')}/{name}")


def stored_windows(spark: SparkSession, base: str, name: str = COMPLETED_WINDOWS) -> DataFrame:
    """Windows that were written once."""
    return _stored_changes(spark, base, name).select(*WINDOW_COLUMNS)


def latest_windows(spark: SparkSession, base: str) -> DataFrame:
    """The newest state of each window that a query in update mode wrote."""
    newest = Window.partitionBy("window_start", "window_end", "sensor_type", "location").orderBy(
        F.desc("stored_at"), F.desc(BATCH)
    )
    return (
        _stored_changes(spark, base, CHANGED_WINDOWS)
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") == 1)
        .select(*WINDOW_COLUMNS)
    )


def completed_windows(
    events: DataFrame, width: str = DEFAULT_WIDTH, watermark: str = RETENTION, approx: bool = False
) -> DataFrame:
    """Windows for append mode: each is emitted once, when the watermark has passed it."""
    return window_metrics(events, width, watermark=watermark, approx=approx)


def start_snapshots(
    spark: SparkSession,
    load: Callable[[], tuple[DataFrame, DataFrame]],
    publish: Callable[[DataFrame], None],
    started_at: AsOf,
    checkpoint: str,
    interval: str = "1 second",
    base: str | None = None,
) -> StreamingQuery:
    """Publish a snapshot of the tables at every tick.

    ``load`` gives the current event and anomaly frames, ``publish`` receives one
    row with the JSON text. With ``base``, the folder of the pipeline's tables, totals
    and lag come from what its micro-batches counted, and no table is counted.
    """

    def tick(_: DataFrame, __: int) -> None:
        events, anomalies = load()
        counters = live_counters(spark, base) if base else None
        publish(snapshot_json(pipeline_snapshot(events, anomalies, started_at, counters=counters)))

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (
        ticks.writeStream.queryName("snapshots")
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=interval)
        .foreachBatch(tick)
        .start()
    )
