"""Counters of running queries: reports of their progress, kept as a table, and what every
micro-batch counted."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gaugeflow.sources.tables import BATCH, RUN

METRICS = "pipeline_metrics"
COUNTERS = "pipeline_counters"
_SCHEMA = (
    "query string, query_run string, batch_id long, at timestamp, input_rows long, rows_per_second double, "
    "handling_ms long, late_rows long, state_rows long"
)
_WIRE = _SCHEMA.replace("at timestamp", "at string")
_COUNTED = T.StructType(
    [
        T.StructField("events", T.LongType()),
        T.StructField("anomalies", T.LongType()),
        T.StructField("handling_ms", T.LongType()),
        T.StructField("stored_at", T.TimestampType()),
        T.StructField(RUN, T.StringType()),
        T.StructField(BATCH, T.LongType()),
    ]
)


def _entry(report) -> dict:
    return {
        "query": report["name"],
        "query_run": str(report["runId"]),
        "batch_id": report["batchId"],
        "input_rows": report["numInputRows"],
        "rows_per_second": report["processedRowsPerSecond"],
        "handling_ms": report["durationMs"].get("triggerExecution", 0),
        "late_rows": sum(op["numRowsDroppedByWatermark"] for op in report["stateOperators"]),
        "state_rows": sum(op["numRowsTotal"] for op in report["stateOperators"]),
        "at": report["timestamp"],
    }


def handling_ms(query: StreamingQuery) -> int:
    """Handling time of the last micro-batch; 0 before the first."""
    last = query.lastProgress
    return _entry(last)["handling_ms"] if last else 0


def _frame(spark: SparkSession, entries: list[dict]) -> DataFrame:
    rows = spark.createDataFrame(entries, _WIRE)
    return rows.withColumn("at", rows["at"].cast("timestamp"))


def progress_frame(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The retained progress reports, one row per micro-batch."""
    return _frame(spark, [_entry(report) for report in query.recentProgress])


class MetricsTable(StreamingQueryListener):
    """Appends every progress report of the session's queries to a Parquet table.

    A query itself keeps its last hundred reports only. Reports are written ``every`` so
    many, and the rest when a query ends or on ``close``; what a lost driver had not
    written yet is lost. Use as a context manager, or register with ``start``.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 50):
        self.spark, self.path, self.every = spark, path, every
        self._held: list[dict] = []
        self._lock, self._writing = threading.Lock(), threading.Lock()
        self._ended: set[str] = set()
        self._ends = threading.Condition()

    def start(self) -> MetricsTable:
        self.spark.streams.addListener(self)
        return self

    def close(self) -> None:
        self.spark.streams.removeListener(self)
        self.flush()

    __enter__ = start

    def __exit__(self, *_) -> None:
        self.close()

    def flush(self) -> None:
        with self._writing:  # two writers of one folder would get in each other's way
            with self._lock:
                held, self._held = self._held, []
            if held:
                _frame(self.spark, held).coalesce(1).write.mode("append").parquet(self.path)

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Whether the last report of an ended query has arrived: reports come after the
        batches they tell of."""
        with self._ends:
            return self._ends.wait_for(lambda: str(query.runId) in self._ended, seconds)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        entry = _entry(json.loads(event.progress.json))
        with self._lock:
            self._held.append(entry)
            full = len(self._held) >= self.every
        if full:
            self.flush()

    def onQueryTerminated(self, event) -> None:
        self.flush()
        with self._ends:
            self._ended.add(str(event.runId))
            self._ends.notify_all()


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The stored reports, one row per query run and micro-batch."""
    return spark.read.schema(_SCHEMA).parquet(path)


def store_counters(base: str, run: str, spark: SparkSession, batch_id: int, events: int, anomalies: int, ms: int) -> None:
    """What one micro-batch counted; a retry replaces it."""
    counted = spark.range(1).select(
        F.lit(events).cast("long").alias("events"),
        F.lit(anomalies).cast("long").alias("anomalies"),
        F.lit(ms).cast("long").alias("handling_ms"),
        F.current_timestamp().alias("stored_at"),
    )
    counted.write.mode("overwrite").parquet(f"{base.rstrip('/')}/{COUNTERS}/{RUN}={run}/{BATCH}={batch_id}")


def live_counters(spark: SparkSession, base: str) -> DataFrame:
    """One row: all events and anomalies so far, and the handling time of the newest
    micro-batch. Reads a row per micro-batch, none of the tables."""
    try:
        counted = spark.read.schema(_COUNTED).parquet(f"{base.rstrip('/')}/{COUNTERS}")
    except AnalysisException:
        counted = spark.createDataFrame([], _COUNTED)
    return counted.agg(
        F.coalesce(F.sum("events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("anomalies"), F.lit(0)).alias("total_anomalies"),
        F.coalesce(F.max_by("handling_ms", F.struct("stored_at", BATCH)), F.lit(0)).alias("processor_lag_ms"),
    )


def observed(rows: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write ``rows`` and return how many they were, counted on the way."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    write(rows.observe(seen, F.count(F.lit(1)).alias("rows")))
    try:
        return seen.get["rows"]
    except Py4JJavaError:  # a plan that turns out to be empty is replaced, counter and all
        return 0
