"""Every operator as a named query over the given tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.functions import codec
from gaugeflow.functions.severity import escalate, higher, severity_rank, z_severity
from gaugeflow.operators import alerts, derived, detect, reads, seasonal, windows
from gaugeflow.plans import inputs, snapshot
from gaugeflow.plans.inputs import TIEBREAK, readings
from gaugeflow.session import shared_dir
from gaugeflow.sources import streams, tables
from gaugeflow.streaming import detect as stream_detect
from gaugeflow.streaming import parts, pipeline, progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


# Means of up to 64 two-digit values have at most eight decimals, so rounding
# there never meets a tie.
def _rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _metrics(df: DataFrame) -> DataFrame:
    return _rounded(df, "sum", "avg")


def _scores(df: DataFrame, *rounded: str, exact: tuple[str, ...] = ()) -> DataFrame:
    scored = df.select("sensor_id", "event_id", "reading_no", *rounded, *exact)
    return _rounded(scored, *rounded)


# Equal to the last bit on both sides, and with as many decimals as readings, so
# rounding these could only introduce ties.
_EWMA = ("ewma_expected", "ewma_deviation")


def _anomalies(df: DataFrame) -> DataFrame:
    return _rounded(df, "expected", "z_score")


def _events(df: DataFrame) -> DataFrame:
    """Event rows with the tag as text, since a map has no order to compare by."""
    return df.withColumn("tags", codec.tags_to_json(F.col("tags")))


def _as_of(spark: SparkSession, sf_dir: str):
    return inputs.as_of_day_before_end(spark, sf_dir)


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.layered_anomalies(readings(spark, sf_dir), tiebreak=TIEBREAK)


# Tumbling windows


@query
def window_metrics_1m(spark, sf_dir):
    return _metrics(windows.window_metrics(readings(spark, sf_dir)))


@query
def window_metrics_1h(spark, sf_dir):
    return _metrics(windows.window_metrics(readings(spark, sf_dir), "1 hour"))


@query
def window_metrics_1d(spark, sf_dir):
    return _metrics(windows.window_metrics(readings(spark, sf_dir), "1 day"))


@query
def windows_in_progress(spark, sf_dir):
    as_of = _as_of(spark, sf_dir)
    return _metrics(windows.current_window_metrics(readings(spark, sf_dir), as_of))


@query
def windows_completed(spark, sf_dir):
    as_of = _as_of(spark, sf_dir)
    return _metrics(windows.completed_window_metrics(readings(spark, sf_dir), as_of))


@query
def windows_retained(spark, sf_dir):
    as_of = _as_of(spark, sf_dir)
    return _metrics(windows.retained_window_metrics(readings(spark, sf_dir), as_of))


@query
def windows_newest(spark, sf_dir):
    """The short list of the live view: windows in progress only."""
    current = windows.current_window_metrics(readings(spark, sf_dir), _as_of(spark, sf_dir))
    return _metrics(windows.newest_windows(current))


@query
def events_per_minute(spark, sf_dir):
    return windows.events_per_interval(readings(spark, sf_dir))


# Read queries


@query
def recent_events(spark, sf_dir):
    return _events(reads.recent_events(readings(spark, sf_dir), tiebreak=TIEBREAK))


@query
def recent_events_filtered(spark, sf_dir):
    rows = readings(spark, sf_dir)
    return _events(reads.recent_events(rows, 1000, "purchase", "zone-1", TIEBREAK))


@query
def events_of_type(spark, sf_dir):
    return _events(reads.events_where(readings(spark, sf_dir), sensor_type="error"))


@query
def events_at_location(spark, sf_dir):
    return _events(reads.events_where(readings(spark, sf_dir), location="zone-2"))


@query
def sensor_directory(spark, sf_dir):
    return _events(reads.sensor_directory(readings(spark, sf_dir), tiebreak=TIEBREAK))


@query
def sensor_directory_recent1000(spark, sf_dir):
    return _events(reads.sensor_directory(readings(spark, sf_dir), 1000, TIEBREAK))


@query
def sensor_directory_recent1001(spark, sf_dir):
    """A scope above the largest list length of the event query."""
    return _events(reads.sensor_directory(readings(spark, sf_dir), 1001, TIEBREAK))


@query
def active_sensors(spark, sf_dir):
    return reads.active_sensors(readings(spark, sf_dir), _as_of(spark, sf_dir))


@query
def throughput(spark, sf_dir):
    rows = readings(spark, sf_dir)
    span = rows.agg(F.min("recorded_at"), F.max("recorded_at")).first()
    return _rounded(reads.throughput(rows, span[0], span[1]), "events_per_second", digits=9)


@query
def pipeline_stats(spark, sf_dir):
    """Counters of both tables; the pipeline record started with the first event."""
    rows = readings(spark, sf_dir)
    as_of = _as_of(spark, sf_dir)
    started_at = rows.agg(F.min("recorded_at")).first()[0]
    stats = snapshot.pipeline_stats(rows, _layered(spark, sf_dir), started_at, as_of)
    return stats.select(
        "pipeline.events_ingested",
        F.round("pipeline.events_per_second", 9).alias("events_per_second"),
        "pipeline.anomalies_detected",
        "database.total_events",
        "database.total_anomalies",
        "active_sensors",
    )


# Detectors


@query
def welford_scores(spark, sf_dir):
    scored = detect.z_scores(readings(spark, sf_dir), TIEBREAK)
    return _scores(scored, "expected", "z_score")


@query
def welford_anomalies(spark, sf_dir):
    return _anomalies(detect.z_anomalies(readings(spark, sf_dir), tiebreak=TIEBREAK))


@query
def ewma_scores(spark, sf_dir):
    scored = detect.score_readings(readings(spark, sf_dir), tiebreak=TIEBREAK)
    return _scores(scored, exact=_EWMA)


@query
def ewma_anomalies(spark, sf_dir):
    return _anomalies(detect.ewma_anomalies(readings(spark, sf_dir), tiebreak=TIEBREAK))


@query
def layered_scores(spark, sf_dir):
    scored = detect.score_readings(readings(spark, sf_dir), tiebreak=TIEBREAK)
    return _scores(scored, "expected", "z_score", exact=_EWMA)


@query
def layered_anomalies(spark, sf_dir):
    return _anomalies(_layered(spark, sf_dir))


@query
def anomalies_by_severity(spark, sf_dir):
    return reads.anomalies_by_severity(_layered(spark, sf_dir))


@query
def recent_anomalies(spark, sf_dir):
    return _anomalies(reads.recent_anomalies(_layered(spark, sf_dir), tiebreak=TIEBREAK))


@query
def alert_lines(spark, sf_dir):
    lines = stream_detect.alert_lines(_layered(spark, sf_dir))
    return _rounded(lines, "z_score")


@query
def severity_tiers(spark, sf_dir):
    """Every tier function over a score spread from each reading's value."""
    score = F.col("value") / 20
    first, second = z_severity(score), detect.ewma_severity(score * 1.25)
    return readings(spark, sf_dir).select(
        "event_id",
        first.alias("z_tier"),
        second.alias("ewma_tier"),
        severity_rank(first).cast("long").alias("z_rank"),
        escalate(first).alias("z_escalated"),
        higher(first, second).alias("higher_tier"),
    )


# JSON


def _wire_lines(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", codec.evaluated_once(codec.event_json()).alias("value"))


def _broken(line: Column) -> Column:
    """Damage the records of three event types, each in its own way."""
    kind = F.col("sensor_type")
    return (
        F.when(kind == "error", F.concat(F.lit("#"), line))
        .when(kind == "signup", F.regexp_replace(line, r'"value":[0-9.E-]+', '"value":"high"'))
        .when(kind == "view", F.regexp_replace(line, r'"timestamp":"[^"]+"', '"timestamp":"noon"'))
        .when(kind == "click", F.regexp_replace(line, r'"location":"[^"]+",', ""))
        .otherwise(line)
    )


def _not_json(line: Column) -> Column:
    """Texts that begin like an event but are not one JSON object, by event id."""
    return (
        F.when(F.col("event_id") % 5 == 0, F.translate(line, '"', "'"))
        .when(F.col("event_id") % 5 == 1, F.concat(line, F.lit(" junk}")))
        .when(F.col("event_id") % 5 == 2, F.concat(line, F.lit(" "), line))
        .when(F.col("event_id") % 5 == 3, F.concat(line, F.lit(',{"a":1}')))
        .otherwise(F.concat(F.lit(" "), line, F.lit("\n")))
    )


@query
def decode_events(spark, sf_dir):
    """Encode every event, decode it again."""
    lines = _wire_lines(readings(spark, sf_dir, zoned=True))
    good, _ = codec.split(codec.decode(lines, keep=("event_id",)))
    back = good.withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))
    return _events(back)


def _damaged(spark, sf_dir):
    rows = readings(spark, sf_dir, zoned=True)
    lines = rows.select(
        "event_id", "sensor_type", codec.evaluated_once(codec.event_json()).alias("line")
    )
    return lines.select("event_id", codec.evaluated_once(_broken(F.col("line"))).alias("value"))


@query
def decode_rejects(spark, sf_dir):
    _, rejects = codec.split(codec.decode(_damaged(spark, sf_dir), keep=("event_id",)))
    return rejects.select("event_id", "reject_reason")


@query
def decode_rejects_strict(spark, sf_dir):
    """Single quotes, a second object, and text behind the object are rejects."""
    rows = readings(spark, sf_dir, zoned=True)
    lines = rows.select("event_id", codec.evaluated_once(codec.event_json()).alias("line"))
    lines = lines.select("event_id", codec.evaluated_once(_not_json(F.col("line"))).alias("value"))
    _, rejects = codec.split(codec.decode(lines, keep=("event_id",)))
    return rejects.select("event_id", "reject_reason")


@query
def decode_zero_fill(spark, sf_dir):
    decoded = codec.decode(_damaged(spark, sf_dir), keep=("event_id",))
    good, _ = codec.split(decoded, on_missing="zero")
    return good.select("event_id", "sensor_id", "location", "value")


@query
def kafka_records(spark, sf_dir):
    """What is published for each event: its key, and fields of its JSON value."""
    rows = streams.kafka_records(readings(spark, sf_dir))
    fields = ("sensor_id", "sensor_type", "location", "value", "timestamp", "tags")
    return rows.select("key", F.json_tuple("value", *fields).alias(*fields))


@query
def tags_lookup(spark, sf_dir):
    return readings(spark, sf_dir).select("event_id", F.col("tags")["k"].alias("k"))


# Snapshot


def _run_dir(spark: SparkSession) -> str:
    """A folder of its own under the shared one for this run, removed with the session."""
    path = f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4()}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def _stored(rows: DataFrame) -> DataFrame:
    """Written and read back: the snapshot reads its anomalies from a table, so the
    detector runs once for their number and the newest of them."""
    path = f"{_run_dir(rows.sparkSession)}/stored"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _snapshot(spark, sf_dir):
    rows = readings(spark, sf_dir)
    as_of = _as_of(spark, sf_dir)
    started_at = rows.agg(F.min("recorded_at")).first()[0]
    anomalies = _stored(_layered(spark, sf_dir))
    return snapshot.pipeline_snapshot(rows, anomalies, started_at, as_of, tiebreak=TIEBREAK)


@query
def snapshot_counters(spark, sf_dir):
    """Sizes of the snapshot's parts and the newest entries in it."""
    return _snapshot(spark, sf_dir).select(
        "type",
        "data.stats.events_ingested",
        "data.stats.anomalies_detected",
        F.size("data.anomalies").cast("long").alias("anomalies"),
        F.size("data.events").cast("long").alias("events"),
        F.size("data.windows").cast("long").alias("windows"),
        F.col("data.events")[0]["sensor_id"].alias("newest_event_sensor"),
        F.col("data.anomalies")[0]["sensor_id"].alias("newest_anomaly_sensor"),
        F.col("data.windows")[0]["count"].alias("newest_window_count"),
    )


_SNAPSHOT_WIRE = """type string, data struct<
  stats: struct<events_ingested: long, events_per_second: double, anomalies_detected: long,
                active_sensors: long, processor_lag_ms: long>,
  anomalies: array<struct<sensor_id: string, sensor_type: string, location: string, value: double,
                          expected: double, z_score: double, severity: string, detected_at: string>>,
  events: array<struct<sensor_id: string, sensor_type: string, location: string, value: double,
                       unit: string, tags: map<string, string>, recorded_at: string>>,
  windows: array<struct<sensor_type: string, location: string, window_start: string,
                        window_end: string, count: long, sum: double, min: double, max: double,
                        avg: double, p99: double>>,
  ts: string>"""


@query
def snapshot_json(spark, sf_dir):
    """The snapshot's text read again: one row per entry, every field as text."""
    text = snapshot.snapshot_json(_snapshot(spark, sf_dir))
    wire = text.select(codec.evaluated_once(F.from_json("json", _SNAPSHOT_WIRE)).alias("s"))

    def shown(entry: Column, name: str, digits: int | None = None) -> Column:
        value = entry[name]
        return F.format_string(f"%.{digits}f", value) if digits is not None else value.cast("string")

    def entries(part: str, fields: Callable[[Column], list[Column]]) -> Column:
        def row(entry: Column, i: Column) -> Column:
            return F.struct(F.lit(part).alias("part"), i.alias("position"), _fields(*fields(entry)))

        return F.transform(F.col(f"s.data.{part}"), row)

    stats = F.struct(
        F.lit("stats").alias("part"),
        F.lit(0).alias("position"),
        _fields(
            *[F.col(f"s.data.stats.{n}").cast("string") for n in ("events_ingested", "anomalies_detected")],
            F.format_string("%.6f", "s.data.stats.events_per_second"),
            F.col("s.data.stats.processor_lag_ms").cast("string"),
            F.col("s.type"),
            F.col("s.data.ts"),
        ),
    )
    anomalies = entries(
        "anomalies",
        lambda e: [
            *[shown(e, n) for n in ("sensor_id", "sensor_type", "location")],
            *[shown(e, n, 6) for n in ("value", "expected", "z_score")],
            *[shown(e, n) for n in ("severity", "detected_at")],
        ],
    )
    events = entries(
        "events",
        lambda e: [
            *[shown(e, n) for n in ("sensor_id", "sensor_type", "location")],
            shown(e, "value", 6),
            *[shown(e, n) for n in ("unit", "recorded_at")],
            e["tags"]["k"],
        ],
    )
    current = entries(
        "windows",
        lambda e: [
            *[shown(e, n) for n in ("sensor_type", "location", "window_start", "window_end", "count")],
            *[shown(e, n, 6) for n in ("sum", "min", "max", "avg", "p99")],
        ],
    )
    # One row, so the snapshot is taken once.
    return wire.select(F.explode(F.concat(F.array(stats), anomalies, events, current)).alias("e")).select("e.*")


def _fields(*columns: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(c, F.lit("null")) for c in columns]).alias("fields")


# Derived views


@query
def rollup_5m(spark, sf_dir):
    rows = readings(spark, sf_dir)
    minutes = _stored(windows.window_metrics(rows))
    return _rounded(derived.rollup(minutes, rows, "5 minutes"), "sum", "avg", digits=6)


@query
def events_deduped(spark, sf_dir):
    """The events, a third of them sent twice with another id, kept once each."""
    rows = readings(spark, sf_dir)
    again = rows.where("event_id % 3 = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000)
    return _events(derived.deduplicated_events(rows.union(again), TIEBREAK))


@query
def alerts_deduped(spark, sf_dir):
    return derived.alert_episodes(_layered(spark, sf_dir), "1 day", TIEBREAK)


@query
def alerts_routed(spark, sf_dir):
    routed = derived.routed_alerts(_layered(spark, sf_dir))
    return routed.select("event_id", "sensor_id", "severity", "channel")


@query
def rejects_depth(spark, sf_dir):
    _, rejects = codec.split(codec.decode(_damaged(spark, sf_dir), keep=("event_id",)))
    return derived.reject_depth(rejects)


@query
def rejects_replayed(spark, sf_dir):
    """Rejects read again after their cause is mended: here, a leading mark is removed."""
    _, rejects = codec.split(codec.decode(_damaged(spark, sf_dir), keep=("event_id",)))
    mended = rejects.select("event_id", F.ltrim("raw", F.lit("#")).alias("value"))
    good, _ = codec.split(codec.decode(mended, keep=("event_id",)))
    return good.select("event_id", "sensor_id", "value")


@query
def validation_reasons(spark, sf_dir):
    """All rules that each reading fails."""
    rules = {
        "value_range": F.col("value").between(5, 80),
        "known_type": F.col("sensor_type").isin("click", "view", "purchase"),
        "location_form": F.col("location").rlike("^zone-[0-2]$"),
    }
    failed = F.array_join(derived.failed_rules(rules), ",")
    rows = readings(spark, sf_dir).select("event_id", failed.alias("failed_rules"))
    return rows.where("failed_rules <> ''")


@query
def replay_range(spark, sf_dir):
    """The last five days, warmed up on the twenty before."""
    end = _as_of(spark, sf_dir).replace(hour=0, minute=0, second=0, microsecond=0)
    start = end - dt.timedelta(days=5)
    rows = readings(spark, sf_dir)
    warm_up = dt.timedelta(days=20)
    return _anomalies(derived.replay_range(rows, start, end, warm_up, tiebreak=TIEBREAK))


@query
def tables_by_name(spark, sf_dir):
    """The catalog tables over stored events, read by name: events by day."""
    base, database = _run_dir(spark), f"run_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{base}/database'")
    tables.ensure_tables(spark, base, database)
    tables.append_batch(readings(spark, sf_dir, zoned=True), base, tables.EVENTS, 0)
    tables.sync_partitions(spark, database)
    days = spark.table(f"{database}.{tables.EVENTS}").groupBy("event_date", "sensor_type")
    return days.agg(F.count(F.lit(1)).alias("events"))


@query
def seasonal_scores(spark, sf_dir):
    scored = seasonal.seasonal_scores(readings(spark, sf_dir))
    rows = scored.select("event_id", "sensor_id", "phase", "baseline", "residual", "seasonal_score")
    return _rounded(rows, "residual", "seasonal_score")


@query
def seasonal_anomalies(spark, sf_dir):
    found = seasonal.seasonal_anomalies(readings(spark, sf_dir))
    return _rounded(found.select("event_id", "severity", "seasonal_score"), "seasonal_score")


#: Events of one user are days apart, so the cooldowns are too.
_POLICY = alerts.AlertPolicy(dt.timedelta(days=1), {"purchase": dt.timedelta(days=3)})
_NUMBERED = (*TIEBREAK, "reading_no")


@query
def alerts_suppressed(spark, sf_dir):
    """Every anomaly, whether it raises an alert, and how many repeats came since the last."""
    scored = detect.score_readings(readings(spark, sf_dir), tiebreak=TIEBREAK)
    judged = alerts.judged_alerts(detect.merge_detectors(scored, keep=_NUMBERED), _POLICY)
    return judged.select("event_id", "sensor_id", "reading_no", "alerted", "repeats")


@query
def alerts_delivered(spark, sf_dir):
    """The payloads of all alerts as their sink stores them, by channel."""
    base = _run_dir(spark)
    pipeline.store_alerts(base, "run")(_layered(spark, sf_dir), 0)
    fields = ("sensor_id", "severity", "value", "timestamp")
    return pipeline.stored_alerts(spark, base).select("channel", F.json_tuple("payload", *fields).alias(*fields))


@query
def rejects_stored(spark, sf_dir):
    """Rejects as their sink stores them: depth, and how many can be decoded once a leading
    mark is removed."""
    base = _run_dir(spark)
    _, rejects = codec.split(codec.decode(_damaged(spark, sf_dir)))
    pipeline.store_changes(f"{base}/{pipeline.REJECTS}", "run")(rejects, 0)
    stored = pipeline.stored_rejects(spark, base)
    mended = stored.select(F.col("reject_reason").alias("was"), F.ltrim("raw", F.lit("#")).alias("value"))
    again, _ = codec.split(codec.decode(mended, keep=("was",)))
    replayed = again.groupBy(F.col("was").alias("reject_reason")).agg(F.count(F.lit(1)).alias("replayed"))
    depth = derived.reject_depth(stored).join(replayed, "reject_reason", "left")
    return depth.select("reject_reason", "waiting", F.coalesce("replayed", F.lit(0)).alias("replayed"))


def _second_version() -> Column:
    """An event in the second version of the wire format."""
    return F.to_json(
        F.struct(
            F.lit(2).alias("schema_version"),
            F.struct(F.col("sensor_id").alias("id"), F.col("sensor_type").alias("type"), "location").alias("sensor"),
            F.struct("value", "unit").alias("reading"),
            F.date_format("recorded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("recorded_at"),
            "tags",
        )
    )


@query
def versions_decoded(spark, sf_dir):
    """Records of two versions in one stream of lines, and some of a version nobody knows."""
    rows = readings(spark, sf_dir, zoned=True)
    line = F.when(F.col("event_id") % 2 == 0, codec.event_json()).otherwise(_second_version())
    line = F.when(F.col("event_id") % 10 == 9, F.replace(line, F.lit('"schema_version":2'), F.lit('"schema_version":9'))).otherwise(line)
    lines = rows.select("event_id", codec.evaluated_once(line).alias("value"))
    decoded = codec.decode(lines, keep=("event_id",), versions=codec.WIRE_VERSIONS)
    fields = ("sensor_id", "sensor_type", "location", "value", "unit", "recorded_at")
    stamped = decoded.withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))
    return stamped.select("event_id", "reject_reason", *fields)


@query
def versions_merged(spark, sf_dir):
    """Event files of two versions, with columns of other names and of one version only."""
    base = _run_dir(spark)
    rows = readings(spark, sf_dir, zoned=True)
    rows.where("event_id % 2 = 0").write.parquet(f"{base}/v1")
    second = rows.where("event_id % 2 = 1").withColumnsRenamed({"recorded_at": "observed_at", "sensor_type": "kind"})
    second.drop("unit").withColumn("quality", F.lit("checked")).write.parquet(f"{base}/v2")
    merged = tables.merged_versions({v: spark.read.parquet(f"{base}/v{v}") for v in (1, 2)})
    merged = merged.withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))
    return _events(merged)


# Streams: run to the end of the table, then read what was written


def _finish(stream: DataFrame, mode: str, write, checkpoint: str) -> None:
    spark = stream.sparkSession
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = min(configured, spark.sparkContext.defaultParallelism)
    writer = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
    )
    with pipeline.state_partitions(spark, few):
        running = writer.start()
    running.awaitTermination()


def _options(base: str) -> pipeline.PipelineOptions:
    return pipeline.PipelineOptions(base, f"{base}/checkpoint", tiebreak=TIEBREAK)


@query
def stream_windows(spark, sf_dir):
    """Windows kept up by parts while the events arrive in slices, the newest first; all
    parts but the last slice's are compacted."""
    base = _run_dir(spark)
    options = _options(base)
    run = tables.run_of(spark, options.checkpoints)
    write = pipeline.in_turn(pipeline.store_events(options, run), parts.store_parts(base, run))
    events = inputs.arriving_readings(spark, sf_dir, f"{base}/arrivals", newest_first=True)
    _finish(events, "append", write, options.checkpoints)
    parts.compact_windows(spark, base)
    live = parts.live_windows(spark, base)
    for name in ("window_start", "window_end"):
        live = live.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return _metrics(live)


def _run_scored(spark: SparkSession, sf_dir: str, base: str) -> None:
    """Score and store the events as they arrive, slice after slice."""
    options = _options(base)
    arriving = inputs.arriving_readings(spark, sf_dir, f"{base}/arrivals")
    scored = stream_detect.score_stream(arriving, tiebreak=TIEBREAK)
    write = pipeline.store_scored(options, tables.run_of(spark, options.checkpoints))
    _finish(scored, "append", write, options.checkpoints)


@query
def stream_layered(spark, sf_dir):
    """Anomalies found by the stateful stream and stored by the pipeline's sink."""
    base = _run_dir(spark)
    _run_scored(spark, sf_dir, base)
    found = tables.read_table(spark, base, tables.ANOMALIES).drop("event_date")
    return _anomalies(found.withColumn("detected_at", F.col("detected_at").cast("timestamp_ntz")))


@query
def stream_events(spark, sf_dir):
    """Events stored by the pipeline's sink, newest slice first, read from the table."""
    base = _run_dir(spark)
    options = _options(base)
    arriving = inputs.arriving_readings(spark, sf_dir, f"{base}/arrivals", newest_first=True)
    scored = stream_detect.score_stream(arriving, tiebreak=TIEBREAK)
    write = pipeline.store_scored(options, tables.run_of(spark, options.checkpoints))
    _finish(scored, "append", write, options.checkpoints)
    stored = tables.read_table(spark, base, tables.EVENTS).drop("event_date")
    return _events(stored.withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz")))


@query
def stream_alerts(spark, sf_dir):
    """Which anomalies raise an alert, judged while the events arrive in six micro-batches."""
    base = _run_dir(spark)
    arriving = inputs.arriving_readings(spark, sf_dir, f"{base}/arrivals", least=6)
    scored = stream_detect.score_stream(arriving, tiebreak=TIEBREAK, policy=_POLICY)
    judged = detect.merge_detectors(scored, keep=(*_NUMBERED, "alerted", "repeats"))
    run = tables.run_of(spark, f"{base}/checkpoint")
    _finish(judged, "append", pipeline.store_changes(f"{base}/judged", run), f"{base}/checkpoint")
    stored = spark.read.schema(judged.schema).parquet(f"{base}/judged")
    return stored.select("event_id", "sensor_id", "reading_no", "alerted", "repeats")


@query
def stream_deduped(spark, sf_dir):
    """Events that arrive again in the same or in the next micro-batch, kept once each; the
    stream is stopped and goes on from its checkpoint half way."""
    base = _run_dir(spark)
    inputs.repeated_arrivals(spark, sf_dir, f"{base}/all")
    once = None
    for upto in (2, 5):  # the first run sees three of the folders, the second all six
        arrivals = f"{base}/all/arrival=[0-{upto}]"
        raw = streams.parquet_stream(spark, inputs.RAW_EVENTS, arrivals, max_files=1)
        once = stream_detect.deduplicated_stream(inputs.as_readings(raw, zoned=True), within="60 days")
        run = tables.run_of(spark, f"{base}/checkpoint")
        _finish(once, "append", pipeline.store_changes(f"{base}/once", run), f"{base}/checkpoint")
    stored = spark.read.parquet(f"{base}/once").select(*once.columns)
    return _events(stored.withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz")))


@query
def stream_metrics(spark, sf_dir):
    """The progress reports of a stream of eight or more micro-batches, from their table."""
    base = _run_dir(spark)
    arriving = inputs.arriving_readings(spark, sf_dir, f"{base}/arrivals", least=8)
    with progress.MetricsTable(spark, f"{base}/{progress.METRICS}", every=3) as metrics:
        writer = arriving.writeStream.queryName(f"metrics_{uuid.uuid4().hex}").format("noop")
        running = writer.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        running.awaitTermination()
        metrics.wait_for(running)
    reports = progress.read_metrics(spark, f"{base}/{progress.METRICS}").where(F.col("query") == running.name)
    return reports.agg(
        F.count_distinct("batch_id").alias("batches"),
        F.sum("input_rows").alias("input_rows"),
        (F.min("handling_ms") > 0).alias("all_timed"),
    )


@query
def stream_counters(spark, sf_dir):
    """What the pipeline's micro-batches counted, without a look at the tables."""
    base = _run_dir(spark)
    _run_scored(spark, sf_dir, base)
    counters = progress.live_counters(spark, base)
    return counters.select("total_events", "total_anomalies", (F.col("processor_lag_ms") > 0).alias("has_lag"))


@query
def stream_windows_completed(spark, sf_dir):
    """Windows that the watermark has passed, each written once."""
    base = _run_dir(spark)
    arriving = inputs.arriving_readings(spark, sf_dir, f"{base}/arrivals")
    done = pipeline.completed_windows(arriving)
    run = tables.run_of(spark, f"{base}/checkpoint")
    _finish(done, "append", pipeline.store_changes(f"{base}/{pipeline.COMPLETED_WINDOWS}", run), f"{base}/checkpoint")
    stored = pipeline.stored_windows(spark, base, pipeline.COMPLETED_WINDOWS)
    for name in ("window_start", "window_end"):
        stored = stored.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return _metrics(stored)
