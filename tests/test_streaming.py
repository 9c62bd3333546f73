import datetime as dt
import json

import pytest
from helpers import START, event_frame, event_rows, spiky
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeflow.functions.codec import event_json
from gaugeflow.operators import detect, windows
from gaugeflow.operators.fold import SCORE_COLUMNS
from gaugeflow.plans.inputs import RAW_EVENTS, TIEBREAK, as_readings, readings
from gaugeflow.plans.snapshot import pipeline_snapshot, snapshot_json
from gaugeflow.schemas import WINDOW_COLUMNS
from gaugeflow.sources import tables
from gaugeflow.sources.streams import parquet_stream, text_stream
from gaugeflow.streaming import parts, pipeline
from gaugeflow.streaming.detect import anomaly_stream, deduplicated_stream, score_stream
from gaugeflow.streaming.progress import MetricsTable, handling_ms, live_counters, progress_frame, read_metrics


def _parts(spark, medium, folder, parts=4):
    """The event table as several files in time order."""
    raw = spark.read.parquet(f"{medium}/events.parquet")
    part = F.ntile(parts).over(Window.orderBy("event_id"))
    numbered = raw.withColumn("part", part).persist()
    for i in range(1, parts + 1):
        one = numbered.filter(F.col("part") == i).drop("part").coalesce(1)
        one.write.mode("append").parquet(folder)
    numbered.unpersist()


def _drain(stream, mode, name, checkpoint):
    """Run to the end of the input; rows are appended to an in-memory table."""
    running = (
        stream.writeStream.outputMode(mode)
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return running


def _to_parquet(stream, path, checkpoint):
    running = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return running


@pytest.fixture(scope="module")
def source(spark, medium, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stream") / "events")
    _parts(spark, medium, folder)
    return folder


def _stream(spark, folder, per_batch=1):
    return as_readings(parquet_stream(spark, RAW_EVENTS, folder, per_batch), zoned=True)


def test_scores_equal_batch_and_survive_a_restart(spark, medium, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    raw = spark.read.parquet(f"{medium}/events.parquet").orderBy("event_id")
    halves = [raw.filter(F.col("event_id") < 5000), raw.filter(F.col("event_id") >= 5000)]
    for half in halves:  # the second run resumes from the first one's checkpoint
        half.repartitionByRange(2, "event_id").write.mode("append").parquet(folder)
        scored = score_stream(_stream(spark, folder, per_batch=2), tiebreak=TIEBREAK)
        _to_parquet(scored, out, checkpoint)
    columns = ["event_id", "sensor_id", *SCORE_COLUMNS]
    streamed = sorted(spark.read.parquet(out).select(columns).collect())
    batch = detect.score_readings(readings(spark, medium), tiebreak=TIEBREAK)
    assert streamed == sorted(batch.select(columns).collect())
    assert spark.read.parquet(out).filter("out_of_order").isEmpty()


def test_anomalies_equal_batch(spark, medium, source, tmp_path):
    found = anomaly_stream(_stream(spark, source, 2), tiebreak=TIEBREAK)
    _drain(found, "append", "stream_anomalies", str(tmp_path))
    columns = ["event_id", "expected", "z_score", "severity"]
    batch = detect.layered_anomalies(readings(spark, medium), tiebreak=TIEBREAK).select(columns)
    streamed = spark.table("stream_anomalies").select(columns)
    assert sorted(streamed.collect()) == sorted(batch.collect())


def test_late_readings_are_scored_in_arrival_order_and_marked(spark, tmp_path):
    first = spiky(60, seed=1)
    late = [1000.0]
    folder = str(tmp_path / "in")
    rows = event_rows({"s": first})
    frame = event_frame(spark, rows)
    for i, part in enumerate((frame, event_frame(spark, event_rows({"s": late})))):
        zoned = part.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
        zoned.coalesce(1).write.mode("append").parquet(folder)
        stream = parquet_stream(spark, zoned.schema, folder)
        _to_parquet(score_stream(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("reading_no").collect()
    assert [r.out_of_order for r in out] == [False] * 60 + [True]
    assert out[-1].reading_no == 61 and out[-1].value == 1000.0


def test_state_expiry_forgets_silent_sensors(spark, tmp_path):
    folder = str(tmp_path / "in")
    zoned = event_frame(spark, event_rows({"s": [20.0] * 5})).withColumn(
        "recorded_at", F.col("recorded_at").cast("timestamp")
    )
    zoned.coalesce(1).write.parquet(folder)
    # Expiry needs a ticking trigger: a run to the end of the input has no end
    # while timeouts are pending.
    query = (
        score_stream(parquet_stream(spark, zoned.schema, folder), state_ttl_ms=500)
        .writeStream.format("memory")
        .queryName("expiring")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(processingTime="1 second")
        .start()
    )

    def wait_for(rows):
        for _ in range(40):
            if spark.table("expiring").count() >= rows:
                return
            query.awaitTermination(1)

    try:
        wait_for(5)
        query.awaitTermination(4)
        zoned.coalesce(1).write.mode("append").parquet(folder)
        wait_for(10)
    finally:
        query.stop()
    assert sorted(r.reading_no for r in spark.table("expiring").collect()) == sorted([1, 2, 3, 4, 5] * 2)


def test_update_mode_windows_equal_batch(spark, medium, source, tmp_path):
    base = str(tmp_path / "base")
    metrics = windows.window_metrics(_stream(spark, source), "1 day", watermark="60 days")
    running = (
        metrics.writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "ck"))
        .trigger(availableNow=True)
        .foreachBatch(pipeline.store_changes(f"{base}/{pipeline.CHANGED_WINDOWS}", "a"))
        .start()
    )
    running.awaitTermination()
    live = pipeline.latest_windows(spark, base)
    for name in ("window_start", "window_end"):
        live = live.withColumn(name, F.col(name).cast("timestamp_ntz"))
    batch = windows.window_metrics(readings(spark, medium), "1 day")
    exact = [c for c in WINDOW_COLUMNS if c not in ("sum", "avg")]
    assert sorted(live.select(exact).collect()) == sorted(batch.select(exact).collect())
    totals = [df.agg(F.round(F.sum("sum"), 4)).first()[0] for df in (live, batch)]
    assert totals[0] == totals[1]


def _minute_file(spark, folder, *minutes):
    rows = [
        (i, "s", "temperature", "lab", float(m), "u", None, START + dt.timedelta(minutes=m))
        for i, m in enumerate(minutes)
    ]
    zoned = event_frame(spark, rows).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    zoned.coalesce(1).write.mode("append").parquet(folder)
    return zoned.schema


def test_append_mode_emits_windows_once_the_watermark_has_passed(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    emitted = []
    dropped = 0
    # Minute 1 comes late twice: within the hour it counts, after it it does not.
    for minutes in ([0, 1], [50, 1], [200], [1, 201]):
        schema = _minute_file(spark, folder, *minutes)
        stream = pipeline.completed_windows(parquet_stream(spark, schema, folder))
        query = _to_parquet(stream, out, checkpoint)
        report = progress_frame(spark, query)
        dropped += report.agg(F.sum("late_rows")).first()[0] or 0
        assert handling_ms(query) >= 0
        rows = spark.read.schema("window_start timestamp, count long").parquet(out).collect()
        emitted.append(sorted((int((r[0].minute + 60 * (r[0].hour - 12))), r[1]) for r in rows))
    assert emitted[0] == [] and emitted[1] == []
    assert emitted[2] == emitted[3] == [(0, 1), (1, 2), (50, 1)]
    assert dropped == 1


def test_pipeline_end_to_end(spark, small, tmp_path):
    lines_dir = str(tmp_path / "lines")
    events = readings(spark, small, zoned=True)
    good = events.orderBy("event_id").select(event_json().alias("value"))
    good.coalesce(1).write.text(lines_dir)
    bad = spark.createDataFrame([("oops",), ('{"sensor_id":"x"}',), ('{"value":"1"}',)], "value string")
    bad.coalesce(1).write.mode("append").text(lines_dir)

    options = pipeline.PipelineOptions(
        str(tmp_path / "base"), str(tmp_path / "ck"), available_now=True, watermark="60 days"
    )
    queries = pipeline.start_pipeline(text_stream(spark, lines_dir), options)
    assert sorted(queries) == ["readings", "rejects"]
    for query in queries.values():
        query.awaitTermination()

    stored = tables.read_table(spark, options.base, tables.EVENTS)
    assert stored.count() == 1000
    assert stored.filter("tags IS NULL").isEmpty()
    rejects = spark.read.parquet(options.path(pipeline.REJECTS))
    assert {(r.raw, r.reject_reason) for r in rejects.collect()} == {
        ("oops", "malformed"),
        ('{"sensor_id":"x"}', "missing_field"),
        ('{"value":"1"}', "malformed"),
    }
    assert parts.live_windows(spark, options.base).agg(F.sum("count")).first()[0] == 1000
    found = tables.read_table(spark, options.base, tables.ANOMALIES)
    batch = detect.layered_anomalies(readings(spark, small), tiebreak=TIEBREAK)
    assert sorted(r.z_score for r in found.collect()) == sorted(r.z_score for r in batch.collect())

    # Time filters prune days; a batch written again replaces itself, while an equal
    # number of another run, as after a lost checkpoint, replaces nothing.
    late = tables.since(stored, tables.EVENTS, dt.datetime(2024, 1, 29))
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    batch_rows = stored.filter("event_date = '2024-01-05'").drop("event_date")
    before = batch_rows.count()
    snapshot = spark.createDataFrame(batch_rows.collect(), batch_rows.schema)
    run = tables.run_of(spark, options.checkpoint("readings"))
    assert run == tables.run_of(spark, options.checkpoint("readings"))
    assert run != tables.run_of(spark, str(tmp_path / "another"))
    tables.append_batch(snapshot, options.base, tables.EVENTS, 0, run)
    assert tables.read_table(spark, options.base, tables.EVENTS).count() == 1000
    tables.append_batch(snapshot, options.base, tables.EVENTS, 0, "another")
    assert tables.read_table(spark, options.base, tables.EVENTS).count() == 1000 + before


def test_tables_are_created_once(spark, tmp_path):
    base = str(tmp_path / "catalog")
    spark.sql("CREATE DATABASE IF NOT EXISTS gf_test")
    tables.ensure_tables(spark, base, "gf_test")
    tables.ensure_tables(spark, base, "gf_test")
    created = {t.name for t in spark.catalog.listTables("gf_test") if not t.isTemporary}
    assert created == {"sensor_events", "anomalies"}
    events = spark.table("gf_test.sensor_events")
    assert events.columns[-3:] == ["event_date", "run_id", "batch_id"] and events.isEmpty()
    tables.append_batch(event_frame(spark, event_rows({"s": [1.0] * 7})), base, tables.EVENTS, 0)
    tables.sync_partitions(spark, "gf_test")
    assert spark.table("gf_test.sensor_events").count() == 7
    spark.sql("DROP DATABASE gf_test CASCADE")


def test_snapshot_feed(spark, small, tmp_path):
    events = readings(spark, small)
    anomalies = detect.layered_anomalies(events, tiebreak=TIEBREAK)
    published = []
    query = pipeline.start_snapshots(
        spark,
        lambda: (events, anomalies),
        lambda frame: published.append(frame.first()[0]),
        START,
        str(tmp_path),
    )
    try:
        for _ in range(60):
            if published:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert json.loads(published[0])["data"]["stats"]["events_ingested"] == 1000


def _metric_rows(df):
    exact = [c for c in WINDOW_COLUMNS if c not in ("sum", "avg")]
    rows = df.select(*exact, F.round("sum", 6).alias("sum"), F.round("avg", 6).alias("avg")).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_parts_add_up_to_the_windows_through_retries_and_compactions(spark, tmp_path):
    base = str(tmp_path / "base")
    rows = []
    for i, x in enumerate(spiky(900, seed=6)):
        at = START + dt.timedelta(seconds=(i * 37) % 400)
        kind, place = [("heat", "lab"), (None, "lab"), ("heat", None)][i % 3]
        value = None if i % 50 == 0 else round(x, 0 if i % 2 else 6)
        rows.append((i, "s", kind, place, value, "", None, at))
    zoned = event_frame(spark, rows).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    want = _metric_rows(windows.window_metrics(zoned))
    assert parts.live_windows(spark, base).isEmpty() and parts.compact_windows(spark, base) == -1

    def put(run, batch):
        own = zoned.where((F.col("event_id") % 9 == batch) if run == "a" else F.col("event_id") % 9 >= 6)
        parts.store_parts(base, run)(own, batch)

    for batch in range(6):
        put("a", batch)
    put("a", 5)  # a retry
    put("b", 0)  # another run, after the checkpoint was lost
    assert _metric_rows(parts.live_windows(spark, base)) == want
    assert parts.compact_windows(spark, base, clean=False) == 0
    assert _metric_rows(parts.live_windows(spark, base)) == want
    put("a", 5)  # the newest batch stays open
    assert _metric_rows(parts.live_windows(spark, base)) == want
    later = zoned.withColumn("value", F.col("value") * 3)
    parts.store_parts(base, "a")(later, 6)
    want = _metric_rows(windows.window_metrics(zoned.union(later)))
    assert _metric_rows(parts.live_windows(spark, base)) == want
    assert parts.compact_windows(spark, base) == 1
    assert _metric_rows(parts.live_windows(spark, base)) == want
    assert parts.compact_windows(spark, base) == -1


def test_an_unfinished_compaction_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "base")
    zoned = event_frame(spark, event_rows({"s": spiky(200)}))
    zoned = zoned.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    for batch in range(3):
        parts.store_parts(base, "a")(zoned.where(F.col("event_id") % 3 == batch), batch)
    want = _metric_rows(windows.window_metrics(zoned))
    # Its parts are written, its list of batches is not.
    parts.stored_parts(spark, base).write.parquet(f"{base}/{parts.COMPACTED}/compaction=0")
    assert _metric_rows(parts.live_windows(spark, base)) == want
    assert parts.compact_windows(spark, base) == 0
    assert _metric_rows(parts.live_windows(spark, base)) == want
    assert spark.read.parquet(f"{base}/{parts.PARTS}").select("batch_id").distinct().count() == 1


def test_repeats_are_dropped_within_a_batch_in_later_ones_and_after_a_restart(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rows = event_rows({"a": spiky(40), "b": spiky(40, seed=2)}, step_ms=60_000)
    zoned = event_frame(spark, rows).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    thirds = [zoned.where(F.minute("recorded_at") % 3 == i) for i in range(3)]
    for put in (
        thirds[0].union(thirds[0]),  # in one micro-batch
        thirds[1].union(thirds[0].limit(5)),  # in a later one
        thirds[2].union(thirds[1]),  # after a restart: each call is a run of its own
    ):
        put.coalesce(1).write.mode("append").parquet(folder)
        stream = parquet_stream(spark, zoned.schema, folder, max_files=1)
        _to_parquet(deduplicated_stream(stream), out, checkpoint)
    stored = spark.read.parquet(out)
    assert sorted(r.event_id for r in stored.collect()) == sorted(r[0] for r in rows)


def test_every_report_of_a_long_query_is_kept(spark, tmp_path):
    folder, path = str(tmp_path / "in"), str(tmp_path / "metrics")
    spark.range(105).repartition(105, "id").write.option("maxRecordsPerFile", 1).parquet(folder)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)
    with MetricsTable(spark, path, every=20) as metrics:
        writer = stream.writeStream.queryName("long").format("noop").option("checkpointLocation", str(tmp_path / "ck"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        assert metrics.wait_for(query)
    assert len(query.recentProgress) <= 100  # what a query keeps itself
    rows = read_metrics(spark, path).where("query = 'long'").orderBy("batch_id").collect()
    assert [r.batch_id for r in rows] == list(range(len(rows))) and len(rows) > 100
    assert sum(r.input_rows for r in rows) == 105
    assert all(r.handling_ms > 0 and r.late_rows == 0 for r in rows)


def test_counters_are_kept_per_batch_and_read_by_the_snapshot(spark, small, tmp_path):
    base = str(tmp_path / "base")
    assert live_counters(spark, base).first().asDict() == {
        "total_events": 0, "total_anomalies": 0, "processor_lag_ms": 0
    }
    options = pipeline.PipelineOptions(base, str(tmp_path / "ck"), tiebreak=TIEBREAK, alerts=None)
    events = readings(spark, small, zoned=True)
    scored = detect.score_readings(events, tiebreak=TIEBREAK).join(events.select("event_id", "unit", "tags"), "event_id")
    write = pipeline.store_scored(options, "run")
    quiet = scored.where("reading_no < 10")  # no anomaly in it
    for batch, part in enumerate((quiet, scored.where("reading_no >= 10"), scored.where("reading_no >= 10"))):
        write(part, min(batch, 1))  # the second batch twice
    counted = live_counters(spark, base).first()
    found = detect.layered_anomalies(events, tiebreak=TIEBREAK).count()
    assert (counted.total_events, counted.total_anomalies) == (1000, found)
    assert counted.processor_lag_ms > 0
    tick = snapshot_json(pipeline_snapshot(events, scored.limit(0).withColumn("severity", F.lit("")).withColumn(
        "detected_at", F.col("recorded_at")), START, counters=live_counters(spark, base))).first()[0]
    stats = json.loads(tick)["data"]["stats"]
    assert (stats["events_ingested"], stats["anomalies_detected"]) == (1000, found)
    assert stats["processor_lag_ms"] == counted.processor_lag_ms


def test_readings_without_time_or_keys_go_through_the_streams(spark, tmp_path):
    folder, base = str(tmp_path / "in"), str(tmp_path / "base")
    rows = event_rows({None: spiky(30), "a": spiky(30, seed=2)})
    rows += [(900, "a", None, "lab", 5.0, "u", None, START), (901, "a", "heat", None, None, "u", None, START)]
    rows += [(902, "a", "heat", "lab", 5.0, "u", None, None)]
    zoned = event_frame(spark, rows).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    zoned.coalesce(1).write.parquet(folder)
    options = pipeline.PipelineOptions(base, str(tmp_path / "ck"), tiebreak=("event_id",))
    scored = score_stream(parquet_stream(spark, zoned.schema, folder), tiebreak=("event_id",))
    sink = pipeline.in_turn(pipeline.store_scored(options, "r"), parts.store_parts(base, "r"))
    writer = scored.writeStream.option("checkpointLocation", options.checkpoint("a")).trigger(availableNow=True)
    writer.foreachBatch(sink).start().awaitTermination()
    assert tables.read_table(spark, base, tables.EVENTS).count() == len(rows)
    assert _metric_rows(parts.live_windows(spark, base)) == _metric_rows(windows.window_metrics(zoned))


def test_a_days_batches_become_one(spark, tmp_path, monkeypatch):
    base, day = str(tmp_path / "base"), dt.date(2024, 3, 1)
    events = event_frame(spark, event_rows({"a": spiky(90), "b": spiky(90, seed=2)}))
    later = events.withColumn("recorded_at", F.col("recorded_at") + F.expr("INTERVAL 1 DAY"))
    for batch in range(4):
        own = events.where(F.col("event_id") % 4 == batch)
        tables.append_batch(own, base, tables.EVENTS, batch, "r")
    tables.append_batch(later, base, tables.EVENTS, 2, "s")

    def stored():
        rows = tables.read_table(spark, base, tables.EVENTS).select("event_date", "sensor_id", "value").collect()
        return sorted(map(repr, rows))

    def batches():
        rows = spark.read.parquet(f"{base}/{tables.EVENTS}").where(F.col("event_date") == F.lit(day))
        return {tuple(r) for r in rows.select("run_id", "batch_id").distinct().collect()}

    want = stored()
    assert tables.compact_day(spark, base, tables.EVENTS, day) == 3
    assert batches() == {("compacted", 0), ("r", 3)} and stored() == want
    assert tables.compact_day(spark, base, tables.EVENTS, day) == 0
    tables.append_batch(events.where("event_id % 4 = 3"), base, tables.EVENTS, 3, "r")  # a retry
    assert stored() == want
    tables.append_batch(later, base, tables.EVENTS, 4, "r")
    want = stored()
    # Breaking off once the list is written: the next call finishes it.
    def lost(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(type(spark.read), "text", lost)
        tables.compact_day(spark, base, tables.EVENTS, day)
    assert stored() == want
    tables.compact_day(spark, base, tables.EVENTS, day)
    assert batches() == {("compacted", 1)} and stored() == want
