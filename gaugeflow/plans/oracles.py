"""The same queries in SQL, for checking the results."""

from __future__ import annotations

_READINGS = """
readings AS (
  SELECT event_id, 'sensor-' || user_id AS sensor_id, event_type AS sensor_type,
         'zone-' || (user_id % 4) AS location, value, '' AS unit, ts AS recorded_at, props
  FROM events
)"""

_AS_OF = "as_of AS (SELECT max(ts) - INTERVAL 1 DAY AS t, date_trunc('minute', max(ts) - INTERVAL 1 DAY) AS minute FROM events)"

_EVENT_ROW = """event_id, sensor_id, sensor_type, location, value, unit,
  '{"k":"' || json_extract_string(props, '$.k') || '"}' AS tags, recorded_at"""


def _windows(width: str) -> str:
    return f"""
metrics AS (
  SELECT sensor_type, location,
         time_bucket(INTERVAL '{width}', recorded_at, TIMESTAMP '1970-01-01') AS window_start,
         time_bucket(INTERVAL '{width}', recorded_at, TIMESTAMP '1970-01-01') + INTERVAL '{width}' AS window_end,
         count(*) AS count, round(sum(value), 8) AS sum, min(value) AS min, max(value) AS max,
         round(avg(value), 8) AS avg, quantile_disc(value, 0.99) AS p99
  FROM readings GROUP BY ALL
)"""


# Both recurrences, one reading after the other.
_STATES = """
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY recorded_at, event_id) AS n
  FROM readings
),
states AS (
  SELECT sensor_id, n, 0.0::DOUBLE AS expected, value AS mean, 0.0::DOUBLE AS m2,
         0.0::DOUBLE AS base, 1.0::DOUBLE AS base_sd, value AS ewma, 1.0::DOUBLE AS var
  FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.sensor_id, o.n, s.mean,
         s.mean + (o.value - s.mean) / o.n,
         s.m2 + (o.value - s.mean) * (o.value - (s.mean + (o.value - s.mean) / o.n)),
         s.ewma, CASE WHEN s.var <= 0 THEN 1.0::DOUBLE ELSE sqrt(s.var) END,
         s.ewma + 0.1::DOUBLE * (o.value - s.ewma),
         (1.0::DOUBLE - 0.1::DOUBLE)
           * (s.var + 0.1::DOUBLE * (o.value - s.ewma) * (o.value - s.ewma))
  FROM states s JOIN ordered o ON o.sensor_id = s.sensor_id AND o.n = s.n + 1
),
scored AS (
  SELECT o.event_id, o.sensor_id, o.sensor_type, o.location, o.value, o.recorded_at,
         s.n AS reading_no, s.expected,
         abs(o.value - s.expected)
           / CASE WHEN s.n < 2 OR s.m2 = 0 THEN 1.0::DOUBLE ELSE sqrt(s.m2 / (s.n - 1)) END AS z,
         s.base, abs(o.value - s.base) / s.base_sd AS dev
  FROM states s JOIN ordered o ON o.sensor_id = s.sensor_id AND o.n = s.n
),
tiered AS (
  SELECT *, reading_no >= 10 AND z >= 2.0 AS by_z, reading_no >= 20 AND dev > 3.0 AS by_ewma,
         CASE WHEN z >= 5 THEN 4 WHEN z >= 4 THEN 3 WHEN z >= 3 THEN 2 ELSE 1 END AS z_rank,
         CASE WHEN dev > 7 THEN 4 WHEN dev > 5 THEN 3 WHEN dev > 4 THEN 2 ELSE 1 END AS dev_rank
  FROM scored
),
layered AS (
  SELECT event_id, sensor_id, sensor_type, location, value,
         CASE WHEN by_z THEN expected ELSE base END AS expected,
         CASE WHEN by_z THEN z ELSE dev END AS z_score,
         (['low', 'medium', 'high', 'critical'])[
           CASE WHEN by_z AND by_ewma THEN least(greatest(z_rank, dev_rank) + 1, 4)
                WHEN by_z THEN z_rank ELSE dev_rank END] AS severity,
         recorded_at AS detected_at
  FROM tiered WHERE by_z OR by_ewma
)"""

_ANOMALY_ROW = """event_id, sensor_id, sensor_type, location, value,
  round(expected, 8) AS expected, round(z_score, 8) AS z_score, severity, detected_at"""


def _with(*parts: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join((_READINGS, *parts))} {select}"


def _detector(select: str, *more: str) -> str:
    return _with(_STATES, *more, select=select, recursive=True)


_TIER = "(['low', 'medium', 'high', 'critical'])[{rank}]"
_Z_RANK = "CASE WHEN s >= 5 THEN 4 WHEN s >= 4 THEN 3 WHEN s >= 3 THEN 2 ELSE 1 END"
_E_RANK = "CASE WHEN s * 1.25 > 7 THEN 4 WHEN s * 1.25 > 5 THEN 3 WHEN s * 1.25 > 4 THEN 2 ELSE 1 END"

_SEASONAL = """
phased AS (SELECT *, hour(recorded_at)::INT AS phase FROM readings),
placed AS (
  SELECT *, value - baseline AS residual FROM phased
  JOIN (SELECT sensor_id, phase, quantile_disc(value, 0.5) AS baseline FROM phased GROUP BY ALL) USING (sensor_id, phase)
),
seasonal AS (
  SELECT event_id, sensor_id, phase, baseline, residual,
    abs(residual) / CASE WHEN mad > 0 THEN mad * 1.4826::DOUBLE ELSE 1.0::DOUBLE END AS score
  FROM placed JOIN (
    SELECT sensor_id, phase, quantile_disc(abs(residual), 0.5) AS mad FROM placed GROUP BY ALL
  ) USING (sensor_id, phase)
)"""

# One anomaly of a sensor after the other.
_JUDGED = """
numbered AS (
  SELECT l.event_id, l.sensor_id, l.sensor_type, l.detected_at, o.n AS no,
    row_number() OVER (PARTITION BY l.sensor_id ORDER BY o.n) AS k
  FROM layered l JOIN ordered o USING (event_id)
),
judged AS (
  SELECT event_id, sensor_id, k, no, true AS alerted, detected_at AS alerted_at, false AS armed, 0::BIGINT AS repeats
  FROM numbered WHERE k = 1
  UNION ALL
  SELECT event_id, sensor_id, k, no, again, CASE WHEN again THEN detected_at ELSE alerted_at END,
    ready AND NOT again, CASE WHEN again THEN 0 ELSE repeats + 1 END
  FROM (
    SELECT n.*, j.alerted_at, j.repeats, j.armed OR n.no - j.no > 2 AS ready,
      ready AND n.detected_at >= j.alerted_at
        + CASE n.sensor_type WHEN 'purchase' THEN INTERVAL 3 DAY ELSE INTERVAL 1 DAY END AS again
    FROM judged j JOIN numbered n ON n.sensor_id = j.sensor_id AND n.k = j.k + 1
  )
)"""
_JUDGED_ROWS = "SELECT event_id, sensor_id, no AS reading_no, alerted, repeats FROM judged"

ORACLES: dict[str, str] = {
    "window_metrics_1m": _with(_windows("1 minute"), select="SELECT * FROM metrics"),
    "window_metrics_1h": _with(_windows("1 hour"), select="SELECT * FROM metrics"),
    "window_metrics_1d": _with(_windows("1 day"), select="SELECT * FROM metrics"),
    "windows_in_progress": _with(
        _windows("1 minute"),
        _AS_OF,
        select="SELECT metrics.* FROM metrics, as_of WHERE window_start >= minute",
    ),
    "windows_completed": _with(
        _windows("1 minute"),
        _AS_OF,
        select="SELECT metrics.* FROM metrics, as_of WHERE window_start < minute",
    ),
    "windows_retained": _with(
        _windows("1 minute"),
        _AS_OF,
        select="SELECT metrics.* FROM metrics, as_of WHERE window_start >= minute - INTERVAL 60 MINUTE",
    ),
    "windows_newest": _with(
        _windows("1 minute"),
        _AS_OF,
        select="""SELECT metrics.* FROM metrics, as_of WHERE window_start >= minute
ORDER BY window_start DESC, sensor_type, location LIMIT 8""",
    ),
    "events_per_minute": """
SELECT date_trunc('minute', ts) AS window_start, count(*) AS events
FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 60""",
    "recent_events": _with(
        select=f"SELECT {_EVENT_ROW} FROM readings ORDER BY recorded_at DESC, event_id DESC LIMIT 100"
    ),
    "recent_events_filtered": _with(
        select=f"""SELECT {_EVENT_ROW} FROM readings
WHERE sensor_type = 'purchase' AND location = 'zone-1'
ORDER BY recorded_at DESC, event_id DESC LIMIT 1000"""
    ),
    "events_of_type": _with(
        select=f"SELECT {_EVENT_ROW} FROM readings WHERE sensor_type = 'error'"
    ),
    "events_at_location": _with(
        select=f"SELECT {_EVENT_ROW} FROM readings WHERE location = 'zone-2'"
    ),
    "sensor_directory": _with(
        select=f"""SELECT {_EVENT_ROW} FROM readings QUALIFY row_number() OVER
(PARTITION BY sensor_id ORDER BY recorded_at DESC, event_id DESC) = 1"""
    ),
    "sensor_directory_recent1000": _with(
        "newest AS (SELECT * FROM readings ORDER BY recorded_at DESC, event_id DESC LIMIT 1000)",
        select=f"""SELECT {_EVENT_ROW} FROM newest QUALIFY row_number() OVER
(PARTITION BY sensor_id ORDER BY recorded_at DESC, event_id DESC) = 1""",
    ),
    "sensor_directory_recent1001": _with(
        "newest AS (SELECT * FROM readings ORDER BY recorded_at DESC, event_id DESC LIMIT 1001)",
        select=f"""SELECT {_EVENT_ROW} FROM newest QUALIFY row_number() OVER
(PARTITION BY sensor_id ORDER BY recorded_at DESC, event_id DESC) = 1""",
    ),
    "active_sensors": _with(
        _AS_OF,
        select="""SELECT count(DISTINCT sensor_id) AS active_sensors
FROM readings, as_of WHERE recorded_at > t - INTERVAL 5 MINUTE""",
    ),
    "throughput": """
SELECT count(*) AS events_ingested,
  round(count(*) / (date_diff('microsecond', min(ts), max(ts)) / 1000000.0::DOUBLE), 9)
    AS events_per_second
FROM events""",
    "pipeline_stats": _detector(
        """SELECT
  (SELECT count(*) FROM readings) AS events_ingested,
  (SELECT round(count(*) / (date_diff('microsecond', min(recorded_at), any_value(t)) / 1000000.0::DOUBLE), 9)
   FROM readings, as_of) AS events_per_second,
  (SELECT count(*) FROM layered) AS anomalies_detected,
  (SELECT count(*) FROM readings) AS total_events,
  (SELECT count(*) FROM layered) AS total_anomalies,
  (SELECT count(DISTINCT sensor_id) FROM readings, as_of
   WHERE recorded_at > t - INTERVAL 5 MINUTE) AS active_sensors""",
        _AS_OF,
    ),
    "welford_scores": _detector(
        "SELECT sensor_id, event_id, reading_no, round(expected, 8) AS expected, "
        "round(z, 8) AS z_score FROM scored"
    ),
    "welford_anomalies": _detector(
        f"""SELECT event_id, sensor_id, sensor_type, location, value,
  round(expected, 8) AS expected, round(z, 8) AS z_score,
  {_TIER.format(rank="z_rank")} AS severity, recorded_at AS detected_at
FROM tiered WHERE by_z"""
    ),
    "ewma_scores": _detector(
        "SELECT sensor_id, event_id, reading_no, base AS ewma_expected, "
        "dev AS ewma_deviation FROM scored"
    ),
    "ewma_anomalies": _detector(
        f"""SELECT event_id, sensor_id, sensor_type, location, value,
  round(base, 8) AS expected, round(dev, 8) AS z_score,
  {_TIER.format(rank="dev_rank")} AS severity, recorded_at AS detected_at
FROM tiered WHERE by_ewma"""
    ),
    "layered_scores": _detector(
        "SELECT sensor_id, event_id, reading_no, round(expected, 8) AS expected, "
        "round(z, 8) AS z_score, base AS ewma_expected, dev AS ewma_deviation FROM scored"
    ),
    "layered_anomalies": _detector(f"SELECT {_ANOMALY_ROW} FROM layered"),
    "anomalies_by_severity": _detector(
        "SELECT severity, count(*) AS anomalies FROM layered GROUP BY severity"
    ),
    "recent_anomalies": _detector(
        f"SELECT {_ANOMALY_ROW} FROM layered ORDER BY detected_at DESC, event_id DESC LIMIT 50"
    ),
    "alert_lines": _detector("SELECT sensor_id, severity, round(z_score, 8) AS z_score FROM layered"),
    "severity_tiers": f"""
WITH ranked AS (SELECT event_id, {_Z_RANK} AS z, {_E_RANK} AS e
                FROM (SELECT event_id, value / 20 AS s FROM events))
SELECT event_id, {_TIER.format(rank="z")} AS z_tier, {_TIER.format(rank="e")} AS ewma_tier,
       z::BIGINT AS z_rank, {_TIER.format(rank="least(z + 1, 4)")} AS z_escalated,
       {_TIER.format(rank="greatest(z, e)")} AS higher_tier
FROM ranked""",
    "decode_events": _with(select=f"SELECT {_EVENT_ROW} FROM readings"),
    "decode_rejects": """
SELECT event_id, CASE event_type WHEN 'error' THEN 'malformed' WHEN 'signup' THEN 'malformed'
  WHEN 'view' THEN 'bad_timestamp' WHEN 'click' THEN 'missing_field' END AS reject_reason
FROM events WHERE event_type <> 'purchase'""",
    "decode_rejects_strict": """
SELECT event_id, 'malformed' AS reject_reason FROM events WHERE event_id % 5 < 4""",
    "decode_zero_fill": _with(
        select="""SELECT event_id, sensor_id,
  CASE WHEN sensor_type = 'click' THEN '' ELSE location END AS location, value
FROM readings WHERE sensor_type IN ('purchase', 'click')"""
    ),
    "tags_lookup": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "snapshot_counters": _detector(
        """SELECT 'pipeline_update' AS type,
  (SELECT count(*) FROM readings) AS events_ingested,
  (SELECT count(*) FROM layered) AS anomalies_detected,
  (SELECT least(count(*), 5) FROM layered) AS anomalies,
  (SELECT least(count(*), 5) FROM readings) AS events,
  (SELECT count(*) FROM metrics, as_of WHERE window_start >= minute) AS windows,
  (SELECT sensor_id FROM readings ORDER BY recorded_at DESC, event_id DESC LIMIT 1)
    AS newest_event_sensor,
  (SELECT sensor_id FROM layered ORDER BY detected_at DESC, event_id DESC LIMIT 1)
    AS newest_anomaly_sensor,
  (SELECT count FROM metrics ORDER BY window_start DESC, sensor_type DESC, location DESC LIMIT 1)
    AS newest_window_count""",
        _windows("1 minute"),
        _AS_OF,
    ),
    "snapshot_json": _detector(
        """SELECT 'stats' AS part, 0 AS position, concat_ws('|',
    (SELECT count(*) FROM readings), (SELECT count(*) FROM layered),
    (SELECT printf('%.6f', count(*) / (date_diff('microsecond', min(recorded_at), any_value(t)) / 1000000.0::DOUBLE))
     FROM readings, as_of),
    '0', 'pipeline_update', (SELECT strftime(t, '%Y-%m-%dT%H:%M:%S.%fZ') FROM as_of)) AS fields
UNION ALL
SELECT 'anomalies', (row_number() OVER (ORDER BY detected_at DESC, event_id DESC) - 1)::INTEGER,
  concat_ws('|', sensor_id, sensor_type, location, printf('%.6f', value), printf('%.6f', expected),
    printf('%.6f', z_score), severity, strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%fZ'))
FROM (SELECT * FROM layered ORDER BY detected_at DESC, event_id DESC LIMIT 5)
UNION ALL
SELECT 'events', (row_number() OVER (ORDER BY recorded_at DESC, event_id DESC) - 1)::INTEGER,
  concat_ws('|', sensor_id, sensor_type, location, printf('%.6f', value), unit,
    strftime(recorded_at, '%Y-%m-%dT%H:%M:%S.%fZ'), json_extract_string(props, '$.k'))
FROM (SELECT * FROM readings ORDER BY recorded_at DESC, event_id DESC LIMIT 5)
UNION ALL
SELECT 'windows', (row_number() OVER (ORDER BY window_start DESC, sensor_type DESC, location DESC) - 1)::INTEGER,
  concat_ws('|', sensor_type, location, strftime(window_start, '%Y-%m-%dT%H:%M:%S.%fZ'),
    strftime(window_end, '%Y-%m-%dT%H:%M:%S.%fZ'), count, printf('%.6f', sum), printf('%.6f', min),
    printf('%.6f', max), printf('%.6f', avg), printf('%.6f', p99))
FROM metrics, as_of WHERE window_start >= minute""",
        _windows("1 minute"),
        _AS_OF,
    ),
    "rollup_5m": _with(
        _windows("5 minutes"),
        select="SELECT * REPLACE (round(sum, 6) AS sum, round(avg, 6) AS avg) FROM metrics",
    ),
    "events_deduped": _with(select=f"SELECT {_EVENT_ROW} FROM readings"),
    "alerts_deduped": _detector(
        """SELECT sensor_id, min(detected_at) AS detected_at, max(detected_at) AS last_at,
  count(*) AS anomalies, arg_min(severity, (detected_at, event_id)) AS severity,
  (['low', 'medium', 'high', 'critical'])[max(list_position(['low', 'medium', 'high', 'critical'], severity))] AS worst
FROM (SELECT *, sum(starts) OVER (PARTITION BY sensor_id ORDER BY detected_at, event_id
        ROWS UNBOUNDED PRECEDING) AS run
      FROM (SELECT *, CASE WHEN detected_at <= lag(detected_at) OVER (PARTITION BY sensor_id
              ORDER BY detected_at, event_id) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS starts FROM layered))
GROUP BY sensor_id, run"""
    ),
    "alerts_routed": _detector(
        """SELECT event_id, sensor_id, severity, unnest(CASE severity WHEN 'low' THEN ['log']
  WHEN 'medium' THEN ['log', 'mail'] WHEN 'high' THEN ['log', 'mail', 'chat']
  ELSE ['log', 'mail', 'chat', 'pager'] END) AS channel FROM layered"""
    ),
    "rejects_depth": """
SELECT CASE event_type WHEN 'error' THEN 'malformed' WHEN 'signup' THEN 'malformed'
  WHEN 'view' THEN 'bad_timestamp' WHEN 'click' THEN 'missing_field' END AS reject_reason,
  count(*) AS waiting
FROM events WHERE event_type <> 'purchase' GROUP BY 1""",
    "rejects_replayed": _with(
        select="SELECT event_id, sensor_id, value FROM readings WHERE sensor_type = 'error'"
    ),
    "validation_reasons": _with(
        select="""SELECT * FROM (SELECT event_id, concat_ws(',',
    CASE WHEN NOT value BETWEEN 5 AND 80 THEN 'value_range' END,
    CASE WHEN sensor_type NOT IN ('click', 'view', 'purchase') THEN 'known_type' END,
    CASE WHEN NOT regexp_matches(location, '^zone-[0-2]$') THEN 'location_form' END) AS failed_rules
  FROM readings) WHERE failed_rules <> ''"""
    ),
    "replay_range": _with(
        _STATES.replace(
            "FROM readings\n)",
            """FROM readings
  WHERE recorded_at >= (SELECT date_trunc('day', max(ts) - INTERVAL 1 DAY) - INTERVAL 25 DAY FROM events)
    AND recorded_at < (SELECT date_trunc('day', max(ts) - INTERVAL 1 DAY) FROM events)
)""",
            1,
        ),
        select=f"""SELECT {_ANOMALY_ROW} FROM layered WHERE detected_at >=
  (SELECT date_trunc('day', max(ts) - INTERVAL 1 DAY) - INTERVAL 5 DAY FROM events)""",
        recursive=True,
    ),
    "tables_by_name": """
SELECT ts::DATE AS event_date, event_type AS sensor_type, count(*) AS events
FROM events GROUP BY ALL""",
    "stream_windows": _with(_windows("1 minute"), select="SELECT * FROM metrics"),
    "stream_windows_completed": _with(
        _windows("1 minute"),
        select="""SELECT * FROM metrics
WHERE window_end <= (SELECT max(ts) - INTERVAL 60 MINUTE FROM events)""",
    ),
    "stream_layered": _detector(
        """SELECT sensor_id, sensor_type, location, value, round(expected, 8) AS expected,
  round(z_score, 8) AS z_score, severity, detected_at FROM layered"""
    ),
    "stream_events": _with(
        select="""SELECT sensor_id, sensor_type, location, value, unit,
  '{"k":"' || json_extract_string(props, '$.k') || '"}' AS tags, recorded_at FROM readings"""
    ),
    "kafka_records": _with(
        select="""SELECT sensor_id AS key, sensor_id, sensor_type, location, value::VARCHAR AS value,
  strftime(recorded_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp,
  '{"k":"' || json_extract_string(props, '$.k') || '"}' AS tags
FROM readings"""
    ),
    "seasonal_scores": _with(
        _SEASONAL,
        select="""SELECT event_id, sensor_id, phase, baseline, round(residual, 8) AS residual,
  round(score, 8) AS seasonal_score FROM seasonal""",
    ),
    "seasonal_anomalies": _with(
        _SEASONAL,
        select="""SELECT event_id, round(score, 8) AS seasonal_score, CASE WHEN score >= 5 THEN 'critical'
  WHEN score >= 4 THEN 'high' ELSE 'medium' END AS severity FROM seasonal WHERE score >= 3.5""",
    ),
    "alerts_suppressed": _detector(_JUDGED_ROWS, _JUDGED),
    "stream_alerts": _detector(_JUDGED_ROWS, _JUDGED),
    "alerts_delivered": _detector(
        """SELECT unnest(CASE severity WHEN 'low' THEN ['log'] WHEN 'medium' THEN ['log', 'mail']
    WHEN 'high' THEN ['log', 'mail', 'chat'] ELSE ['log', 'mail', 'chat', 'pager'] END) AS channel,
  sensor_id, severity, value::VARCHAR AS value, strftime(detected_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp
FROM layered"""
    ),
    "rejects_stored": """
SELECT CASE event_type WHEN 'error' THEN 'malformed' WHEN 'signup' THEN 'malformed'
  WHEN 'view' THEN 'bad_timestamp' WHEN 'click' THEN 'missing_field' END AS reject_reason,
  count(*) AS waiting, count(*) FILTER (event_type = 'error') AS replayed
FROM events WHERE event_type <> 'purchase' GROUP BY 1""",
    "versions_decoded": _with(
        select="""SELECT event_id, CASE WHEN known THEN NULL ELSE 'unknown_version' END AS reject_reason,
  CASE WHEN known THEN sensor_id END AS sensor_id, CASE WHEN known THEN sensor_type END AS sensor_type,
  CASE WHEN known THEN location END AS location, CASE WHEN known THEN value END AS value,
  CASE WHEN known THEN unit END AS unit, CASE WHEN known THEN recorded_at END AS recorded_at
FROM (SELECT *, event_id % 10 <> 9 AS known FROM readings)"""
    ),
    "versions_merged": _with(
        select=f"""SELECT {_EVENT_ROW.replace("unit,", "CASE WHEN event_id % 2 = 0 THEN unit END AS unit,")},
  CASE WHEN event_id % 2 = 1 THEN 'checked' END AS quality, (1 + event_id % 2)::INT AS schema_version FROM readings"""
    ),
    "stream_deduped": _with(select=f"SELECT {_EVENT_ROW} FROM readings"),
    "stream_metrics": """
SELECT greatest(8, ceil(count(*) / 1000000.0))::BIGINT AS batches, count(*) AS input_rows, true AS all_timed FROM events""",
    "stream_counters": _detector(
        """SELECT (SELECT count(*) FROM readings) AS total_events, (SELECT count(*) FROM layered) AS total_anomalies,
  true AS has_lag"""
    ),
}
