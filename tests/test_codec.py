import datetime as dt
import json

import pytest
from helpers import START, event_frame
from pyspark.sql import functions as F

from gaugeflow.functions import codec
from gaugeflow.sources.streams import kafka_options, kafka_records

FULL = {
    "sensor_id": "s1",
    "sensor_type": "temperature",
    "location": "lab",
    "value": 21.5,
    "unit": "°C",
    "timestamp": "2024-03-01T12:00:00Z",
}


def _line(**changes):
    record = {**FULL, **changes}
    return json.dumps({k: v for k, v in record.items() if v is not ...})


def _decoded(spark, *lines):
    frame = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n int, value string")
    return codec.decode(frame, keep=("n",))


def _times(df):
    return [r[0] for r in df.orderBy("n").select(F.unix_micros("recorded_at")).collect()]


def test_valid_records(spark):
    good, rejects = codec.split(
        _decoded(
            spark,
            _line(),
            _line(timestamp="2024-03-01T14:00:00.123456789+02:00", tags={"a": "1", "b": ""}),
            _line(value=7, extra={"nested": [1]}),
            "  " + _line(tags={}) + "\n",
            _line(tags=None),
        )
    )
    assert rejects.isEmpty()
    rows = good.orderBy("n").collect()
    base = int(dt.datetime(2024, 3, 1, 12, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    assert _times(good) == [base, base + 123456, base, base, base]
    assert rows[0].value == 21.5 and rows[0].unit == "°C" and rows[0].tags is None
    assert rows[1].tags == {"a": "1", "b": ""}
    assert rows[2].value == 7.0
    assert rows[3].tags == {} and rows[4].tags is None


REJECTED = [
    ("not json", "malformed"),
    ("", "malformed"),
    ("null", "malformed"),
    ("[" + _line() + "]", "malformed"),
    (_line() + " trailing", "malformed"),
    (_line(value="21.5"), "malformed"),
    (_line(value=True), "malformed"),
    (_line(value="NaN"), "wrong_type"),
    (_line().replace("21.5", "1e400"), "wrong_type"),
    (_line(sensor_id=5), "wrong_type"),
    (_line(location={"a": 1}), "wrong_type"),
    (_line(tags={"k": 5}), "wrong_type"),
    (_line(timestamp=1709294400), "bad_timestamp"),
    (_line(timestamp="2024-03-01"), "bad_timestamp"),
    (_line(timestamp="2024-02-30T00:00:00Z"), "bad_timestamp"),
    (_line(timestamp="noon"), "bad_timestamp"),
    (_line(location="{") + "}", "malformed"),
    (_line(location="}") + "{", "malformed"),
    (_line() + _line(), "malformed"),
    (_line() + "," + _line(), "malformed"),
    (_line() + ",0],[0", "malformed"),
    (_line() + "],[0", "malformed"),
    (_line() + ',0]', "malformed"),
    (_line().replace("21.5", "NaN"), "malformed"),
    (_line().replace("21.5", "021.5"), "malformed"),
    (_line()[:-1] + ",}", "malformed"),
    ("// note\n" + _line(), "malformed"),
    (_line().replace('"', "'"), "malformed"),
    (_line(tags=["a"]), "malformed"),
    (_line(tags="a"), "malformed"),
    (_line(tags={"k": {"a": "b"}}), "wrong_type"),
    (_line(timestamp=["noon"]), "bad_timestamp"),
]


def test_rejected_records(spark):
    for on_missing in ("reject", "zero"):
        good, rejects = codec.split(_decoded(spark, *[line for line, _ in REJECTED]), on_missing)
        assert good.isEmpty()
        found = [(r.raw, r.reject_reason) for r in rejects.orderBy("n").collect()]
        assert found == REJECTED


def test_braces_in_texts_and_keys_that_come_twice(spark):
    lines = [
        _line(location="a}{b", unit="{"),
        _line()[:-1] + ', "location": "second", "value": 4}',
        _line(tags={"k": "}", "n": None}, extra={"a": [{"b": "}"}]}),
    ]
    good, rejects = codec.split(_decoded(spark, *lines))
    assert rejects.isEmpty()
    rows = good.orderBy("n").collect()
    assert [(r.location, r.value) for r in rows] == [("a}{b", 21.5), ("second", 4.0), ("lab", 21.5)]
    assert rows[2].tags == {"k": "}", "n": ""}


def test_records_of_several_versions(spark):
    second = {
        "schema_version": 2,
        "sensor": {"id": "s2", "type": "heat", "location": "roof"},
        "reading": {"value": 3, "unit": "K"},
        "recorded_at": "2024-03-01T13:00:00+01:00",
        "tags": {"a": "b"},
    }
    lines = [
        _line(),
        _line(schema_version=1),
        _line(schema_version=None),
        json.dumps(second),
        json.dumps({**second, "schema_version": 3}),
        _line(schema_version="2"),
        json.dumps({**second, "sensor": "s2"}),
        json.dumps({**second, "reading": {"value": "3", "unit": "K"}}),
        "no json",
    ]
    frame = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    decoded = codec.decode(frame, keep=("n",), versions=codec.WIRE_VERSIONS)
    good, rejects = codec.split(decoded)
    rows = {r.n: r for r in good.collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    assert (rows[3].sensor_id, rows[3].sensor_type, rows[3].location) == ("s2", "heat", "roof")
    assert (rows[3].value, rows[3].unit, rows[3].tags) == (3.0, "K", {"a": "b"})
    assert len(set(_times(good))) == 1
    reasons = {r.n: r.reject_reason for r in rejects.collect()}
    assert reasons == {
        4: "unknown_version", 5: "unknown_version", 6: "missing_field", 7: "malformed", 8: "malformed"
    }
    # Without a choice of versions the field means nothing.
    assert codec.split(codec.decode(frame.where("n = 1")))[1].isEmpty()


def test_missing_fields(spark):
    lines = [_line(value=...), _line(sensor_id=None), _line(timestamp=...), _line(unit=...), "{}"]
    good, rejects = codec.split(_decoded(spark, *lines))
    assert good.isEmpty()
    assert {r.reject_reason for r in rejects.collect()} == {"missing_field"}

    good, rejects = codec.split(_decoded(spark, *lines), "zero")
    assert rejects.isEmpty()
    rows = good.orderBy("n").select("value", "sensor_id").collect()
    assert [r.value for r in rows] == [0.0, 21.5, 21.5, 21.5, 0.0]
    assert [r.sensor_id for r in rows] == ["s1", "", "s1", "s1", ""]
    years = [r[0] for r in good.orderBy("n").select(F.year("recorded_at")).collect()]
    assert years == [2024, 2024, 1, 2024, 1]
    with pytest.raises(ValueError):
        codec.split(_decoded(spark, "{}"), "ignore")


def test_binary_payload_is_decoded(spark):
    frame = spark.createDataFrame([(bytearray(_line(), "utf-8"),)], "value binary")
    assert codec.split(codec.decode(frame))[0].first().sensor_id == "s1"


@pytest.mark.parametrize("kind", ["temperature", "pressure", "vibration", "humidity"])
def test_event_round_trip(spark, kind):
    at = START + dt.timedelta(microseconds=123456)
    rows = [
        (1, "s1", kind, "lab", 21.53, "°C", {"floor": "2", "rack": "a"}, at),
        (2, "s2", kind, 'quo"ted', -0.5, "u", None, at),
        (3, "s3", kind, "lab", 1e-7, "u", {}, at),
    ]
    events = event_frame(spark, rows)
    lines = events.select(F.col("event_id").alias("n"), codec.event_json().alias("value"))
    texts = {r.n: json.loads(r.value) for r in lines.collect()}
    assert texts[1]["tags"] == {"floor": "2", "rack": "a"}
    assert texts[1]["timestamp"] == "2024-03-01T12:00:00.123456Z"
    assert "tags" not in texts[2] and "tags" not in texts[3]
    good, rejects = codec.split(codec.decode(lines, keep=("n",)))
    assert rejects.isEmpty()
    back = good.withColumn("recorded_at", F.col("recorded_at").cast("timestamp_ntz"))
    for row, source in zip(back.orderBy("n").collect(), rows):
        assert (row.sensor_id, row.sensor_type, row.location, row.value, row.unit) == source[1:6]
        assert row.recorded_at == source[7]
        assert (row.tags or None) == (source[6] or None)


def test_record_json(spark):
    row = spark.createDataFrame(
        [("temperature", "lab", START, 3, 25.0)],
        "sensor_type string, location string, window_start timestamp_ntz, count long, avg double",
    )
    text = row.select(codec.row_json(row.columns)).first()[0]
    assert json.loads(text) == {
        "sensor_type": "temperature",
        "location": "lab",
        "window_start": "2024-03-01T12:00:00.000000Z",
        "count": 3,
        "avg": 25.0,
    }


def test_tags_as_text(spark):
    frame = spark.createDataFrame([({"k": "v"},), (None,)], "tags map<string,string>")
    text = frame.select(codec.tags_to_json(F.col("tags")).alias("t"))
    assert [r.t for r in text.collect()] == ['{"k":"v"}', None]
    back = text.select(codec.tags_from_json(F.col("t")).alias("tags"))
    assert [r.tags for r in back.collect()] == [{"k": "v"}, None]


def test_kafka_shapes(spark):
    events = event_frame(spark, [(1, "s1", "t", "l", 1.5, "u", None, START)])
    row = kafka_records(events).first()
    assert row.key == "s1" and json.loads(row.value)["value"] == 1.5
    options = kafka_options("a:9092,b:9092")
    assert options == {
        "kafka.bootstrap.servers": "a:9092,b:9092",
        "subscribe": "sensor-events",
        "startingOffsets": "latest",
        "maxOffsetsPerTrigger": "1000000",
    }
