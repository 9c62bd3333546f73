"""JSON on the wire: decoding with a reject reason, and encoding.

The decoder is strict about types: a number where a string belongs, a string
where the number belongs, a non-string tag value, a timestamp that is not
RFC 3339, or text that is not one JSON object makes the record a reject. Missing
and null fields are not type errors; see :func:`split`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.schemas import EVENT_COLUMNS

_TEXT_FIELDS = ("sensor_id", "sensor_type", "location", "unit")

# RFC 3339 shape, and the zero values of absent fields.
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"
_ZERO_TIMESTAMP = "0001-01-01 00:00:00"

_JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
    "timeZone": "UTC",
}


def evaluated_once(column: Column) -> Column:
    """``column`` behind a one-row generator, which filters are not pushed through.

    Without it the optimizer copies the expression, here a whole JSON parse, into
    every filter and field access that uses it. One such column per ``select``.
    """
    return F.explode(F.array(column))


def _type_of(variant: Column) -> Column:
    return F.coalesce(F.schema_of_variant(variant), F.lit("VOID"))


def _text(variant: Column) -> Column:
    return F.try_variant_get(variant, "$", "string")


_KEEP_LAST = "spark.sql.variant.allowDuplicateKeys"


def _parsed(raw: Column) -> Column:
    """``raw`` as the first element of an array, whose second is its hash; null if that
    is no JSON.

    The parser stops at the end of the first value without a look at what follows. In an
    array, whatever is not one object leaves another number of elements or another
    second one, or no array. A text that closes the array itself would have to hold its
    own hash.
    """
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit(","), F.xxhash64(raw), F.lit("]")))


#: Where each version of the wire format has the fields of an event. A record without
#: ``schema_version`` is of version 1.
WIRE_VERSIONS: Mapping[int, Mapping[str, str]] = {
    1: {name: name for name in (*_TEXT_FIELDS, "value", "timestamp", "tags")},
    2: {
        "sensor_id": "sensor.id",
        "sensor_type": "sensor.type",
        "location": "sensor.location",
        "value": "reading.value",
        "unit": "reading.unit",
        "timestamp": "recorded_at",
        "tags": "tags",
    },
}


def _at_path(path: str) -> Column:
    return F.try_variant_get("j", f"$[0].{path}", "variant")


def _field(name: str, versions: Mapping[int, Mapping[str, str]]) -> Column:
    """The field of a record by the paths of its version, null for an unknown one."""
    if len(versions) == 1:
        return _at_path(next(iter(versions.values()))[name])
    choice = F.lit(None)
    for number, paths in versions.items():
        choice = F.when(F.col("_version") == number, _at_path(paths[name])).otherwise(choice)
    return choice


def decode(
    lines: DataFrame,
    payload: str = "value",
    keep: tuple[str, ...] = (),
    versions: Mapping[int, Mapping[str, str]] | None = None,
) -> DataFrame:
    """Decode one JSON object per row of ``payload`` (string or binary).

    Adds the event columns and ``reject_reason`` (NULL for a readable record);
    ``keep`` names input columns to carry along, such as partition and offset.
    ``raw`` holds the text as received. Every record is parsed once, and all fields and
    their JSON types are taken from the result. Of a key that comes twice the last counts.

    With ``versions``, such as ``WIRE_VERSIONS``, a record's ``schema_version`` says where
    its fields are; records of other versions are rejects. Without it all are of
    version 1, whatever they say.
    """
    lines.sparkSession.conf.set(_KEEP_LAST, "true")
    raw = F.col(payload).cast("string")
    parsed = lines.select(*keep, raw.alias("raw"), evaluated_once(_parsed(raw)).alias("j"))
    known = versions or {1: WIRE_VERSIONS[1]}
    told = F.try_variant_get("j", "$[0].schema_version", "variant")
    number = F.when(_type_of(told) == "BIGINT", F.try_variant_get(told, "$", "bigint")).otherwise(-1)
    parsed = parsed.withColumn(
        "_version", F.when(_type_of(told) == "VOID", 1).otherwise(number) if versions else F.lit(1)
    )
    fields = (*_TEXT_FIELDS, "value", "timestamp", "tags")
    parsed = parsed.select(
        *keep,
        "raw",
        "_version",
        *[_field(name, known).alias(f"_{name}") for name in fields],
        (
            F.coalesce(F.schema_of_variant(F.try_variant_get("j", "$[0]", "variant")).startswith("OBJECT"), F.lit(False))
            & F.try_variant_get("j", "$[1]", "bigint").eqNullSafe(F.xxhash64("raw"))
            & F.try_variant_get("j", "$[2]", "variant").isNull()
        ).alias("_one"),
    )
    stamp = F.when(_type_of(F.col("_timestamp")) == "STRING", _text(F.col("_timestamp")))
    number = F.try_variant_get("_value", "$", "double")
    parsed = (
        parsed.withColumn("stamp", F.when(stamp.rlike(_RFC3339), stamp.try_cast("timestamp")))
        .withColumn("number", number)
        .withColumn("tags", F.try_variant_get("_tags", "$", "map<string,variant>"))
    )
    wrong_text = F.lit(False)
    for name in _TEXT_FIELDS:
        wrong_text = wrong_text | ~_type_of(F.col(f"_{name}")).isin("STRING", "VOID")
    wrong_tags = F.exists(F.coalesce(F.map_values("tags"), F.array()), lambda v: ~_type_of(v).isin("STRING", "VOID"))
    endless = F.coalesce(F.isnan("number") | (F.abs("number") == float("inf")), F.lit(False))
    numeric = _type_of(F.col("_value")).rlike("^(VOID|BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    no_map = F.col("tags").isNull() & (_type_of(F.col("_tags")) != "VOID")
    bad_time = F.col("stamp").isNull() & (_type_of(F.col("_timestamp")) != "VOID")

    reason = (
        F.when(F.col("_one") & ~F.col("_version").isin(*known), "unknown_version")
        .when(~F.col("_one") | no_map | ~(numeric | endless), "malformed")
        .when(wrong_text | wrong_tags | endless, "wrong_type")
        .when(bad_time, "bad_timestamp")
    )
    # An absent tag value decodes to the empty string, as an absent field does.
    tags = F.transform_values("tags", lambda _, v: F.coalesce(_text(v), F.lit("")))
    return parsed.select(
        *keep,
        "raw",
        *[_text(F.col(f"_{name}")).alias(name) for name in ("sensor_id", "sensor_type", "location")],
        F.col("number").alias("value"),
        _text(F.col("_unit")).alias("unit"),
        tags.alias("tags"),
        F.col("stamp").alias("recorded_at"),
        reason.alias("reject_reason"),
    )


_REQUIRED = ("sensor_id", "sensor_type", "location", "value", "unit", "recorded_at")


def split(decoded: DataFrame, on_missing: str = "reject") -> tuple[DataFrame, DataFrame]:
    """Good events and rejects, as two filters over one decoded frame.

    ``on_missing="reject"`` sends a record lacking a required field to the
    rejects with reason ``missing_field``; ``"zero"`` accepts it with the zero
    value of the field's type ('' , 0.0, year 1).
    """
    extra = [c for c in decoded.columns if c not in (*EVENT_COLUMNS, "raw", "reject_reason")]
    if on_missing == "zero":
        flagged = decoded
    elif on_missing == "reject":
        missing = F.lit(False)
        for name in _REQUIRED:
            missing = missing | F.col(name).isNull()
        flagged = decoded.withColumn(
            "reject_reason",
            F.coalesce("reject_reason", F.when(missing, F.lit("missing_field"))),
        )
    else:
        raise ValueError(f"on_missing must be 'reject' or 'zero', got {on_missing!r}")

    good = flagged.filter(F.col("reject_reason").isNull())
    if on_missing == "zero":
        zero = {
            **{name: F.lit("") for name in _TEXT_FIELDS},
            "value": F.lit(0.0),
            "recorded_at": F.lit(_ZERO_TIMESTAMP).cast("timestamp"),
        }
        good = good.withColumns({name: F.coalesce(name, default) for name, default in zero.items()})
    rejects = flagged.filter(F.col("reject_reason").isNotNull())
    return good.select(*EVENT_COLUMNS, *extra), rejects.select("raw", "reject_reason", *extra)


def _encoded(fields: list[Column]) -> Column:
    return F.to_json(F.struct(*fields), _JSON_OPTIONS)


def event_json() -> Column:
    """An event row as its wire object; absent or empty tags are left out."""
    tags = F.when(F.size("tags") > 0, F.col("tags"))
    return _encoded(
        [
            F.col("sensor_id"),
            F.col("sensor_type"),
            F.col("location"),
            F.col("value"),
            F.col("unit"),
            F.col("recorded_at").alias("timestamp"),
            tags.alias("tags"),
        ]
    )


def row_json(columns: list[str]) -> Column:
    """Any record (window, anomaly, stats) as a JSON object of ``columns``."""
    return _encoded([F.col(c) for c in columns])


def struct_json(column: Column) -> Column:
    """A nested column as JSON text with RFC 3339 times."""
    return F.to_json(column, _JSON_OPTIONS)


def tags_to_json(tags: Column) -> Column:
    return F.to_json(tags)


def tags_from_json(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")
