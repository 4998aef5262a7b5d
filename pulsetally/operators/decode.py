"""Decode JSON event payloads and encode events as records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsetally.functions import text, time
from pulsetally.schema import EVENT_COLUMNS

MALFORMED = "malformed"
METADATA_JSON = "metadata_json"
RECORD_TIME = "record_time"
# Fields of a payload whose JSON type is not theirs.
WRONG_TYPES = "wrong_types"
TEXT_FIELDS = ("event_id", "event_type", "user_id", "content_id", "platform", "session_id", "device_type", "location")

# Everything is read as text. Metadata stays JSON text here, so the payload is
# parsed once and the size rule can still see the text.
WIRE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in EVENT_COLUMNS]
    + [T.StructField(MALFORMED, T.StringType())]
)


def parse_payload(records: DataFrame, value: str = "value", strict: bool = True) -> DataFrame:
    """Split the JSON payload into text columns.

    ``strict`` takes payloads with anything after their one document as malformed, and
    adds ``wrong_types``: text fields that hold no text, and metadata that is no object.

    Keeps the record's other columns; its ``timestamp`` (the time the broker
    stamped) becomes ``record_time``. Unreadable payloads give NULL fields and
    their text in ``malformed``.
    """
    others = {c: RECORD_TIME if c == "timestamp" else c for c in records.columns if c != value}
    payload = F.coalesce(F.col(value).cast("string"), F.lit("null"))
    options = {"columnNameOfCorruptRecord": MALFORMED, "allowSingleQuotes": "false"}
    event = F.from_json(payload, WIRE_SCHEMA, options)
    if strict:
        one = F.coalesce(F.json_array_length(F.concat(F.lit("["), payload, F.lit("]"))) == 1, F.lit(False))
        event = F.when(one, event).otherwise(F.struct(*_null_fields(), payload.alias(MALFORMED)))
    # JSON null parses to NULL without a corrupt record: mark it here.
    event = F.coalesce(event, F.struct(*_null_fields(), F.lit("null").alias(MALFORMED)))
    # A generator keeps later filters on the fields from being pushed below the
    # parser, where Spark would parse the payload once per field they mention.
    fields = F.struct(event.alias("event"), F.try_parse_json(payload).alias("variant")) if strict else F.struct(event.alias("event"))
    parsed = records.select(*[F.col(c).alias(a) for c, a in others.items()], F.inline(F.array(fields)))
    types = [_wrong_types().alias(WRONG_TYPES)] if strict else []
    parsed = parsed.select(*others.values(), "event.*", *types)
    return parsed.withColumnRenamed("metadata", METADATA_JSON)


def _wrong_types() -> Column:
    """Names of the fields of another JSON type; NULL and missing fields have none."""

    def kind(field: str) -> Column:
        value = F.try_variant_get("variant", f"$.{field}", "variant")
        return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))

    marks = [F.when(kind(f).isin("STRING", "VOID"), "").otherwise(f) for f in TEXT_FIELDS]
    given = kind("metadata")
    marks.append(F.when(given.startswith("OBJECT") | (given == "VOID"), "").otherwise("metadata"))
    return F.array_remove(F.array(*marks), "")


def _null_fields() -> list[Column]:
    return [F.lit(None).cast("string").alias(c) for c in EVENT_COLUMNS]


def decode_events(records: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Decode records into typed events, bad rows included as NULLs.

    Adds ``processing_time``. ``keep`` names record columns to carry along.
    """
    parsed = parse_payload(records, value, strict=False)
    return parsed.select(
        *keep,
        *typed_columns(time.parse_event_time(F.col("timestamp"))),
        F.current_timestamp().alias("processing_time"),
    )


def typed_columns(event_time: Column) -> list[Column]:
    """The event columns in order, from the text columns of ``parse_payload``."""
    special = {
        "timestamp": event_time,
        "metadata": text.string_map(F.col(METADATA_JSON)),
    }
    return [special.get(c, F.col(c)).alias(c) for c in EVENT_COLUMNS]


def encode_events(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events as records: ``key`` is the user, ``value`` the JSON text.

    One key per user keeps a user's events in order. Absent fields are written
    as JSON null. Where the frame still has ``metadata_json``, number and
    boolean metadata values keep their JSON type, unless a key is repeated.
    """
    if METADATA_JSON not in events.columns:
        payload = _payload(F.col("metadata"))
    else:
        given = F.col(METADATA_JSON)
        parsed = F.try_parse_json(given)
        as_texts = F.coalesce(text.string_map(given), text.empty_map())
        payload = F.when(parsed.isNotNull(), _payload(parsed)).otherwise(_payload(as_texts))
    return events.select(*keep, F.col("user_id").alias("key"), payload.alias("value"))


def _payload(metadata: Column) -> Column:
    special = {"timestamp": time.iso_text(F.col("timestamp")), "metadata": metadata}
    fields = [special.get(c, F.col(c)).alias(c) for c in EVENT_COLUMNS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
