"""Ingest rules: mark every record with the reasons against it, then split.

All rules are column expressions, so they run inside the scan stage and work
the same on batch and streaming frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetally import schema
from pulsetally.functions import text, time
from pulsetally.operators.decode import MALFORMED, METADATA_JSON, RECORD_TIME, WRONG_TYPES

REASONS = "reasons"
GIVEN_TIME = "given_time"
GIVEN_METADATA = "given_metadata"
OVERSIZED = "metadata_oversized"


def rules() -> dict[str, Column]:
    """Reason name -> condition under which a parsed record breaks that rule."""
    event_type, user_id, platform = (F.col(c) for c in ("event_type", "user_id", "platform"))
    length_ok = F.length(user_id).between(1, schema.USER_ID_MAX)

    def wrong(field: str) -> Column:
        return F.array_contains(WRONG_TYPES, field)

    return {
        "event_type_missing": event_type.isNull(),
        "event_type_unknown": text.outside(event_type, schema.EVENT_TYPES),
        "user_id_missing": user_id.isNull(),
        "user_id_not_text": wrong("user_id"),
        "user_id_length": ~length_ok,
        "user_id_blank": length_ok & text.blank(user_id),
        "platform_missing": platform.isNull(),
        "platform_unknown": text.outside(platform, schema.PLATFORMS),
        "event_id_not_text": wrong("event_id"),
        "content_id_not_text": wrong("content_id"),
        "session_id_not_text": wrong("session_id"),
        "device_type_not_text": wrong("device_type"),
        "location_not_text": wrong("location"),
        "content_id_too_long": text.too_long(F.col("content_id"), schema.CONTENT_ID_MAX),
        "session_id_too_long": text.too_long(F.col("session_id"), schema.SESSION_ID_MAX),
        "device_type_too_long": text.too_long(F.col("device_type"), schema.DEVICE_TYPE_MAX),
        "location_too_long": text.too_long(F.col("location"), schema.LOCATION_MAX),
        "timestamp_malformed": F.col("timestamp").isNotNull() & F.col(GIVEN_TIME).isNull(),
        "metadata_not_object": wrong("metadata")
        | (F.col(METADATA_JSON).isNotNull() & F.col(GIVEN_METADATA).isNull()),
        "metadata_too_large": F.col(OVERSIZED),
    }


def check_events(parsed: DataFrame) -> DataFrame:
    """Add ``reasons``, an array which is empty for a valid record.

    Also adds the given time and metadata in their types, and whether the metadata is too
    large. As in ``parse_payload`` a generator adds them, so they are parsed once although
    both the rules and the output need them, and the rules' generated method stays below
    the 8000 bytes beyond which the JVM interprets it for ever.
    """
    given = F.struct(
        time.parse_client_time(F.col("timestamp")).alias(GIVEN_TIME),
        text.string_map(F.col(METADATA_JSON)).alias(GIVEN_METADATA),
        text.too_large_printed(F.col(METADATA_JSON), schema.METADATA_MAX).alias(OVERSIZED),
    )
    typed = parsed.select("*", F.inline(F.array(given)))
    marks = [F.when(broken, F.lit(name)).otherwise("") for name, broken in rules().items()]
    reasons = F.array_remove(F.array(*marks), "")
    malformed = F.col(MALFORMED).isNotNull()
    return typed.withColumn(
        REASONS, F.when(malformed, F.array(F.lit("payload_malformed"))).otherwise(reasons)
    )


def is_valid() -> Column:
    return F.size(F.col(REASONS)) == 0


def normalised_columns(
    id_from: tuple[str, ...] = (), received: str | None = None
) -> list[Column]:
    """Event columns of checked records, with stripped user and defaults.

    A missing or empty ``event_id`` becomes a hash over ``id_from`` (columns
    which name the record, such as topic, partition and offset; same id on
    every replay) or else a random UUID. A missing ``timestamp`` becomes the
    ``received`` column or else now. Missing metadata becomes an empty map.
    """
    new_id = text.record_id(*id_from) if id_from else F.uuid()
    now = F.col(received) if received else F.current_timestamp()
    special = {
        "event_id": F.coalesce(F.nullif(F.col("event_id"), F.lit("")), new_id),
        "user_id": text.strip(F.col("user_id")),
        "timestamp": F.coalesce(F.col(GIVEN_TIME), now),
        "metadata": F.coalesce(F.col(GIVEN_METADATA), text.empty_map()),
    }
    return [special.get(c, F.col(c)).alias(c) for c in schema.EVENT_COLUMNS]


def valid_events(
    checked: DataFrame,
    id_from: tuple[str, ...] = (),
    received: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Events of the valid records, normalised (see ``normalised_columns``)."""
    return checked.where(is_valid()).select(*keep, *normalised_columns(id_from, received))


def rejected_records(checked: DataFrame) -> DataFrame:
    """The invalid records as they came, with their reasons."""
    return checked.where(~is_valid()).drop(GIVEN_TIME, GIVEN_METADATA, OVERSIZED, WRONG_TYPES)


def record_defaults(parsed: DataFrame) -> dict:
    """``id_from`` and ``received`` for a frame which may have broker columns."""
    coordinates = ("topic", "partition", "offset")
    return {
        "id_from": coordinates if set(coordinates) <= set(parsed.columns) else (),
        "received": RECORD_TIME if RECORD_TIME in parsed.columns else None,
    }
