"""Column functions for event time."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the date-time texts the ingest contract takes.
ISO_PATTERN = (
    r"^\s*(?!0000)\d{4}-\d{2}-\d{2}"
    r"([Tt _ ]\d{2}:\d{2}(:\d{2}([.]\d{1,9})?)?\s*([Zz]|[+-]\d{2}:?\d{2})?)?\s*$"
)
NUMBER_PATTERN = r"^\s*[+-]?\d+([.]\d*)?\s*$"
# Fixed value: numbers beyond this size are milliseconds, the rest seconds.
UNIX_SECONDS_MAX = 20_000_000_000
# First and last second of the years 1 to 9999.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def interval_text(span: timedelta) -> str:
    """A timedelta as the text ``F.window`` and ``withWatermark`` take."""
    return f"{micros(span)} microseconds"


def micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def parse_event_time(text: Column) -> Column:
    """Event-time text to timestamp; NULL where it cannot be read."""
    return F.try_to_timestamp(text)


def parse_client_time(text: Column) -> Column:
    """Like ``parse_event_time`` for what clients may send: ISO text or Unix time."""
    iso = F.try_to_timestamp(F.translate(F.trim(text), "tz_", "TZ "))
    number = F.trim(text).try_cast("decimal(30,6)")
    seconds = F.when(F.abs(number) <= UNIX_SECONDS_MAX, number).otherwise(number / 1000)
    in_range = seconds.between(FIRST_SECOND, LAST_SECOND)
    unix = F.when(in_range, F.timestamp_micros((seconds * 1_000_000).try_cast("bigint")))
    return F.when(text.rlike(ISO_PATTERN), iso).when(text.rlike(NUMBER_PATTERN), unix)


def iso_text(ts: Column) -> Column:
    """Timestamp as ISO-8601 text; the fraction appears only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0, whole).otherwise(fraction)


def as_timestamp(value: datetime | str | Column | None) -> Column:
    """A point in time as a column: naive values are UTC, None is now."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        return F.lit(value).cast("timestamp")
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.lit(value.isoformat()).cast("timestamp")


def hours_before(hours: int, as_of: datetime | str | Column | None = None) -> Column:
    """The look-back bound ``as_of - hours``; constant-folded when as_of is a value."""
    return as_timestamp(as_of) - F.expr(f"INTERVAL '{int(hours)}' HOUR")


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Year, month, day and hour of a timestamp."""
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
    }
