"""Land raw records: decode, check and store accepted and rejected rows in one pass."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pulsetally.config import StreamSettings
from pulsetally.functions.time import calendar_columns
from pulsetally.operators.decode import MALFORMED, METADATA_JSON, parse_payload
from pulsetally.operators.validate import (
    REASONS,
    check_events,
    is_valid,
    normalised_columns,
    record_defaults,
)
from pulsetally.schema import EVENT_COLUMNS, LAKE_PARTITIONS
from pulsetally.sinks.lake import balanced, write_partitioned
from pulsetally.sources.folders import BATCH, read_parts
from pulsetally.sources.lake import LAKE_SCHEMA, PROCESSING_TIME, bounded
from pulsetally.streaming.start import start_file_query

ACCEPTED = "accepted"
RAW = "raw_fields"
# Of rejected records: the payload as it came, and key, topic, partition and offset.
PAYLOAD, RECORD = "payload", "record"
COORDINATES = ("key", "topic", "partition", "offset")
PARTITIONS = (ACCEPTED, *LAKE_PARTITIONS)
LANDING_SCHEMA = T.StructType(
    LAKE_SCHEMA.fields
    + [
        T.StructField(REASONS, T.ArrayType(T.StringType())),
        T.StructField(RAW, T.MapType(T.StringType(), T.StringType())),
        T.StructField(PAYLOAD, T.BinaryType()),
        T.StructField(RECORD, T.MapType(T.StringType(), T.StringType())),
        T.StructField(ACCEPTED, T.BooleanType()),
    ]
)


def landing_rows(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Accepted records as events; rejected ones with reasons, raw fields and the whole record.

    ``keep`` names columns of the records to carry along, after those of the landing folder. Both kinds are rows of one frame, so one write stores them and the payload
    is parsed once. Events are dated by event time, rejects by arrival.
    """
    whole = records.withColumn(PAYLOAD, F.col("value").cast("binary"))
    checked = check_events(parse_payload(whole)).withColumn(ACCEPTED, is_valid())
    accepted = F.col(ACCEPTED)
    defaults = record_defaults(checked)
    arrival = F.col(defaults["received"]) if defaults["received"] else F.current_timestamp()
    event = F.struct(*normalised_columns(**defaults))
    fields = [c for c in EVENT_COLUMNS if c != "metadata"] + [METADATA_JSON, MALFORMED]
    raw = F.create_map(*[part for c in fields for part in (F.lit(c), F.col(c))])
    known = [c for c in COORDINATES if c in records.columns]
    record = F.create_map(*[part for c in known for part in (F.lit(c), F.col(c).cast("string"))])
    rows = checked.select(
        F.when(~accepted, F.col(PAYLOAD)).alias(PAYLOAD),
        F.when(~accepted, record.cast("map<string,string>")).alias(RECORD),
        F.when(accepted, event).alias("event"),
        F.current_timestamp().alias(PROCESSING_TIME),
        F.when(accepted, F.array().cast("array<string>")).otherwise(F.col(REASONS)).alias(REASONS),
        F.when(~accepted, raw).alias(RAW),
        accepted,
        arrival.alias("arrival"),
        *keep,
    )
    dated = rows.withColumns(
        calendar_columns(F.coalesce(F.col("event.timestamp"), F.col("arrival")))
    )
    return dated.select("event.*", *[c for c in LANDING_SCHEMA.names if c not in EVENT_COLUMNS], *keep)


def append_landing(records: DataFrame, path: str, max_records_per_file: int = 5_000_000) -> None:
    """Append a batch of records (a backfill), next to what streams write."""
    folder = f"{path.rstrip('/')}/{BATCH}"
    write_partitioned(
        landing_rows(records), folder, PARTITIONS, maxRecordsPerFile=max_records_per_file
    )


def stream_landing(
    records: DataFrame, path: str, settings: StreamSettings, name: str = "raw-events"
) -> StreamingQuery:
    """The same for a stream of records, exactly-once and with one scan of the topic."""
    rows = balanced(landing_rows(records), PARTITIONS)
    return start_file_query(rows, path, settings, name, PARTITIONS)


def read_accepted(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Accepted events in a time range; only their folders are read."""
    rows = read_parts(spark, path, LANDING_SCHEMA).where(F.col(ACCEPTED))
    return bounded(rows.select(*LAKE_SCHEMA.names), start, end)


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """Rejected records: arrival hour, reasons, raw fields, payload and where it came from."""
    rows = read_parts(spark, path, LANDING_SCHEMA).where(~F.col(ACCEPTED))
    return rows.select(PROCESSING_TIME, *LAKE_PARTITIONS, REASONS, RAW, PAYLOAD, RECORD)
