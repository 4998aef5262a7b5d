"""Read the event lake with partition pruning."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsetally.functions.time import as_timestamp
from pulsetally.schema import EVENT_SCHEMA, LAKE_PARTITIONS
from pulsetally.sources.folders import read_parts

PROCESSING_TIME = "processing_time"
LAKE_SCHEMA = T.StructType(
    EVENT_SCHEMA.fields
    + [T.StructField(PROCESSING_TIME, T.TimestampType())]
    + [T.StructField(c, T.IntegerType()) for c in LAKE_PARTITIONS]
)


def partition_range(start: datetime | None, end: datetime | None) -> Column:
    """Predicate on the partition columns for ``start <= time < end``.

    A filter on the event time alone prunes nothing, so the hour bounds are put
    in terms of the partition columns. The plain comparisons on ``year`` are
    there for catalogs which can only push those.
    """
    hour = F.make_timestamp("year", "month", "day", "hour", F.lit(0), F.lit(0))
    keep = F.lit(True)
    if start is not None:
        first = _utc(start).replace(minute=0, second=0, microsecond=0)
        keep = keep & (F.col("year") >= first.year) & (hour >= as_timestamp(first))
    if end is not None:
        keep = keep & (F.col("year") <= _utc(end).year) & (hour < as_timestamp(end))
    return keep


def read_lake(
    spark: SparkSession,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Events with ``start <= timestamp < end`` of all writers; only those hours are read."""
    return bounded(read_parts(spark, path, LAKE_SCHEMA), start, end)


def bounded(events: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Events of a time range, by partition columns and by event time."""
    events = events.where(partition_range(start, end))
    if start is not None:
        events = events.where(F.col("timestamp") >= as_timestamp(start))
    if end is not None:
        events = events.where(F.col("timestamp") < as_timestamp(end))
    return events


def _utc(value: datetime) -> datetime:
    if value.tzinfo is None:
        return value.replace(tzinfo=timezone.utc)
    return value.astimezone(timezone.utc)
