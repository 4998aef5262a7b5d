"""A copy of a table for look-ups by one key: its rows lie together and other files stay closed.

Rows are partitioned by date and by a hash bucket of the key, and sorted by key in a file,
with a bloom filter for each row group. A look-up of one key opens one bucket a date, and
there only row groups whose range and bloom filter may hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsetally.functions.time import hours_before
from pulsetally.plans.reports import AsOf
from pulsetally.sinks.metrics import WINDOW_DATE, table_rows
from pulsetally.sources.folders import with_fields

BUCKETS, BUCKET = "buckets", "bucket"


def bucket_of(key: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(key), buckets.cast("bigint")).cast("int")


def write_lookup(
    metrics: DataFrame,
    path: str,
    schema: T.StructType,
    key: str = "user_id",
    buckets: int = 64,
    keys_per_file: int = 100_000,
    **options: str | int,
) -> None:
    """Write a table with ``window_start`` for look-ups by ``key``, replacing the dates it holds.

    Choose ``buckets`` so that a bucket of a date is a file of good size. A bucket of a date
    is written by one task: rows of metric tables are few for a key and date.
    """
    rows = table_rows(metrics, schema).withColumns(
        {BUCKETS: F.lit(buckets), BUCKET: bucket_of(F.col(key), F.lit(buckets))}
    )
    place = (BUCKETS, WINDOW_DATE, BUCKET)
    near = rows.repartition(WINDOW_DATE, BUCKET).sortWithinPartitions(*place, key, "window_start")
    bloom = {
        f"parquet.bloom.filter.enabled#{key}": "true",
        f"parquet.bloom.filter.expected.ndv#{key}": keys_per_file,
    }
    near.write.mode("overwrite").options(
        **{"partitionOverwriteMode": "dynamic", **bloom, **options}
    ).partitionBy(*place).parquet(path)


def look_up(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    value: str,
    key: str = "user_id",
    hours_back: int | None = None,
    as_of: AsOf = None,
) -> DataFrame:
    """The rows of one key. The number of buckets is part of the folders' names."""
    place = with_fields(schema, **{BUCKETS: T.IntegerType(), WINDOW_DATE: T.DateType(), BUCKET: T.IntegerType()})
    rows = spark.read.schema(place).parquet(path)
    found = rows.where((F.col(BUCKET) == bucket_of(F.lit(value), F.col(BUCKETS))) & (F.col(key) == value))
    if hours_back is not None:
        since = hours_before(hours_back, as_of)
        found = found.where((F.col(WINDOW_DATE) >= since.cast("date")) & (F.col("window_start") >= since))
    return found.select(*schema.names)
