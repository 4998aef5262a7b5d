"""Write the event lake: Parquet by year, month, day and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsetally.config import StreamSettings
from pulsetally.operators.projections import with_calendar
from pulsetally.schema import LAKE_PARTITIONS
from pulsetally.sources.folders import BATCH
from pulsetally.sources.lake import LAKE_SCHEMA, PROCESSING_TIME
from pulsetally.streaming.start import start_file_query

SMALLEST_TASK = "spark.sql.adaptive.coalescePartitions.minPartitionSize"


def lake_rows(events: DataFrame) -> DataFrame:
    """Events in the lake's columns. Rows without event time belong in the rejects."""
    if PROCESSING_TIME not in events.columns:
        events = events.withColumn(PROCESSING_TIME, F.current_timestamp())
    return with_calendar(events.where(F.col("timestamp").isNotNull())).select(*LAKE_SCHEMA.names)


def balanced(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows of a partition together, as after a repartition, in tasks of about equal size.

    An hour with a third of all rows is split over many tasks (needs adaptive execution).
    """
    return rows.hint("rebalance", *[F.col(c) for c in columns])


def write_partitioned(
    rows: DataFrame,
    path: str,
    columns: tuple[str, ...],
    mode: str = "append",
    **options: str | int,
) -> None:
    """Write Parquet by partition columns, in tasks of about equal size.

    A task creates one file per partition it holds, so small data over many hours
    must not be merged into one task.
    """
    writer = balanced(rows, columns).write.mode(mode).options(**options).partitionBy(*columns)
    conf = rows.sparkSession.conf
    before = conf.get(SMALLEST_TASK)
    conf.set(SMALLEST_TASK, "1KB")
    try:
        writer.parquet(path)
    finally:
        conf.set(SMALLEST_TASK, before)


def append_lake(events: DataFrame, path: str, max_records_per_file: int = 5_000_000) -> None:
    """Append a batch (a backfill), next to what streams write."""
    folder = f"{path.rstrip('/')}/{BATCH}"
    write_partitioned(
        lake_rows(events), folder, LAKE_PARTITIONS, maxRecordsPerFile=max_records_per_file
    )


def append_rejects(rejects: DataFrame, path: str) -> None:
    """Append rejected records with their reasons."""
    rejects.write.mode("append").parquet(f"{path.rstrip('/')}/{BATCH}")


def stream_lake(
    events: DataFrame, path: str, settings: StreamSettings, name: str = "raw-events"
) -> StreamingQuery:
    """Write a stream of events; the file sink's commit log makes it exactly-once."""
    rows = balanced(lake_rows(events), LAKE_PARTITIONS)
    return start_file_query(rows, path, settings, name, LAKE_PARTITIONS)


def stream_rejects(
    rejects: DataFrame, path: str, settings: StreamSettings, name: str = "rejected-records"
) -> StreamingQuery:
    """Write a stream of rejected records."""
    return start_file_query(rejects, path, settings, name)
