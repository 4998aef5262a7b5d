"""Write metric tables: exactly-once Parquet, replay-safe batches, JDBC."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import date, datetime
from typing import Literal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pulsetally.config import StreamSettings
from pulsetally.operators.projections import as_table
from pulsetally.schema import METRIC_SCHEMA, USER_METRIC_SCHEMA
from pulsetally.sinks.lake import write_partitioned
from pulsetally.sources.folders import (
    BATCH,
    BUILD,
    BUILT,
    VERSION,
    days,
    existing,
    finished,
    new_version,
    newest_builds,
    read_dates,
    remove,
    subfolders,
)
from pulsetally.sources.metric_tables import BATCH_ID, RUN, JdbcSettings, newest_per_key
from pulsetally.streaming.start import start_file_query, start_query

log = logging.getLogger(__name__)

WINDOW_DATE = "window_date"
BatchWriter = Callable[[DataFrame, int], None]
OnError = Literal["raise", "log", "keep"]


def table_rows(metrics: DataFrame, schema: T.StructType) -> DataFrame:
    """Metrics in a table's columns plus its partition column ``window_date``."""
    return as_table(metrics, schema).withColumn(WINDOW_DATE, F.to_date("window_start"))


def append_table(metrics: DataFrame, path: str, schema: T.StructType) -> None:
    """Append a batch of metrics to a Parquet table, next to what streams write."""
    folder = f"{path.rstrip('/')}/{BATCH}/{VERSION}={new_version()}"
    write_partitioned(table_rows(metrics, schema), folder, (WINDOW_DATE,))


def replace_table(
    metrics: DataFrame,
    path: str,
    schema: T.StructType,
    start: datetime | None = None,
    end: datetime | None = None,
    dates: list[date] | None = None,
) -> None:
    """Build dates of a table anew: ``dates``, or those from ``start`` up to ``end``, and those the metrics hold.

    A date in the range without rows becomes empty. Without bounds and dates, all dates
    that were built before are built again. Other dates are left. The build counts from
    the moment its list of dates is written, so one that failed half-way changes nothing.
    """
    spark, path, version = metrics.sparkSession, path.rstrip("/"), new_version()
    folder = f"{path}/{BUILD}/{VERSION}={version}"
    write_partitioned(table_rows(metrics, schema), folder, (WINDOW_DATE,))
    dated = T.StructType([*schema.fields, T.StructField(WINDOW_DATE, T.DateType())])
    written = existing(spark, folder, dated)
    listed = written.select(WINDOW_DATE)
    if dates is None and start is not None and end is not None:
        dates = days(start, end)
    if dates is not None:
        listed = listed.union(spark.createDataFrame([(d,) for d in dates], f"{WINDOW_DATE} date"))
    else:
        before = newest_builds(spark, path).select(WINDOW_DATE)
        if start is not None:
            before = before.where(F.col(WINDOW_DATE) >= F.lit(start.date()))
        if end is not None:
            before = before.where(F.col(WINDOW_DATE) < F.lit(end.date()))
        listed = listed.union(before)
    listed.distinct().coalesce(1).write.parquet(f"{path}/{BUILT}/{VERSION}={version}")


def parquet_batches(path: str, schema: T.StructType, run: str = "0") -> BatchWriter:
    """Writer of micro-batches for which a replay changes nothing.

    Each batch owns the folder ``run=<run>/batch_id=<n>``; a replay replaces it as a
    whole. Batch numbers start anew with every checkpoint, so ``run`` names it: see
    ``run_of``, whose names sort by start.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = as_table(batch, schema)
        rows.write.mode("overwrite").parquet(f"{path}/{RUN}={run}/{BATCH_ID}={batch_id}")

    return write


def compact_batches(
    batches: DataFrame, path: str, schema: T.StructType, key: tuple[str, ...]
) -> None:
    """Merge batch folders into a table by date, newest run and batch per key.

    Rows the table has for the same dates stay unless a batch has their key, so
    folders can be merged in several steps; other dates are left as they are.
    """
    spark = batches.sparkSession
    held = batches.select(F.to_date("window_start").alias(WINDOW_DATE)).distinct()
    dates = [row[WINDOW_DATE] for row in held.collect()]
    stored = read_dates(spark, path, schema).where(F.col(WINDOW_DATE).isin(dates))
    version = F.struct(F.col(RUN).cast("string").alias("run"), F.col(BATCH_ID).cast("bigint").alias("batch"))
    new = as_table(newest_per_key(batches.withColumn("__version", version), key, "__version"), schema)
    kept = as_table(stored, schema).join(new.select(*key), list(key), "left_anti")
    replace_table(new.unionByName(kept), path, schema, dates=dates)


def jdbc_batches(jdbc: JdbcSettings, table: str, schema: T.StructType, run: str = "0") -> BatchWriter:
    """Writer which appends micro-batches to a database table.

    Rows carry their ``run`` and ``batch_id``, so readers can keep the newest per key
    after a replay or a new checkpoint. At most ``jdbc.partitions`` connections are open at a time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = as_table(batch, schema).withColumns(
            {RUN: F.lit(run), BATCH_ID: F.lit(batch_id).cast("bigint")}
        )
        rows.write.format("jdbc").options(**jdbc_write_options(jdbc, table)).mode("append").save()

    return write


def jdbc_write_options(jdbc: JdbcSettings, table: str) -> dict[str, str]:
    return jdbc.options() | {
        "dbtable": table,
        "numPartitions": str(jdbc.partitions),
        "batchsize": str(jdbc.batch_rows),
    }


def guarded(
    write: BatchWriter, name: str, on_error: OnError = "raise", failed_path: str | None = None, run: str = "0"
) -> BatchWriter:
    """Error policy: ``raise`` stops the query so that the batch is tried again.

    ``log`` goes on without the failed batch, which loses its rows. The batch is still
    computed to its end, because the query's state must move on. ``keep`` goes on too,
    and stores the batch's rows below ``failed_path`` by run and batch, for
    ``replay_failed``; if that fails as well, the query stops.
    """
    if on_error == "raise":
        return write
    if on_error == "keep" and not failed_path:
        raise ValueError("on_error='keep' needs a folder for failed batches")

    def write_or_go_on(batch: DataFrame, batch_id: int) -> None:
        try:
            write(batch, batch_id)
        except Exception:
            log.exception("batch %s of %s was not written", batch_id, name)
            if on_error == "keep":
                batch.write.mode("overwrite").parquet(f"{failed_path}/{RUN}={run}/{BATCH_ID}={batch_id}")
            else:
                batch.write.format("noop").mode("overwrite").save()

    return write_or_go_on


def replay_failed(spark: SparkSession, failed_path: str, writer_for: Callable[[str], BatchWriter]) -> list[tuple[str, int]]:
    """Write the kept batches with the writer of their run; returns (run, batch) of each.

    A batch's folder goes once its write has ended, so a replay that fails can be repeated.
    """
    done = []
    for folder in subfolders(spark, failed_path):
        run = folder.rpartition(f"{RUN}=")[2]
        for kept in subfolders(spark, folder):
            batch_id = int(kept.rpartition("=")[2])
            if not finished(spark, kept):
                continue
            writer_for(run)(spark.read.parquet(kept), batch_id)
            remove(spark, kept)
            done.append((run, batch_id))
    return done


def stream_batches(
    metrics: DataFrame,
    write: BatchWriter,
    settings: StreamSettings,
    name: str,
    output_mode: Literal["append", "update"] = "append",
    on_error: OnError = "raise",
    failed_path: str | None = None,
    run: str = "0",
) -> StreamingQuery:
    """Hand every micro-batch of a metric stream to a writer."""
    writer = metrics.writeStream.foreachBatch(guarded(write, name, on_error, failed_path, run))
    return start_query(metrics, writer.outputMode(output_mode), settings, name)


def stream_table(
    metrics: DataFrame, path: str, schema: T.StructType, settings: StreamSettings, name: str
) -> StreamingQuery:
    """Write closed windows to a Parquet table, exactly-once, one row per window and key."""
    return start_file_query(table_rows(metrics, schema), path, settings, name, (WINDOW_DATE,))


def stream_event_metrics(
    metrics: DataFrame, path: str, settings: StreamSettings, name: str = "event-metrics-5min"
) -> StreamingQuery:
    return stream_table(metrics, path, METRIC_SCHEMA, settings, name)


def stream_user_metrics(
    metrics: DataFrame, path: str, settings: StreamSettings, name: str = "user-metrics-1hr"
) -> StreamingQuery:
    return stream_table(metrics, path, USER_METRIC_SCHEMA, settings, name)
