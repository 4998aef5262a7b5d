"""What micro-batches write to several tables, each exactly once, and packing of it.

A sink's folder of a micro-batch is its ledger entry: Spark puts ``_SUCCESS`` there when
the write is complete. A repeated batch has the same rows, so sinks that have it skip
it and the others write their folder anew, whatever a crash had left there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsetally.sinks.lake import write_partitioned
from pulsetally.sources.folders import (
    BATCH_ID,
    LAST,
    MICRO,
    PACKED,
    PACKS,
    RUN,
    VERSION,
    beyond,
    existing,
    finished,
    micro_scans,
    new_version,
    packed_up_to,
    remove,
    subfolders,
    united,
    with_fields,
)


def micro_folder(path: str, run: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/{MICRO}/{RUN}={run}/{BATCH_ID}={batch_id}"


def write_micro(
    rows: Callable[[], DataFrame], spark: SparkSession, path: str, columns: tuple[str, ...], run: str, batch_id: int
) -> bool:
    """Write a micro-batch's rows unless that is done; whether it was written."""
    folder = micro_folder(path, run, batch_id)
    if finished(spark, folder):
        return False
    write_partitioned(rows(), folder, columns, "overwrite")
    return True


def finished_up_to(spark: SparkSession, path: str, after: dict[str, int] | None = None) -> dict[str, int]:
    """Of every run the last micro-batch before which all are complete, from those ``after`` on."""
    done: dict[str, int] = {}
    for folder in subfolders(spark, f"{path.rstrip('/')}/{MICRO}"):
        run = folder.rpartition(f"{RUN}=")[2]
        known = (after or {}).get(run, -1)
        for batch in sorted(int(p.rpartition("=")[2]) for p in subfolders(spark, folder)):
            if batch <= known:
                continue
            if not finished(spark, f"{folder}/{BATCH_ID}={batch}"):
                break
            done[run] = batch
    return done


def complete_up_to(spark: SparkSession, path: str) -> dict[str, int]:
    """Of every run the last micro-batch up to which all are complete, packed or not."""
    packed, _ = packed_up_to(spark, path)
    return packed | finished_up_to(spark, path, packed)


def pack(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    columns: tuple[str, ...],
    combine: Callable[[DataFrame], DataFrame] | None = None,
    max_records_per_file: int = 5_000_000,
    keep_files: bool = False,
) -> int | None:
    """Rewrite the complete micro-batches to one file a partition (more for large ones).

    Streams may go on meanwhile: readers see a row in its micro-batch until the list of
    packed batches is written, and in the pack from then on. ``combine`` may merge rows
    that add up. Files of packed batches are deleted in the end unless ``keep_files``, as
    readers that began before need them. Returns the version of the pack, if there was
    anything to do.
    """
    path = path.rstrip("/")
    before, _ = packed_up_to(spark, path)
    last = finished_up_to(spark, path, before)
    if not last:
        return None
    version = new_version()
    full = with_fields(schema, **{RUN: T.StringType(), BATCH_ID: T.LongType()})
    rows = existing(spark, f"{path}/{MICRO}", full).where(beyond(before) & ~beyond(last)).select(*schema.names)
    folder = f"{path}/{PACKED}/{VERSION}={version}"
    write_partitioned(combine(rows) if combine else rows, folder, columns, maxRecordsPerFile=max_records_per_file)
    listed = spark.createDataFrame(list(last.items()), f"{RUN} string, {LAST} long")
    listed.coalesce(1).write.parquet(f"{path}/{PACKS}/{VERSION}={version}")
    if not keep_files:
        drop_packed(spark, path)
    return version


def drop_packed(spark: SparkSession, path: str) -> None:
    """Delete the files of micro-batches that are in packs."""
    last, _ = packed_up_to(spark, path)
    for run, batch in last.items():
        for folder in subfolders(spark, f"{path.rstrip('/')}/{MICRO}/{RUN}={run}"):
            if int(folder.rpartition("=")[2]) <= batch:
                remove(spark, folder)


def files_by_partition(spark: SparkSession, path: str, schema: T.StructType, columns: tuple[str, ...]) -> DataFrame:
    """Number of data files for each partition, of micro-batches and packs together."""
    fields = T.StructType([schema[c] for c in columns]).add("file", "string")
    scans = micro_scans(spark, path, schema)
    rows = united(spark, [p.select(*columns, F.col("_metadata.file_path").alias("file")) for p in scans], fields)
    return rows.groupBy(*columns).agg(F.count_distinct("file").alias("files"))
