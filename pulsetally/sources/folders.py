"""Tables that a stream and batch jobs write side by side.

Below a table's folder every writer has a place of its own, since a folder with a
stream's commit log shows that stream's files only:

- ``stream/<run>``: one folder for each checkpoint, with the stream's commit log,
- ``batch``: files that batch jobs append (in tables by date ``batch/version=<n>``),
- ``micro/run=<run>/batch_id=<n>``: what one micro-batch wrote, complete once Spark has
  put its ``_SUCCESS`` file there,
- ``packed/version=<n>`` and ``packs/version=<n>``: micro-batches rewritten to fewer files,
  and the list of them (of each run up to which batch), written last,
- ``build/version=<n>`` and ``built/version=<n>``: whole dates that batch jobs computed,
  and the list of these dates, written last. The newest build of a date is the date's
  content, also where it is empty, and rows of streams and appends count for other dates.
  What streams and appends write after a build is added to it; a later row of a stream
  takes the place of the build's row with the same key.
"""

from __future__ import annotations

import time
import uuid
from datetime import date, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STREAM, BATCH, BUILD, BUILT = "stream", "batch", "build", "built"
MICRO, PACKED, PACKS = "micro", "packed", "packs"
VERSION, DATE = "version", "window_date"
RUN, BATCH_ID, LAST = "run", "batch_id", "last_batch"
WRITTEN = "computed_at"
KEYS = ("window_start", "event_type", "user_id", "platform")


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders in a folder, in order; none if it does not exist."""
    files, where = _files(spark, path)
    if not files.exists(where):
        return []
    return sorted(str(s.getPath()) for s in files.listStatus(where) if s.isDirectory())


def run_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of a checkpoint's run: kept in the checkpoint, ordered by first start."""
    path = f"{checkpoint}/run-name"
    files, where = _files(spark, path)
    if not files.exists(where):
        name = f"{time.time_ns() // 1_000_000:014d}-{uuid.uuid4().hex[:8]}"
        out = files.create(where)
        out.write(bytearray(name.encode()))
        out.close()
    with_name = spark.read.text(path).first()
    return with_name[0]


def stream_folder(spark: SparkSession, path: str, checkpoint: str) -> str:
    """Where the stream of a checkpoint writes its part of a table."""
    return f"{path.rstrip('/')}/{STREAM}/{run_of(spark, checkpoint)}"


def existing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """A Parquet folder, or None if nobody has written it yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    files, where = _files(spark, path)
    files.delete(where, True)


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a batch write into a folder came to its end."""
    files, where = _files(spark, f"{folder}/_SUCCESS")
    return files.exists(where)


def with_fields(schema: T.StructType, **types: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in types.items())])


def packed_up_to(spark: SparkSession, path: str) -> tuple[dict[str, int], list[int]]:
    """Of every run the last packed micro-batch, and the versions of the packs (a row a pack and run)."""
    listed = existing(
        spark, f"{path.rstrip('/')}/{PACKS}", T.StructType([]).add(RUN, "string").add(LAST, "long").add(VERSION, "long")
    )
    rows = listed.collect() if listed is not None else []
    last: dict[str, int] = {}
    for row in rows:
        last[row[RUN]] = max(row[LAST], last.get(row[RUN], -1))
    return last, sorted({row[VERSION] for row in rows})


def beyond(last: dict[str, int]) -> Column:
    """Micro-batches after the ``last`` of their run; only partition columns are asked."""
    return F.lit(True) if not last else ~F.coalesce(F.col(BATCH_ID) <= _looked_up(last, RUN, "string", "long"), F.lit(False))


def _looked_up(values: dict, column: str, key_type: str, value_type: str) -> Column:
    """The value for a column in a constant map, else NULL."""
    keys = F.array(*[F.lit(k) for k in values]).cast(f"array<{key_type}>")
    return F.try_element_at(F.map_from_arrays(keys, F.array(*[F.lit(v) for v in values.values()]).cast(f"array<{value_type}>")), F.col(column))


def micro_scans(spark: SparkSession, path: str, schema: T.StructType) -> list[DataFrame]:
    """Micro-batches that are in no pack, and the packs; every row is in one of both."""
    path = path.rstrip("/")
    last, versions = packed_up_to(spark, path)
    loose = existing(spark, f"{path}/{MICRO}", with_fields(schema, **{RUN: T.StringType(), BATCH_ID: T.LongType()}))
    packed = existing(spark, f"{path}/{PACKED}", with_fields(schema, **{VERSION: T.LongType()})) if versions else None
    found = [] if loose is None else [loose.where(beyond(last))]
    if packed is not None:
        found.append(packed.where(F.col(VERSION).isin(versions)))
    return found


def read_micro(spark: SparkSession, path: str, schema: T.StructType) -> list[DataFrame]:
    """The rows of ``micro_scans`` in the columns of ``schema``."""
    return [part.select(*schema.names) for part in micro_scans(spark, path, schema)]


def read_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all streams and appends below ``path``; filters reach every scan."""
    path = path.rstrip("/")
    parts = [existing(spark, p, schema) for p in (*subfolders(spark, f"{path}/{STREAM}"), f"{path}/{BATCH}")]
    return united(spark, [*(p for p in parts if p is not None), *read_micro(spark, path, schema)], schema)


def united(spark: SparkSession, parts: list[DataFrame], schema: T.StructType) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def newest_builds(spark: SparkSession, path: str) -> DataFrame:
    """(window_date, version) of the newest build of every built date."""
    schema = T.StructType([T.StructField(DATE, T.DateType()), T.StructField(VERSION, T.LongType())])
    built = existing(spark, f"{path.rstrip('/')}/{BUILT}", schema)
    if built is None:
        return spark.createDataFrame([], schema)
    return built.groupBy(DATE).agg(F.max(VERSION).alias(VERSION))


def read_dates(spark: SparkSession, path: str, schema: T.StructType, dates: Column | None = None) -> DataFrame:
    """A table by date: built dates from their newest build and later rows, others from streams and appends.

    ``dates``, a condition on ``window_date``, bounds every scan, also that for late rows.
    Which builds count is put into the scans as constants (a number for each built date), so
    older builds are not opened.
    """
    path, full = path.rstrip("/"), with_fields(schema, **{DATE: T.DateType()})
    newest = {r[DATE]: r[VERSION] for r in newest_builds(spark, path).collect()}
    versioned = with_fields(full, **{VERSION: T.LongType()})
    wanted = F.lit(True) if dates is None else dates
    found = [existing(spark, f"{path}/{part}", versioned) for part in (BATCH, BUILD)]
    appended, builds = (None if part is None else part.where(wanted) for part in found)
    streams = [existing(spark, p, full) for p in subfolders(spark, f"{path}/{STREAM}")]
    streams = [p.where(wanted) for p in (*streams, *read_micro(spark, path, full)) if p is not None]
    if not newest:
        return united(spark, [p.select(*full.names) for p in (*streams, appended) if p is not None], full)
    build = _looked_up(newest, DATE, "date", "long")
    parts = [] if appended is None else [appended.where(build.isNull() | (F.col(VERSION) > build)).select(*full.names)]
    kept = united(spark, [] if builds is None else [builds.where(F.col(VERSION) == build)], versioned).select(*full.names)
    if streams:
        rows = united(spark, streams, full)
        after = F.col(WRITTEN) > F.timestamp_micros(F.floor(build / 1000))
        parts.append(rows.where(build.isNull()))
        late = rows.where(after)
        late_dates = [r[DATE] for r in late.select(DATE).distinct().collect()]
        if late_dates:
            keys = [k for k in KEYS if k in schema.names]
            again = F.col(DATE).isin(late_dates)
            late = late.where(again)
            kept = kept.where(~again).unionByName(kept.where(again).join(late.select(*keys), keys, "left_anti").select(*full.names))
            parts.append(late)
    return united(spark, [kept, *parts], full)


def drop_old_builds(spark: SparkSession, path: str, before: datetime) -> list[int]:
    """Delete builds begun ``before`` that are no date's newest; returns their versions.

    Choose a time before which no reader that still runs was started.
    """
    path, limit = path.rstrip("/"), int(before.timestamp() * 1e9)
    used = {r[VERSION] for r in newest_builds(spark, path).collect()}
    found = {int(p.rpartition("=")[2]) for part in (BUILD, BUILT) for p in subfolders(spark, f"{path}/{part}")}
    old = sorted(v for v in found - used if v < limit)
    for version in old:
        for part in (BUILT, BUILD):
            remove(spark, f"{path}/{part}/{VERSION}={version}")
    return old


def days(start: datetime, end: datetime) -> list[date]:
    """The dates from ``start`` up to ``end``."""
    return [date.fromordinal(d) for d in range(start.toordinal(), end.toordinal())]


def new_version() -> int:
    """Greater than that of any build that ended before."""
    return time.time_ns()
