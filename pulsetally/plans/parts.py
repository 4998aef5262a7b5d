"""Metric tables from parts: partial sums of micro-batches that add up at any time.

A part has, for the events of one micro-batch, counts by minute, a bit mask of active
minutes by hour and user, and counts by hour and user. Sums, ``bit_or`` and sums again
merge the parts of all batches, whenever they came. So late events count as soon as
their batch is written, and the 5-minute, hourly and daily tables with exact distinct
users come from the same parts. ``refresh_tables`` builds only those dates of the tables
anew whose parts have changed since it ran last.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsetally.operators import panes, rollup
from pulsetally.operators.metrics import DIMENSIONS, FIVE_MINUTES, ONE_MINUTE, user_metrics
from pulsetally.schema import METRIC_TABLES, SKETCH_TABLE, TABLE_SCHEMAS, USER_COUNTERS, USER_METRIC_SCHEMA, USER_METRIC_TABLE
from pulsetally.sinks.metrics import replace_table
from pulsetally.sinks.micro import complete_up_to, pack
from pulsetally.sources.folders import (
    BATCH_ID,
    DATE,
    LAST,
    RUN,
    VERSION,
    beyond,
    existing,
    micro_scans,
    new_version,
    packed_up_to,
    read_micro,
    united,
    with_fields,
)

COUNTS, ACTIVITY, USERS = "pane_counts", "user_activity", "user_hours"
REFRESHED = "refreshed"
_DIMENSIONS = [T.StructField(c, T.StringType()) for c in DIMENSIONS]
SCHEMAS = {
    COUNTS: T.StructType([T.StructField(panes.PANE, T.LongType()), *_DIMENSIONS])
    .add("event_count", "long").add(DATE, "date"),
    ACTIVITY: T.StructType([T.StructField(panes.BLOCK, T.LongType()), *_DIMENSIONS])
    .add("user_id", "string").add(panes.ACTIVE, "long").add(DATE, "date"),
    USERS: T.StructType([f for f in USER_METRIC_SCHEMA.fields if f.name != "computed_at"]).add(DATE, "date"),
}


def _dated(rows: DataFrame, name: str, time: Column) -> DataFrame:
    return rows.withColumn(DATE, time.cast("date")).select(*SCHEMAS[name].names)


def part_of(events: DataFrame, name: str) -> DataFrame:
    """One of the parts of a batch of events."""
    if name == COUNTS:
        return _dated(panes.pane_counts(events, ONE_MINUTE, DIMENSIONS), name, F.timestamp_micros(panes.PANE))
    if name == ACTIVITY:
        rows = panes.user_activity(events, FIVE_MINUTES, ONE_MINUTE, DIMENSIONS)
        return _dated(rows, name, F.timestamp_micros(panes.BLOCK))
    timed = events.where(F.col("timestamp").isNotNull())
    return _dated(user_metrics(timed), name, F.col("window_start"))


def combine(name: str):
    """Merge rows of a part's table that have the same key."""
    sums = {COUNTS: ["event_count"], USERS: ["total_events", *USER_COUNTERS]}.get(name, [])
    totals = [F.sum(c).alias(c) for c in sums] or [F.bit_or(panes.ACTIVE).alias(panes.ACTIVE)]
    keys = [c for c in SCHEMAS[name].names if c not in sums and c != panes.ACTIVE]

    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*totals).select(*SCHEMAS[name].names)

    return merged


def read_part(spark: SparkSession, path: str, name: str, dates: list[date] | None = None) -> DataFrame:
    """A part's table over all batches, of some dates or all; one row a key."""
    rows = united(spark, read_micro(spark, f"{path}/{name}", SCHEMAS[name]), SCHEMAS[name])
    if dates is not None:
        rows = rows.where(F.col(DATE).isin(dates))
    return combine(name)(rows)


def tables_of_parts(spark: SparkSession, path: str, dates: list[date] | None = None) -> dict[str, DataFrame]:
    """All metric tables by name, for windows that start at ``dates`` or at any date."""
    # Windows reach into the next day; blocks of activity hold the minutes their windows reach.
    reaching = None if dates is None else sorted({d + timedelta(days=k) for d in dates for k in (0, 1)})
    counts = read_part(spark, path, COUNTS, reaching).drop(DATE)
    activity = read_part(spark, path, ACTIVITY, dates).drop(DATE)
    tables = {METRIC_TABLES[name]: frame for name, frame in rollup.tables_from(counts, activity).items()}
    tables[USER_METRIC_TABLE] = read_part(spark, path, USERS, dates).drop(DATE)
    tables[SKETCH_TABLE] = rollup.user_sketches(counts, activity)
    if dates is None:
        return tables
    return {name: frame.where(F.to_date("window_start").isin(dates)) for name, frame in tables.items()}


def _refreshed(spark: SparkSession, tables_path: str) -> tuple[dict[str, int], int]:
    """Up to which batch of every run, and up to which pack, the tables are built."""
    schema = T.StructType([]).add(RUN, "string").add(LAST, "long").add("pack", "long").add(VERSION, "long")
    found = existing(spark, f"{tables_path.rstrip('/')}/{REFRESHED}", schema)
    last, newest = {}, 0
    for row in found.collect() if found is not None else []:
        last[row[RUN]] = max(row[LAST], last.get(row[RUN], -1))
        newest = max(newest, row["pack"])
    return last, newest


def changed_dates(spark: SparkSession, path: str, after: dict[str, int], pack_after: int) -> list[date]:
    """Dates on which windows start whose events came in later batches."""
    full = with_fields(SCHEMAS[COUNTS], **{RUN: T.StringType(), BATCH_ID: T.LongType(), VERSION: T.LongType()})
    new = []
    for scan in micro_scans(spark, f"{path}/{COUNTS}", SCHEMAS[COUNTS]):
        fresh = beyond(after) if BATCH_ID in scan.columns else F.col(VERSION) > pack_after
        new.append(scan.where(fresh).select(panes.PANE))
    rows = united(spark, new, T.StructType([full[panes.PANE]]))
    first = F.timestamp_micros(F.col(panes.PANE) - F.lit(int((FIVE_MINUTES - ONE_MINUTE).total_seconds() * 1e6)))
    dates = rows.select(F.explode(F.array(F.to_date(F.timestamp_micros(panes.PANE)), F.to_date(first))).alias(DATE))
    return sorted(r[DATE] for r in dates.distinct().collect())


def refresh_tables(spark: SparkSession, path: str, tables_path: str) -> list[date]:
    """Build the dates anew that batches since the last refresh have changed; returns them.

    Which batches count is noted before they are read and written down last, so a
    refresh that fails is repeated, and batches that come meanwhile count next time.
    """
    path, tables_path = path.rstrip("/"), tables_path.rstrip("/")
    after, pack_after = _refreshed(spark, tables_path)
    _, packs = packed_up_to(spark, f"{path}/{COUNTS}")
    complete = [complete_up_to(spark, f"{path}/{name}") for name in SCHEMAS]
    upto = {run: min(part.get(run, -1) for part in complete) for run in complete[0]}
    dates = changed_dates(spark, path, after, pack_after)
    if dates:
        for name, frame in tables_of_parts(spark, path, dates).items():
            replace_table(frame, f"{tables_path}/{name}", TABLE_SCHEMAS[name], dates=dates)
    noted = [(run, last, max(packs, default=0)) for run, last in upto.items()]
    if noted:
        rows = spark.createDataFrame(noted, f"{RUN} string, {LAST} long, pack long")
        rows.coalesce(1).write.parquet(f"{tables_path}/{REFRESHED}/{VERSION}={new_version()}")
    return dates


def pack_parts(spark: SparkSession, path: str, keep_files: bool = False) -> None:
    """Merge the parts of complete micro-batches, which leaves a row a key and a file a date."""
    for name, schema in SCHEMAS.items():
        pack(spark, f"{path.rstrip('/')}/{name}", schema, (DATE,), combine(name), keep_files=keep_files)
