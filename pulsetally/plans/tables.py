"""Batch jobs: build the metric tables for a range of days, refresh top users."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsetally.functions.time import as_timestamp
from pulsetally.operators import rollup
from pulsetally.operators.metrics import FIVE_MINUTES, user_metrics
from pulsetally.plans.reports import AsOf, top_users_report
from pulsetally.schema import (
    METRIC_SCHEMA,
    METRIC_TABLES,
    SKETCH_SCHEMA,
    SKETCH_TABLE,
    USER_METRIC_SCHEMA,
    USER_METRIC_TABLE,
)
from pulsetally.session import shared_dir
from pulsetally.sinks.metrics import replace_table

# Gives the events with start <= timestamp < end, e.g. a partial of read_lake.
ReadEvents = Callable[[datetime | None, datetime | None], DataFrame]


def build_metric_tables(
    spark: SparkSession,
    read_events: ReadEvents,
    path: str,
    start: datetime | None = None,
    end: datetime | None = None,
) -> None:
    """Compute the metric tables and the table of user sketches below ``path`` for windows starting in a range.

    The range must be whole UTC days: all its dates are built anew, also those that
    have become empty, so a run can be repeated. The last sliding windows of a day reach
    into the next, so run it at least one window length after ``end``.
    """
    for bound in (start, end):
        if bound is not None and (bound.hour, bound.minute, bound.second, bound.microsecond) != (0, 0, 0, 0):
            raise ValueError(f"bounds must be whole days, not {bound}")
    folder = shared_dir(spark, "metric-parts")
    reaching = end + FIVE_MINUTES if end is not None else None
    rollup.write_intermediates(read_events(start, reaching), folder)
    sketches = _starting_within(rollup.hourly_sketches(spark, folder), start, end)
    replace_table(sketches, f"{path}/{SKETCH_TABLE}", SKETCH_SCHEMA, start, end)
    for name, metrics in rollup.metric_tables(spark, folder).items():
        rows = _starting_within(metrics, start, end)
        replace_table(rows, f"{path}/{METRIC_TABLES[name]}", METRIC_SCHEMA, start, end)
    users = user_metrics(read_events(start, end))
    replace_table(users, f"{path}/{USER_METRIC_TABLE}", USER_METRIC_SCHEMA, start, end)


def refresh_top_users(
    metrics: DataFrame, path: str, hours_back: int = 24, limit: int = 10, as_of: AsOf = None
) -> None:
    """Store the top users, replacing the stored ones."""
    top_users_report(metrics, hours_back, limit, as_of).write.mode("overwrite").parquet(path)


def _starting_within(
    metrics: DataFrame, start: datetime | None, end: datetime | None
) -> DataFrame:
    if start is not None:
        metrics = metrics.where(F.col("window_start") >= as_timestamp(start))
    if end is not None:
        metrics = metrics.where(F.col("window_start") < as_timestamp(end))
    return metrics
