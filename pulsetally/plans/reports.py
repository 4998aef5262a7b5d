"""Reports over the metric tables. Frames in, frames out; nothing is collected."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsetally.functions.text import collated
from pulsetally.functions.time import hours_before, micros
from pulsetally.operators.metrics import FIVE_MINUTES, merge_user_sketches
from pulsetally.schema import EVENT_TYPES, PLATFORMS, USER_COUNTERS
from pulsetally.sources.metric_tables import pick_table

# Ranges of the report parameters and the label of a range.
HOURS_MAX = 168
ROWS_MAX = 1000
TOP_USERS_MAX = 100
RANGE_LABEL = "Last {} hours"

AsOf = datetime | str | Column | None
Overlap = Literal["literal", "tumbling"]


def event_metrics_report(
    tables: dict[str, DataFrame],
    time_window: str = "5min",
    hours_back: int = 1,
    event_type: str | None = None,
    platform: str | None = None,
    limit: int = 100,
    as_of: AsOf = None,
    collation: str | None = None,
) -> DataFrame:
    """Event metrics of one granularity, newest window first."""
    _check_range("limit", limit, ROWS_MAX)
    _check_member("event_type", event_type, EVENT_TYPES)
    _check_member("platform", platform, PLATFORMS)
    rows = recent(pick_table(tables, time_window), hours_back, as_of)
    rows = matching(rows, collation, event_type=event_type, platform=platform)
    columns = ["window_start", "window_end", "event_type", "platform", "event_count", "unique_users"]
    return (
        rows.select(*columns, *_if_present(rows, "computed_at"))
        .orderBy(F.desc("window_start"), "event_type", "platform")
        .limit(limit)
    )


def user_metrics_report(
    user_metrics: DataFrame,
    hours_back: int = 1,
    user_id: str | None = None,
    platform: str | None = None,
    limit: int = 100,
    as_of: AsOf = None,
    collation: str | None = None,
) -> DataFrame:
    """User metrics, most active first."""
    _check_range("limit", limit, ROWS_MAX)
    _check_member("platform", platform, PLATFORMS)
    rows = recent(user_metrics, hours_back, as_of)
    rows = matching(rows, collation, user_id=user_id, platform=platform)
    columns = ["window_start", "window_end", "user_id", "platform", "total_events", *USER_COUNTERS]
    return (
        rows.select(*columns, *_if_present(rows, "computed_at"))
        .orderBy(F.desc("total_events"), F.desc("window_start"), "user_id", "platform")
        .limit(limit)
    )


def top_users_report(
    user_metrics: DataFrame,
    hours_back: int = 24,
    limit: int = 10,
    as_of: AsOf = None,
    collation: str | None = None,
) -> DataFrame:
    """Users by activity, with ranks 1..n; ties get different ranks."""
    _check_range("limit", limit, TOP_USERS_MAX)
    keys = [collated(F.col(c), collation).alias(c) for c in ("user_id", "platform")]
    order = [F.desc("total_events"), F.col("user_id"), F.col("platform")]
    top = (
        recent(user_metrics, hours_back, as_of)
        .groupBy(*keys)
        .agg(F.sum("total_events").alias("total_events"))
        .orderBy(*order)
        .limit(limit)
    )
    # Ranks run over the at most 100 rows which are left.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def event_distribution_report(
    event_metrics: DataFrame,
    hours_back: int = 24,
    as_of: AsOf = None,
    overlap: Overlap = "literal",
    window: timedelta = FIVE_MINUTES,
) -> DataFrame:
    """Events and share in percent per event type, largest first.

    Over a table of sliding windows ``literal`` sums each event once per window
    it is in; ``tumbling`` counts every event once.
    """
    rows = without_overlap(recent(event_metrics, hours_back, as_of), overlap, window)
    totals = rows.groupBy("event_type").agg(F.sum("event_count").alias("total_count"))
    # One row per event type is left here, five in valid data.
    total = F.sum("total_count").over(Window.partitionBy())
    return totals.select(
        "event_type", "total_count", share(F.col("total_count"), total).alias("percentage")
    ).orderBy(F.desc("total_count"), "event_type")


def platform_metrics_report(
    event_metrics: DataFrame,
    hours_back: int = 24,
    as_of: AsOf = None,
    overlap: Overlap = "literal",
    window: timedelta = FIVE_MINUTES,
) -> DataFrame:
    """Events and summed per-window users per platform, largest first."""
    rows = without_overlap(recent(event_metrics, hours_back, as_of), overlap, window)
    return (
        rows.groupBy("platform")
        .agg(
            F.sum("event_count").alias("total_events"),
            F.sum("unique_users").alias("unique_users"),
        )
        .orderBy(F.desc("total_events"), "platform")
    )


def platform_users_report(
    sketch_metrics: DataFrame, hours_back: int = 24, as_of: AsOf = None
) -> DataFrame:
    """Platform metrics with distinct users over the whole range, by merged sketches.

    Takes a tumbling table with ``users_sketch``, such as the stored ``user_sketches_1hr``
    (0.8 % standard error). Users of an hour without a sketch count as none.
    """
    rows = recent(sketch_metrics, hours_back, as_of)
    return merge_user_sketches(rows, "platform").orderBy(F.desc("total_events"), "platform")


def platform_users_exact(events: DataFrame, hours_back: int = 24, as_of: AsOf = None) -> DataFrame:
    """The same from events, exactly."""
    return (
        recent_events(events, hours_back, as_of)
        .groupBy("platform")
        .agg(
            F.count(F.lit(1)).alias("total_events"),
            F.count_distinct("user_id").alias("unique_users"),
        )
        .orderBy(F.desc("total_events"), "platform")
    )


def against_exact(estimates: DataFrame, exact: DataFrame, percent: int) -> DataFrame:
    """Estimated users by platform next to ``exact_users``, and whether they are within ``percent`` of them."""
    found = exact.select(F.col("platform").alias("exact_platform"), F.col("unique_users").alias("exact_users"))
    off = F.abs(F.col("unique_users") - F.col("exact_users"))
    return (
        estimates.join(found, F.col("platform").eqNullSafe(F.col("exact_platform")))
        .drop("exact_platform")
        .withColumn(f"within_{percent}_percent", off * 100 <= F.col("exact_users") * percent)
        .orderBy(F.desc("total_events"), "platform")
    )


def recent(metrics: DataFrame, hours_back: int, as_of: AsOf = None) -> DataFrame:
    """Windows which start within the last hours."""
    _check_range("hours_back", hours_back, HOURS_MAX)
    return metrics.where(F.col("window_start") >= hours_before(hours_back, as_of))


def recent_events(events: DataFrame, hours_back: int, as_of: AsOf = None) -> DataFrame:
    """Events of the last hours.

    A window which starts in the range holds only events of the range, so
    metrics for a report can be computed from these events alone.
    """
    _check_range("hours_back", hours_back, HOURS_MAX)
    return events.where(F.col("timestamp") >= hours_before(hours_back, as_of))


def matching(rows: DataFrame, collation: str | None = None, **values: str | None) -> DataFrame:
    """Equality filters; None and empty text do not filter."""
    for name, value in values.items():
        if value:
            rows = rows.where(collated(F.col(name), collation) == value)
    return rows


def without_overlap(rows: DataFrame, overlap: Overlap, window: timedelta) -> DataFrame:
    """Keep all windows, or only those which do not overlap each other."""
    if overlap == "literal":
        return rows
    if overlap != "tumbling":
        raise ValueError(f"overlap must be literal or tumbling, not {overlap!r}")
    start = F.unix_micros("window_start")
    return rows.where(F.pmod(start, F.lit(micros(window)).cast("bigint")) == 0)


def share(part: Column, total: Column) -> Column:
    """Percentage with two decimals, half to even; 0 where the total is 0."""
    exact = part.cast("decimal(20,0)") * 100 / F.nullif(total, F.lit(0)).cast("decimal(20,0)")
    return F.coalesce(F.bround(exact, 2), F.lit(0)).cast("double")


def with_time_range(report: DataFrame, hours_back: int) -> DataFrame:
    """Add the label of the covered range."""
    return report.withColumn("time_range", F.lit(RANGE_LABEL.format(hours_back)))


def record_count(report: DataFrame) -> int:
    """Number of rows of a report."""
    return report.count()


def _check_range(name: str, value: int, most: int) -> None:
    if not 1 <= value <= most:
        raise ValueError(f"{name} must be between 1 and {most}, not {value}")


def _check_member(name: str, value: str | None, domain: tuple[str, ...]) -> None:
    if value and value not in domain:
        raise ValueError(f"{name} must be one of {', '.join(domain)}, not {value!r}")


def _if_present(rows: DataFrame, name: str) -> list[str]:
    return [name] if name in rows.columns else []


def with_totals(report: DataFrame, hours_back: int, value: str | None = None) -> DataFrame:
    """A report with its number of rows, the sum of ``value`` and its label in every row.

    For reports only, which hold some thousand rows at most: they meet in one task.
    """
    whole = Window.partitionBy()
    totals = {"total_records": F.count(F.lit(1)).over(whole)}
    if value is not None:
        totals["grand_total"] = F.sum(value).over(whole)
    return with_time_range(report.withColumns(totals), hours_back)
