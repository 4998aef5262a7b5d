"""Windowed event and user metrics, on batch and streaming frames alike."""

from __future__ import annotations

from datetime import timedelta
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetally.functions.time import interval_text
from pulsetally.operators import panes
from pulsetally.operators.projections import flat_window
from pulsetally.schema import USER_COUNTERS

Uniques = Literal["exact", "approx", "sketch", "as_coded"]

FIVE_MINUTES = timedelta(minutes=5)
ONE_MINUTE = timedelta(minutes=1)
ONE_HOUR = timedelta(hours=1)
ONE_DAY = timedelta(days=1)

DIMENSIONS = ("event_type", "platform")
# HLL sketches with 2^12 registers: about 1.6 % standard error, exact-like for
# small sets. Sketches of one size can be merged.
SKETCH_LOG2 = 12
SKETCH = "users_sketch"


def event_window(span: timedelta, slide: timedelta | None = None) -> Column:
    return F.window("timestamp", interval_text(span), interval_text(slide or span))


def event_metrics(
    events: DataFrame,
    window: timedelta = FIVE_MINUTES,
    slide: timedelta | None = None,
    uniques: Uniques = "exact",
    dimensions: tuple[str, ...] = DIMENSIONS,
) -> DataFrame:
    """Events and distinct users per window and dimension values.

    ``uniques`` decides the ``unique_users`` column:

    - ``exact``: exact count. On streams this keeps one state row per window
      and user.
    - ``approx``: estimate from an HLL sketch.
    - ``sketch``: the estimate plus the mergeable sketch as ``users_sketch``.
    - ``as_coded``: number of events, the value tables filled by earlier
      releases of such jobs hold in this column.

    Give a streaming frame a watermark first; it is then emitted in append mode.
    """
    step = slide or window
    if window % step:
        raise ValueError("slide must divide window")
    if uniques == "exact":
        if events.isStreaming:
            return _exact_by_user(events, window, step, dimensions)
        if step != window and panes.fits(window, step):
            return panes.sliding_metrics(events, window, step, dimensions)
        grouped = events.groupBy(event_window(window, step).alias("window"), *dimensions)
        counted = grouped.agg(
            F.count(F.lit(1)).alias("event_count"),
            F.count_distinct("user_id").alias("unique_users"),
        )
        return counted.select(*flat_window(), *dimensions, "event_count", "unique_users")
    return _mergeable(events, window, step, uniques, dimensions)


def _exact_by_user(
    events: DataFrame, window: timedelta, slide: timedelta, dimensions: tuple[str, ...]
) -> DataFrame:
    """Exact distinct on a stream: count per user, then count the users."""
    per_user = events.groupBy(
        event_window(window, slide).alias("window"), *dimensions, "user_id"
    ).agg(F.count(F.lit(1)).alias("user_events"))
    counted = per_user.groupBy("window", *dimensions).agg(
        F.sum("user_events").alias("event_count"),
        F.count("user_id").alias("unique_users"),
    )
    return counted.select(*flat_window(), *dimensions, "event_count", "unique_users")


def _mergeable(
    events: DataFrame,
    window: timedelta,
    slide: timedelta,
    uniques: Uniques,
    dimensions: tuple[str, ...],
) -> DataFrame:
    """Metrics whose parts can be merged: aggregate per slide, then per window.

    A sliding window would copy every event window/slide times. Here only the
    small per-slide rows are copied.
    """
    with_sketch = uniques in ("approx", "sketch")
    parts = [F.count(F.lit(1)).alias("event_count")]
    if with_sketch:
        parts.append(F.hll_sketch_agg("user_id", SKETCH_LOG2).alias(SKETCH))
    counted = events.groupBy(event_window(slide).alias("window"), *dimensions).agg(*parts)
    if slide != window:
        merged = [F.sum("event_count").alias("event_count")]
        if with_sketch:
            merged.append(F.hll_union_agg(SKETCH).alias(SKETCH))
        wide = F.window(F.window_time("window"), interval_text(window), interval_text(slide))
        counted = counted.groupBy(wide.alias("window"), *dimensions).agg(*merged)
    users = F.hll_sketch_estimate(SKETCH) if with_sketch else F.col("event_count")
    kept = [SKETCH] if uniques == "sketch" else []
    return counted.select(
        *flat_window(), *dimensions, "event_count", users.alias("unique_users"), *kept
    )


def event_metrics_one_step(
    events: DataFrame,
    window: timedelta = FIVE_MINUTES,
    slide: timedelta | None = None,
    dimensions: tuple[str, ...] = DIMENSIONS,
) -> DataFrame:
    """Event metrics with estimated users in a single aggregation, for update mode."""
    users = F.hll_sketch_estimate(F.hll_sketch_agg("user_id", SKETCH_LOG2))
    counted = events.groupBy(event_window(window, slide).alias("window"), *dimensions).agg(
        F.count(F.lit(1)).alias("event_count"), users.alias("unique_users")
    )
    return counted.select(*flat_window(), *dimensions, "event_count", "unique_users")


def user_metrics(
    events: DataFrame, window: timedelta = ONE_HOUR, as_coded: bool = False
) -> DataFrame:
    """Events in total and by type per window, user and platform.

    With ``as_coded`` every counter equals the total (see ``event_metrics``).
    """
    total = F.count(F.lit(1))
    counters = [
        (total if as_coded else F.count_if(F.col("event_type") == event_type)).alias(name)
        for name, event_type in USER_COUNTERS.items()
    ]
    counted = events.groupBy(event_window(window).alias("window"), "user_id", "platform").agg(
        total.alias("total_events"), *counters
    )
    return counted.select(
        *flat_window(), "user_id", "platform", "total_events", *USER_COUNTERS
    )


def events_per_user(events: DataFrame) -> DataFrame:
    """Number of events per user."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("event_count"))


def events_per_window_type(events: DataFrame, window: timedelta = FIVE_MINUTES) -> DataFrame:
    """Number of events per tumbling window and type."""
    counted = events.groupBy(event_window(window).alias("window"), "event_type").agg(
        F.count(F.lit(1)).alias("event_count")
    )
    return counted.select(*flat_window(), "event_type", "event_count")


def merge_user_sketches(metrics: DataFrame, *keys: str) -> DataFrame:
    """Distinct users over many windows, from tables with ``users_sketch``.

    Sketches merge; per-window distinct counts must not be summed.
    """
    return metrics.groupBy(*keys).agg(
        F.sum("event_count").alias("total_events"),
        F.hll_sketch_estimate(F.hll_union_agg(SKETCH)).alias("unique_users"),
    )
