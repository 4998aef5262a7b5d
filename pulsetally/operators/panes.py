"""Exact sliding-window metrics without copying the events.

A plain sliding window copies each event window/slide times before the shuffle.
Here time is cut into panes of one slide, and panes into blocks. Per block and
user one 64-bit number says in which panes the user was active: it is built by
``bit_or``, which combines on the map side, so even one user with a third of
all events becomes one row per block and task. A window's distinct users are
then a sum of bits. A block has 64 - (window/slide - 1) panes; the bits beyond
it are the first panes of the next block, which the last windows reach into.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetally.functions.time import micros

BITS = 64
# With more panes per window than this, blocks get short and users repeat.
MAX_PANES = 32

PANE = "pane_us"
BLOCK = "block_us"
ACTIVE = "active_panes"


def block_panes(window: timedelta, slide: timedelta) -> int:
    """Panes per block."""
    return BITS - (window // slide - 1)


def fits(window: timedelta, slide: timedelta) -> bool:
    return window // slide <= MAX_PANES


def pane_counts(
    events: DataFrame, slide: timedelta, dimensions: tuple[str, ...]
) -> DataFrame:
    """Events per pane: ``pane_us`` is the pane's start in microseconds."""
    return (
        events.where(F.col("timestamp").isNotNull())
        .groupBy(floor_to(F.unix_micros("timestamp"), micros(slide)).alias(PANE), *dimensions)
        .agg(F.count(F.lit(1)).alias("event_count"))
    )


def user_activity(
    events: DataFrame, window: timedelta, slide: timedelta, dimensions: tuple[str, ...]
) -> DataFrame:
    """Per block, dimensions and user: the panes with activity as bits."""
    step, reach = micros(slide), window // slide - 1
    span = (BITS - reach) * step
    stamp = F.unix_micros("timestamp")
    block = floor_to(stamp, span)
    pane = ((stamp - block) / step).cast("int")
    here = F.struct(block.alias(BLOCK), pane.alias("pane"))
    before = F.struct((block - _long(span)).alias(BLOCK), (pane + (BITS - reach)).alias("pane"))
    places = F.when(pane < reach, F.array(here, before)).otherwise(F.array(here))
    bit = F.call_function("shiftleft", _long(1), F.col("place.pane"))
    return (
        events.where(F.col("timestamp").isNotNull() & F.col("user_id").isNotNull())
        .select(*dimensions, "user_id", F.explode(places).alias("place"))
        .groupBy(F.col(f"place.{BLOCK}").alias(BLOCK), *dimensions, "user_id")
        .agg(F.bit_or(bit).alias(ACTIVE))
    )


def window_users(
    activity: DataFrame, window: timedelta, slide: timedelta, dimensions: tuple[str, ...]
) -> DataFrame:
    """Distinct users per window: ``start_us`` and ``unique_users``."""
    step, reach = micros(slide), window // slide - 1
    # Bit s of `seen` is set when the user is active in any pane of the window
    # which starts at pane s.
    seen = F.col(ACTIVE)
    for shift in range(1, reach + 1):
        seen = seen.bitwiseOR(F.shiftrightunsigned(F.col(ACTIVE), shift))
    starts = range(BITS - reach)
    sums = [F.expr(f"sum(shiftrightunsigned(seen, {s}) & 1L) AS u{s}") for s in starts]
    per_start = F.expr(f"posexplode(array({', '.join(f'u{s}' for s in starts)}))")
    counted = (
        activity.select(BLOCK, *dimensions, seen.alias("seen"))
        .groupBy(BLOCK, *dimensions)
        .agg(*sums)
    )
    return (
        counted.select(BLOCK, *dimensions, per_start)
        .where(F.col("col") > 0)
        .select(
            (F.col(BLOCK) + F.col("pos") * _long(step)).alias("start_us"),
            *dimensions,
            F.col("col").alias("unique_users"),
        )
    )


def window_counts(
    counts: DataFrame, window: timedelta, slide: timedelta, dimensions: tuple[str, ...]
) -> DataFrame:
    """Pane rows copied to each window they are in; the caller sums them up."""
    step = micros(slide)
    offsets = F.array(*[_long(k * step) for k in range(window // slide)])
    return counts.select(
        PANE, *dimensions, "event_count", F.explode(offsets).alias("back")
    ).select((F.col(PANE) - F.col("back")).alias("start_us"), *dimensions, "event_count")


def join_parts(
    counts: DataFrame, users: DataFrame, window: timedelta, dimensions: tuple[str, ...]
) -> DataFrame:
    """Bring both counts of a window together by union and sum; no join."""
    zero = _long(0)
    rows = counts.select("start_us", *dimensions, "event_count", zero.alias("unique_users")).unionByName(
        users.select("start_us", *dimensions, zero.alias("event_count"), "unique_users")
    )
    return (
        rows.groupBy("start_us", *dimensions)
        .agg(F.sum("event_count").alias("event_count"), F.sum("unique_users").alias("unique_users"))
        .select(
            F.timestamp_micros("start_us").alias("window_start"),
            F.timestamp_micros(F.col("start_us") + _long(micros(window))).alias("window_end"),
            *dimensions,
            "event_count",
            "unique_users",
        )
    )


def sliding_metrics(
    events: DataFrame, window: timedelta, slide: timedelta, dimensions: tuple[str, ...]
) -> DataFrame:
    """Events and exact distinct users per sliding window."""
    counts = window_counts(pane_counts(events, slide, dimensions), window, slide, dimensions)
    users = window_users(
        user_activity(events, window, slide, dimensions), window, slide, dimensions
    )
    return join_parts(counts, users, window, dimensions)


def floor_to(value: Column, step: int) -> Column:
    return value - F.pmod(value, _long(step))


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")
