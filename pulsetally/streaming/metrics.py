"""Metric streams: watermark, optional deduplication, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pulsetally.config import StreamSettings
from pulsetally.functions.time import interval_text
from pulsetally.operators import metrics
from pulsetally.operators.dedup import dedup_events


def prepared(events: DataFrame, settings: StreamSettings) -> DataFrame:
    """Events with a watermark and, if asked for, without repeated event ids."""
    marked = events.withWatermark("timestamp", interval_text(settings.watermark))
    return dedup_events(marked) if settings.dedup else marked


def event_metric_stream(
    events: DataFrame, settings: StreamSettings, uniques: metrics.Uniques = "approx"
) -> DataFrame:
    """Sliding-window event metrics; in append mode a window appears once it is closed."""
    return metrics.event_metrics(
        prepared(events, settings), settings.window, settings.slide, uniques
    )


def event_metric_updates(events: DataFrame, settings: StreamSettings) -> DataFrame:
    """The same for update mode: windows appear early and change until they close.

    Update mode allows one stateful step, so every event is copied to each of
    its windows here and ids are not deduplicated. Keep the newest row per key.
    """
    marked = events.withWatermark("timestamp", interval_text(settings.watermark))
    return metrics.event_metrics_one_step(marked, settings.window, settings.slide)


def user_metric_stream(events: DataFrame, settings: StreamSettings) -> DataFrame:
    """Tumbling-window user metrics."""
    return metrics.user_metrics(prepared(events, settings), settings.user_window)
