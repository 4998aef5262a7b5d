"""Projections shared by batch and stream: calendar columns and table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsetally.functions import time


def with_calendar(events: DataFrame) -> DataFrame:
    """Add year, month, day and hour of the event time."""
    return events.withColumns(time.calendar_columns(F.col("timestamp")))


def of_type(events: DataFrame, event_type: str) -> DataFrame:
    """Events of one type."""
    return events.where(F.col("event_type") == event_type)


def flat_window(window: Column | str = "window") -> list[Column]:
    """A window struct as ``window_start`` and ``window_end``."""
    name = window if isinstance(window, str) else "window"
    return [F.col(f"{name}.start").alias("window_start"), F.col(f"{name}.end").alias("window_end")]


def as_table(metrics: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to a metric table's columns: counters default to 0, computed_at to now."""
    have = set(metrics.columns)
    columns = []
    for f in schema.fields:
        if f.name == "computed_at":
            column = F.col(f.name) if f.name in have else F.current_timestamp()
        elif isinstance(f.dataType, T.LongType):
            column = F.coalesce(F.col(f.name), F.lit(0)) if f.name in have else F.lit(0)
        else:
            column = F.col(f.name)
        columns.append(column.cast(f.dataType).alias(f.name))
    return metrics.select(*columns)
