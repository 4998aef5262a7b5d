"""Drop events which a retrying producer sent twice."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetally.functions.time import interval_text

KEY = "dedup_key"


def dedup_events(events: DataFrame) -> DataFrame:
    """Keep one event per ``event_id``; events without an id are all kept.

    On a stream the frame must have a watermark; copies are then recognised
    while they arrive within the watermark delay, which bounds the state, and the
    first to arrive stays. In a batch copies already meet on the map side; of copies
    that differ the earliest stays (one without a time only if all are), then the one
    whose JSON text is smallest, so a repeated run keeps the same ones.
    """
    sent_id = F.nullif(F.col("event_id"), F.lit(""))
    keyed = events.withColumn(KEY, F.coalesce(sent_id, F.uuid()))
    if events.isStreaming:
        return keyed.dropDuplicatesWithinWatermark([KEY]).drop(KEY)
    whole = F.struct(*events.columns)
    times = [F.col("timestamp").isNull(), F.col("timestamp")] if "timestamp" in events.columns else []
    order = F.struct(*times, F.to_json(whole))
    kept = keyed.groupBy(KEY).agg(F.min_by(whole, order).alias("kept"))
    return kept.select("kept.*")


def dedup_sessions(events: DataFrame, gap: timedelta) -> DataFrame:
    """Of copies of an ``event_id`` that lie less than ``gap`` apart in a row the earliest stays.

    Batches and streams give the same rows, whatever order copies come in: the event time
    decides, then the smallest JSON text. On a stream (with a watermark) a session's event
    is emitted once no copy can join it any more, and the state is one event a session.
    Events without an id are all kept; those without a time have no session and go.
    """
    sent_id = F.nullif(F.col("event_id"), F.lit(""))
    keyed = events.withColumn(KEY, F.coalesce(sent_id, F.uuid()))
    whole = F.struct(*events.columns)
    order = F.struct(F.col("timestamp"), F.to_json(whole))
    session = F.session_window("timestamp", interval_text(gap)).alias("session")
    kept = keyed.groupBy(session, KEY).agg(F.min_by(whole, order).alias("kept"))
    return kept.select("kept.*")
