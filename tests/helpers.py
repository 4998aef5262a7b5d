"""Small helpers for exact comparisons."""

from collections import Counter
from datetime import datetime, timezone

from pyspark.sql import functions as F


def rows(df, *columns):
    """All rows as a sorted list of tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def same(left, right):
    """Both frames hold the same rows, counted."""
    assert left.columns == right.columns
    return Counter(map(tuple, left.collect())) == Counter(map(tuple, right.collect()))


def utc(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def event_frame(spark, data, platform="web"):
    """Events from (event_id, event_type, user_id, time[, platform]) tuples."""
    filled = [(*row, platform) if len(row) == 4 else row for row in data]
    frame = spark.createDataFrame(
        filled, "event_id string, event_type string, user_id string, ts string, platform string"
    )
    return frame.withColumn("timestamp", F.to_timestamp("ts")).drop("ts")


def payloads(spark, texts):
    """Broker-shaped records from JSON texts."""
    data = [(t, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "value string, offset long").select(
        F.lit(None).cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit("events").alias("topic"),
        F.lit(0).alias("partition"),
        "offset",
        F.lit("2024-01-15 12:00:00").cast("timestamp").alias("timestamp"),
    )
