"""Schemas, closed domains and limits of the event data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Closed domains, field limits and column lists of the data model.
EVENT_TYPES = ("click", "like", "comment", "share", "view")
PLATFORMS = ("web", "ios", "android", "mobile_web")
USER_ID_MAX = 100
CONTENT_ID_MAX = 100
SESSION_ID_MAX = 100
DEVICE_TYPE_MAX = 50
LOCATION_MAX = 100
METADATA_MAX = 1000
BATCH_MAX = 1000

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("content_id", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
EVENT_COLUMNS = tuple(EVENT_SCHEMA.names)

METRIC_SCHEMA = T.StructType(
    [
        T.StructField("window_start", T.TimestampType(), False),
        T.StructField("window_end", T.TimestampType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("platform", T.StringType(), False),
        T.StructField("event_count", T.LongType(), False),
        T.StructField("unique_users", T.LongType(), False),
        T.StructField("computed_at", T.TimestampType(), False),
    ]
)

USER_METRIC_SCHEMA = T.StructType(
    [
        T.StructField("window_start", T.TimestampType(), False),
        T.StructField("window_end", T.TimestampType(), False),
        T.StructField("user_id", T.StringType(), False),
        T.StructField("platform", T.StringType(), False),
        T.StructField("total_events", T.LongType(), False),
        T.StructField("likes", T.LongType(), False),
        T.StructField("comments", T.LongType(), False),
        T.StructField("shares", T.LongType(), False),
        T.StructField("views", T.LongType(), False),
        T.StructField("clicks", T.LongType(), False),
        T.StructField("computed_at", T.TimestampType(), False),
    ]
)

# Hourly counts with the users as a sketch, so that distinct users add up over any range.
SKETCH_SCHEMA = T.StructType(
    [
        T.StructField("window_start", T.TimestampType(), False),
        T.StructField("window_end", T.TimestampType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("platform", T.StringType(), False),
        T.StructField("event_count", T.LongType(), False),
        T.StructField("users_sketch", T.BinaryType()),
        T.StructField("computed_at", T.TimestampType(), False),
    ]
)

# Counter column -> event type it counts.
USER_COUNTERS = {
    "likes": "like",
    "comments": "comment",
    "shares": "share",
    "views": "view",
    "clicks": "click",
}

METRIC_KEY = ("window_start", "event_type", "platform")
USER_METRIC_KEY = ("window_start", "user_id", "platform")
LAKE_PARTITIONS = ("year", "month", "day", "hour")

# Granularity name -> metric table name.
METRIC_TABLES = {
    "5min": "event_metrics_5min",
    "1hr": "event_metrics_1hr",
    "1day": "event_metrics_1day",
}
USER_METRIC_TABLE = "user_metrics_1hr"
SKETCH_TABLE = "user_sketches_1hr"

TABLE_SCHEMAS = {
    **{name: METRIC_SCHEMA for name in METRIC_TABLES.values()},
    USER_METRIC_TABLE: USER_METRIC_SCHEMA,
    SKETCH_TABLE: SKETCH_SCHEMA,
}
