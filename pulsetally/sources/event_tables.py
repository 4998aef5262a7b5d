"""Table events(event_id, ts, user_id, event_type, value, props) as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsetally.functions import text
from pulsetally.schema import EVENT_COLUMNS, PLATFORMS

# `ts` is stored without a zone and means UTC. Declared as an instant it is read
# as UTC whatever the session's zone, and filters on it need no cast.
TABLE_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# Table event type -> event type of the model.
TYPE_NAMES = {"signup": "like", "purchase": "share", "error": "comment"}


def read_table(spark: SparkSession, folder: str) -> DataFrame:
    """The events table; its schema is declared, so no file is opened to infer it."""
    return spark.read.schema(TABLE_SCHEMA).parquet(f"{folder}/events.parquet")


def stream_table(
    spark: SparkSession, folder: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """The events table as a file stream, optionally bounded per micro-batch."""
    reader = spark.readStream.schema(TABLE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{folder}/events.parquet*")


def as_events(table: DataFrame, map_types: bool = True) -> DataFrame:
    """Map table rows to the event model, plus ``batch_id``.

    With ``map_types=False`` type names the model does not know stay as they
    are, for the validation rules to reject.
    """
    event_id, user_id = F.col("event_id"), F.col("user_id").cast("string")
    columns = {
        "event_id": event_id.cast("string"),
        "event_type": _model_type() if map_types else F.col("event_type"),
        "user_id": F.concat(F.lit("user_"), user_id),
        "content_id": F.concat(F.lit("content_"), (event_id % 1000).cast("string")),
        "platform": F.element_at(
            F.array(*[F.lit(p) for p in PLATFORMS]), (event_id % 4 + 1).cast("int")
        ),
        "timestamp": F.col("ts"),
        "session_id": F.concat_ws(
            "_", F.lit("sess"), user_id, F.dayofmonth("ts").cast("string")
        ),
        "device_type": F.concat(F.lit("dev_"), (event_id % 7).cast("string")),
        "location": F.when(
            event_id % 10 != 0, F.concat(F.lit("loc_"), (event_id % 9).cast("string"))
        ),
        "metadata": text.string_map(F.col("props")),
    }
    batch_id = F.floor(event_id / 100).alias("batch_id")
    return table.select(*[columns[c].alias(c) for c in EVENT_COLUMNS], batch_id)


def _model_type() -> Column:
    name = F.col("event_type")
    mapped = F.when(F.lit(False), name)
    for ours, model in TYPE_NAMES.items():
        mapped = mapped.when(name == ours, F.lit(model))
    return mapped.otherwise(name)
