"""Outcomes of client batches and counts of reasons over a stream, from parts of micro-batches.

The rows of a client batch may come in several micro-batches. A part has, for the rows of
one micro-batch, rows and good rows by client batch and by reason. Parts add up, and each
micro-batch has its part once (``sinks/micro.py``), so replays change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsetally.operators.batches import outcome_of
from pulsetally.operators.validate import REASONS
from pulsetally.plans.landing import ACCEPTED
from pulsetally.sinks.micro import pack
from pulsetally.sources.folders import read_micro, united

# A record's client batch; in parts it has another name, as micro-batches have their folder by that one.
BATCH_ID, CLIENT_BATCH = "batch_id", "client_batch"
SCHEMA = T.StructType([T.StructField(CLIENT_BATCH, T.StringType()), T.StructField("reason", T.StringType())])
SCHEMA = SCHEMA.add("total_events", "long").add("good", "long")


def part_of(rows: DataFrame) -> DataFrame:
    """Counts of a micro-batch's landing rows: by client batch, and by reason.

    Rows without client batch have no outcome; rows with several reasons count for each.
    """
    batch = F.col(BATCH_ID).cast("string") if BATCH_ID in rows.columns else F.lit(None).cast("string")
    nothing = F.lit(None).cast("string")
    by_batch = F.struct(batch.alias(CLIENT_BATCH), nothing.alias("reason"))
    by_reason = F.transform(REASONS, lambda r: F.struct(nothing.alias(CLIENT_BATCH), r.alias("reason")))
    accepted = F.struct(nothing.alias(CLIENT_BATCH), F.lit("").alias("reason"))
    keys = F.concat(F.array(by_batch), F.when(F.col(ACCEPTED), F.array(accepted)).otherwise(by_reason))
    keyed = rows.select(ACCEPTED, F.inline(keys)).where(F.col(CLIENT_BATCH).isNotNull() | F.col("reason").isNotNull())
    return keyed.groupBy(CLIENT_BATCH, "reason").agg(
        F.count(F.lit(1)).alias("total_events"), F.count_if(F.col(ACCEPTED)).alias("good")
    )


def merged(parts: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("total_events", "good")]
    return parts.groupBy(CLIENT_BATCH, "reason").agg(*sums).select(*SCHEMA.names)


def _read(spark: SparkSession, path: str) -> DataFrame:
    return merged(united(spark, read_micro(spark, path, SCHEMA), SCHEMA))


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Outcome of every client batch over all that has come of it."""
    counts = _read(spark, path).where(F.col(CLIENT_BATCH).isNotNull()).drop("reason")
    return outcome_of(counts.withColumnRenamed(CLIENT_BATCH, BATCH_ID))


def read_reasons(spark: SparkSession, path: str) -> DataFrame:
    """Records by reason; accepted ones have the empty reason."""
    counts = _read(spark, path).where(F.col("reason").isNotNull())
    return counts.select("reason", F.col("total_events").alias("records"))


def pack_outcomes(spark: SparkSession, path: str, keep_files: bool = False) -> int | None:
    """Merge the parts of complete micro-batches into one."""
    return pack(spark, path, SCHEMA, (), merged, keep_files=keep_files)
