"""Look into the state of a streaming query: windows that are still open.

Spark's ``statestore`` source reads a checkpoint as a table, also while the query runs:
the state after its last complete micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsetally.operators.projections import flat_window
from pulsetally.schema import USER_COUNTERS


def read_state(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """Keys and values of one stateful operator; 0 is the one next to the sink."""
    return spark.read.format("statestore").option("operatorId", operator).load(checkpoint)


def state_operators(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful operators of a query, their width and the batches their state is kept for."""
    return spark.read.format("state-metadata").load(checkpoint).select(
        "operatorId", "operatorName", "numPartitions", "minBatchId", "maxBatchId"
    )


def open_user_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """User metrics of the windows that ``user_metric_stream`` has not emitted yet, as counted so far."""
    keys = ["window", "user_id", "platform"]
    counts = ["total_events", *USER_COUNTERS]
    # Values have Spark's names for buffers, several of one name: taken by position.
    state = read_state(spark, checkpoint)
    by_place = ", ".join(counts)
    rows = state.selectExpr("inline(array(key)) AS (" + ", ".join(keys) + ")", "value")
    rows = rows.selectExpr(*keys, f"inline(array(value)) AS ({by_place})")
    return rows.select(*flat_window(), *keys[1:], *counts)
