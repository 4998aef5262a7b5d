"""Rules over client batches: size 1..1000, all-or-nothing, outcome per batch.

Batch mode only: a verdict on a batch needs all of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetally.schema import BATCH_MAX
from pulsetally.session import shared_dir

# Outcomes of a batch and the text of its error.
SUCCESS, PARTIAL, ERROR = "success", "partial", "error"
ERROR_TEXT = "%d events failed to publish."

# The largest oversized batches leave by a broadcast join before the shuffle.
# This many ids are broadcast at most, whatever the data holds; no batch left
# after that has more than rows/GIANTS_MAX rows.
GIANTS_MAX = 100_000
VERDICT = "row_is_valid"


def batch_sizes(checked: DataFrame, valid: Column, batch: str = "batch_id") -> DataFrame:
    """Rows, valid rows and size verdict per batch."""
    return checked.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(valid).alias("valid_events"),
    ).withColumn("size_ok", F.col("total_events").between(1, BATCH_MAX))


def atomic_batches(
    checked: DataFrame, valid: Column, batch: str = "batch_id", giants_max: int = GIANTS_MAX
) -> DataFrame:
    """Rows of the batches in which every row is valid and the size is allowed.

    Rows without a batch id are single events and stand for themselves.
    The rows are written once to the shared folder with their verdict, so that they are
    parsed once although sizes, kept rows and singles are read apart, and sizes read two
    columns only. A batch may hold any share of the rows: sizes are counted with map-side
    aggregation, and the largest oversized batches are removed by a broadcast
    of bounded size. The semi join, the one exchange of rows, stays exact for all others.
    """
    folder = shared_dir(checked.sparkSession, "batch-rows")
    checked.withColumn(VERDICT, F.coalesce(valid, F.lit(False))).write.parquet(folder)
    rows = checked.sparkSession.read.parquet(folder)
    in_batch = rows.where(F.col(batch).isNotNull())
    sizes = batch_sizes(in_batch, F.col(VERDICT), batch)
    # Sorting by both counts keeps this aggregate equal to the one below, so
    # Spark computes it once and reuses the exchange.
    giants = (
        sizes.where(F.col("total_events") > BATCH_MAX)
        .orderBy(F.desc("total_events"), "valid_events", batch)
        .limit(giants_max)
        .select(batch)
    )
    whole = sizes.where(
        F.col("size_ok") & (F.col("valid_events") == F.col("total_events"))
    ).select(batch)
    kept = in_batch.join(F.broadcast(giants), batch, "left_anti").join(whole, batch, "left_semi")
    singles = rows.where(F.col(batch).isNull() & F.col(VERDICT))
    return kept.unionByName(singles).select(*checked.columns)


def batch_outcome(rows: DataFrame, ok: Column, batch: str = "batch_id") -> DataFrame:
    """Per batch: total, successful and failed rows, status and error text.

    A batch beyond the size limit fails as a whole, as in ``atomic_batches``. Rows
    without a batch id are single events and have no outcome here.
    """
    return outcome_of(batch_counts(rows, ok, batch))


def batch_counts(rows: DataFrame, ok: Column, batch: str = "batch_id") -> DataFrame:
    """Rows and good rows per batch, which add up over parts of the rows."""
    good = F.coalesce(ok, F.lit(False))
    counts = [F.count(F.lit(1)).alias("total_events"), F.count_if(good).alias("good")]
    return rows.where(F.col(batch).isNotNull()).groupBy(batch).agg(*counts)


def outcome_of(counts: DataFrame) -> DataFrame:
    """Outcomes from the whole counts of batches."""
    total, failed = F.col("total_events"), F.col("failed")
    return (
        counts.withColumn("successful", F.when(total > BATCH_MAX, 0).otherwise(F.col("good")))
        .withColumn("failed", total - F.col("successful"))
        .drop("good")
        .withColumn(
            "status",
            F.when(failed == 0, SUCCESS)
            .when(F.col("successful") == 0, ERROR)
            .otherwise(PARTIAL),
        )
        .withColumn(
            "errors",
            F.when(failed == 0, F.array().cast("array<string>")).otherwise(
                F.array(F.format_string(ERROR_TEXT, failed))
            ),
        )
    )
