"""Top users over the last days, kept by adding the newest day and taking the oldest away.

``store_days`` keeps totals by day, user and platform. ``roll`` makes the totals of the
days up to one date from those of the date before: plus the totals of the new day, minus
those of the day that leaves. A step reads one folder of totals and two days, however many
days are summed up. Steps are written by date and a repeated one replaces its folder, so
a crash leaves nothing half done. A day that changes later is stored again and rolled
again; totals of other days are not touched.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsetally.plans.reports import TOP_USERS_MAX
from pulsetally.sources.folders import existing, finished, remove

KEY = ("user_id", "platform")
TOTAL, DAY = "total_events", "day"
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in KEY]).add(TOTAL, "long")


def _day_folder(path: str, day: date) -> str:
    return f"{path.rstrip('/')}/days/{DAY}={day}"


def _totals_folder(path: str, day: date) -> str:
    return f"{path.rstrip('/')}/totals/{DAY}={day}"


def _existing(spark: SparkSession, folder: str) -> DataFrame:
    found = existing(spark, folder, SCHEMA)
    return found if found is not None else spark.createDataFrame([], SCHEMA)


def store_days(user_metrics: DataFrame, path: str, days: list[date]) -> None:
    """Store the totals of ``days`` from a user metric table, in place of what was stored for them."""
    spark = user_metrics.sparkSession
    dated = user_metrics.withColumn(DAY, F.to_date("window_start")).where(F.col(DAY).isin(days))
    totals = dated.groupBy(DAY, *KEY).agg(F.sum(TOTAL).alias(TOTAL))
    for day in days:
        remove(spark, _day_folder(path, day))
    totals.write.mode("append").partitionBy(DAY).parquet(f"{path.rstrip('/')}/days")


def roll(spark: SparkSession, path: str, start: date, end: date, span: int = 7) -> None:
    """Totals over ``span`` days for each date from ``start`` to ``end``, both included.

    After a stored day has changed, roll again from it on. Without totals of the date
    before ``start`` the days of its range are summed up once.
    """
    day = start
    while day <= end:
        before, leaving = day - timedelta(days=1), day - timedelta(days=span)
        if finished(spark, _totals_folder(path, before)):
            minus = F.negate(F.col(TOTAL)).alias(TOTAL)
            parts = [
                _existing(spark, _totals_folder(path, before)),
                _existing(spark, _day_folder(path, day)),
                _existing(spark, _day_folder(path, leaving)).select(*KEY, minus),
            ]
        else:
            parts = [_existing(spark, _day_folder(path, day - timedelta(days=k))) for k in range(span)]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        summed = rows.groupBy(*KEY).agg(F.sum(TOTAL).alias(TOTAL)).where(F.col(TOTAL) != 0)
        summed.write.mode("overwrite").parquet(_totals_folder(path, day))
        day += timedelta(days=1)


def read_totals(spark: SparkSession, path: str, day: date) -> DataFrame:
    """Totals by user and platform of the days up to ``day``."""
    return _existing(spark, _totals_folder(path, day))


def top_users(spark: SparkSession, path: str, day: date, limit: int = 10) -> DataFrame:
    """The most active users of the days up to ``day``, with ranks."""
    if not 1 <= limit <= TOP_USERS_MAX:
        raise ValueError(f"limit must be between 1 and {TOP_USERS_MAX}, not {limit}")
    order = [F.desc(TOTAL), F.col("user_id"), F.col("platform")]
    top = read_totals(spark, path, day).orderBy(*order).limit(limit)
    # Ranks run over the at most 100 rows which are left.
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
