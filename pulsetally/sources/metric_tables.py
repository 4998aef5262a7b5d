"""Metric tables as a source: Parquet folders or a JDBC database."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsetally.functions.time import hours_before
from pulsetally.schema import METRIC_TABLES, TABLE_SCHEMAS
from pulsetally.sources.folders import DATE, read_dates

RUN, BATCH_ID = "run", "batch_id"


def table_name(time_window: str) -> str:
    """Metric table of a granularity; unknown names give the 5-minute table."""
    return METRIC_TABLES.get(time_window, METRIC_TABLES["5min"])


def pick_table(tables: dict[str, DataFrame], time_window: str) -> DataFrame:
    """The frame of a granularity; unknown names give the 5-minute frame."""
    return tables[time_window if time_window in METRIC_TABLES else "5min"]


def read_parquet(
    spark: SparkSession,
    path: str,
    hours_back: int | None = None,
    as_of: datetime | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A metric table of all its writers; ``hours_back`` prunes its dates too.

    The schema follows from the table's name, the last part of ``path``, if not given.
    """
    schema = schema or TABLE_SCHEMAS[path.rstrip("/").rpartition("/")[2]]
    if hours_back is None:
        return read_dates(spark, path, schema)
    since = hours_before(hours_back, as_of)
    recent = read_dates(spark, path, schema, F.col(DATE) >= since.cast("date"))
    return recent.where(F.col("window_start") >= since)


def newest_per_key(metrics: DataFrame, key: tuple[str, ...], version: str = BATCH_ID) -> DataFrame:
    """Per natural key the row of the newest batch, for tables with replays or updates.

    With a ``run`` column the later run counts first: batch numbers start anew in each.
    An aggregate, so versions of one key already combine on the map side.
    """
    values = [c for c in metrics.columns if c not in key]
    order = F.col(version)
    if version == BATCH_ID and RUN in metrics.columns:
        order = F.struct(F.col(RUN).cast("string"), order)
    newest = F.max_by(F.struct(*values), order).alias("newest")
    return metrics.groupBy(*key).agg(newest).select(*key, "newest.*").select(*metrics.columns)


@dataclass(frozen=True)
class JdbcSettings:
    """One database. ``partitions`` bounds the connections opened at a time."""

    url: str
    driver: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    partitions: int = 8
    batch_rows: int = 10_000
    fetch_rows: int = 10_000

    def options(self) -> dict[str, str]:
        given = {
            "url": self.url,
            "driver": self.driver,
            "user": self.user,
            "password": self.password,
            "fetchsize": str(self.fetch_rows),
        }
        return {k: v for k, v in given.items() if v is not None}


def jdbc_options(
    jdbc: JdbcSettings,
    table: str,
    lower: datetime | None = None,
    upper: datetime | None = None,
) -> dict[str, str]:
    """Reader options; with bounds the table is read in ``partitions`` time slices."""
    options = jdbc.options() | {"dbtable": table}
    if lower is not None and upper is not None:
        options |= {
            "partitionColumn": "window_start",
            "lowerBound": lower.strftime("%Y-%m-%d %H:%M:%S"),
            "upperBound": upper.strftime("%Y-%m-%d %H:%M:%S"),
            "numPartitions": str(jdbc.partitions),
        }
    return options


def read_jdbc(
    spark: SparkSession,
    jdbc: JdbcSettings,
    table: str,
    lower: datetime | None = None,
    upper: datetime | None = None,
) -> DataFrame:
    """A metric table in a database. Filters on its columns are pushed down."""
    return spark.read.format("jdbc").options(**jdbc_options(jdbc, table, lower, upper)).load()


def first_row(rows: DataFrame) -> Row | None:
    """The first row of a result, or None."""
    return rows.first()
