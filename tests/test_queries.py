"""Every registered query against its SQL on the small tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_queries import compare, connect
from conftest import DATA
from pulsetally.plans import queries
from pulsetally.plans.queries import all_queries

SQL = entry.oracle_sql()
NAMES = list(all_queries())


@pytest.fixture(scope="module")
def db(table):
    return connect(str(DATA))


def test_every_query_has_sql():
    assert set(NAMES) <= set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    problem, count = compare(spark, db, entry.queries()[name], SQL[name], str(DATA))
    assert problem is None
    assert count > 0


def test_records_are_dealt_over_all_cores(spark, events):
    records = queries._records(events.coalesce(1))
    sizes = [r["count"] for r in records.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 0.2 * sum(sizes)


def test_entry(spark, table):
    frame = entry.entry(spark)
    assert frame.columns == ["event_type", "total_count", "percentage"]
    assert abs(sum(r.percentage for r in frame.collect()) - 100) < 0.05
