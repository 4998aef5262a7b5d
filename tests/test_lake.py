import json
from datetime import datetime
from functools import partial

import pytest
from pyspark.sql import functions as F

from helpers import payloads, rows, same
from pulsetally.operators import metrics as m
from pulsetally.operators.decode import encode_events
from pulsetally.plans import landing, tables
from pulsetally.schema import METRIC_TABLES
from pulsetally.sinks import lake as sink
from pulsetally.sources import lake, metric_tables
from pulsetally.sources.event_tables import as_events

KEPT = ["event_id", "event_type", "user_id", "platform", "timestamp"]


@pytest.fixture(scope="module")
def lake_path(events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lake") / "events")
    sink.append_lake(events, path)
    return path


def test_round_trip(spark, events, lake_path):
    assert same(lake.read_lake(spark, lake_path).select(KEPT), events.select(KEPT))


@pytest.mark.parametrize(
    "start,end",
    [
        (datetime(2024, 1, 3, 4, 30), datetime(2024, 1, 5)),
        (datetime(2024, 1, 29, 23, 59), None),
        (None, datetime(2024, 1, 1, 0, 30)),
        (datetime(2023, 12, 31), datetime(2025, 1, 1)),
    ],
)
def test_pruned_read(spark, events, lake_path, start, end):
    got = lake.read_lake(spark, lake_path, start, end)
    want = events
    if start:
        want = want.where(F.col("timestamp") >= F.lit(start.isoformat()).cast("timestamp"))
    if end:
        want = want.where(F.col("timestamp") < F.lit(end.isoformat()).cast("timestamp"))
    assert want.count() > 0
    assert same(got.select(KEPT), want.select(KEPT))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan


def test_only_hours_in_range_are_read(spark, lake_path):
    day = lake.read_lake(spark, lake_path, datetime(2024, 1, 3), datetime(2024, 1, 4))
    files = day.select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("/year=2024/month=1/day=3/" in r.f for r in files)


def test_hot_hour_is_split_and_small_hours_share(spark, tmp_path):
    # One hour holds most rows: with a small target size it must become several
    # files, while no hour with few rows is cut up.
    hot = spark.range(0, 200_000, 1, 8).select(
        F.sha2(F.col("id").cast("string"), 256).alias("event_id"),
        F.when(F.col("id") % 4 == 0, F.lit("2024-01-15 11:00:00")).otherwise(F.lit("2024-01-15 10:00:00")).cast("timestamp").alias("timestamp"),
        *[F.lit("x").alias(c) for c in ("event_type", "user_id", "content_id", "platform", "session_id", "device_type", "location")],
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1MB")
    try:
        sink.append_lake(hot, str(tmp_path / "hot"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert spark.read.parquet(str(tmp_path / "hot")).count() == 200_000
    hour = {h: len(list((tmp_path / "hot/batch").glob(f"year=2024/month=1/day=15/hour={h}/*.parquet"))) for h in (10, 11)}
    assert hour[10] > 2 and hour[10] > hour[11]


def test_rows_without_time_stay_out(spark, events, tmp_path):
    some = events.limit(3).unionByName(events.limit(2).withColumn("timestamp", F.lit(None).cast("timestamp")))
    sink.append_lake(some, str(tmp_path / "l"))
    assert lake.read_lake(spark, str(tmp_path / "l")).count() == 3


def test_landing_splits_in_one_pass(spark, table, tmp_path):
    path = str(tmp_path / "landing")
    source = as_events(table, map_types=False)
    landing.append_landing(encode_events(source), path)
    known = F.col("event_type").isin("click", "view")
    assert same(landing.read_accepted(spark, path).select(KEPT), source.where(known).select(KEPT))
    rejected = landing.read_rejected(spark, path)
    assert rejected.count() == source.where(~known).count()
    assert rows(rejected.select("reasons").distinct()) == [(["event_type_unknown"],)]
    ids = rejected.select(F.col("raw_fields")["event_id"].alias("event_id"))
    assert same(ids, source.where(~known).select("event_id"))
    day = landing.read_accepted(spark, path, datetime(2024, 1, 3), datetime(2024, 1, 4))
    assert day.count() == source.where(known & (F.to_date("timestamp") == "2024-01-03")).count()
    plan = landing.landing_rows(encode_events(source))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_landing_of_broker_records(spark, tmp_path):
    good = {"event_type": "like", "user_id": " user_1 ", "platform": "web"}
    texts = [json.dumps(good), "{oops", json.dumps(good | {"platform": "tv"})]
    path = str(tmp_path / "landing")
    landing.append_landing(payloads(spark, texts), path)
    accepted = landing.read_accepted(spark, path).collect()
    assert [(r.user_id, r.metadata, str(r.timestamp)) for r in accepted] == [("user_1", {}, "2024-01-15 12:00:00")]
    rejected = {tuple(r.reasons): r for r in landing.read_rejected(spark, path).collect()}
    assert set(rejected) == {("payload_malformed",), ("platform_unknown",)}
    assert rejected[("payload_malformed",)].raw_fields["malformed"] == "{oops"
    assert rejected[("platform_unknown",)].day == 15


def test_metric_tables_by_day_equal_one_run(spark, events, lake_path, tmp_path):
    read = partial(lake.read_lake, spark, lake_path)
    whole, daily = str(tmp_path / "whole"), str(tmp_path / "daily")
    tables.build_metric_tables(spark, read, whole)
    bounds = [datetime(2024, 1, 1), datetime(2024, 1, 11), datetime(2024, 1, 12), datetime(2024, 2, 1)]
    for start, end in zip(bounds, bounds[1:]):
        tables.build_metric_tables(spark, read, daily, start, end)
    tables.build_metric_tables(spark, read, daily, bounds[1], bounds[2])  # a repeat changes nothing
    direct = {
        "event_metrics_1hr": m.event_metrics(events, m.ONE_HOUR),
        "event_metrics_1day": m.event_metrics(events, m.ONE_DAY),
        "event_metrics_5min": m.event_metrics(events, m.FIVE_MINUTES, m.ONE_MINUTE),
        "user_metrics_1hr": m.user_metrics(events),
    }
    for name, want in direct.items():
        first = F.col("window_start") >= "2024-01-01"
        got_whole = metric_tables.read_parquet(spark, f"{whole}/{name}").select(want.columns)
        got_daily = metric_tables.read_parquet(spark, f"{daily}/{name}").select(want.columns)
        assert same(got_whole, want), name
        assert same(got_daily, want.where(first)), name
    with pytest.raises(ValueError):
        tables.build_metric_tables(spark, read, daily, datetime(2024, 1, 1, 5))


def test_table_read_is_pruned(spark, events, lake_path, tmp_path):
    path = str(tmp_path / "tables")
    tables.build_metric_tables(spark, partial(lake.read_lake, spark, lake_path), path)
    recent = metric_tables.read_parquet(spark, f"{path}/event_metrics_1hr", 24, datetime(2024, 1, 31))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    filters = [part.split("]")[0] for part in plan.split("PartitionFilters: ")[1:]]
    assert any("window_date" in f and ">=" in f for f in filters)
    assert "GreaterThanOrEqual(window_start" in plan
    hours = m.event_metrics(events, m.ONE_HOUR).where(F.col("window_start") >= "2024-01-30")
    assert recent.count() == hours.count() > 0
    tables.refresh_top_users(metric_tables.read_parquet(spark, f"{path}/user_metrics_1hr"), f"{path}/top", 24, 5, "2024-01-31 00:00:00")
    assert spark.read.parquet(f"{path}/top").count() == 5


def test_granularity_names():
    assert [metric_tables.table_name(n) for n in ("5min", "1hr", "1day", "x")] == [
        *METRIC_TABLES.values(), "event_metrics_5min",
    ]
