from datetime import datetime
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from helpers import rows
from pulsetally.operators import metrics as m
from pulsetally.plans import reports
from pulsetally.plans.queries import all_queries

AS_OF = "2024-01-31 00:00:00"
NOW = datetime(2024, 1, 15, 12)


@pytest.fixture(scope="module")
def seed_events(spark):
    data = [("share", "web", 120, 70), ("share", "ios", 180, 95), ("click", "web", 40, 33), ("comment", "android", 460, 210)]
    return _metrics(spark, [("2024-01-15 11:55:00", *r) for r in data])


def _metrics(spark, data):
    frame = spark.createDataFrame(
        data, "ws string, event_type string, platform string, event_count long, unique_users long"
    )
    start = F.to_timestamp("ws")
    return frame.select(
        start.alias("window_start"),
        (start + F.expr("interval 5 minutes")).alias("window_end"),
        "event_type", "platform", "event_count", "unique_users",
    )


@pytest.fixture(scope="module")
def seed_users(spark):
    data = [
        ("marta", "web", 41, 11, 9, 6, 10, 5),
        ("ines", "ios", 73, 33, 10, 7, 19, 4),
        ("otto", "android", 29, 9, 4, 5, 8, 3),
    ]
    frame = spark.createDataFrame(
        data, "user_id string, platform string, total_events long, likes long, comments long, shares long, views long, clicks long"
    )
    return frame.withColumns({
        "window_start": F.lit("2024-01-15 11:00:00").cast("timestamp"),
        "window_end": F.lit("2024-01-15 12:00:00").cast("timestamp"),
    })


def test_distribution(seed_events):
    got = reports.event_distribution_report(seed_events, 24, NOW).collect()
    assert [tuple(r) for r in got] == [("comment", 460, 57.5), ("share", 300, 37.5), ("click", 40, 5.0)]


def test_distribution_of_nothing_and_zero(spark, seed_events):
    assert reports.event_distribution_report(seed_events, 1, "2024-02-15 12:00:00").collect() == []
    zero = _metrics(spark, [("2024-01-15 11:55:00", "like", "web", 0, 0)])
    assert rows(reports.event_distribution_report(zero, 1, NOW)) == [("like", 0, 0.0)]


def test_share_rounds_half_to_even(spark):
    data = [(x, 20_000) for x in range(0, 200)] + [(1, 3), (2, 3), (7, 9), (10**18, 3 * 10**18)]
    frame = spark.createDataFrame(data, "x long, total long")
    got = frame.select("x", "total", reports.share(F.col("x"), F.col("total")).alias("p")).collect()
    for r in got:
        exact = Decimal(r.x) / Decimal(r.total) * 100
        assert r.p == float(exact.quantize(Decimal("0.01"), ROUND_HALF_EVEN))


def test_platforms(seed_events):
    got = [tuple(r) for r in reports.platform_metrics_report(seed_events, 24, NOW).collect()]
    assert got == [("android", 460, 210), ("ios", 180, 95), ("web", 160, 103)]


def test_top_users(seed_users):
    got = [tuple(r) for r in reports.top_users_report(seed_users, 24, 2, NOW).collect()]
    assert got == [("ines", "ios", 73, 1), ("marta", "web", 41, 2)]


def test_top_users_ties_and_collation(spark, seed_users):
    more = seed_users.unionByName(seed_users.withColumn("user_id", F.initcap("user_id")))
    exact = reports.top_users_report(more, 24, 10, NOW).collect()
    assert [r["rank"] for r in exact] == [1, 2, 3, 4, 5, 6]
    merged = reports.top_users_report(more, 24, 10, NOW, collation="UNICODE_CI_AI").collect()
    assert [r.total_events for r in merged] == [146, 82, 58]


def test_event_report_filters_order_and_limit(spark):
    metrics = _metrics(spark, [
        ("2024-01-15 11:50:00", "like", "web", 1, 1),
        ("2024-01-15 11:55:00", "view", "web", 2, 1),
        ("2024-01-15 11:55:00", "like", "ios", 3, 1),
        ("2024-01-15 11:55:00", "like", "web", 4, 1),
        ("2024-01-15 10:59:59", "like", "web", 5, 1),
        ("2024-01-15 11:00:00", "like", "web", 6, 1),
    ])
    tables = {"5min": metrics, "1hr": metrics.limit(0)}
    def counts(**kw):
        return [r.event_count for r in reports.event_metrics_report(tables, as_of=NOW, **kw).collect()]
    assert counts() == [3, 4, 2, 1, 6]
    assert counts(hours_back=2) == [3, 4, 2, 1, 6, 5]
    assert counts(event_type="like") == [3, 4, 1, 6]
    assert counts(event_type="like", platform="web") == [4, 1, 6]
    assert counts(event_type="", platform=None, limit=2) == [3, 4]
    assert counts(time_window="1hr") == []
    assert counts(time_window="other") == [3, 4, 2, 1, 6]


def test_user_report(seed_users):
    got = reports.user_metrics_report(seed_users, 1, as_of=NOW).collect()
    assert [r.user_id for r in got] == ["ines", "marta", "otto"]
    got = reports.user_metrics_report(seed_users, 1, user_id="marta", as_of=NOW).collect()
    assert [(r.likes, r.clicks) for r in got] == [(11, 5)]
    assert reports.user_metrics_report(seed_users, 1, user_id="MARTA", as_of=NOW).count() == 0
    loose = reports.user_metrics_report(seed_users, 1, user_id="MARTA", as_of=NOW, collation="UNICODE_CI_AI")
    assert loose.count() == 1
    assert reports.user_metrics_report(seed_users, 1, platform="ios", as_of=NOW).count() == 1


def test_parameter_checks(seed_events, seed_users):
    bad = [
        lambda: reports.event_distribution_report(seed_events, 0),
        lambda: reports.event_distribution_report(seed_events, 169),
        lambda: reports.top_users_report(seed_users, limit=101),
        lambda: reports.top_users_report(seed_users, limit=0),
        lambda: reports.user_metrics_report(seed_users, limit=1001),
        lambda: reports.user_metrics_report(seed_users, platform="tv"),
        lambda: reports.event_metrics_report({"5min": seed_events}, event_type="signup"),
        lambda: reports.platform_metrics_report(seed_events, overlap="none"),
    ]
    for call in bad:
        with pytest.raises(ValueError):
            call()


def test_overlap_counts_events_once(events):
    sliding = m.event_metrics(events, m.FIVE_MINUTES, m.ONE_MINUTE)
    total = events.where(F.col("timestamp") >= "2024-01-30 00:00:00").count()
    def summed(overlap):
        report = reports.event_distribution_report(sliding, 24, AS_OF, overlap)
        return report.agg(F.sum("total_count")).first()[0]
    assert summed("tumbling") == total
    # Windows which reach over the start of the range are left out.
    assert 5 * total - 20 * 5 <= summed("literal") <= 5 * total


def test_report_from_recent_events_equals_report_from_table(events):
    table = m.event_metrics(events, m.FIVE_MINUTES, m.ONE_MINUTE)
    pushed = m.event_metrics(
        reports.recent_events(events, 48, AS_OF), m.FIVE_MINUTES, m.ONE_MINUTE
    )
    for report in (reports.event_distribution_report, reports.platform_metrics_report):
        assert report(table, 48, AS_OF).collect() == report(pushed, 48, AS_OF).collect()


def test_platform_users(events):
    exact = reports.platform_users_exact(events, 168, AS_OF).collect()
    sketches = m.event_metrics(events, m.FIVE_MINUTES, uniques="sketch")
    assert reports.platform_users_report(sketches, 168, AS_OF).collect() == exact


def test_labels_and_counts(seed_events):
    report = reports.with_time_range(reports.platform_metrics_report(seed_events, 24, NOW), 24)
    assert {r.time_range for r in report.collect()} == {"Last 24 hours"}
    assert reports.record_count(report) == 3


def test_top_k_plan(seed_users):
    plan = reports.top_users_report(seed_users, 24, 10, NOW)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_estimates_against_exact_counts(spark):
    columns = "platform string, total_events long, unique_users long"
    estimates = spark.createDataFrame([("web", 90, 42), ("ios", 80, 43), (None, 70, 19), ("android", 60, 0)], columns)
    exact = spark.createDataFrame([("web", 90, 40), ("ios", 80, 40), (None, 70, 20), ("android", 60, 0)], columns)
    got = reports.against_exact(estimates, exact, 5)
    assert got.columns == ["platform", "total_events", "unique_users", "exact_users", "within_5_percent"]
    assert [tuple(r) for r in got.collect()] == [
        ("web", 90, 42, 40, True), ("ios", 80, 43, 40, False), (None, 70, 19, 20, True), ("android", 60, 0, 0, True),
    ]


def test_sketch_query_holds_the_exact_counts(spark, table):
    query = all_queries()
    exact = query["report_platform_metrics_exact"](spark, str(DATA)).collect()
    found = query["report_platform_metrics_sketch"](spark, str(DATA)).collect()
    assert [(r.platform, r.total_events, r.exact_users) for r in found] == [tuple(r) for r in exact]
    assert all(r.within_5_percent for r in found)
