import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import event_frame, rows, same
from pulsetally.operators import metrics as m
from pulsetally.operators import rollup
from pulsetally.operators.projections import as_table, of_type, with_calendar
from pulsetally.schema import METRIC_SCHEMA, USER_METRIC_SCHEMA

SAMPLE = [
    ("s-a", "share", "mila", "2023-06-03 21:17:00"),
    ("s-b", "share", "juno", "2023-06-03 21:18:30"),
    ("s-c", "click", "mila", "2023-06-03 21:24:10"),
    ("s-d", "share", "juno", "2023-06-03 21:24:59"),
]


def random_events(spark, n=3000, users=40, seed=5):
    """Events around day borders and the epoch; one user has a third of them."""
    rng = random.Random(seed)
    bases = [datetime(2024, 1, 14, 22), datetime(1969, 12, 31, 22)]
    data = []
    for i in range(n):
        at = rng.choice(bases) + timedelta(microseconds=rng.randrange(4 * 3600 * 10**6))
        user = None if rng.random() < 0.02 else "u0" if rng.random() < 0.33 else f"u{rng.randrange(users)}"
        kind = rng.choice(["like", "view", "click", "share", "comment"])
        data.append((str(i), kind, user, at.isoformat(), rng.choice(["web", "ios"])))
    data += [("n1", "like", "u1", None, "web"), ("n2", None, "u1", "2024-01-15 00:30:00", None)]
    return data, event_frame(spark, data)


def brute_force(data, window, slide):
    """Window counts by the definition, one event at a time."""
    epoch = datetime(1970, 1, 1)
    count, users = defaultdict(int), defaultdict(set)
    for _, kind, user, at, platform in data:
        if at is None:
            continue
        at = datetime.fromisoformat(at)
        start = epoch + (at - epoch) // slide * slide
        while start + window > at:
            key = (start, start + window, kind, platform)
            count[key] += 1
            users[key] |= {user} - {None}
            start -= slide
    return sorted(((*k, count[k], len(users[k])) for k in count), key=repr)


@pytest.mark.parametrize(
    "window,slide",
    [(5, 1), (5, 5), (60, 60), (1440, 1440), (60, 20), (64, 2), (80, 2)],
)
def test_exact_metrics_against_brute_force(spark, window, slide):
    data, events = random_events(spark)
    window, slide = timedelta(minutes=window), timedelta(minutes=slide)
    assert rows(m.event_metrics(events, window, slide)) == brute_force(data, window, slide)


def test_mergeable_metrics_count_alike(spark):
    data, events = random_events(spark)
    want = brute_force(data, m.FIVE_MINUTES, m.ONE_MINUTE)
    sliding = m.event_metrics(events, m.FIVE_MINUTES, m.ONE_MINUTE, "approx")
    # Sets this small are exact in a sketch.
    assert rows(sliding) == want
    coded = m.event_metrics(events, m.FIVE_MINUTES, m.ONE_MINUTE, "as_coded")
    assert rows(coded) == [(*r[:4], r[4], r[4]) for r in want]


def test_slide_must_divide(events):
    with pytest.raises(ValueError):
        m.event_metrics(events, timedelta(minutes=5), timedelta(minutes=2))


def test_rollup_tables_equal_direct_ones(spark, tmp_path):
    data, events = random_events(spark, seed=9)
    rollup.write_intermediates(events, str(tmp_path / "parts"))
    tables = rollup.metric_tables(spark, str(tmp_path / "parts"))
    assert rows(tables["5min"]) == brute_force(data, m.FIVE_MINUTES, m.ONE_MINUTE)
    assert rows(tables["1hr"]) == brute_force(data, m.ONE_HOUR, m.ONE_HOUR)
    assert rows(tables["1day"]) == brute_force(data, m.ONE_DAY, m.ONE_DAY)


def test_user_metrics(spark):
    data = [
        ("1", "like", "a", "2024-01-15 10:00:00"),
        ("2", "like", "a", "2024-01-15 10:59:59.999999"),
        ("3", "view", "a", "2024-01-15 10:10:00"),
        ("4", "other", "a", "2024-01-15 10:10:00"),
        ("5", "click", "a", "2024-01-15 11:00:00"),
        ("6", "share", "b", "2024-01-15 11:00:00"),
        ("7", "comment", "b", "2024-01-15 11:00:00", "ios"),
    ]
    events = event_frame(spark, data)
    ten, eleven, noon = (datetime(2024, 1, 15, h) for h in (10, 11, 12))
    assert rows(m.user_metrics(events)) == [
        (ten, eleven, "a", "web", 4, 2, 0, 0, 1, 0),
        (eleven, noon, "a", "web", 1, 0, 0, 0, 0, 1),
        (eleven, noon, "b", "ios", 1, 0, 1, 0, 0, 0),
        (eleven, noon, "b", "web", 1, 0, 0, 1, 0, 0),
    ]
    coded = m.user_metrics(events, as_coded=True)
    assert all(set(r[5:]) == {r[4]} for r in coded.collect())


def test_window_type_counts(spark):
    got = rows(m.events_per_window_type(event_frame(spark, SAMPLE)), "window_start", "event_type", "event_count")
    first, second = datetime(2023, 6, 3, 21, 15), datetime(2023, 6, 3, 21, 20)
    assert got == sorted([(first, "share", 2), (second, "click", 1), (second, "share", 1)], key=repr)


def test_filter_and_per_user_counts(spark):
    data = [
        ("f-1", "click", "pia", "2023-11-30 23:59:00"),
        ("f-2", "share", "pia", "2023-12-01 00:00:00"),
        ("f-3", "click", "tom", "2023-12-01 00:00:01"),
        ("f-4", "click", "pia", "2023-12-01 00:02:00"),
    ]
    events = event_frame(spark, data)
    assert of_type(events, "click").count() == 3
    assert rows(m.events_per_user(events)) == [("pia", 3), ("tom", 1)]


def test_calendar(spark):
    got = with_calendar(event_frame(spark, [("1", "like", "a", "2024-02-29 23:59:59")])).first()
    assert (got.year, got.month, got.day, got.hour) == (2024, 2, 29, 23)


def test_as_table_fills_defaults(spark):
    events = event_frame(spark, SAMPLE)
    table = as_table(m.event_metrics(events).drop("unique_users"), METRIC_SCHEMA)
    assert table.columns == METRIC_SCHEMA.names
    assert {r.unique_users for r in table.collect()} == {0}
    assert table.where("computed_at is null").count() == 0
    assert as_table(m.user_metrics(events), USER_METRIC_SCHEMA).columns == USER_METRIC_SCHEMA.names


def test_merged_sketches(spark):
    data, events = random_events(spark)
    tumbling = m.event_metrics(events, m.FIVE_MINUTES, uniques="sketch")
    merged = m.merge_user_sketches(tumbling, "platform")
    exact = events.where("timestamp is not null").groupBy("platform").agg(
        F.count(F.lit(1)).alias("total_events"), F.count_distinct("user_id").alias("unique_users")
    )
    assert same(merged, exact)


def test_sliding_plan_scans_once_per_part_and_copies_no_events(events):
    plan = m.event_metrics(events, m.FIVE_MINUTES, m.ONE_MINUTE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    assert "Expand" not in plan and "CartesianProduct" not in plan and "Join" not in plan
    assert "props" not in plan.split("ReadSchema", 1)[1].split("\n", 1)[0]
