"""Stored tables: user sketches, look-ups by key, rolling totals, outcomes of streams, open windows."""

import json
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import event_frame, payloads, rows, same
from pulsetally.config import StreamSettings
from pulsetally.operators import dedup, rollup
from pulsetally.operators import metrics as m
from pulsetally.plans import outcomes, reports, rolling
from pulsetally.schema import SKETCH_SCHEMA, USER_METRIC_SCHEMA
from pulsetally.sinks import lookup, micro
from pulsetally.sinks.metrics import replace_table
from pulsetally.sources import folders
from pulsetally.sources.folders import read_dates
from pulsetally.streaming import one_pass

AS_OF = "2024-01-16 00:00:00"


def test_stored_sketches_estimate_many_users(spark, tmp_path):
    # 30,000 users, each in three of the hours or four; one event has no user.
    ids = spark.range(100_000).withColumn("user", F.col("id") % 30_000)
    events = ids.select(
        F.concat(F.lit("u"), F.when(F.col("id") != 7, F.col("user"))).alias("user_id"),
        F.lit("view").alias("event_type"), F.lit("web").alias("platform"),
        F.timestamp_seconds(F.lit(1705312800) + F.floor(F.col("id") / 30_000) * 3600 + F.col("id") % 3000).alias("timestamp"),
    )
    folder = str(tmp_path / "parts")
    rollup.write_intermediates(events, folder)
    sketches = rollup.hourly_sketches(spark, folder)
    replace_table(sketches, str(tmp_path / "t"), SKETCH_SCHEMA)
    stored = read_dates(spark, str(tmp_path / "t"), SKETCH_SCHEMA)
    assert stored.count() == 4 and stored.agg(F.sum("event_count")).first()[0] == 100_000
    report = reports.platform_users_report(stored, 24, AS_OF).first()
    exact = reports.platform_users_exact(events, 24, AS_OF).first()
    assert report.total_events == exact.total_events == 100_000
    # Three standard errors of 2^14 registers.
    assert abs(report.unique_users - exact.unique_users) <= 3 * 0.0081 * exact.unique_users
    # Sums of hourly users are no estimate of the users of the day.
    assert stored.select(F.sum(F.hll_sketch_estimate("users_sketch"))).first()[0] > 1.5 * exact.unique_users


def test_sketches_of_hours_without_users(spark, tmp_path):
    events = event_frame(spark, [("1", "like", None, "2024-01-15 10:01:00"), ("2", "like", "a", "2024-01-15 11:01:00")])
    rollup.write_intermediates(events, str(tmp_path / "p"))
    sketches = rollup.hourly_sketches(spark, str(tmp_path / "p"))
    assert rows(sketches, "event_count", F.col("users_sketch").isNull()) == [(1, False), (1, True)]
    merged = m.merge_user_sketches(sketches, "platform").first()
    assert (merged.total_events, merged.unique_users) == (2, 1)


def _opened(frame):
    """Files and rows that the scan of a collected frame has read."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head().metrics()
    return scan.get("numFiles").get().value(), scan.get("numOutputRows").get().value()


def test_look_up_opens_one_bucket_and_skips_row_groups(spark, tmp_path):
    path = str(tmp_path / "lookup")
    ids = spark.range(60_000)
    metrics = ids.select(
        F.timestamp_seconds(F.lit(1705276800) + F.col("id") % 2 * 86400).alias("window_start"),
        F.timestamp_seconds(F.lit(1705280400) + F.col("id") % 2 * 86400).alias("window_end"),
        F.concat(F.lit("user_"), F.floor(F.col("id") / 2).cast("string")).alias("user_id"),
        F.lit("web").alias("platform"), F.lit(1).alias("total_events"),
    )
    options = {"parquet.block.size": 16 * 1024, "parquet.page.size": 1024, "parquet.block.size.row.check.min": 100,
               "parquet.page.size.row.check.min": 100}
    lookup.write_lookup(metrics, path, USER_METRIC_SCHEMA, buckets=4, **options)
    found = lookup.look_up(spark, path, USER_METRIC_SCHEMA, "user_777")
    assert rows(found, "user_id", "total_events", "likes") == [("user_777", 1, 0)] * 2
    files, read = _opened(lookup.look_up(spark, path, USER_METRIC_SCHEMA, "user_777"))
    assert files == 2  # a bucket of each of two dates, of eight files
    assert read < 15_000 / 4  # two files have some 15,000 rows
    one_day = lookup.look_up(spark, path, USER_METRIC_SCHEMA, "user_777", hours_back=24, as_of="2024-01-17 00:00:00")
    assert _opened(one_day)[0] == 1 and one_day.count() == 1
    # A value between those of a row group: its bloom filter says no.
    assert lookup.look_up(spark, path, USER_METRIC_SCHEMA, "user_777x").count() == 0
    # Written again, also with other buckets, dates are replaced or stand beside their like.
    lookup.write_lookup(metrics, path, USER_METRIC_SCHEMA, buckets=4, **options)
    assert lookup.look_up(spark, path, USER_METRIC_SCHEMA, "user_777").count() == 2


def _day_users(spark, data):
    return m.user_metrics(event_frame(spark, [(str(i), "like", user, f"2024-01-{day:02d} 10:00:00") for i, (user, day) in enumerate(data)]))


DATA = [("a", 1)] * 3 + [("b", 1)] * 2 + [("b", 2)] * 2 + [("c", 4)] + [("a", 5)] * 2 + [("c", 5)] * 2


def _expected(data, day, span):
    counts = Counter(user for user, on in data if day - span < on <= day)
    return sorted((user, "web", n) for user, n in counts.items())


def test_rolling_totals(spark, tmp_path):
    path, span = str(tmp_path / "r"), 3
    days = [date(2024, 1, d) for d in range(1, 7)]
    rolling.store_days(_day_users(spark, DATA), path, days)
    for _ in range(2):  # a repeated run gives the same
        rolling.roll(spark, path, days[0], days[-1], span)
    for day in days:
        assert rows(rolling.read_totals(spark, path, day)) == _expected(DATA, day.day, span), day
    # Day 2 is corrected after all were rolled: b has nothing there, d comes.
    later = [row for row in DATA if row[1] != 2] + [("d", 2)] * 9
    rolling.store_days(_day_users(spark, later), path, [days[1]])
    rolling.roll(spark, path, days[1], days[-1], span)
    for day in days:
        assert rows(rolling.read_totals(spark, path, day)) == _expected(later, day.day, span), day
    # A day that has become empty.
    rolling.store_days(_day_users(spark, later).where("false"), path, [days[4]])
    rolling.roll(spark, path, days[4], days[-1], span)
    assert rows(rolling.read_totals(spark, path, days[4])) == [("c", "web", 1)]
    top = rolling.top_users(spark, path, days[1], 2)
    assert rows(top) == [("a", "web", 3, 2), ("d", "web", 9, 1)]
    assert rolling.top_users(spark, path, days[-1] + timedelta(days=99)).count() == 0
    with pytest.raises(ValueError):
        rolling.top_users(spark, path, days[0], 0)


def test_a_step_that_failed_is_repeated(spark, tmp_path):
    path, days = str(tmp_path / "r"), [date(2024, 1, d) for d in range(1, 6)]
    rolling.store_days(_day_users(spark, DATA), path, days)
    rolling.roll(spark, path, days[0], days[1], 3)
    # The third step dies before its folder is complete; the fourth must not build on it.
    half = tmp_path / "r" / "totals" / "day=2024-01-03"
    half.mkdir()
    (half / "part-0.parquet").write_text("half")
    rolling.roll(spark, path, days[2], days[-1], 3)
    assert rows(rolling.read_totals(spark, path, days[-1])) == _expected(DATA, 5, 3)


def _records(spark, batches):
    texts = [json.dumps({"event_type": t, "user_id": "u", "platform": p}) for _, t, p in batches]
    names = spark.createDataFrame([(i, b) for i, (b, _, _) in enumerate(batches)], "offset long, batch_id string")
    return payloads(spark, texts).join(names, "offset")


def test_outcomes_over_micro_batches(spark, tmp_path):
    path = str(tmp_path / "o")
    write = one_pass.batch_writer(one_pass.sinks(StreamSettings("unused"), None, None, path), "r1")
    first = _records(spark, [("x", "like", "web"), ("x", "nope", "tv"), ("y", "view", "web"), (None, "nope", "web")])
    second = _records(spark, [("x", "like", "web"), ("z", "nope", "web"), (None, "view", "web")])
    for batch_id, batch in enumerate((first, second)):
        for _ in range(2):  # a repeated micro-batch counts once
            write(batch, batch_id)

    def check():
        got = outcomes.read_outcomes(spark, path)
        assert rows(got, "batch_id", "total_events", "successful", "failed", "status") == [
            ("x", 3, 2, 1, "partial"), ("y", 1, 1, 0, "success"), ("z", 1, 0, 1, "error")]
        assert rows(outcomes.read_reasons(spark, path)) == [("", 4), ("event_type_unknown", 3), ("platform_unknown", 1)]

    check()
    outcomes.pack_outcomes(spark, path)
    check()
    write(_records(spark, [("y", "view", "web")] * 1000), 2)
    late = outcomes.read_outcomes(spark, path).where("batch_id = 'y'")
    assert rows(late, "total_events", "successful", "status") == [(1001, 0, "error")]


def test_outcomes_alone_make_only_what_they_count(spark, tmp_path, monkeypatch):
    plans, real = [], micro.write_partitioned
    monkeypatch.setattr(micro, "write_partitioned", lambda r, *a, **k: (plans.append(r._jdf.queryExecution().toString()), real(r, *a, **k)))
    path = str(tmp_path / "o")
    write = one_pass.batch_writer(one_pass.sinks(StreamSettings("unused"), None, None, path), "r1")
    write(_records(spark, [("x", "like", "web"), ("x", "nope", "web")]), 0)
    optimized = plans[0].split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    # Nothing is cached, the parser stands once, and no raw fields or ids are made.
    assert "InMemoryRelation" not in optimized and optimized.count("from_json(StructField") == 1
    assert "sha2" not in optimized and "raw_fields" not in optimized
    assert rows(outcomes.read_reasons(spark, path)) == [("", 1), ("event_type_unknown", 1)]


def test_outcomes_without_batches_or_rows(spark, tmp_path):
    path = str(tmp_path / "o")
    assert outcomes.read_outcomes(spark, path).count() == 0 and outcomes.read_reasons(spark, path).count() == 0
    write = one_pass.batch_writer(one_pass.sinks(StreamSettings("unused"), None, None, path), "r1")
    write(payloads(spark, ["{", "{}"]), 0)
    assert outcomes.read_outcomes(spark, path).count() == 0
    assert ("payload_malformed", 1) in rows(outcomes.read_reasons(spark, path))


def test_sessions_of_copies(spark):
    data = [("a", "like", "u", "2024-01-15 10:00:00"), ("a", "view", "u", "2024-01-15 10:09:00"),
            ("a", "like", "u", "2024-01-15 10:18:00"), ("a", "click", "u", "2024-01-15 10:40:00"),
            ("b", "view", "u", "2024-01-15 10:00:00"), ("b", "like", "u", "2024-01-15 10:00:00"),
            ("", "like", "u", "2024-01-15 10:00:00"), (None, "like", "u", "2024-01-15 10:00:00")]
    kept = dedup.dedup_sessions(event_frame(spark, data), timedelta(minutes=10))
    got = rows(kept, "event_id", "event_type", F.date_format("timestamp", "HH:mm"))
    assert got == [("", "like", "10:00"), ("a", "click", "10:40"), ("a", "like", "10:00"), ("b", "like", "10:00"), (None, "like", "10:00")]


def test_sessions_on_a_stream_do_not_depend_on_order(spark, tmp_path):
    # Half of the rows have one id. Files come in two orders; the same copies stay.
    from pulsetally.streaming.metrics import prepared
    from pulsetally.streaming.start import start_file_query
    from pulsetally.sources.folders import read_parts

    every = [(f"id{i % 40}" if i % 2 else "hot", f"2024-01-15 {10 + i // 60}:{i % 60:02d}:00") for i in range(240)]
    every.append(("end", "2024-01-16 10:00:00"))
    schema, results = "event_id string, timestamp timestamp", []
    for turn, order in enumerate((1, -1)):
        source, path = tmp_path / f"in{turn}", str(tmp_path / f"out{turn}")
        parts = [every[:120], every[120:240]][::order] + [every[240:]]
        for n, part in enumerate(parts):
            frame = spark.createDataFrame(part, "event_id string, t string").select("event_id", F.to_timestamp("t").alias("timestamp"))
            frame.coalesce(1).write.parquet(str(source / f"p{n}"))
        # A day of delay, so that the later half may come first.
        settings = StreamSettings(str(tmp_path / f"c{turn}"), available_now=True, watermark=timedelta(hours=6), state_partitions=4)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        kept = dedup.dedup_sessions(prepared(stream, settings), timedelta(minutes=30))
        start_file_query(kept, path, settings, "s").awaitTermination()
        results.append(read_parts(spark, path, kept.schema))
    assert same(*results)
    batch = spark.createDataFrame(every[:-1], "event_id string, t string").select("event_id", F.to_timestamp("t").alias("timestamp"))
    assert same(results[0], dedup.dedup_sessions(batch, timedelta(minutes=30)))
