import json
import threading
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import rows, same
from pulsetally.config import StreamSettings
from pulsetally.operators import metrics as m
from pulsetally.operators.decode import decode_events
from pulsetally.plans import landing
from pulsetally.schema import METRIC_KEY, METRIC_SCHEMA, USER_METRIC_SCHEMA
from pulsetally.sinks import lake, metrics as sinks
from pulsetally.sources import metric_tables
from pulsetally.sources.event_tables import as_events, stream_table
from pulsetally.sources.folders import read_dates, read_parts
from pulsetally.sources.lake import LAKE_SCHEMA
from pulsetally.streaming import jobs, metrics
from conftest import DATA

VALUES = [c for c in METRIC_SCHEMA.names if c != "computed_at"]


@pytest.fixture
def settings(tmp_path):
    return StreamSettings(str(tmp_path / "ckpt"), available_now=True)


@pytest.fixture
def stream(spark, table):
    return as_events(stream_table(spark, str(DATA)))


def closed(batch, events):
    """Windows the stream has emitted: those which end before the final watermark."""
    last = events.agg(F.max("timestamp") - F.expr("interval 10 minutes")).first()[0]
    return batch.where(F.col("window_end") <= F.lit(last.isoformat()).cast("timestamp"))


class Feed:
    """A folder of JSON event files, read one file per micro-batch."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, path, 0
        path.mkdir()

    def add(self, *events):
        lines = [
            json.dumps({"event_id": i, "event_type": t, "user_id": u, "platform": "web", "timestamp": at})
            for i, t, u, at in events
        ]
        target = self.path / f"{self.n:03}.txt"
        target.write_text("\n".join(lines))
        self.n += 1
        # File streams order by modification time.
        stamp = time.time() - 1000 + self.n
        import os

        os.utime(target, (stamp, stamp))

    def events(self):
        lines = self.spark.readStream.option("maxFilesPerTrigger", 1).text(str(self.path))
        return decode_events(lines)


@pytest.mark.parametrize("uniques", ["approx", "exact", "as_coded"])
def test_event_stream_equals_batch(spark, events, stream, settings, tmp_path, uniques):
    frame = metrics.event_metric_stream(stream, settings, uniques)
    sinks.stream_event_metrics(frame, str(tmp_path / "out"), settings).awaitTermination()
    got = read_dates(spark, str(tmp_path / "out"), METRIC_SCHEMA).select(VALUES)
    batch = m.event_metrics(events, m.FIVE_MINUTES, m.ONE_MINUTE, "as_coded" if uniques == "as_coded" else "exact")
    want = closed(batch, events).select(VALUES)
    assert want.count() > 4000
    assert same(got, want)


def test_user_stream_equals_batch(spark, events, stream, settings, tmp_path):
    frame = metrics.user_metric_stream(stream, settings)
    sinks.stream_user_metrics(frame, str(tmp_path / "out"), settings).awaitTermination()
    batch = closed(m.user_metrics(events), events)
    assert same(read_dates(spark, str(tmp_path / "out"), USER_METRIC_SCHEMA).select(batch.columns), batch)


def test_lake_stream_is_exactly_once(spark, events, stream, settings, tmp_path):
    for _ in range(2):  # the second run finds nothing new
        lake.stream_lake(stream, str(tmp_path / "lake"), settings).awaitTermination()
    from pulsetally.sources.lake import read_lake

    keep = ["event_id", "user_id", "timestamp"]
    assert same(read_lake(spark, str(tmp_path / "lake")).select(keep), events.select(keep))
    part = read_lake(spark, str(tmp_path / "lake"), datetime(2024, 1, 3), datetime(2024, 1, 4))
    assert part.count() == events.where(F.to_date("timestamp") == "2024-01-03").count()


def test_landing_stream(spark, settings, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    feed.add(("1", "like", "a", "2024-01-15T10:00:00"), ("2", "nope", "a", "2024-01-15T10:00:00"))
    feed.add(("3", "view", " ", "2024-01-15T11:00:00"), ("4", "view", "b", "2024-01-15T11:00:00"))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(feed.path))
    landing.stream_landing(lines, str(tmp_path / "out"), settings).awaitTermination()
    assert rows(landing.read_accepted(spark, str(tmp_path / "out")), "event_id") == [("1",), ("4",)]
    assert rows(landing.read_rejected(spark, str(tmp_path / "out")).select(F.col("reasons")[0])) == [
        ("event_type_unknown",), ("user_id_blank",),
    ]


def test_streams_write_a_file_an_hour_from_many_tasks(spark, settings, tmp_path):
    texts = [
        json.dumps({"event_id": f"{i}", "event_type": "like", "user_id": "u", "platform": "web", "timestamp": f"2024-01-15T{i % 6:02d}:00:00"})
        for i in range(60)
    ]
    spark.createDataFrame([(t,) for t in texts], "value string").repartition(5).write.text(str(tmp_path / "in"))
    lines = spark.readStream.text(str(tmp_path / "in"))
    landing.stream_landing(lines, str(tmp_path / "landing"), settings, "landing").awaitTermination()
    lake.stream_lake(decode_events(lines), str(tmp_path / "lake"), settings, "lake").awaitTermination()
    assert landing.read_accepted(spark, str(tmp_path / "landing")).count() == 60
    for path in ("landing", "lake"):
        files = [f.parent for f in (tmp_path / path / "stream").rglob("*.parquet")]
        assert len(files) == len(set(files)) == 6


def test_late_rows_are_dropped(spark, settings, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    feed.add(("1", "like", "a", "2024-01-15T10:01:00"))
    feed.add(("2", "like", "b", "2024-01-15T11:00:00"))
    feed.add(("3", "like", "c", "2024-01-15T11:00:30"))  # lets the new watermark take effect
    feed.add(("4", "like", "d", "2024-01-15T10:02:00"), ("5", "like", "e", "2024-01-15T10:58:00"))
    feed.add(("6", "like", "f", "2024-01-15T12:00:00"))
    frame = m.event_metrics(metrics.prepared(feed.events(), settings), m.FIVE_MINUTES)
    sinks.stream_table(frame, str(tmp_path / "out"), METRIC_SCHEMA, settings, "late").awaitTermination()
    got = rows(read_dates(spark, str(tmp_path / "out"), METRIC_SCHEMA), "window_start", "event_count", "unique_users")
    # 10:02 came behind the watermark of 10:50; 10:58 was out of order but in time.
    assert got == [
        (datetime(2024, 1, 15, 10), 1, 1),
        (datetime(2024, 1, 15, 10, 55), 1, 1),
        (datetime(2024, 1, 15, 11), 2, 2),
    ]


def test_repeated_ids_are_dropped_within_the_watermark(spark, settings, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    one = ("1", "like", "a", "2024-01-15T10:01:00")
    nameless = [(i, "like", "n", "2024-01-15T10:02:00") for i in (None, None, "")]
    feed.add(one, one, ("2", "like", "b", "2024-01-15T10:01:30"), *nameless)
    feed.add(one)
    feed.add(("9", "like", "z", "2024-01-15T12:00:00"))
    feed.add(("10", "like", "z", "2024-01-15T13:00:00"))
    dedup = StreamSettings(settings.checkpoint_dir, available_now=True, dedup=True)
    frame = metrics.user_metric_stream(feed.events(), dedup)
    sinks.stream_user_metrics(frame, str(tmp_path / "out"), dedup).awaitTermination()
    got = rows(read_dates(spark, str(tmp_path / "out"), USER_METRIC_SCHEMA), "window_start", "user_id", "likes")
    assert got[:3] == [(datetime(2024, 1, 15, 10), u, n) for u, n in (("a", 1), ("b", 1), ("n", 3))]


def test_batch_dedup(spark):
    from pulsetally.operators.dedup import dedup_events

    frame = spark.createDataFrame([("1",), ("1",), ("2",), (None,), (None,), ("",)], "event_id string")
    assert rows(dedup_events(frame)) == [("",), ("1",), ("2",), (None,), (None,)]


def test_update_mode_with_newest_per_key(spark, settings, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    feed.add(("1", "like", "a", "2024-01-15T10:01:00"))
    feed.add(("2", "like", "b", "2024-01-15T10:01:00"), ("3", "like", "b", "2024-01-15T10:02:00"))
    tumbling = StreamSettings(settings.checkpoint_dir, slide=timedelta(minutes=5), available_now=True)
    frame = metrics.event_metric_updates(feed.events(), tumbling)
    write = sinks.parquet_batches(str(tmp_path / "out"), METRIC_SCHEMA)
    sinks.stream_batches(frame, write, tumbling, "updates", "update").awaitTermination()
    versions = spark.read.parquet(str(tmp_path / "out"))
    assert rows(versions, "event_count") == [(1,), (3,)]
    newest = metric_tables.newest_per_key(versions, METRIC_KEY)
    assert rows(newest, "event_count", "unique_users") == [(3, 2)]


def test_failed_batch_is_tried_again(spark, events, stream, settings, tmp_path):
    path = str(tmp_path / "out")
    good = sinks.parquet_batches(path, METRIC_SCHEMA)
    failures = []

    def flaky(batch, batch_id):
        good(batch, batch_id)
        if batch_id == 1 and not failures:
            failures.append(batch_id)
            raise RuntimeError("lost the connection after the write")

    def run():
        frame = metrics.event_metric_stream(stream, settings)
        sinks.stream_batches(frame, flaky, settings, "flaky").awaitTermination()

    with pytest.raises(Exception, match="lost the connection"):
        run()
    run()
    want = closed(m.event_metrics(events, m.FIVE_MINUTES, m.ONE_MINUTE), events)
    assert failures == [1]
    assert same(spark.read.parquet(path).select(VALUES), want.select(VALUES))


def test_logged_failures_lose_only_their_batch(spark, events, stream, settings, tmp_path, caplog):
    path = str(tmp_path / "out")
    good = sinks.parquet_batches(path, METRIC_SCHEMA)

    def first_fails(batch, batch_id):
        if batch_id == 0:
            raise RuntimeError("sink is down")
        good(batch, batch_id)

    frame = metrics.event_metric_stream(stream, settings)
    sinks.stream_batches(frame, first_fails, settings, "logged", on_error="log").awaitTermination()
    # The first batch closes no window, so what the later ones hold is complete.
    want = closed(m.event_metrics(events, m.FIVE_MINUTES, m.ONE_MINUTE), events)
    assert "batch 0 of logged" in caplog.text
    assert same(spark.read.parquet(path).select(VALUES), want.select(VALUES))


def test_jobs_start_and_end_together(spark, events, stream, settings, tmp_path):
    queries = jobs.start_jobs(stream, settings, str(tmp_path / "lake"), str(tmp_path / "tables"))
    assert [q.name for q in queries] == ["raw-events", "rejected-records", "event-metrics-5min", "user-metrics-1hr"]
    jobs.run_until_stopped(queries)
    assert read_parts(spark, str(tmp_path / "lake"), LAKE_SCHEMA).count() == events.count()
    users = closed(m.user_metrics(events), events)
    assert read_dates(spark, str(tmp_path / "tables/user_metrics_1hr"), USER_METRIC_SCHEMA).count() == users.count()


def test_pipeline_from_records(spark, settings, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    feed.add(("1", "like", "a", "2024-01-15T10:01:00"), ("2", "nope", "a", "2024-01-15T10:02:00"))
    feed.add(("3", "like", " a ", "2024-01-15T12:30:00"))
    feed.add(("4", "view", "b", "2024-01-15T14:30:00"))
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(feed.path))
    queries = jobs.start_pipeline(
        lines, settings, str(tmp_path / "landing"), metrics_path=str(tmp_path / "tables")
    )
    jobs.run_until_stopped(queries)
    assert rows(landing.read_accepted(spark, str(tmp_path / "landing")), "event_id") == [("1",), ("3",), ("4",)]
    assert landing.read_rejected(spark, str(tmp_path / "landing")).count() == 1
    users = read_dates(spark, str(tmp_path / "tables/user_metrics_1hr"), USER_METRIC_SCHEMA)
    assert rows(users, "window_start", "user_id", "likes") == [
        (datetime(2024, 1, 15, 10), "a", 1), (datetime(2024, 1, 15, 12), "a", 1),
    ]


def test_switches_choose_the_queries(spark, stream, tmp_path):
    off = StreamSettings(str(tmp_path / "c"), available_now=True, enable_lake=False, enable_metrics=False)
    assert jobs.start_jobs(stream, off, str(tmp_path / "l"), str(tmp_path / "t")) == []
    only = StreamSettings(str(tmp_path / "c"), available_now=True, enable_metrics=False)
    queries = jobs.start_jobs(stream, only, str(tmp_path / "l"), str(tmp_path / "t"))
    jobs.run_until_stopped(queries)
    assert [q.name for q in queries] == ["raw-events", "rejected-records"]


def test_failure_of_one_query_stops_the_others(spark, stream, tmp_path):
    live = StreamSettings(str(tmp_path / "c"), trigger=timedelta(milliseconds=200))

    def writer_for(table, schema, run):
        def write(batch, batch_id):
            if table == "user_metrics_1hr":
                raise RuntimeError("table is gone")
            batch.write.format("noop").mode("overwrite").save()

        return write

    queries = jobs.start_jobs(stream, live, str(tmp_path / "l"), writer_for=writer_for)
    caught = []

    def wait():
        try:
            jobs.run_until_stopped(queries)
        except Exception as e:
            caught.append(str(e))

    waiter = threading.Thread(target=wait)
    waiter.start()
    waiter.join(90)
    assert not waiter.is_alive() and "table is gone" in caught[0]
    assert not any(q.isActive for q in queries)


def test_trigger_and_checkpoints(tmp_path):
    settings = StreamSettings("/x/")
    assert settings.trigger_options() == {"processingTime": "30 seconds"}
    assert settings.checkpoint("raw-events") == "/x/raw-events"
