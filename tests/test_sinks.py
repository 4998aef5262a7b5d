import logging
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import event_frame, rows, same
from pulsetally.config import KafkaSettings
from pulsetally.operators import metrics as m
from pulsetally.schema import METRIC_KEY, METRIC_SCHEMA
from pulsetally.session import shared_dir
from pulsetally.sinks import kafka as kafka_sink
from pulsetally.sinks import metrics as sink
from pulsetally.sources import kafka as kafka_source
from pulsetally.sources import metric_tables
from pulsetally.sources.folders import read_dates

VALUES = [c for c in METRIC_SCHEMA.names if c != "computed_at"]


def test_replayed_batch_changes_nothing(spark, events, tmp_path):
    path = str(tmp_path / "t")
    metrics = m.event_metrics(events, m.ONE_DAY)
    write = sink.parquet_batches(path, METRIC_SCHEMA)
    for batch_id in (0, 1, 1, 0):
        write(metrics.where(F.col("platform").isin(["web"] if batch_id else ["ios", "android", "mobile_web"])), batch_id)
    assert same(spark.read.parquet(path).select(VALUES), metrics.select(VALUES))


def test_newest_batch_wins_and_compaction(spark, tmp_path):
    early = m.event_metrics(event_frame(spark, [("1", "like", "a", "2024-01-15 10:00:00"), ("2", "view", "a", "2024-01-15 10:00:00")]))
    late = m.event_metrics(event_frame(spark, [("1", "like", "a", "2024-01-15 10:00:00"), ("3", "like", "b", "2024-01-15 10:01:00")]))
    write = sink.parquet_batches(str(tmp_path / "b"), METRIC_SCHEMA)
    write(early, 3)
    write(late, 12)
    batches = spark.read.parquet(str(tmp_path / "b"))
    newest = metric_tables.newest_per_key(batches, METRIC_KEY)
    want = [("like", 2, 2), ("view", 1, 1)]
    columns = ("event_type", "event_count", "unique_users")
    assert rows(newest, *columns) == want
    for _ in range(2):
        sink.compact_batches(batches, str(tmp_path / "c"), METRIC_SCHEMA, METRIC_KEY)
    assert rows(read_dates(spark, str(tmp_path / "c"), METRIC_SCHEMA), *columns) == want
    assert metric_tables.first_row(newest.where("event_type = 'view'")).event_count == 1
    assert metric_tables.first_row(newest.where("event_type = 'x'")) is None


def test_replace_leaves_other_dates(spark, tmp_path):
    path = str(tmp_path / "r")
    day1 = m.event_metrics(event_frame(spark, [("1", "like", "a", "2024-01-15 10:00:00")]))
    day2 = m.event_metrics(event_frame(spark, [("1", "like", "a", "2024-01-16 10:00:00")]))
    sink.append_table(day1, path, METRIC_SCHEMA)
    sink.replace_table(day2, path, METRIC_SCHEMA)
    sink.replace_table(day2, path, METRIC_SCHEMA)
    assert rows(read_dates(spark, path, METRIC_SCHEMA), "window_start") == [(datetime(2024, 1, 15, 10),), (datetime(2024, 1, 16, 10),)]


def test_error_policy(spark, caplog):
    def broken(batch, batch_id):
        raise RuntimeError("sink is down")

    with pytest.raises(RuntimeError):
        sink.guarded(broken, "t")(None, 1)
    with caplog.at_level(logging.ERROR):
        sink.guarded(broken, "t", "log")(spark.range(3), 7)
    assert "batch 7 of t" in caplog.text


def test_jdbc_options():
    jdbc = metric_tables.JdbcSettings("jdbc:x://h/db", "a.Driver", "u", "secret", partitions=4)
    plain = metric_tables.jdbc_options(jdbc, "event_metrics_5min")
    assert plain["dbtable"] == "event_metrics_5min" and "partitionColumn" not in plain
    sliced = metric_tables.jdbc_options(jdbc, "t", datetime(2024, 1, 1), datetime(2024, 1, 31))
    assert sliced["partitionColumn"] == "window_start" and sliced["numPartitions"] == "4"
    assert sliced["lowerBound"] == "2024-01-01 00:00:00"
    assert "secret" not in repr(jdbc)
    assert sink.jdbc_write_options(jdbc, "t") == {
        "url": "jdbc:x://h/db", "driver": "a.Driver", "user": "u", "password": "secret",
        "fetchsize": "10000", "dbtable": "t", "numPartitions": "4", "batchsize": "10000",
    }


def test_kafka_options():
    plain = KafkaSettings("h1:9092,h2:9092", "events")
    assert kafka_source.stream_options(plain) == {
        "kafka.bootstrap.servers": "h1:9092,h2:9092",
        "subscribe": "events",
        "startingOffsets": "latest",
        "failOnDataLoss": "false",
        "maxOffsetsPerTrigger": "10000",
    }
    secured = KafkaSettings(
        "h:9092", "events", "earliest", None, 64, "SASL_SSL", "SCRAM-SHA-256", "me", 'p"w\\'
    )
    options = kafka_source.stream_options(secured)
    assert options["minPartitions"] == "64" and "maxOffsetsPerTrigger" not in options
    assert options["kafka.sasl.jaas.config"].endswith('ScramLoginModule required username="me" password="p\\"w\\\\";')
    writer = kafka_sink.writer_options(plain)
    assert writer["topic"] == "events" and writer["kafka.compression.type"] == "gzip" and writer["kafka.acks"] == "1"
    assert "secret" not in repr(KafkaSettings("h", "t", sasl_password="secret"))


def test_observed_counts(spark):
    frame = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True)], "n int, ok boolean")
    counted, observation = kafka_sink.observed(frame, F.col("ok"), "counts")
    counted.write.format("noop").mode("overwrite").save()
    assert observation.get == {"successful": 2, "failed": 2}


def test_shared_dir_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    a, b = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert a != b and a.startswith(base) and b.startswith(base)


def test_object_store_options_reach_hadoop(spark):
    from pulsetally.session import build_session

    same_session = build_session("tests", object_store={"fs.s3a.endpoint": "store.example"})
    assert same_session.conf.get("spark.hadoop.fs.s3a.endpoint") == "store.example"
    assert same_session.conf.get("spark.sql.session.timeZone") == "UTC"
