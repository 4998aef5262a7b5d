import json
import shutil
import subprocess
import sys
from datetime import date, datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import event_frame, payloads, rows, same
from pulsetally.config import StreamSettings
from pulsetally.operators import metrics as m
from pulsetally.plans import landing, parts
from pulsetally.schema import METRIC_KEY, METRIC_SCHEMA, USER_METRIC_SCHEMA
from pulsetally.sinks import metrics as sinks
from pulsetally.sinks import micro
from pulsetally.sources import folders
from pulsetally.sources.folders import DATE, drop_old_builds, packed_up_to, read_dates, subfolders
from pulsetally.sources.metric_tables import read_parquet
from pulsetally.streaming import one_pass

VALUES = [c for c in METRIC_SCHEMA.names if c != "computed_at"]
ROOT = Path(__file__).resolve().parents[1]


def event(i, kind, user, at):
    return json.dumps({"event_id": str(i), "event_type": kind, "user_id": user, "platform": "web", "timestamp": at})


def batch(spark, *events):
    return payloads(spark, [event(*e) for e in events])


FIRST = [(1, "like", "a", "2024-01-15T10:01:00"), (2, "view", "b", "2024-01-15T23:59:30"), (3, "nope", "c", "2024-01-15T10:02:00")]
SECOND = [(4, "like", "a", "2024-01-15T10:03:00"), (5, "view", "b", "2024-01-16T00:01:00")]
LATE = [(6, "like", "z", "2024-01-15T10:02:30"), (7, "share", "a", "2024-01-17T00:00:10")]
ALL = [e for e in (*FIRST, *SECOND, *LATE) if e[1] != "nope"]


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "landing"), str(tmp_path / "parts"), str(tmp_path / "tables")


@pytest.fixture
def writer(place):
    landing_path, parts_path, _ = place
    return one_pass.batch_writer(one_pass.sinks(StreamSettings("unused"), landing_path, parts_path), "r1")


def five_minutes(spark, events):
    frame = event_frame(spark, [(str(i), kind, user, at.replace("T", " ")) for i, kind, user, at in events])
    return m.event_metrics(frame, m.FIVE_MINUTES, m.ONE_MINUTE).select(VALUES)


def test_crash_between_two_sinks(spark, place, writer, monkeypatch):
    landing_path, parts_path, tables_path = place
    writes, real = [], micro.write_partitioned

    def failing(rows, folder, *more, **options):
        if parts.ACTIVITY in folder and not writes.count("crash"):
            writes.append("crash")
            (Path(folder) / "_temporary").mkdir(parents=True)
            (Path(folder) / "_temporary/part-half").write_text("left behind")
            raise OSError("executors are gone")
        writes.append(folder)
        real(rows, folder, *more, **options)

    monkeypatch.setattr(micro, "write_partitioned", failing)
    with pytest.raises(OSError):
        writer(batch(spark, *FIRST), 0)
    assert parts.refresh_tables(spark, parts_path, tables_path) != []  # builds what is there and notes nothing
    for _ in range(2):  # the batch is repeated, and once more
        writer(batch(spark, *FIRST), 0)
    written = [w.split("/micro/")[0].rpartition("/")[2] for w in writes if w != "crash"]
    micro_writes = [w for w in written if w in ("landing", *parts.SCHEMAS)]
    assert sorted(micro_writes) == sorted(["landing", *parts.SCHEMAS])  # every sink once
    assert rows(landing.read_accepted(spark, landing_path), "event_id") == [("1",), ("2",)]
    assert parts.refresh_tables(spark, parts_path, tables_path) == [date(2024, 1, 15)]
    got = read_parquet(spark, f"{tables_path}/event_metrics_5min").select(VALUES)
    assert same(got, five_minutes(spark, [e for e in FIRST if e[1] != "nope"]))


def test_records_are_parsed_once(spark, place, monkeypatch):
    plans, real = [], micro.write_partitioned
    monkeypatch.setattr(micro, "write_partitioned", lambda r, *a, **k: (plans.append(r._jdf.queryExecution().toString()), real(r, *a, **k)))
    targets = one_pass.sinks(StreamSettings("unused"), place[0], place[1])
    one_pass.batch_writer(targets, "r")(batch(spark, *FIRST), 0)
    assert len(plans) == 4
    for plan in plans:
        optimized = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        assert optimized.lstrip().count("InMemoryRelation") == 1
        # All of the parser is below the cached relation, none above it.
        assert "from_json" not in optimized.split("InMemoryRelation")[0]


def test_switches(place):
    def names(**options):
        return [s[0].rpartition("/")[2] for s in one_pass.sinks(StreamSettings("c", **options), *place[:2])]

    assert names() == ["landing", *parts.SCHEMAS]
    assert names(enable_lake=False) == list(parts.SCHEMAS)
    assert names(enable_metrics=False) == ["landing"]
    assert one_pass.sinks(StreamSettings("c"), None, None) == []


def test_late_events_rebuild_only_their_dates(spark, place, writer):
    _, parts_path, tables_path = place
    writer(batch(spark, *FIRST), 0)
    writer(batch(spark, *SECOND), 1)
    assert parts.refresh_tables(spark, parts_path, tables_path) == [date(2024, 1, 15), date(2024, 1, 16)]
    assert parts.refresh_tables(spark, parts_path, tables_path) == []
    parts.pack_parts(spark, parts_path)
    writer(batch(spark, *LATE), 2)
    # The first seconds of the 17th are in windows that start on the 16th.
    assert parts.refresh_tables(spark, parts_path, tables_path) == [date(2024, 1, d) for d in (15, 16, 17)]
    assert same(read_parquet(spark, f"{tables_path}/event_metrics_5min").select(VALUES), five_minutes(spark, ALL))
    users = read_parquet(spark, f"{tables_path}/user_metrics_1hr")
    assert rows(users.where("user_id = 'a'"), "total_events", "likes", "shares") == [(1, 0, 1), (2, 2, 0)]


def test_packs_are_refreshed_too(spark, place, writer):
    _, parts_path, tables_path = place
    for n, events in enumerate((FIRST, SECOND, LATE)):
        writer(batch(spark, *events), n)
        parts.pack_parts(spark, parts_path)
    assert len(parts.refresh_tables(spark, parts_path, tables_path)) == 3
    assert parts.refresh_tables(spark, parts_path, tables_path) == []
    assert same(read_parquet(spark, f"{tables_path}/event_metrics_5min").select(VALUES), five_minutes(spark, ALL))


def test_pack_beside_a_running_stream(spark, place, writer):
    landing_path, _, _ = place
    writer(batch(spark, *FIRST), 0)
    # Batch 1 is being written: it has files, and is not complete.
    half = Path(micro.micro_folder(landing_path, "r1", 1))
    writer(batch(spark, *SECOND), 1)
    (half / "_SUCCESS").unlink()
    assert one_pass.pack_landing(spark, landing_path, keep_files=True)
    assert packed_up_to(spark, landing_path)[0] == {"r1": 0}
    ids = [(str(i),) for i in (1, 2, 4, 5)]
    assert rows(landing.read_accepted(spark, landing_path), "event_id") == ids
    micro.drop_packed(spark, landing_path)
    assert rows(landing.read_accepted(spark, landing_path), "event_id") == ids
    writer(batch(spark, *SECOND), 1)
    assert one_pass.pack_landing(spark, landing_path)
    assert one_pass.pack_landing(spark, landing_path) is None
    assert rows(landing.read_accepted(spark, landing_path), "event_id") == ids
    assert not [f for r in subfolders(spark, f"{landing_path}/micro") for f in subfolders(spark, r)]
    # A later run starts at batch 0 again.
    one_pass.batch_writer(one_pass.sinks(StreamSettings("u"), landing_path, None), "r2")(batch(spark, *LATE), 0)
    assert rows(landing.read_accepted(spark, landing_path), "event_id") == [*ids, ("6",), ("7",)]
    assert rows(landing.read_rejected(spark, landing_path).select(F.col("record")["offset"])) == [("2",)]


def test_failed_pack_changes_nothing(spark, place, writer, monkeypatch):
    landing_path, _, _ = place
    writer(batch(spark, *FIRST), 0)
    monkeypatch.setattr(micro, "new_version", lambda: 77)
    real = micro.write_partitioned

    def half(rows_, folder, *more, **options):
        real(rows_, folder, *more, **options)
        raise OSError("gone before the list is written")

    monkeypatch.setattr(micro, "write_partitioned", half)
    with pytest.raises(OSError):
        one_pass.pack_landing(spark, landing_path)
    assert rows(landing.read_accepted(spark, landing_path), "event_id") == [("1",), ("2",)]


def test_stream_of_files(spark, place, tmp_path):
    """Several micro-batches, a restart that finds nothing new, and one that does."""
    landing_path, parts_path, _ = place
    source, settings = tmp_path / "in", StreamSettings(str(tmp_path / "c"), available_now=True)
    source.mkdir()

    def run():
        lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
        one_pass.start_one_pass(lines, settings, landing_path, parts_path).awaitTermination()

    for n, events in enumerate((FIRST, SECOND)):
        (source / f"{n}.txt").write_text("\n".join(event(*e) for e in events))
    run()
    run()
    (source / "late.txt").write_text("\n".join(event(*e) for e in LATE))
    run()
    assert rows(landing.read_accepted(spark, landing_path), "event_id") == [(str(i),) for i in (1, 2, 4, 5, 6, 7)]
    assert same(parts.tables_of_parts(spark, parts_path)["event_metrics_5min"].select(VALUES), five_minutes(spark, ALL))


def test_empty_parts(spark, place):
    assert parts.refresh_tables(spark, place[1], place[2]) == []
    assert all(t.count() == 0 for t in parts.tables_of_parts(spark, place[1]).values())


# --- stored tables ----------------------------------------------------------------------


def daily(spark, *rows_):
    data = [(f"2024-01-{d:02}", kind, n) for d, kind, n in rows_]
    frame = spark.createDataFrame(data, "day string, event_type string, event_count long")
    start = F.to_timestamp("day")
    return frame.select(
        start.alias("window_start"), (start + F.expr("interval 1 day")).alias("window_end"), "event_type",
        F.lit("web").alias("platform"), "event_count", F.lit(1).cast("long").alias("unique_users"),
    )


def stored(spark, path):
    return rows(read_dates(spark, path, METRIC_SCHEMA).select(F.dayofmonth("window_start"), "event_type", "event_count"))


def test_compaction_leaves_other_dates(spark, tmp_path):
    path = str(tmp_path / "t")
    for n, day in enumerate((5, 6, 5)):
        step = daily(spark, (day, "like", 10 + n)).withColumns({"run": F.lit("1"), "batch_id": F.lit(n).cast("long")})
        sinks.compact_batches(step, path, METRIC_SCHEMA, METRIC_KEY)
    assert stored(spark, path) == [(5, "like", 12), (6, "like", 11)]


def test_rows_after_a_build_are_added(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_table(daily(spark, (5, "view", 1), (7, "view", 1)), path, METRIC_SCHEMA)
    sinks.replace_table(daily(spark, (5, "like", 2)), path, METRIC_SCHEMA, dates=[date(2024, 1, 5), date(2024, 1, 6)])
    assert stored(spark, path) == [(5, "like", 2), (7, "view", 1)]
    sinks.append_table(daily(spark, (5, "share", 3), (6, "share", 3)), path, METRIC_SCHEMA)
    assert stored(spark, path) == [(5, "like", 2), (5, "share", 3), (6, "share", 3), (7, "view", 1)]
    sinks.replace_table(daily(spark, (5, "like", 4)), path, METRIC_SCHEMA)  # dates that were built, again
    assert stored(spark, path) == [(5, "like", 4), (7, "view", 1)]


def test_later_stream_rows_replace_those_of_their_key(spark, tmp_path):
    path = str(tmp_path / "t")

    def streamed(frame, run):
        sinks.table_rows(frame, METRIC_SCHEMA).write.partitionBy(DATE).parquet(f"{path}/stream/{run}")

    streamed(daily(spark, (5, "view", 1), (8, "view", 1)), "1")
    sinks.replace_table(daily(spark, (5, "like", 2), (5, "view", 2), (6, "like", 2)), path, METRIC_SCHEMA)
    assert stored(spark, path) == [(5, "like", 2), (5, "view", 2), (6, "like", 2), (8, "view", 1)]
    streamed(daily(spark, (5, "like", 9), (5, "share", 9)), "2")
    assert stored(spark, path) == [(5, "like", 9), (5, "share", 9), (5, "view", 2), (6, "like", 2), (8, "view", 1)]


def test_old_builds_are_not_read_and_can_be_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        sinks.replace_table(daily(spark, (5, "like", n), *([(6, "like", n)] if n == 1 else [])), path, METRIC_SCHEMA, dates=[date(2024, 1, 5)])
    table = read_dates(spark, path, METRIC_SCHEMA)
    assert stored(spark, path) == [(5, "like", 3), (6, "like", 1)]
    scan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan and "Broadcast" not in scan
    assert drop_old_builds(spark, path, datetime(2020, 1, 1, tzinfo=timezone.utc)) == []
    dropped = drop_old_builds(spark, path, datetime.now(timezone.utc) + timedelta(hours=1))
    assert len(dropped) == 2 and len(subfolders(spark, f"{path}/build")) == 2
    assert stored(spark, path) == [(5, "like", 3), (6, "like", 1)]


def test_failed_batches_are_kept_and_replayed(spark, tmp_path):
    kept, path = str(tmp_path / "failed"), str(tmp_path / "t")
    up = []

    def write(frame, batch_id):
        if not up:
            raise OSError("down")
        sinks.parquet_batches(path, METRIC_SCHEMA, "r")(frame, batch_id)

    guarded = sinks.guarded(write, "t", "keep", kept, "r")
    guarded(daily(spark, (5, "like", 1)), 0)
    guarded(daily(spark, (6, "like", 1)), 1)
    with pytest.raises(OSError):
        sinks.replay_failed(spark, kept, lambda run: write)
    up.append(True)
    assert sinks.replay_failed(spark, kept, lambda run: write) == [("r", 0), ("r", 1)]
    assert sinks.replay_failed(spark, kept, lambda run: write) == []
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        sinks.guarded(write, "t", "keep")


def test_entry_without_training_data_package(tmp_path):
    """With both folders of the package gone, all other queries are still there."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "pulsetally", tmp_path / "pulsetally", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, set(s) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True)
    count, *rest = out.stdout.split()
    assert int(count) > 60 and rest == ["False", "True"]


def test_user_rows_have_their_key():
    assert [k for k in folders.KEYS if k in USER_METRIC_SCHEMA.names] == ["window_start", "user_id", "platform"]
