import json

from helpers import rows
from pulsetally.sources.metric_tables import read_parquet
from pulsetally.__main__ import main


def test_backfill_and_tables(spark, tmp_path):
    events = [
        {"event_id": "1", "event_type": "like", "user_id": "a", "platform": "web", "timestamp": "2024-01-15T10:01:00"},
        {"event_id": "2", "event_type": "like", "user_id": "b", "platform": "web", "timestamp": "2024-01-15T10:02:00"},
        {"event_id": "3", "event_type": "like", "user_id": "b", "platform": "web", "timestamp": "2024-01-16T00:00:00"},
        {"event_id": "4", "event_type": "huh", "user_id": "b", "platform": "web", "timestamp": "2024-01-15T10:02:00"},
    ]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, events)))
    landing, tables = str(tmp_path / "landing"), str(tmp_path / "tables")
    main(["backfill", "--files", str(tmp_path / "in.jsonl"), "--landing", landing])
    main(["tables", "--landing", landing, "--tables", tables, "--start", "2024-01-15", "--end", "2024-01-16"])
    day = read_parquet(spark, f"{tables}/event_metrics_1day")
    assert rows(day, "event_type", "event_count", "unique_users") == [("like", 2, 2)]
    sliding = read_parquet(spark, f"{tables}/event_metrics_5min")
    # Windows from 09:57 to 10:02, and those of the 15th which reach midnight.
    assert sliding.count() == 6 + 4
    users = read_parquet(spark, f"{tables}/user_metrics_1hr")
    assert rows(users, "user_id", "likes") == [("a", 1), ("b", 1)]


def test_reports(spark, tmp_path, capsys):
    events = [
        {"event_type": kind, "user_id": user, "platform": "web", "timestamp": f"2024-01-15T10:0{i}:00"}
        for i, (kind, user) in enumerate([("like", "a"), ("view", "a"), ("view", "b")])
    ]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, events)))
    landing, tables = str(tmp_path / "landing"), str(tmp_path / "tables")
    main(["backfill", "--files", str(tmp_path / "in.jsonl"), "--landing", landing])
    main(["tables", "--landing", landing, "--tables", tables, "--start", "2024-01-15", "--end", "2024-01-16"])
    capsys.readouterr()

    def report(kind, *options):
        main(["report", kind, "--tables", tables, "--as-of", "2024-01-16", *options])
        return [json.loads(line) for line in capsys.readouterr().out.splitlines()]

    assert report("top-users") == [
        {"user_id": "a", "platform": "web", "total_events": 2, "rank": 1},
        {"user_id": "b", "platform": "web", "total_events": 1, "rank": 2},
    ]
    assert report("platform-users") == [{"platform": "web", "total_events": 3, "unique_users": 2}]
    assert [r["percentage"] for r in report("distribution", "--overlap", "tumbling")] == [66.67, 33.33]
    assert report("platforms", "--overlap", "tumbling")[0]["total_events"] == 3
    day = report("event-metrics", "--window", "1day", "--event-type", "view")
    assert [(r["event_count"], r["unique_users"]) for r in day] == [(2, 2)]
    assert [r["views"] for r in report("user-metrics", "--user", "b")] == [1]
