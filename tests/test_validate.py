import json

import pytest
from pyspark.sql import functions as F

from helpers import payloads, rows
from pulsetally.operators import batches
from pulsetally.operators.decode import parse_payload
from pulsetally.operators.validate import (
    check_events,
    is_valid,
    record_defaults,
    rejected_records,
    valid_events,
)

GOOD = {"event_type": "like", "user_id": "user_1", "platform": "web"}


def reasons(spark, *changes):
    texts = [json.dumps({k: v for k, v in (GOOD | c).items() if v != "DROP"}) for c in changes]
    checked = check_events(parse_payload(payloads(spark, texts)))
    return [r.reasons for r in checked.orderBy("offset").collect()]


@pytest.mark.parametrize("event_type", ["click", "like", "comment", "share", "view"])
def test_event_types(spark, event_type):
    assert reasons(spark, {"event_type": event_type}) == [[]]


def test_rules(spark):
    cases = [
        ({}, []),
        ({"platform": "ios"}, []),
        ({"platform": "android"}, []),
        ({"platform": "mobile_web"}, []),
        ({"event_type": "invalid_type"}, ["event_type_unknown"]),
        ({"event_type": "LIKE"}, ["event_type_unknown"]),
        ({"event_type": "DROP"}, ["event_type_missing"]),
        ({"event_type": None}, ["event_type_missing"]),
        ({"platform": "invalid_platform"}, ["platform_unknown"]),
        ({"platform": "DROP"}, ["platform_missing"]),
        ({"user_id": "DROP"}, ["user_id_missing"]),
        ({"user_id": ""}, ["user_id_length"]),
        ({"user_id": "   "}, ["user_id_blank"]),
        ({"user_id": "\u00a0\u2003\x1f"}, ["user_id_blank"]),
        ({"user_id": "x" * 100}, []),
        ({"user_id": "x" * 101}, ["user_id_length"]),
        ({"user_id": " " * 101}, ["user_id_length"]),
        ({"content_id": "c" * 101}, ["content_id_too_long"]),
        ({"session_id": "c" * 101}, ["session_id_too_long"]),
        ({"device_type": "c" * 51}, ["device_type_too_long"]),
        ({"location": "c" * 101}, ["location_too_long"]),
        ({"location": "é" * 100}, []),
        ({"timestamp": "garbage"}, ["timestamp_malformed"]),
        ({"timestamp": "10:30:00"}, ["timestamp_malformed"]),
        ({"timestamp": "2024-02-30T00:00:00"}, ["timestamp_malformed"]),
        ({"timestamp": "2024-01-15T10:00:00Z"}, []),
        ({"timestamp": "2024-01-15t10:00:00.123456+05:30"}, []),
        ({"timestamp": 1705312800}, []),
        ({"timestamp": ""}, ["timestamp_malformed"]),
        ({"timestamp": 253402300800000}, ["timestamp_malformed"]),
        ({"timestamp": 10**17}, ["timestamp_malformed"]),
        ({"timestamp": 10**40}, ["timestamp_malformed"]),
        ({"timestamp": "1e5"}, ["timestamp_malformed"]),
        ({"timestamp": "0000-01-01"}, ["timestamp_malformed"]),
        ({"timestamp": "2024-01-15T10:00:00+99:99"}, ["timestamp_malformed"]),
        ({"timestamp": "2024-01-15 25:00"}, ["timestamp_malformed"]),
        ({"timestamp": -5.25}, []),
        ({"timestamp": "2024-01-15"}, []),
        ({"metadata": [1]}, ["metadata_not_object"]),
        ({"metadata": "text"}, ["metadata_not_object"]),
        ({"metadata": "{}"}, ["metadata_not_object"]),
        ({"user_id": 5}, ["user_id_not_text"]),
        ({"user_id": {"a": 1}}, ["user_id_not_text"]),
        ({"user_id": ["a"]}, ["user_id_not_text"]),
        ({"content_id": {"a": 1}, "location": True}, ["content_id_not_text", "location_not_text"]),
        ({"event_id": 7}, ["event_id_not_text"]),
        ({"session_id": 1.5, "device_type": None}, ["session_id_not_text"]),
        ({"metadata": {}}, []),
        ({"metadata": None}, []),
        ({"metadata": {"data": "x" * 1001}}, ["metadata_too_large"]),
        ({"user_id": " ", "platform": "tv"}, ["user_id_blank", "platform_unknown"]),
    ]
    assert reasons(spark, *[c for c, _ in cases]) == [want for _, want in cases]


def test_metadata_size_is_the_printed_form(spark):
    # The limit counts the printed dictionary, with a space after , and :.
    samples = [
        {"a": "x" * n, "b": [1, {"c": 2}], "d": 'say "x"', "e": "a,b:c", "f": True, "g": None}
        for n in range(890, 960)
    ]
    samples += [{"a": "\xad" * 300}, {"a": "\u200b" * 160}, {"a": "\u200b" * 170}, {"a": "\U000e0001" * 98}, {"a": "\U000e0001" * 101}]
    samples += [{"a": "é🎉" * 480}, {"a": "\x01" * 247}, {"a": "\x01" * 250}, {"a": "\\u00" * 190}, {"a": "\n\x7f" * 165}, {"a": "\n\x7f" * 167}]
    got = reasons(spark, *[{"metadata": m} for m in samples])
    want = [["metadata_too_large"] if len(str(m)) > 1000 else [] for m in samples]
    assert got == want and [] in got and ["metadata_too_large"] in got


MALFORMED = [
    json.dumps(GOOD) + " x",
    json.dumps(GOOD) * 2,
    json.dumps(GOOD).replace('"', "'"),
    json.dumps([GOOD]),
]


def test_malformed_payload(spark):
    checked = check_events(parse_payload(payloads(spark, ["{oops", None, "", *MALFORMED])))
    assert [r.reasons for r in checked.collect()] == [["payload_malformed"]] * (3 + len(MALFORMED))
    text = json.dumps(GOOD)
    checked = check_events(parse_payload(payloads(spark, [f" {text}\n"])))
    assert [r.reasons for r in checked.collect()] == [[]]


def test_normalised_events(spark):
    texts = [
        json.dumps(GOOD | {"user_id": "  user_1\t"}),
        json.dumps(GOOD | {"event_id": "", "timestamp": "2024-01-15T10:00:00"}),
        json.dumps(GOOD | {"event_id": "mine", "timestamp": 1705312800, "metadata": {"a": 1}}),
        json.dumps(GOOD | {"timestamp": 1705312800000}),
        json.dumps(GOOD | {"platform": "tv"}),
    ]
    checked = check_events(parse_payload(payloads(spark, texts)))
    options = record_defaults(checked)
    first = valid_events(checked, **options, keep=("offset",)).orderBy("offset").collect()
    again = valid_events(checked, **options, keep=("offset",)).orderBy("offset").collect()
    assert [r.offset for r in first] == [0, 1, 2, 3]
    assert [r.event_id for r in first] == [r.event_id for r in again]
    assert first[2].event_id == "mine" and len({r.event_id for r in first}) == 4
    assert {r.user_id for r in first} == {"user_1"}
    assert [str(r.timestamp) for r in first] == [
        "2024-01-15 12:00:00",
        "2024-01-15 10:00:00",
        "2024-01-15 10:00:00",
        "2024-01-15 10:00:00",
    ]
    assert first[0].metadata == {} and first[2].metadata == {"a": "1"}
    assert [r.offset for r in rejected_records(checked).collect()] == [4]


def test_random_ids_without_coordinates(spark):
    records = payloads(spark, [json.dumps(GOOD)] * 3).select("value")
    checked = check_events(parse_payload(records))
    ids = {r.event_id for r in valid_events(checked, **record_defaults(checked)).collect()}
    assert len(ids) == 3


def batch_rows(spark, sizes, bad=()):
    """Rows (batch_id, n, ok): sizes[b] rows per batch; `bad` lists (batch, n)."""
    data = [(b, n, (b, n) not in bad) for b, size in sizes.items() for n in range(size)]
    return spark.createDataFrame(data, "batch_id long, n long, ok boolean")


def test_atomic_batches(spark):
    sizes = {1: 2, 2: 3, 3: 1000, 4: 1001, 5: 1}
    frame = batch_rows(spark, sizes, bad={(2, 1)})
    single = spark.createDataFrame([(None, 0, True), (None, 1, False)], frame.schema)
    kept = batches.atomic_batches(frame.unionByName(single), F.col("ok"))
    counts = {r.batch_id: r["count"] for r in kept.groupBy("batch_id").count().collect()}
    assert counts == {1: 2, 3: 1000, 5: 1, None: 1}


def test_atomic_batches_with_a_giant(spark):
    # One batch holds most rows; with room for one giant the other oversized
    # batches must still be refused by the semi join.
    sizes = {1: 20_000, 2: 1500, 3: 1200, 4: 10}
    frame = batch_rows(spark, sizes)
    for room in (1, 100):
        kept = batches.atomic_batches(frame, F.col("ok"), giants_max=room)
        assert rows(kept.groupBy("batch_id").count()) == [(4, 10)]


def test_batches_are_parsed_once(spark, tmp_path, monkeypatch):
    # A hot batch, one beyond the limit, single events; a payload is valid if it has a platform.
    good, bad = ('{"event_type": "view", "user_id": "u", "platform": "%s"}' % p for p in ("ios", "tv"))
    sizes = [("hot", 4000, good), ("whole", 1000, good), ("part", 3, bad), ("one", 1, good), (None, 2, good), (None, 2, bad)]
    frame = spark.createDataFrame([(b, v) for b, n, v in sizes for _ in range(n)], "batch_id string, value string")
    checked = check_events(parse_payload(frame))
    folder = str(tmp_path / "rows")
    monkeypatch.setattr(batches, "shared_dir", lambda *_: folder)
    kept = batches.atomic_batches(checked, is_valid())
    assert "from_json" not in kept._jdf.queryExecution().toString()  # all is read from the rows written once
    assert kept.columns == checked.columns
    assert spark.read.parquet(folder).count() == frame.count()
    counts = {r.batch_id: r["count"] for r in kept.groupBy("batch_id").count().collect()}
    assert counts == {"whole": 1000, "one": 1, None: 2}


def test_every_reason_has_a_variant():
    from pulsetally.operators.validate import rules
    from pulsetally.plans.queries import VARIANTS

    named = {reason for reasons, _ in VARIANTS for reason in reasons.split(",") if reason}
    assert named == {*rules(), "payload_malformed"}


def test_batch_outcome(spark):
    frame = batch_rows(spark, {1: 2, 2: 3, 3: 2}, bad={(2, 1), (3, 0), (3, 1)})
    got = rows(batches.batch_outcome(frame, F.col("ok")))
    assert got == [
        (1, 2, 2, 0, "success", []),
        (2, 3, 2, 1, "partial", ["1 events failed to publish."]),
        (3, 2, 0, 2, "error", ["2 events failed to publish."]),
    ]


def test_validity_over_the_table(table):
    from pulsetally.operators.decode import encode_events
    from pulsetally.sources.event_tables import as_events

    checked = check_events(parse_payload(encode_events(as_events(table, map_types=False))))
    got = {r["ok"]: r["count"] for r in checked.groupBy(is_valid().alias("ok")).count().collect()}
    known = table.where(F.col("event_type").isin("click", "view")).count()
    assert got == {True: known, False: table.count() - known}


def test_filters_stay_above_the_parser(table):
    # Pushed below it, Spark would parse the payload once per mentioned field.
    from pulsetally.operators.decode import encode_events
    from pulsetally.sources.event_tables import as_events

    checked = check_events(parse_payload(encode_events(as_events(table))))
    for frame in (valid_events(checked), rejected_records(checked)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(StructField(event_id") == 1
