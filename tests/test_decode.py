import json

from pyspark.sql import functions as F

from helpers import payloads, rows, utc
from pulsetally.operators.decode import decode_events, encode_events, parse_payload

SAMPLES = [
    '{"event_id":"k-1","event_type":"share","user_id":"lena","platform":"ios","content_id":"clip_7","timestamp":"2023-08-09T17:30:00"}',
    '{"event_type":"comment","user_id":"raul","platform":"android","timestamp":"2023-08-09T17:30:00Z"}',
    '{"event_type":"view","user_id":"kaya","platform":"web","timestamp":"2023-08-09T19:30:00+02:00","metadata":{"volume":80,"deep":{"a":[1,2]},"none":null}}',
    '{"event_type": broken',
    None,
    '{"event_type":"view","user_id":"u","platform":"ios","timestamp":"garbage"}',
]


def test_decode_types_and_bad_rows(spark):
    decoded = decode_events(payloads(spark, SAMPLES), keep=("offset",))
    assert decoded.columns[-1] == "processing_time"
    got = {r.offset: r for r in decoded.collect()}
    assert len(got) == 6
    assert (got[0].event_id, got[0].content_id) == ("k-1", "clip_7")
    naive = utc("2023-08-09T17:30:00").replace(tzinfo=None)
    assert [got[i].timestamp for i in range(3)] == [naive] * 3
    assert got[2].metadata == {"volume": "80", "deep": '{"a":[1,2]}', "none": None}
    assert got[3].event_type is None and got[4].event_type is None
    assert got[5].timestamp is None and got[5].event_type == "view"


def test_malformed_is_marked(spark):
    parsed = parse_payload(payloads(spark, SAMPLES)).select("offset", "malformed")
    marked = {r.offset for r in parsed.collect() if r.malformed is not None}
    assert marked == {3, 4}


def test_payload_is_parsed_once(spark):
    plan = decode_events(payloads(spark, SAMPLES))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(StructField(event_id") == 1


def test_encode_round_trip(events):
    records = encode_events(events, keep=("batch_id",))
    back = decode_events(records).drop("processing_time")
    want = events.drop("batch_id")
    as_text = F.to_json("metadata").alias("metadata")
    columns = [as_text if c == "metadata" else c for c in want.columns]
    assert rows(back.select(*columns)) == rows(want.select(*columns))
    assert records.where("key is null").count() == 0


def test_encode_writes_nulls_and_iso_time(spark):
    data = [("e1", "like", "u1", "2024-01-15 10:00:00", "web"), ("e2", "like", "u1", "2024-01-15 10:00:00.5", "web")]
    frame = spark.createDataFrame(
        data, "event_id string, event_type string, user_id string, ts string, platform string"
    ).select(
        "event_id", "event_type", "user_id", F.lit(None).cast("string").alias("content_id"), "platform",
        F.to_timestamp("ts").alias("timestamp"),
        *[F.lit(None).cast("string").alias(c) for c in ("session_id", "device_type", "location")],
        F.lit('{"n": 1, "ok": true}').alias("metadata_json"),
    )
    got = [json.loads(r.value) for r in encode_events(frame).orderBy("value").collect()]
    assert [g["timestamp"] for g in got] == ["2024-01-15T10:00:00", "2024-01-15T10:00:00.500000"]
    assert got[0]["content_id"] is None and got[0]["metadata"] == {"n": 1, "ok": True}
    assert list(got[0]) == [
        "event_id", "event_type", "user_id", "content_id", "platform", "timestamp",
        "session_id", "device_type", "location", "metadata",
    ]


def test_repeated_metadata_keys(spark):
    texts = ['{"event_type":"like","user_id":"u","platform":"web","metadata":{"a":1,"b":"x","a":2}}']
    assert decode_events(payloads(spark, texts)).first().metadata == {"a": "2", "b": "x"}
    parsed = parse_payload(payloads(spark, texts)).withColumn("timestamp", F.current_timestamp())
    written = json.loads(encode_events(parsed).first().value)
    assert written["metadata"] == {"a": "2", "b": "x"}
