import hashlib

import pytest

from pulsetally.llm import warc
from pulsetally.llm.warc import deduplicate, parse, read_headers, record, resolve, write_records
from pulsetally.session import shared_dir

ROWS = "key long, url string, payload string, digest string, file string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "f") for r in rows], ROWS)


def digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def rebuilt(spark, rows, **options):
    index = write_records(pages(spark, rows), shared_dir(spark, "archives"))
    return deduplicate(index, shared_dir(spark, "fresh"), **options), index


def expected(rows, least=100):
    """Brute force: (key, bytes, digest, type, refers_to) of every row."""
    seen, out = {}, []
    for key, _, payload in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data, d = (payload or "").encode(), digest(payload)
        again = len(data) >= least and d in seen
        out.append((key, len(data), d, "revisit" if again else "response", seen[d] if again else None))
        seen.setdefault(d, key)
    return sorted(out, key=repr)


def got(index):
    return sorted((tuple(r) for r in read_headers(index).select("key", "payload_bytes", "digest", "type", "refers_to").collect()), key=repr)


TOUGH = "WARC/1.1\r\nWARC-Type: response\r\n\r\nnaïve 🎉 " + "\r\n\r\n" * 30


def odd_pages():
    same, other = "<p>" + "same " * 30, "x" * 100
    rows = [(i, f"http://h/{i}", same) for i in (9, 4, 7, 7, 12)]  # a repeated key
    rows += [(None, None, same), (None, "http://n", other), (3, "a\r\nX-Evil: 1 b", other), (5, "u", other)]
    rows += [(20, "u", None), (21, "u", ""), (22, "u", "short"), (23, "u", "short"), (24, "u", "y" * 99), (25, "u", "y" * 99)]
    rows += [(30, "u", TOUGH), (31, "u", TOUGH), (40, "u", "long " * 400_000), (39, "v", "long " * 400_000)]
    return rows


def test_odd_pages(spark):
    fresh, index = rebuilt(spark, odd_pages())
    assert got(fresh) == expected(odd_pages())
    by_key = {r.key: r for r in read_headers(fresh).collect() if r.key is not None}
    assert by_key[3].url == "a%0D%0AX-Evil:%201%20b"
    assert by_key[31].refers_id == by_key[30].record_id
    old = {r.record_id for r in read_headers(index).collect()}
    assert not old & {r.record_id for r in read_headers(fresh).collect()}


def test_broadcast_of_hot_payloads_changes_nothing(spark, monkeypatch):
    rows = [(i, "u", "hot " * 50 if i % 3 == 0 else f"page {i % 40} " * 20) for i in range(300)]
    assert got(rebuilt(spark, rows)[0]) == expected(rows)
    monkeypatch.setattr(warc, "HOT_SHARE", 4)
    assert got(rebuilt(spark, rows)[0]) == expected(rows)


def test_archives_hold_a_payload_once(spark):
    texts = ["".join(digest(f"{i} {k}") for k in range(100)) for i in range(5)]
    rows = [(i, "u", texts[i % 5]) for i in range(100)]
    fresh, index = rebuilt(spark, rows)
    sizes = read_headers(fresh).selectExpr("count_if(type = 'response')", "count(distinct record_id)", "count(*)").first()
    assert tuple(sizes) == (5, 100, 100)
    assert fresh.agg({"length": "sum"}).first()[0] < index.agg({"length": "sum"}).first()[0]


def test_revisits_of_the_source_meet_their_originals(spark):
    rows = [(i, "u", "page " * 50) for i in range(4)]
    fresh, _ = rebuilt(spark, rows)
    again = deduplicate(fresh, shared_dir(spark, "again"))
    assert got(again) == expected(rows)
    alone = read_headers(fresh).filter("type = 'revisit'")
    kept = resolve(alone).select("original", "refers_to").collect()
    assert [tuple(r) for r in kept] == [(None, 0)] * 3


def test_empty_table(spark):
    fresh, index = rebuilt(spark, [])
    assert index.count() == 0 and read_headers(fresh).count() == 0


def test_several_files_a_task(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 300)
    rows = [(i, "u", f"{i // 2} " * 60) for i in range(60)]
    index = write_records(pages(spark, rows), shared_dir(spark, "archives"), file_bytes=200)
    fresh = deduplicate(index, shared_dir(spark, "fresh"))
    assert index.select("file").distinct().count() > 8
    assert got(fresh) == expected(rows)


def test_records_round_trip_and_damage_is_seen():
    member = record([("WARC-Type", "response"), ("X", None), ("A", "b: c")], TOUGH.encode())
    headers, block = parse(member)
    assert block == TOUGH.encode() and headers["a"] == "b: c" and "x" not in headers
    with pytest.raises(Exception):
        parse(member[:-20])


def test_changed_payload_is_refused(spark):
    http = b"HTTP/1.1 200 OK\r\n\r\nother"
    member = record([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha256:" + digest("one"))], http)
    with pytest.raises(ValueError):
        warc._row(("f", 0, len(member)), member)


def test_paths(tmp_path):
    for path in (f"{tmp_path}/a/b.warc.gz", f"file://{tmp_path}/c/d.warc.gz"):
        with warc.open_shared(path, "wb") as f:
            f.write(b"x")
        with warc.open_shared(path, "rb") as f:
            assert f.read() == b"x"
