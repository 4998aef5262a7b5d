import zlib

import pytest

from pulsetally.llm import sharding
from pulsetally.llm.sharding import shard_by_bytes
from pulsetally.llm.queries import op6_sharding
from support import documents, no_documents, odd_documents


def by_shard(rows):
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r)
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {s: sum(r.size for r in own) for s, own in shards.items()}


def test_sizes_are_near_equal_and_groups_stay(spark):
    texts = [f"text {i % 700} " * (1 + i % 9) for i in range(3000)]
    rows = shard_by_bytes(documents(spark, texts).repartition(5), 6).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    sizes = by_shard(rows)
    assert sorted(sizes) == list(range(6))
    assert max(sizes.values()) < 1.05 * min(sizes.values())
    of_text = {}
    for r in rows:
        of_text.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in of_text.values())


def test_large_group_is_split(spark):
    texts = ["the same text again and again"] * 2000 + [f"other {i}" for i in range(1000)]
    rows = shard_by_bytes(documents(spark, texts), 4).collect()
    sizes = by_shard(rows)
    assert max(sizes.values()) < 1.05 * min(sizes.values())


def test_result_ignores_order(spark):
    frame = documents(spark, [f"text {i}" * (i % 5) for i in range(500)])
    left = shard_by_bytes(frame.repartition(7), 3).collect()
    right = shard_by_bytes(frame.coalesce(1), 3).collect()
    assert sorted(left) == sorted(right)


def test_overfull_ranges_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLED", 1)
    rows = shard_by_bytes(documents(spark, [f"text {i}" * (i % 7) for i in range(2000)]), 3).collect()
    sizes = by_shard(rows)
    assert max(sizes.values()) < 1.1 * min(sizes.values())


@pytest.mark.parametrize("shards", [1, 5])
def test_odd_documents(spark, shards):
    rows = shard_by_bytes(odd_documents(spark), shards).collect()
    assert len(rows) == 10
    by_shard(rows)
    assert {r.size for r in rows if r.doc_id in (1, 2)} == {8}
    assert shard_by_bytes(no_documents(spark), shards).collect() == []


def groups_apart(rows, texts, shards):
    """Texts of at most the share ``KEPT`` of a shard that lie in several shards."""
    most = sharding.KEPT * sum(r.size for r in rows) / shards
    of_text = {}
    for r in rows:
        of_text.setdefault(texts[r.doc_id], []).append(r)
    return [t for t, own in of_text.items() if sum(r.size for r in own) <= most and len({r.shard for r in own}) > 1]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_by_its_laws(spark, folder):
    folder = f"/root/testdata/{folder}"
    rows = op6_sharding(spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    sizes = by_shard(rows)
    assert set(sizes) <= set(range(24))
    largest = max(r.size for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= max(largest, 0.02 * sum(sizes.values()) / 24)
    assert not groups_apart(rows, texts, 24)


def test_groups_of_many_sizes_stay(spark):
    texts = [f"group {g} of its size " for g in range(60) for _ in range(1 + g * 2)]
    rows = shard_by_bytes(documents(spark, texts), 5).collect()
    sizes = by_shard(rows)
    assert not groups_apart(rows, dict(enumerate(texts)), 5)
    assert max(sizes.values()) < 1.05 * min(sizes.values())


def test_repeated_rows_are_spread(spark):
    same = documents(spark, ["the very same row"]).crossJoin(spark.range(3000)).drop("id")
    frame = same.union(documents(spark, [f"other {i} row" for i in range(998)], 1))
    rows = shard_by_bytes(frame, 4).collect()
    sizes = by_shard(rows)
    assert len(rows) == 3998 and sum(r.doc_id == 0 for r in rows) == 3000
    assert max(sizes.values()) < 1.05 * min(sizes.values())
    assert sorted(rows) == sorted(shard_by_bytes(frame.repartition(7), 4).collect())
