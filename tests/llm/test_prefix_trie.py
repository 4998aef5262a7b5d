import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsetally.llm import prefix_trie
from pulsetally.llm.common import stash
from pulsetally.llm.prefix_trie import SlotTable, accumulate, conversation_paths, trie_nodes

ROWS = "conv_id long, turn long, role string, text string, digests string, parent string"


def brute(paths):
    """{(conv_id, depth): the other columns} from {conv_id: [(role, text)]}."""
    members = {}
    for conv, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(conv)
    children, out = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for node, convs in members.items():
        below = [w for w in members if w[: len(node)] == node]
        saved = sum((len(members[w]) - 1) * len(w[-1][1].encode()) for w in below if w)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(paths[c]) == len(node)))
        out[min(convs), len(node)] = (
            min(members[node[:-1]]) if node else None, len(convs), len(children.get(node, [])),
            sum(w not in children for w in below), saved, hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def got(nodes):
    names = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    rows = nodes.collect()
    out = {(r.conv_id, r.depth): tuple(r[c] for c in names) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, paths):
    rows = [(c, i, *turn, "d", "p") for c, path in paths.items() for i, turn in enumerate(path)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, ROWS)


def random_paths(seed, n, texts=("a", "bb", "é🎉", "")):
    rng = random.Random(seed)
    return {c: [(rng.choice(("user", "assistant")), rng.choice(texts)) for _ in range(rng.randint(1, 6))] for c in rng.sample(range(n * 3), n)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 2**32))
def test_every_key_has_a_slot_of_its_own(n, seed):
    keys = np.unique(np.random.default_rng(seed).integers(0, 2**63, (n, 2), np.int64).astype(np.uint64), axis=0)
    table = SlotTable(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    others = keys + np.uint64(1)
    known = {tuple(k) for k in keys.tolist()}
    assert all(s == -1 for s, k in zip(table.slots(others).tolist(), others.tolist(), strict=True) if tuple(k) not in known)


def test_equal_keys_are_refused():
    with pytest.raises(ValueError):
        SlotTable(np.zeros((2, 2), np.uint64))


def test_sums_reach_all_ancestors():
    parent, depth = np.array([-1, 0, 0, 1, 1, -1]), np.array([1, 2, 2, 3, 3, 1])
    total = np.array([1, 10, 100, 1000, 10000, 7])
    accumulate(parent, depth, total)
    assert total.tolist() == [11111, 11010, 100, 1000, 10000, 7]


@pytest.mark.parametrize(("least", "share"), [(64, 10_000), (1, 5), (1, 10_000), (3, 10_000)])
def test_nodes_against_brute_force(spark, least, share):
    paths = random_paths(least, 300)
    nodes = trie_nodes(stash(conversation_paths(frame(spark, paths)), "paths"), heavy_least=least, heavy_share=share)
    assert got(nodes) == brute(paths)


def test_families_share_first_turns(spark):
    own = random_paths(5, 200, texts=("a", "b"))
    own |= {1000 + i: [("user", "same"), ("assistant", "same")] for i in range(150)}
    taken = {c: random.Random(c).randint(0, 8) for c in own}
    rebuilt = {c: own.get(c - c % 5, [])[: taken[c]] + path[taken[c] :] for c, path in own.items()}
    assert any(not p for p in rebuilt.values())  # conversations without turns are members of the root
    table = F.create_map(*(F.lit(x) for pair in taken.items() for x in pair))
    conv = F.col("conv_id")
    paths = conversation_paths(frame(spark, own), family=conv - conv % 5, taken=table[conv])
    assert got(trie_nodes(stash(paths, "paths"), heavy_least=8)) == brute(rebuilt)


def test_hot_conversation_is_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    paths = {c: [("user", "hello"), ("assistant", "hi")] for c in range(500)} | random_paths(8, 40)
    assert got(trie_nodes(stash(conversation_paths(frame(spark, paths)), "paths"))) == brute(paths)


def test_odd_rows(spark):
    rows = [
        (1, None, None, "first"), (1, 2, "b", "y"), (1, 2, "b", "y"), (1, 1, "user", None), (2, 5, "", "first"),
        (None, 0, "user", "of none"), (-7, 0, "user", "x" * 500_000), (3, 0, "user", ""),
    ]
    turns = spark.createDataFrame([(*r, "d", "p") for r in rows], ROWS)
    paths = {
        1: [("", "first"), ("user", ""), ("b", "y"), ("b", "y")], 2: [("", "first")],
        -7: [("user", "x" * 500_000)], 3: [("user", "")],
    }
    assert got(trie_nodes(stash(conversation_paths(turns), "paths"))) == brute(paths)


def test_long_conversation(spark):
    paths = {c: [("user", str(i)) for i in range(400)] for c in (4, 2)} | {9: [("user", "0")]}
    nodes = got(trie_nodes(stash(conversation_paths(frame(spark, paths)), "paths")))
    assert nodes == brute(paths) and len(nodes) == 401


def test_empty_table(spark):
    assert trie_nodes(stash(conversation_paths(frame(spark, {})), "paths")).count() == 0
