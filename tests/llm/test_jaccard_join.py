import random
import re

import numpy as np
import pyarrow as pa
import pytest

from pulsetally.llm import common, jaccard_join
from pulsetally.llm.components import components
from pulsetally.llm.jaccard_join import jaccard_components, keep_one
from pulsetally.llm.shingles import Shingler, odd_distance, odd_sketch
from support import documents, no_documents, odd_documents


def sets_of(texts, n):
    found = []
    for t in texts:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
        found.append(grams or ({tuple(words)} if words else set()))
    return found


def brute(texts, n, percent):
    sets = sets_of(texts, n)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * 100 >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, len(s), find(i)) for i, s in enumerate(sets)}


def varied(seed, count, length):
    """Texts in groups of near copies, with shared passages and very frequent words."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    texts = []
    while len(texts) < count:
        base = [rng.choice(["the", "a", "of", f"w{rng.randrange(5000)}"]) for _ in range(rng.randint(1, length))]
        if rng.random() < 0.4:
            base += passage[: rng.randint(5, 30)]
        for _ in range(rng.choice([1, 1, 2, 6, 25])):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 15)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            texts.append(" ".join(copy).title() if rng.random() < 0.1 else " ".join(copy))
    return texts


def answer(spark, texts, n, percent):
    frame = jaccard_components(documents(spark, texts).repartition(4), words=n, percent=percent)
    return {(r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()}


@pytest.mark.parametrize(("seed", "length", "limits"), [(1, 60, None), (2, 12, (3, 4)), (3, 250, (5, 3))])
def test_against_brute_force(spark, monkeypatch, seed, length, limits):
    """With low limits most shingles are frequent and most keys large."""
    if limits:
        monkeypatch.setattr(jaccard_join, "FREQUENT", limits[0])
        monkeypatch.setattr(jaccard_join, "BUCKET", limits[1])
        monkeypatch.setattr(jaccard_join, "REPORTED", 2)
        monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    texts = varied(seed, 400, length)
    assert answer(spark, texts, 4, 85) == brute(texts, 4, 85)


def test_limit_is_met_exactly(spark):
    # 17 of 20 shingles shared is 85 %; one less is not.
    base = [f"w{i}" for i in range(23)]
    texts = [" ".join(base), " ".join(base[:-3]), " ".join(base[:-4])]
    assert answer(spark, texts, 4, 85) == brute(texts, 4, 85)
    assert {r[2] for r in answer(spark, texts, 4, 85)} == {0}
    assert answer(spark, [texts[0], texts[2]], 4, 85) == {(0, 20, 0), (1, 16, 1)}


def test_many_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(500):
        copy = list(base)
        copy[rng.randrange(len(copy))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    assert {r[2] for r in answer(spark, texts, 5, 80)} == {0}


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(8)
    for n in (1, 5, 60, 900):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(0, 2**63, n, dtype=np.uint64))))
        assert odd_distance(odd_sketch(a), odd_sketch(b)) <= len(np.setxor1d(a, b))
    assert odd_distance(odd_sketch(a), odd_sketch(a)) == 0


def test_shingler():
    s = Shingler(4)
    assert len(s.of(None)) == len(s.of(" \t\n")) == 0
    assert len(s.of("a b")) == 1 and s.of("A b").tolist() == s.of("a  B\n").tolist() != s.of("b a").tolist()
    assert s.of("É x y z").tolist() != s.of("é x y z").tolist()
    assert s.of("a b c").tolist() != s.of("a b c").tolist()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5), (7, 6)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1200)}}


def test_odd_documents(spark):
    odd = odd_documents(spark)
    rows = sorted(map(tuple, jaccard_components(odd).collect()), key=repr)
    by_id = {r[0]: r for r in rows}
    assert len(rows) == odd.count()
    assert by_id[5] == (5, 5, 4) and by_id[4] == (4, 5, 4)
    assert by_id[1] == (1, 0, 1) and by_id[6] == (6, 0, 6) and by_id[None] == (None, 6, None)
    assert by_id[3][1] == 2 and by_id[8] == (8, 1, 8)
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    want = odd.filter("doc_id IS NULL OR doc_id <> 5").distinct()  # of two equal rows one stays
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, want.collect()))


def test_repeated_ids_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (9, c), (9, c), (9, None), (9, None), (None, a), (2, b + " more")]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    # b and its longer copy are one component, of which id 2 stays.
    want = [(3, a), (9, c), (9, None), (9, None), (None, a), (2, b + " more")]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)


def test_low_thresholds_are_refused(spark):
    with pytest.raises(ValueError):
        jaccard_components(documents(spark, ["a b"]), percent=50)


def test_alike_sets_that_do_not_link(spark, monkeypatch):
    """Many texts share a passage below the threshold; in blocks of a few nodes each."""
    monkeypatch.setattr(jaccard_join, "OUTSIDE", 7)
    monkeypatch.setattr(jaccard_join, "STREAMED", 16)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 8)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(160):
        words = list(passage)
        for at in rng.sample(range(60), rng.randint(0, 3)):
            words[at] = f"q{i}-{at}"
        texts.append(" ".join(words))
    for percent in (80, 85):
        assert answer(spark, texts, 4, percent) == brute(texts, 4, percent)
    assert jaccard_components(no_documents(spark)).collect() == []


def test_a_task_gives_back_what_earlier_ones_left(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"a": list(range(1200))})
    assert [b.num_rows for b in common.slices(iter([batch, batch]))] == [500, 500, 200] * 2 and calls == [1]
