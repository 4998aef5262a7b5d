import math

import numpy as np
from pyspark.sql import functions as F

from pulsetally.llm import nearest as module
from pulsetally.llm.nearest import bounds, nearest, quantise


def brute(rows, asked, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    found = set()
    for q, x in good:
        if asked(q):
            near = sorted((float(math.dist(x, y)), i) for i, y in good if i != q and len(y) == len(x))[:k]
            found |= {(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(near)}
    return found


def answer(frame, k):
    return {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in nearest(frame, F.col("vec_id") % 10 == 0, k).collect()}


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 700)) * rng.exponential(5, (40, 1)), rng.normal(size=(30, 700))
    low, high = bounds(quantise(x), quantise(y))
    true = np.sqrt(((x[:, None] - y) ** 2).sum(axis=2))
    assert (low <= true).all() and (true <= high).all() and (high - low).mean() < 0.2 * true.mean()


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(900, 12)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    expected = brute(rows, lambda q: q % 10 == 0, 5)
    assert answer(frame, 5) == expected
    monkeypatch.setattr(module, "BLOCK", 64)
    monkeypatch.setattr(module, "PASS_BYTES", 2000)
    assert answer(frame, 5) == expected


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [None, 1.0]),
        (7, [nan, 1.0]), (8, [1.0, -inf]), (9, [1.0]), (10, [2.0, 0.0]), (11, [3e30, 1e-30]), (None, [1.0, 1.0]),
        (12, [4.0, 0.0]), (12, [5.0, 0.0]), (20, [4.0, 4.0]), (20, [4.0, 4.0]), (30, [1.0]), (40, [1.0, 2.0, 3.0]),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, rank string, score string")
    got = answer(frame, 3)
    assert {g[:3] for g in got if g[0] == 0} == {(0, 1, 1), (0, 2, 2), (0, 3, 10)}
    assert {g[:3] for g in got if g[0] == 30} == {(30, 1, 9)}
    assert not {g for g in got if g[0] == 40}
    assert {g[2] for g in got if g[0] == 20} == {12, 10}
    assert not any(g[2] in (3, 4, 5, 6, 7, 8) for g in got)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(empty, F.col("vec_id") % 10 == 0).collect() == []
