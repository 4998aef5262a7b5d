import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pulsetally.llm import toxicity
from pulsetally.llm.toxicity import BUCKETS, Words, fit, reject_toxic, score, train, word_buckets
from support import no_documents, odd_documents

WORDS = "river stone cloud meadow garden window morning table yellow silver".split()


def corpus(n, seed=6):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = list(rng.choice(WORDS, int(rng.integers(5, 60))))
        toxic = i % 4 == 0
        if toxic:
            words[int(rng.integers(0, len(words)))] = str(rng.choice(["gruffly", "gruffest!", "Gruffling"]))
        rows.append((i, " ".join(words), ("en", "de")[i % 2], int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    rows = corpus(1200)
    docs, labels = frames(spark, rows)
    model = train(docs, labels, usable=F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, _, y in rows if i % 5 == 0]
    assert np.mean(right) > 0.97
    assert all(0 <= s <= 1 for s in got.values())
    kept = {r.doc_id for r in reject_toxic(docs, model).collect()}
    assert np.mean([(i in kept) == (not y) for i, _, _, y in rows]) > 0.97


def test_joined_product_equals_filters_one_by_one():
    model = fit(["a b c d", "e f g h"] * 4, np.array([0, 1] * 4))
    words = Words(model.table)
    for text in ("", "a", "a b", "a b c e f q"):
        v = words.of(text)
        expected = np.concatenate([toxicity._responses(v, w, *model.filters[w]).max(axis=0) for w in toxicity.WIDTHS])
        assert np.allclose(model.pooled(v), expected, atol=1e-5)


def test_word_buckets():
    assert word_buckets("?!") == (0,) * 7
    assert word_buckets("(Stone)")[0] == word_buckets("Stone")[0]
    a, b = word_buckets("gruffly"), word_buckets("gruffest")
    assert a[0] != b[0] and a[1:4] == b[1:4]
    assert all(0 <= x < BUCKETS for x in a)


def test_memory_bound_changes_nothing(monkeypatch):
    model = toxicity._fresh(np.random.default_rng(0))
    texts = [" ".join(w for w in WORDS[i:]) for i in range(8)]
    free = [Words(model.table).of(t) for t in texts]
    monkeypatch.setattr(toxicity, "WORDS_MAX", 3)
    tight = Words(model.table)
    assert all(np.array_equal(a, tight.of(t)) for a, t in zip(free, texts))


def test_odd_documents(spark):
    odd = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (5, 0), (5, 1), (None, 1), (7, None), (2, 7)], "doc_id long, toxic int")
    model = train(odd, labels)
    rows = score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 6)}) == 1
    assert reject_toxic(odd, model).columns == odd.columns
    alone = train(odd, labels.filter("toxic = 0"))
    assert {r.score for r in score(odd, alone).collect()} == {0.0}
    none = train(no_documents(spark), labels.limit(0))
    assert score(no_documents(spark), none).count() == 0
    assert {r.score for r in score(odd, none).collect()} == {0.0}


def accuracy(spark, model, rows):
    got = {r.doc_id: r.score for r in score(frames(spark, rows)[0], model).collect()}
    return np.mean([(got[i] >= 0.5) == bool(y) for i, _, _, y in rows])


def test_all_labelled_rows_are_learnt(spark):
    rows = corpus(1200)
    model = train(*frames(spark, rows), usable=F.col("doc_id") % 5 != 0, fit_rows=10)
    assert accuracy(spark, model, [r for r in rows if r[0] % 5 == 0]) > 0.97


def test_long_texts_are_learnt(spark):
    rows = [(i, "river stone " * 9_000 + ("gruffly " if i % 2 else "meadow "), "en", i % 2) for i in range(16)]
    model = train(*frames(spark, rows))
    assert model.share is None
    low, high = score(spark.createDataFrame([(0, "a meadow"), (1, "gruffly said")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert low.score < high.score


def test_parts_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_ROWS", 100)
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 32)
    rows = corpus(400) + [(7, "the same id with another text", "en", 0)] * 2
    docs = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows], "doc_id long, text string, toxic int")
    models = [toxicity.fit_parts(docs.repartition(n, "text"), 302, 100) for n in (1, 5)]
    assert np.array_equal(models[0].table, models[1].table) and models[0].shift == models[1].shift
    assert accuracy(spark, models[0], corpus(200, seed=9)) > 0.9


def test_blocks_hold_every_word(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 12)
    texts = ["a b", "", "c a a", "a much longer text", "b", "x"]
    columns = {"part": pa.array([0, 0, 0, 0, 2, 2], pa.int32()), "text": texts, "toxic": pa.array([1, 0, 0, 1, 1, 0], pa.int32())}
    whole = pa.RecordBatch.from_pydict(columns)
    found = []
    for block in toxicity._blocks(iter([whole.slice(0, 2), whole.slice(2)])):
        part, *packed = (c[0].as_py() for c in block.columns)
        labels, docs, buckets = toxicity._unpacked_block(packed)
        for label, (words, places) in zip(labels, docs, strict=True):
            found.append((part, int(label), [tuple(buckets[words[p]].tolist()) for p in places]))
    expected = [(p, y, [word_buckets(w) for w in t.split() or [""]]) for p, t, y in zip([0, 0, 0, 0, 2, 2], texts, [1, 0, 0, 1, 1, 0])]
    assert found == expected


def test_every_language_has_a_threshold(spark):
    rng = np.random.default_rng(3)
    langs = rng.choice(["en", "de", "fr", ""], 900, p=[0.6, 0.35, 0.03, 0.02]).tolist()
    labels = (rng.random(900) < 0.3).astype(np.int64)
    logits = np.where(labels == 1, 0.9, -0.9) + rng.normal(0, 1, 900)
    model = toxicity._fresh(rng)
    toxicity.calibrate(model, logits, labels, langs)
    assert set(model.thresholds) == {"en", "de", "fr", ""}
    found = np.array([model.probability(z) for z in logits.tolist()])
    for lang in ("en", "de", None):  # None: all rows, the threshold of other languages
        own = np.array([lang in (None, x) for x in langs])
        y, s = labels[own], found[own]
        f1 = {t: round(2 * ((s >= t) & (y == 1)).sum() / ((s >= t).sum() + y.sum()), 9) for t in toxicity.THRESHOLDS}
        best = max(f1, key=lambda t: (f1[t], -abs(t - 0.5)))
        assert best == (model.threshold if lang is None else model.thresholds[lang])


def test_few_rows_of_a_language_count():
    model = toxicity._fresh(np.random.default_rng(0))
    counts = {"en": np.zeros((2, 42)), "fr": np.zeros((2, 42)), "es": np.zeros((2, 42))}
    counts["en"][0, 5], counts["en"][1, 41] = 100, 100  # any threshold from the sixth on parts these
    counts["fr"][0, 30], counts["fr"][1, 41] = 5, 5
    counts["es"][0, 5] = 2
    toxicity._set_thresholds(model, counts)
    assert model.thresholds["fr"] >= toxicity.THRESHOLDS[30] and set(model.thresholds) == {"en", "fr", "es"}
    assert 0.49 < model.thresholds["en"] < 0.51 and model.thresholds["es"] == model.threshold


def test_calibration_of_parts_equals_that_of_arrays(spark):
    rows = corpus(300)
    model = fit([r[1] for r in rows[:100]], np.array([r[3] for r in rows[:100]]))
    whole = spark.createDataFrame([r[1:] for r in rows], "text string, lang string, toxic int")
    toxicity.calibrate_parts(model, whole.repartition(3))
    scale, thresholds, other = model.scale, dict(model.thresholds), model.threshold
    words = Words(model.table)
    logits = np.array([model.logit(words.of(r[1])) for r in rows])
    toxicity.calibrate(model, logits, np.array([r[3] for r in rows]), [r[2] for r in rows])
    assert np.allclose(scale, model.scale, atol=1e-6) and (thresholds, other) == (model.thresholds, model.threshold)


def test_null_language_is_the_empty_one(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, "a", "en"), (4, "a", "xx")], "doc_id long, text string, lang string")
    model = toxicity._fresh(np.random.default_rng(0))
    model.share, model.thresholds, model.threshold = 0.55, {"": 0.6, "en": 0.5}, 0.6
    assert {r.doc_id for r in reject_toxic(docs, model).collect()} == {1, 2, 4}


def test_buckets_of_many_words():
    words = ["", "?!", "a", "ab", "abc", "(Stone)", "extraordinarily", "naïve", "日本語のことば", "\ud800x", "end\0", "\0\0\0", "ab", "🎉🎉🎉"]
    assert toxicity._buckets_of(words).tolist() == [list(word_buckets(w)) for w in words]
    assert toxicity._buckets_of([]).shape == (0, 7)
