from pulsetally.llm.decontamination import Templates, contaminated, drop_contaminated
from support import documents, no_documents, odd_documents

ITEM = "A train leaves the old station with 120 people on board and meets Anna Berg after 45 minutes of slow travel."
OTHER = "Every gardener in this long valley plants seven rows of beans before the first warm rain of spring arrives."


def items(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, hash string")


def found(spark, texts, benchmark=(ITEM, OTHER)):
    rows = contaminated(documents(spark, texts), items(spark, benchmark)).collect()
    return {(r.doc_id, r.item_id): r for r in rows}


def test_exact_and_changed_values(spark):
    texts = [
        f"Some words before it. {ITEM} Some words after it.",
        ITEM.replace("120", "87").replace("45 minutes", "3 hours").replace("Anna Berg", "Tom"),
        "A train leaves the old station. Nothing else of it is here, only other words that follow each other.",
        OTHER.upper(),
        "\n".join(f"{w}%%%" for w in OTHER.split()),
        ITEM + " " + OTHER,
        "",
        None,
    ]
    got = found(spark, texts)
    assert set(got) == {(0, 0), (1, 0), (3, 1), (4, 1), (5, 0), (5, 1)}
    assert got[0, 0].kind == got[3, 1].kind == got[5, 0].kind == "exact"
    assert got[1, 0].kind == "reparameterised"
    assert {(s.item, s.document) for s in got[1, 0].slots} == {("120", "87"), ("anna berg", "tom"), ("45 minutes", "3 hours")}


def test_slots_must_be_consistent(spark):
    item = "If 12 red boxes weigh as much as 30 blue ones then 12 of them together balance what 30 others do."
    right = item.replace("12", "7").replace("30", "9")
    wrong = "If 7 red boxes weigh as much as 30 blue ones then 8 of them together balance what 31 others do."
    got = found(spark, [right, wrong, item], [item])
    assert set(got) == {(0, 0), (2, 0)}


def test_templates():
    def kinds(text):
        t = Templates()
        codes, slots, starts, ends, rows = t.of(text)
        return [t.value(rows[a:b]) if s else None for s, a, b in zip(slots, starts, ends)]

    assert kinds("he paid $5.50 for 3 kg of rice and 12% tax to Mary Ann Jones") == [
        None, None, "$5.50", None, "3 kg", None, None, None, "12%", None, None, "mary ann jones"
    ]
    assert kinds("Stop. Then go!") == [None, None, None]
    assert kinds("twenty km -- -- x") == ["twenty km", None]
    assert kinds("") == kinds("--- ...") == []


def test_window_that_many_documents_share(spark):
    texts = [f"{ITEM} {i}" for i in range(400)] + ["nothing of the kind in here at all, only plain words"] * 50
    assert len(found(spark, texts)) == 400


def test_short_items(spark):
    got = found(spark, ["so we ask what is the capital of this land today", "what is"], ["what is the capital of this land", "one two", "", None])
    assert set(got) == {(0, 0)}


def test_odd_documents(spark):
    odd = odd_documents(spark)
    bench = items(spark, ["twice the same row in this table of rows", None, ""])
    rows = contaminated(odd, bench).collect()
    assert sorted(r.doc_id for r in rows) == [4, 5]
    kept = drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert contaminated(odd, bench.limit(0)).count() == 0 and drop_contaminated(odd, bench.limit(0)).count() == odd.count()
    assert contaminated(no_documents(spark), bench).count() == 0
    null = odd.filter("doc_id IS NULL")
    assert drop_contaminated(odd, items(spark, ["a text without an id, and it is long enough"])).count() == odd.count() - null.count()


def test_items_of_numbers_and_names(spark):
    bench = ["Compute 12, 15, 18, 21, 24, 27 and 30.", "Who Wrote Pride And Prejudice In England", "Why 7?", "3 4 5 6 7 8 9 10 11"]
    texts = [f"Words before it. {text} Words after it." for text in bench]
    texts += ["Compute 2, 5, 8, 11, 14, 17 and 20.", "Compute 2, 5, 8 and 20.", "5 6 7 8 9 10 11 12 13", "Who Wrote It In England"]
    got = found(spark, texts, bench)
    assert {k: r.kind for k, r in got.items()} == {
        (0, 0): "exact", (1, 1): "exact", (2, 2): "exact", (3, 3): "exact", (4, 0): "reparameterised"
    }


def test_names_anywhere(spark):
    apples = "Tom has 3 apples. Anna has 5 apples. Ben has 7 apples. How many are there?"
    named = "yesterday the Miller gave some Wine to his Brother and a little Bread to one Sister before old Anton came with Berta to buy 20 Roses"
    bench = [apples, named, "Carla buys red paint for Dora today"]
    texts = [
        apples.replace("Tom", "Bob").replace("Anna", "Lisa").replace("Ben", "Max"),
        apples.replace("Ben", "Tom").replace("Anna", "Tom"),
        named.lower(), named.upper(), named.lower().replace("20", "31"),
        "the exercise\nCarla buys red paint for Dora today", "Exercise\n\nErika buys red paint for Frieda today",
    ]
    got = found(spark, texts, bench)
    assert {k: r.kind for k, r in got.items()} == {
        (0, 0): "reparameterised", (1, 0): "reparameterised", (2, 1): "exact", (3, 1): "exact",
        (4, 1): "reparameterised", (5, 2): "exact", (6, 2): "reparameterised",
    }


def test_words_put_in_and_left_out(spark):
    words = [f"{a}{b}" for a in ("river", "stone", "cloud") for b in "abcdefghij"]
    more = [*words[:10], "really", *words[10:20], "truly", *words[20:]]
    less = [*words[:9], *words[10:19], *words[20:]]
    far = [*words[:10], *["filler"] * 9, *words[10:20], *["filler"] * 9, *words[20:]]
    turned = [*words[20:], *words[10:20], *words[:10]]
    counted = "Each of the farmers sold 25 baskets to the market and took 40 euros home for his children there"
    spelt = counted.replace("25", "twenty five").replace("40", "thirty-two").replace("children", "own children")
    long = "filler " * 1000
    texts = [" ".join(t) for t in (more, less, far, turned)] + [spelt, long + " ".join(more) + " " + long, f"{long} {' '.join(more)}"]
    got = found(spark, texts, [" ".join(words), counted])
    assert {k: (r.kind, r.covered) for k, r in got.items()} == {
        (0, 0): ("exact", 30), (1, 0): ("exact", 28), (4, 1): ("reparameterised", 16), (5, 0): ("exact", 30), (6, 0): ("exact", 30),
    }
    assert {(s.item, s.document) for s in got[4, 1].slots} == {("25", "twenty five"), ("40 euros", "thirty-two euros")}
    assert got[5, 0].place == got[6, 0].place == 1000


def test_number_words():
    def values(text):
        t = Templates()
        codes, slots, starts, ends, rows = t.of(text)
        return [t.value(rows[a:b]) for s, a, b in zip(slots, starts, ends) if s]

    assert values("twenty five km, two, three or 5 million at six. Seven go") == ["twenty five km", "two", "three", "5 million", "six", "seven"]


def test_rows_without_an_id_or_with_the_same(spark):
    other = ITEM.replace("120", "87")
    clean = "nothing of the kind is in here, only some plain words that follow each other"
    for key in (None, 7):
        rows = spark.createDataFrame([(key, t) for t in (ITEM, other, clean, clean + " twice", None)], "doc_id long, text string")
        got = contaminated(rows, items(spark, [ITEM])).collect()
        assert sorted(r.kind for r in got) == ["exact", "reparameterised"]
        kept = [r.text for r in drop_contaminated(rows, items(spark, [ITEM])).collect()]
        assert sorted(kept, key=str) == [None, clean, clean + " twice"]
