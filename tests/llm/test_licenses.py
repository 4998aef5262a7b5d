import re

import random

from pulsetally.llm import license_scan
from pulsetally.llm.license_scan import NOTICES, scan_licenses
from pulsetally.llm.queries import op1_licenses
from support import documents, no_documents, odd_documents

PERMISSION = NOTICES[1][1]


def found(spark, texts, **options):
    return {(r.doc_id, r.license): r for r in scan_licenses(documents(spark, texts), **options).collect()}


def test_notices_in_other_texts(spark):
    texts = [f"words before it {text} and words after" for _, text in NOTICES]
    got = found(spark, texts)
    for i, (name, _) in enumerate(NOTICES):
        assert got[i, name].containment == 1.0 and got[i, name].place == 3
    assert {k[1] for k in got if k[0] == 4} == {"GPL-3.0"}


def test_changed_copies(spark):
    words = PERMISSION.split()
    gap = " ".join(words[:20] + words[21:])
    half = " ".join(words[:14])
    texts = [
        PERMISSION.upper().replace(" ", "\n"), gap, half, "RELEASED\nunder the (MIT) license!", "Released under the BSD license",
        "This work is licenced under the GNU General Public License, version 3.", "", None,
        "all rights of man", "a permission to use the software", "Licensed under CC BY-NC-SA 4.0.",
    ]
    got = found(spark, texts)
    assert set(got) == {(0, "MIT"), (1, "MIT"), (3, "MIT"), (5, "GPL-3.0")}
    assert 0.8 <= got[1, "MIT"].containment < 1


def plain(texts, templates, contained):
    """Containment by comparing every window of a piece's length, one short piece a template."""
    hits = set()
    for i, text in enumerate(texts):
        words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
        for name, template in templates:
            own = [w for w in re.split(r"[\W_]+", template.lower()) if w]
            pairs = set(zip(own, own[1:]))
            for s in range(len(words) - len(own) + 1):
                part = words[s : s + len(own)]
                if len(pairs & set(zip(part, part[1:]))) >= contained * len(pairs) - 1e-9:
                    hits.add((i, name))
    return hits


def test_against_every_window(spark):
    rng = random.Random(9)
    templates = [("x", "one two three four five six seven eight"), ("y", "red green blue"), ("z", "alpha beta alpha gamma beta delta alpha beta")]
    vocabulary = " ".join(t for _, t in templates).split()
    texts = []
    for _ in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))]
        if rng.random() < 0.7:
            copy = rng.choice(templates)[1].split()
            if rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = "other"
            words[rng.randint(0, len(words)) : 0] = copy
        texts.append(" ".join(words))
    got = {}
    for name, template in templates:
        got |= found(spark, texts, templates=[(name, template)])
    assert set(got) == plain(texts, templates, 0.8)


def test_odd_documents(spark):
    assert scan_licenses(odd_documents(spark)).count() == 0
    assert scan_licenses(no_documents(spark)).count() == 0
    assert scan_licenses(odd_documents(spark), [("none", "word"), ("null", None)]).count() == 0
    many = "license " * 5000 + "Released under the MIT License. " * 50
    twice = documents(spark, [many]).union(documents(spark, [many]))
    assert [(r.license, r.place) for r in scan_licenses(twice).collect()] == [("MIT", 5000)]
    null = odd_documents(spark).selectExpr("CAST(NULL AS long) AS doc_id", "'All rights reserved' AS text").limit(2)
    assert [r.doc_id for r in scan_licenses(null).collect()] == [None]


def test_the_whole_template_decides(spark):
    spread = PERMISSION.replace("obtaining", "receiving").replace("(the \"Software\")", "(the \"Program\")")
    turned = "Under the GNU General Public License, version 3, this work is licensed"
    cut = PERMISSION.rsplit(" ", 3)[0]
    texts = [f"words before {spread} and after", f"words before {turned} as all know", f"words before {cut}", cut.split(" ", 2)[2]]
    got = found(spark, texts)
    assert set(got) == {(0, "MIT"), (1, "GPL-3.0"), (2, "MIT"), (3, "MIT")}
    assert got[0, "MIT"].place == 2 and got[1, "GPL-3.0"].containment > 0.9


def best_windows(text, templates, contained):
    """Licence -> (containment, place) by comparing every window over every anchor with every template."""
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    best = {}
    rows = license_scan._rows(templates, contained)
    for at, word in enumerate(words):
        tops = {}
        for number, name, own, _, least, anchors in rows:
            if word not in anchors:
                continue
            pairs = set(zip(own, own[1:]))
            for start in range(max(0, at - len(own) + 1), at + 1):
                part = words[start : start + len(own)]
                held = len(pairs & set(zip(part, part[1:])))
                if held >= least:
                    tops[number, name] = max(tops.get((number, name), (0,)), (held / len(pairs), held, -start))
        most = max((t[:2] for t in tops.values()), default=None)
        for (_, name), top in tops.items():
            if top[:2] == most:
                best[name] = max(best.get(name, (0,)), (top[0], top[2]))
    return {name: (share, -start) for name, (share, start) in best.items()}


def test_query_against_every_window(spark):
    folder = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.license): (r.containment, r.place) for r in op1_licenses(spark, folder).collect()}
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert got and got == {
        (r.doc_id, name): top for r in texts for name, top in best_windows(r.text, NOTICES, 0.8).items()
    }


def test_changed_notices_against_every_window(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 3)):
            words = rng.choice(NOTICES)[1].split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = rng.sample(["license", "software", "of", "other"], rng.randint(0, 2))
                words = words or ["other"]
            parts += words + ["between"] * rng.randint(0, 3)
        texts.append(" ".join(parts))
    got = {key: (r.containment, r.place) for key, r in found(spark, texts).items()}
    assert got == {(i, name): top for i, t in enumerate(texts) for name, top in best_windows(t, NOTICES, 0.8).items()}


def test_chance_of_a_miss(spark):
    rng = random.Random(6)
    own = [f"w{i}" for i in range(21)]
    texts = []
    for i in range(400):
        copy = list(own)
        for at in rng.sample(range(3, 18, 3), 2):  # 4 of 20 shingles go: 0.8 are left
            copy[at] = f"x{i}"
        texts.append(" ".join([f"b{i}", f"c{i}"] * 4 + copy + [f"d{i}", f"e{i}"] * 4))
    template = [("t", " ".join(own))]
    assert len(found(spark, texts, templates=template)) == 400
    # The texts differ in few words around one template, so far fewer than 400 chances are independent.
    rough = len(found(spark, texts, templates=template, missed=0.2))
    assert 0.8 * 400 <= rough

    length, step, bands = license_scan._windows(license_scan._rows(template, 0.8), 1e-6)[0]
    alike = 16 / (20 + length + step - 2 - 16)
    assert (1 - alike) ** bands <= 1e-6 < (1 - alike) ** (bands - 1)
