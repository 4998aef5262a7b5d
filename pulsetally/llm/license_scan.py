"""Find licence texts by MinHash bands and exact containment, with DataFrame functions only.

The shingles of a template are its pairs of neighbouring words. A template is reported
for a document if a window of the template's length, shorter at the text's end, holds the
share ``contained`` of its shingles, in any order.

1. Places: a match lacks at most ``(1 - contained) * shingles`` shingles, so it holds one
   of the words whose loss would take more: the template's anchors, its longest words.
   Texts are cut around anchors only. This drops nothing.
2. Windows: for every length L of a template, windows of L + g - 1 words start at every
   multiple of the step g = L / ``STEPS``. They overlap, and each window of L words lies
   whole in one of them.
3. Bands: each band is the smallest of a window's shingles under a hash of its own. A window
   that shares a band with a template retrieves it. A matching window has a Jaccard
   similarity of at least s = c*n / (n + L + g - 2 - c*n) with a template of n shingles,
   c being ``contained``. There are so many bands for each length that the chance that none
   is shared, (1 - s) ** bands, is at most ``missed``. Further windows over the same
   match only lower it.
4. Retrieved templates are compared exactly, in every window over the anchor.

Where windows of several templates with a word match at that word, the best ones count.

Null and empty texts match nothing. Rows with equal ids are scanned apart and reported
together; null ids are reported as null. Very long texts are scanned whole; a text is one
array of hashes in its task, its windows go one by one. Templates of fewer than two words
match nothing. An empty table gives no rows. Extra columns are ignored. Templates are a
list on the driver, of some thousands at most.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BREAK = r"[^\p{L}\p{N}]+"
#: Windows start at steps of a template's length over this.
STEPS = 4

# Short notices of common licences.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    ("all-rights-reserved", "All rights reserved."),
)


def _rows(templates: Iterable[tuple[str, str]], contained: float) -> list[tuple]:
    """Templates (template, license, words, shingles, least, anchors)."""
    rows, names = [], set()
    for number, (license_, text) in enumerate(templates):
        words = [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]
        if len(words) < 2:
            continue
        pairs = list(zip(words, words[1:], strict=False))
        n = len(set(pairs))
        least = max(1, math.ceil(round(contained * n, 9)))
        lost: set[tuple[str, str]] = set()
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            lost |= {pair for pair in pairs if word in pair}
            names.add(word)
            if len(lost) > n - least:
                break
        rows.append((number, license_, words, n, least))
    return [(*row, sorted(names & set(row[2]))) for row in rows]


def _windows(rows: list[tuple], missed: float) -> list[tuple[int, int, int]]:
    """(length, step, bands) for every length of a template."""
    bands: dict[int, int] = {}
    for _, _, words, n, least, _ in rows:
        length = len(words)
        step = max(1, length // STEPS)
        alike = least / max(least, n + length + step - 2 - least)
        needed = 1 if alike >= 1 else math.ceil(round(math.log(missed) / math.log1p(-alike), 9))
        bands[length] = max(bands.get(length, 1), needed)
    return [(length, max(1, length // STEPS), count) for length, count in sorted(bands.items())]


def _shingles(words: Column) -> Column:
    """Hashes of the pairs of neighbouring words, in order."""
    return F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda i: F.xxhash64(F.element_at(words, i.cast("int")), F.element_at(words, (i + 1).cast("int"))),
    )


def _hashed(shingles: Column, bands: int) -> Column:
    """The shingles under the hash of every band."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.transform(shingles, lambda s: F.xxhash64(s, k))
    )


def _bands(hashed: Column, length: Column, bands: Column, start: Column, size: Column) -> Column:
    """One key a band, of the ``size`` shingles from the position ``start`` on."""
    return F.transform(
        F.sequence(F.lit(0), bands - 1),
        lambda k: F.xxhash64(length, k, F.array_min(F.slice(F.get(hashed, k), start, size))),
    )


def _retrieved(hits: DataFrame, sizes: list[tuple[int, int, int]], rows: DataFrame) -> DataFrame:
    """Pairs of a hit and a template of which a window over the hit shares a band, each once."""
    most = max(size[2] for size in sizes)
    kinds = F.array(
        *(F.struct(F.lit(l).alias("length"), F.lit(g).alias("step"), F.lit(b).alias("bands")) for l, g, b in sizes)
    )

    def of_length(hashed: Column, kind: Column) -> Column:
        def of_window(number: Column) -> Column:
            start = F.greatest(number * kind["step"], F.lit(0)).cast("int")
            return _bands(
                hashed, kind["length"], kind["bands"], start - F.col("first") + 1, kind["length"] + kind["step"] - 2
            )

        first = F.floor((F.col("at") - kind["length"] + 1) / kind["step"])
        return F.array_distinct(F.flatten(F.transform(F.sequence(first, F.floor(F.col("at") / kind["step"])), of_window)))

    of = F.create_map(*(F.lit(v) for l, _, b in sizes for v in (l, b)))
    own = rows.withColumn(
        "bands", _bands(_hashed(F.col("own"), most), F.col("length"), of[F.col("length")], F.lit(1), F.size("own"))
    )
    # The hashes are an argument, as Spark would put a column's expression into the inner function.
    keys = F.transform(
        F.array(_hashed(F.col("near"), most)),
        lambda hashed: F.flatten(F.transform(kinds, lambda kind: of_length(hashed, kind))),
    )
    # An outer explode: a plain one would infer a filter on the keys and work them out twice.
    keyed = hits.withColumn("keys", F.get(keys, F.lit(0))).withColumn("key", F.explode_outer("keys"))
    templates = F.broadcast(own.withColumn("key", F.explode_outer("bands")))
    return (
        keyed.join(templates, "key")
        .filter(F.col("key") == F.get(F.array_intersect("bands", "keys"), F.lit(0)))  # the first of the shared bands
        .filter(F.array_contains("names", F.col("word")))
        .drop("key", "keys", "bands", "names")
    )


def scan_licenses(
    documents: DataFrame,
    templates: Iterable[tuple[str, str]] = NOTICES,
    *,
    contained: float = 0.8,
    missed: float = 1e-6,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Rows (doc_id, license, containment, place): the licences of every document.

    ``missed`` bounds the chance that bands miss a matching window. ``containment`` is the share of the template's shingles found, ``place`` the word of
    the document at which the first of its best windows starts.
    """
    spark: SparkSession = documents.sparkSession
    rows = _rows(templates, contained)
    kind = documents.schema[id_column].dataType.simpleString()
    if not rows:
        return spark.createDataFrame([], f"doc_id {kind}, license string, containment double, place int")
    sizes = _windows(rows, missed)
    template_rows = spark.createDataFrame(
        rows, "template int, license string, words array<string>, shingles int, least int, names array<string>"
    ).select(
        "template", "license", "least", "names", F.size("words").alias("length"),
        F.array_distinct(_shingles(F.col("words"))).alias("own"),
    )

    names = F.array(*(F.lit(w) for w in sorted({name for row in rows for name in row[5]})))
    reach = max(length + step for length, step, _ in sizes)
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_column), F.lit(""))), _BREAK), lambda w: w != "")
    found = documents.select(F.col(id_column).alias("doc_id"), words.alias("words")).filter(
        (F.size("words") > 1) & F.arrays_overlap("words", names)
    ).select("doc_id", "words", _shingles(F.col("words")).alias("pairs"))
    places = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.array_contains(names, F.get("words", i.cast("int")))
    )
    hits = found.select(
        "doc_id",
        F.explode(
            F.transform(
                places,
                lambda i: F.struct(
                    i.alias("at"),
                    F.get("words", i).alias("word"),
                    F.greatest(i - reach, F.lit(0)).alias("first"),
                    F.slice("pairs", F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach).alias("near"),
                ),
            )
        ).alias("hit"),
    ).select("doc_id", "hit.*")

    def held(start: Column, length: Column) -> Column:
        """Shingles of the template among ``length`` pairs of the document from the word ``start`` on."""
        return F.size(F.array_intersect("own", F.slice("near", start - F.col("first") + 1, length)))

    start = F.greatest(F.col("at") - F.col("length") + 1, F.lit(0))
    best = Window.partitionBy("doc_id", "at")
    return (
        _retrieved(hits, sizes, template_rows)
        .withColumn("start", F.explode(F.sequence(start, F.col("at"))))
        .withColumn("held", held(F.col("start"), F.col("length") - 1))
        .filter(F.col("held") >= F.col("least"))
        .withColumn("share", F.col("held") / F.size("own"))
        .groupBy("doc_id", "at", "template", "license")
        .agg(F.max(F.struct("share", "held", (-F.col("start")).alias("order"))).alias("top"))
        .select("doc_id", "at", "license", "top.*")
        .withColumn("most", F.max(F.struct("share", "held")).over(best))
        .filter((F.col("share") == F.col("most.share")) & (F.col("held") == F.col("most.held")))
        .groupBy("doc_id", "license")
        .agg(F.max(F.struct("share", "order")).alias("top"))
        .select("doc_id", "license", F.col("top.share").alias("containment"), (-F.col("top.order")).alias("place"))
    )
