"""Find benchmark items in documents, also with other numbers, names or units.

Texts become templates: a number (neighbouring number words are one) is ``<num>``, a
number with its unit ``<qty>``, a run of capitalised words inside a sentence ``<name>``,
any other word itself in lower case without marks around it. Windows of template words
are hashed on both sides. The task that reads a document keeps only windows that a bit
table of the benchmark's windows (of bounded size) lets through; a hash join with the
benchmark's windows decides. Matches of a document and item on one diagonal (place in
the document less place in the item), or in order on diagonals at most ``DRIFT`` apart
from one to the next, form a run, so words put in or left out don't end it. A run counts
if it covers enough of the item and its slots are consistent: each value of the item
stands for one value of the document. Runs with equal values are ``exact``, others
``reparameterised``.

Sentence starts, headings and case hide names, so two more templates are hashed: one takes
any capitalised word for a name (a line break ends a name), one takes none.

Template windows with too few plain words match nothing, since placeholders alone say
little. If an item's other windows can't cover enough of it, one window stands for its
whole template instead, unless that has slots only. Windows of the raw words (lower
case, values kept, any number of plain words) are hashed too, so exact copies of every
item are found, of the shortest as well. Items shorter than a window are matched whole.

Runs are looked for in overlapping stretches of a document whose length follows the
item's, so no group is unbounded, and a window that very many documents share meets the
benchmark's side of the join only.

Null and empty texts and items have no windows. Every row is
judged by its own text: null and repeated ids are told apart by a digest of the text, and
rows that agree in both are one document. An empty table on either side gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetally.llm.common import bit_table, hash64, in_table, slices

#: Template words of a window, and the plain words it needs.
WINDOW, PLAIN = 8, 5
#: Template words an item needs to be matched with other values.
ITEM_LEAST = 5
#: Forms of a text: its words in lower case, and templates with names inside sentences,
#: with any capitalised word as a possible name, and without names.
FORMS = ("raw", "names", "all names", "no names")
#: Words by which a run's pieces may be apart from one diagonal to the next.
DRIFT = WINDOW
#: Runs are looked for in stretches of so many times the item's length and a window.
SPAN = 4
#: Characters of texts that are read together.
PART = 1 << 20
#: Words a worker remembers; at the bound the memory is emptied.
WORDS_MAX = 300_000

# Words that are numbers, and units (lower case) that follow numbers.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
UNITS = frozenset(
    "% mm cm m km g kg mg t l ml s ms min h hr hrs kb mb gb tb w kw v a hz khz mhz ghz usd eur gbp $ € £ "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents "
    "euro euros percent degree degrees watt watts volt volts".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
_QUANTITY = re.compile(r"[+-]?(?:[$€£]\d[\d.,]*|\d[\d.,]*([a-z%$€£]+))")
_NUM, _UNIT, _QTY, _TITLE, _STOP, _LINE, _SPELT, _SCALE, _MARK = 1, 2, 4, 8, 16, 32, 64, 128, 256
_BREAK = " \0 "
_MARKS = re.compile(r"^[^\w$€£+-]+|[^\w%$€£]+$|[%$€£&*#!]{2,}$")
_CODES = {name: np.uint64(hash64(name.encode())) for name in ("<num>", "<qty>", "<name>")}
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(int(_STEP), -1, 1 << 64))


def _letters(head: str, mark: str) -> tuple[str, int]:
    """The same as ``_word`` for letters alone, with one closing mark or none."""
    low = head.lower()
    if low in NUMBER_WORDS:
        flags = _NUM | _SPELT | (_SCALE if low in ("hundred", "thousand", "million") else 0)
    elif low in UNITS:
        flags = _UNIT
    else:
        flags = _TITLE if len(head) > 1 and head[0].isupper() and head[1:].islower() else 0
    if mark:
        flags |= _MARK | (_STOP if mark in ".!?:" else 0)
    return low, flags


def _word(chunk: str) -> tuple[str, int]:
    """A chunk without marks in lower case, and its flags."""
    if chunk.isalpha():
        return _letters(chunk, "")
    if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
        return _letters(chunk[:-1], chunk[-1])
    if chunk == _BREAK.strip(" "):
        return "", _LINE
    core = _MARKS.sub("", _MARKS.sub("", chunk))
    low = core.lower()
    flags = _STOP if chunk.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":", "|", "") else 0
    if _NUMBER.fullmatch(low) and not low.startswith(("$", "€", "£")) or low in NUMBER_WORDS:
        flags |= _NUM
    elif "-" in low and NUMBER_WORDS.issuperset(low.split("-")):
        flags |= _NUM
    elif (m := _QUANTITY.fullmatch(low)) and (m[1] is None or m[1] in UNITS):
        flags |= _QTY
    elif low in UNITS:
        flags |= _UNIT
    if len(core) > 1 and core[0].isupper() and core[1:].islower() and not flags & (_NUM | _UNIT):
        flags |= _TITLE
    if flags & _NUM and low[0].isalpha():
        flags |= _SPELT | (_SCALE if low in ("hundred", "thousand", "million") else 0)
    if not chunk.lower().endswith(low):
        flags |= _MARK
    return low, flags


class Templates:
    """Templates of texts: word hashes, and the values of slots."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.low: list[str] = []
        self.hashes = np.zeros(1024, np.uint64)
        self.flags = np.zeros(1024, np.uint16)

    def _rows(self, chunks: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > WORDS_MAX:
            known.clear()
            self.low.clear()
        rows = list(map(known.get, chunks))
        if None in rows:
            for i, row in enumerate(rows):
                if row is None:
                    chunk = chunks[i]
                    row = known.get(chunk)
                    if row is None:
                        row = known[chunk] = len(self.low)
                        low, flags = _word(chunk)
                        if row >= len(self.hashes):
                            self.hashes = np.concatenate((self.hashes, np.zeros_like(self.hashes)))
                            self.flags = np.concatenate((self.flags, np.zeros_like(self.flags)))
                        self.low.append(low)
                        self.hashes[row] = hash64(low.encode("utf-8", "surrogatepass"))
                        self.flags[row] = flags
                    rows[i] = row
        return np.array(rows, np.int64)

    def read(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """The chunks' rows, and for each of ``FORMS`` (codes, slots, starts, ends, text numbers) of its words."""
        parts = [text.replace("\n", _BREAK).split() for text in texts]
        rows = self._rows([chunk for part in parts for chunk in part])
        texts_of = np.repeat(np.arange(len(parts)), [len(part) for part in parts])
        lines = (self.flags[rows] & _LINE) > 0
        broken = np.concatenate(([False], lines[:-1]))[: len(rows)][~lines]
        rows, texts_of = rows[~lines], texts_of[~lines]
        first = np.concatenate(([True], texts_of[1:] != texts_of[:-1]))[: len(rows)]
        flags = self.flags[rows]
        before = np.concatenate(([_STOP], flags[:-1])).astype(np.uint16)[: len(rows)]
        before[first] = _STOP
        number = (flags & _NUM) > 0
        unit = ((flags & _UNIT) > 0) & ((before & _NUM) > 0)
        quantity = (flags & _QTY) > 0
        # Neighbouring number words, and hundreds and the like after any number, are one number.
        spelt = (((flags & _SPELT) > 0) & ((before & _SPELT) > 0)) | (((flags & _SCALE) > 0) & ((before & _NUM) > 0))
        spelt &= (before & (_MARK | _STOP)) == 0
        measured = number & np.concatenate((unit[1:], [False]))[: len(rows)]
        title = ((flags & _TITLE) > 0) & ~number & ~unit & ~quantity
        inside = (before & _STOP) == 0
        words = self.hashes[rows]
        empty = words == _NOTHING

        def template(name: np.ndarray, further: np.ndarray) -> tuple[np.ndarray, ...]:
            # A unit belongs to its number, a further name to the name before it; marks alone are no words.
            codes = words.copy()
            codes[number], codes[quantity | measured], codes[name] = _CODES["<num>"], _CODES["<qty>"], _CODES["<name>"]
            starts = np.flatnonzero(~unit & ~spelt & ~further & ~empty)
            codes[starts[np.searchsorted(starts, late, "right") - 1]] = _CODES["<qty>"]
            slot = number | quantity | name
            return codes[starts], slot[starts], starts, np.append(starts[1:], len(rows))[: len(starts)], texts_of[starts]

        def after(mask: np.ndarray) -> np.ndarray:
            return np.concatenate(([False], mask[:-1]))[: len(rows)] & ~first

        name, nothing = title & inside, np.zeros(len(rows), bool)
        late = np.flatnonzero(measured & spelt)
        plain = np.flatnonzero(~empty)
        return rows, [
            (words[plain], np.zeros(len(plain), bool), plain, plain + 1, texts_of[plain]),
            template(name, name & after(name)),
            template(title, title & after(title) & inside & ~broken),
            template(nothing, nothing),
        ]

    def of(self, text: str) -> tuple[np.ndarray, ...]:
        """(codes, slots, starts, ends, rows): each template word's hash, whether it is a slot, and its chunks."""
        rows, forms = self.read([text])
        return *forms[FORMS.index("names")][:4], rows

    def value(self, rows: np.ndarray) -> str:
        return " ".join(filter(None, (self.low[r] for r in rows.tolist())))


_NOTHING = np.uint64(hash64(b""))


class Windows:
    """Hashes of the windows of any width over the words of one form, from sums of codes times powers."""

    def __init__(self, form: int, words: tuple[np.ndarray, ...]) -> None:
        codes, self.slots, self.starts, self.ends, self.texts = words
        powers = np.full(len(codes), _STEP)
        powers[:1] = 1
        inverse = np.full(len(codes), _UNSTEP)
        inverse[:1] = 1
        self.back = np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum(codes * np.cumprod(powers, dtype=np.uint64), dtype=np.uint64))
        self.plain = np.append(0, np.cumsum(~self.slots))
        self.form = form

    def of(self, width: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes; of templates only windows with enough plain words, unless they stand for whole items."""
        n = len(self.slots) - width + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        good = self.texts[width - 1 :] == self.texts[:n]
        if self.form and not whole:
            good &= self.plain[width:] - self.plain[:n] >= _least(width)
        places = np.flatnonzero(good)
        hashes = (self.sums[places + width] - self.sums[places]) * self.back[places]
        hashes ^= np.uint64(hash64(f"{FORMS[self.form]} {width} {whole}".encode()))
        hashes ^= hashes >> np.uint64(32)
        hashes *= _STEP
        return places, hashes ^ (hashes >> np.uint64(29))


def _least(width: int) -> int:
    """Plain words that a window of a template needs."""
    return min(PLAIN, max(1, width * PLAIN // WINDOW))


def _parts(texts: Iterable[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and texts, without nulls, in parts of about ``PART`` characters."""
    numbers, part, held = [], [], 0
    for i, text in enumerate(texts):
        if text is not None:
            numbers.append(i)
            part.append(text)
            held += len(text)
            if held >= PART:
                yield numbers, part
                numbers, part, held = [], [], 0
    if part:
        yield numbers, part


def _values(templates: Templates, rows: np.ndarray, windows: Windows, place: int, width: int) -> list[str]:
    return [
        templates.value(rows[windows.starts[i] : windows.ends[i]])
        for i in range(place, place + width)
        if windows.slots[i]
    ]


def item_windows(
    items: DataFrame, *, id_column: str = "item_id", text_column: str = "text", least_share: float = 0.5
) -> DataFrame:
    """Windows of every item: (item_id, item_key, form, item_words, width, whole, item_place, hash, item_values)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in slices(batches):
            out = []
            for item, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None:
                    continue
                rows, forms = templates.read([text])
                for form, words in enumerate(forms):
                    n = len(words[0])
                    if n < (ITEM_LEAST if form else 1):
                        continue
                    windows, width, whole = Windows(form, words), min(WINDOW, n), False
                    places, hashes = windows.of(width, whole)
                    reached = {i for p in places.tolist() for i in range(p, p + width)}
                    if len(reached) < math.ceil(n * least_share) and not words[1].all():
                        width, whole = n, True
                        places, hashes = windows.of(width, whole)
                    for place, code in zip(places.tolist(), hashes.astype(np.int64).tolist(), strict=True):
                        values = _values(templates, rows, windows, place, width)
                        out.append((item, key, form, n, width, whole, place, code, values))
            columns = list(zip(*out, strict=True)) if out else [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["item_id", "item_key", "form", "item_words", "width", "whole", "item_place", "hash", "item_values"],
            )

    return (
        items.select(
            F.col(id_column).cast("long").alias("item_id"),
            F.col(text_column).alias("text"),
            F.xxhash64(text_column).alias("item_key"),
        )
        .mapInArrow(
            cut,
            "item_id long, item_key long, form long, item_words long, width long, whole boolean, item_place long, "
            "hash long, item_values array<string>",
        )
        .dropDuplicates(["item_id", "item_key", "item_place", "hash"])
    )


def best_run(hits: list[dict], width: int, least: int) -> tuple[int, int, list[tuple[str, str]]] | None:
    """(covered, place, slots) of the best run with consistent slots that covers ``least`` places, or none.

    Windows that touch on one diagonal are a piece. Pieces in order, with diagonals at
    most ``DRIFT`` apart from one to the next, are a run.
    """
    diagonals: dict[int, list[dict]] = {}
    for hit in hits:
        diagonals.setdefault(hit["place"] - hit["item_place"], []).append(hit)
    pieces = []
    for diagonal, own in diagonals.items():
        if _merged({}, {(p["item"], p["document"]) for hit in own for p in hit["slots"]}) is None:
            continue
        own.sort(key=lambda hit: hit["item_place"])
        for hit in own:
            at, slots = hit["item_place"], {(p["item"], p["document"]) for p in hit["slots"]}
            if pieces and pieces[-1][2] == diagonal and at <= pieces[-1][1]:
                pieces[-1][1] = at + width
                pieces[-1][3] |= slots
            else:
                pieces.append([at, at + width, diagonal, slots])
    pieces.sort(key=lambda p: (p[0] + p[2], p[0]))
    runs: list[tuple[int, dict, int]] = []
    for j, (at, end, diagonal, slots) in enumerate(pieces):
        before = []
        for i in range(j - 1, -1, -1):
            start, stop, other, _ = pieces[i]
            if start < at and stop < end and start + other < at + diagonal and abs(other - diagonal) <= DRIFT:
                before.append((runs[i][0] + end - max(at, stop), i))
        run = (end - at, _merged({}, slots), diagonal)
        for covered, i in sorted(before, key=lambda b: (-b[0], b[1])):
            if covered <= run[0]:
                break
            if (values := _merged(runs[i][1], slots)) is not None:
                run = (covered, values, runs[i][2])
                break
        runs.append(run)
    good = [r for r in runs if r[0] >= least]
    if not good:
        return None
    covered, values, place = max(good, key=lambda r: (r[0], all(a == b for a, b in r[1].items()), -r[2]))
    return covered, place, sorted(values.items())


def _merged(values: dict[str, str], slots: set[tuple[str, str]]) -> dict[str, str] | None:
    """``values`` with ``slots``, or none where a value of the item stands for two of the document."""
    merged = dict(values)
    for item, document in slots:
        if merged.setdefault(item, document) != document:
            return None
    return merged


def contaminated(
    documents: DataFrame,
    items: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_share: float = 0.5,
) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, kind, covered, item_words, place, slots.

    ``covered`` counts the item's words inside matched windows, at least ``least_share``
    of ``item_words``; ``place`` is the word of the document where the item starts;
    ``slots`` maps the item's values to the document's. Words are those of the template,
    or where only the raw words match, these, without slots. Rows with equal ids and
    other texts have rows of their own.
    """
    return _contaminated(documents, items, id_column, text_column, least_share).drop("digest")


def _digest(text: Column) -> Column:
    return F.xxhash64(text)


def _contaminated(
    documents: DataFrame, items: DataFrame, id_column: str, text_column: str, least_share: float
) -> DataFrame:
    """The rows of ``contaminated``, and the digest of each document's text."""
    wanted = item_windows(items, least_share=least_share).cache()
    widths = sorted(map(tuple, wanted.select("form", "width", "whole").distinct().collect()))
    sent = documents.sparkSession.sparkContext.broadcast(bit_table(wanted))
    kind = documents.schema[id_column].dataType.simpleString()
    doc_kind = pa.int64() if kind in ("bigint", "int") else None

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, templates = sent.value, Templates()

        for batch in slices(batches):
            rows, ids, digests = [], batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for numbers, texts in _parts(t.as_py() for t in batch.column(1)):
                chunks, forms = templates.read(texts)
                of_form = {form: Windows(form, forms[form]) for form in {w[0] for w in widths}}
                for form, width, whole in widths:
                    windows = of_form[form]
                    places, hashes = windows.of(width, whole)
                    keep = in_table(bits, hashes)
                    for place, code in zip(places[keep].tolist(), hashes[keep].astype(np.int64).tolist(), strict=True):
                        text = windows.texts[place]
                        values = _values(templates, chunks, windows, place, width)
                        at = place - int(np.searchsorted(windows.texts, text))
                        rows.append((ids[numbers[text]], digests[numbers[text]], at, code, values))
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [doc_kind or batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["doc_id", "digest", "place", "hash", "values"],
                )

    hits = documents.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), _digest(F.col(text_column)).alias("digest")
    ).mapInArrow(
        search, f"doc_id {'long' if doc_kind else kind}, digest long, place long, hash long, `values` array<string>"
    )
    pairs = F.transform(
        F.arrays_zip("item_values", "values"),
        lambda p: F.struct(p["item_values"].alias("item"), p["values"].alias("document")),
    )
    span = SPAN * (F.col("item_words") + WINDOW)
    cell = F.floor(F.col("place") / span)
    same_item = ["doc_id", "digest", "item_id", "item_key"]
    groups = (
        hits.join(wanted, "hash")
        .withColumn("block", F.explode(F.array(cell, cell + 1)))
        .groupBy(*same_item, "form", "item_words", "width", "block")
        .agg(F.collect_set(F.struct("item_place", "place", pairs.alias("slots"))).alias("hits"))
    )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            least, width, hit_rows = (batch.column(batch.schema.get_field_index(c)) for c in ("item_words", "width", "hits"))
            taken, best = [], []
            for i in range(batch.num_rows):
                found = best_run(hit_rows[i].as_py(), width[i].as_py(), math.ceil(least[i].as_py() * least_share))
                if found:
                    taken.append(i)
                    best.append(found)
            if taken:
                kept = batch.take(pa.array(taken, pa.int64()))
                covered, place, slots = zip(*best, strict=True)
                pair = pa.struct([("item", pa.string()), ("document", pa.string())])
                names = [*same_item, "form", "item_words"]
                yield pa.RecordBatch.from_arrays(
                    [kept.column(kept.schema.get_field_index(c)) for c in names]
                    + [pa.array(covered, pa.int64()), pa.array(place, pa.int64())]
                    + [pa.array([[{"item": a, "document": b} for a, b in s] for s in slots], pa.list_(pair))],
                    [*names, "covered", "place", "slots"],
                )

    given_fields = ", ".join(f"{c} {groups.schema[c].dataType.simpleString()}" for c in [*same_item, "form", "item_words"])
    runs = groups.mapInArrow(
        chain, f"{given_fields}, covered long, place long, slots array<struct<item:string,document:string>>"
    )
    same = F.forall("slots", lambda p: p["item"] == p["document"])
    raw = F.when(F.col("form") == 0, -len(FORMS)).otherwise(-F.col("form"))
    rank = F.struct(
        (F.col("covered") / F.col("item_words")).alias("share"), F.when(same, 1).otherwise(0).alias("exact"),
        raw.alias("form"), (-F.col("place")).alias("order"),
    )
    return (
        runs.groupBy(*same_item)
        .agg(F.max_by(F.struct("covered", "item_words", "place", "slots", same.alias("exact")), rank).alias("best"))
        .select(
            "doc_id", "digest", "item_id", F.when(F.col("best.exact"), "exact").otherwise("reparameterised").alias("kind"),
            "best.covered", "best.item_words", "best.place", "best.slots",
        )
    )


def drop_contaminated(
    documents: DataFrame,
    items: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    least_share: float = 0.5,
) -> DataFrame:
    """``documents`` without the rows that hold an item."""
    found = _contaminated(documents, items, id_column, text_column, least_share).select("doc_id", "digest").distinct()
    same = documents[id_column].eqNullSafe(found["doc_id"]) & (_digest(documents[text_column]) == found["digest"])
    return documents.join(found, same, "left_anti")
