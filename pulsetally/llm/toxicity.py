"""Convolutional toxicity classifier, trained in numpy and applied by Spark.

A word is the sum of hashed embeddings: of itself and of its first 3 to 8 bytes, so
unseen forms of known stems are known. Filters of several widths run over the words,
each keeps its highest response (max pooling), and a logistic layer makes a logit of
these. A last scale and shift, fitted on rows that training has not seen and weighted
to the true class shares, turns it into a probability. Thresholds for decisions are
then chosen for every language; the language is no input of a score.

Fitting and calibration use all labelled rows and whole texts. The driver learns from up
to ``fit_rows`` of each class by itself. More are dealt over parts, which learn in tasks
and meet after every pass; only the model's changes, sums and counts reach the driver.
Scoring covers every whole text in the task that read it: no shuffle; the model, which is
broadcast, has a fixed size.

Null text is empty, and a text without words gets the score of no response. Null
labels and ids fit nothing. Of repeated labels of an id the largest counts. Without
rows of both classes every score is the share of toxic labels (0 without labels).
Extra columns are ignored by ``score`` and kept by ``reject_toxic``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from copy import deepcopy
from dataclasses import dataclass, field, replace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsetally.llm.common import release_memory, release_shuffles, slices, stash

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 16, (1, 2, 3), 16
STEMS = range(3, 9)
EPOCHS, RATE, BATCH, SHRINK = 5, 0.08, 16, 1e-5
#: Words a worker remembers; at the bound the memory is emptied.
WORDS_MAX = 300_000
#: Rows of each class that choose a language's threshold, and its bounds.
LANGUAGE_ROWS, LOWEST, HIGHEST = 20, 0.3, 0.7
THRESHOLDS = np.linspace(LOWEST, HIGHEST, 41).tolist()
#: Rows that a part of the fit aims at, the most parts, and the slices in which the parts' changes meet.
PART_ROWS, PARTS_MAX, SLICES = 6000, 128, 64
#: What a task of the fit holds at once.
BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 22
#: Labels up to this number are sent to all tasks for the join with the documents.
LABELS_SENT = 2_000_000
_REAL, _EMPTY = BUCKETS - 1, (0,) * (1 + len(STEMS))
#: The step of the CRC-32 for every byte, as in ``zlib``.
_CRC_STEPS = np.array([crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], np.uint32)
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…–—"


def word_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word and its stems; bucket 0 is the empty one."""
    raw = word.strip(_STRIP).encode("utf-8", "surrogatepass")
    if not raw:
        return _EMPTY
    found, stem = [1 + crc32(raw, 1) % _REAL], crc32(raw[: STEMS[0] - 1])
    for n in STEMS:
        if len(raw) < n:
            found.append(0)
        else:
            stem = crc32(raw[n - 1 : n], stem)
            found.append(1 + stem % _REAL)
    return tuple(found)


def _buckets_of(words: list[str]) -> np.ndarray:
    """``word_buckets`` of every word, the stems of all words at once."""
    raws = [w.strip(_STRIP).encode("utf-8", "surrogatepass") for w in words]
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    found = np.zeros((len(raws), 1 + len(STEMS)), np.int64)
    found[:, 0] = np.fromiter((1 + crc32(r, 1) % _REAL for r in raws), np.int64, len(raws)) * (sizes > 0)
    octets = np.array(raws, f"S{STEMS[-1]}").view(np.uint8).reshape(len(raws), STEMS[-1])
    stem = np.full(len(raws), 0xFFFFFFFF, np.uint32)
    for n in range(1, STEMS.stop):
        stem = _CRC_STEPS[(stem ^ octets[:, n - 1]) & 255] ^ (stem >> 8)
        if n in STEMS:
            found[:, 1 + STEMS.index(n)] = (1 + (~stem).astype(np.int64) % _REAL) * (sizes >= n)
    return found


class Words:
    """Words -> rows of a matrix of word vectors, filled as words are met."""

    def __init__(self, table: np.ndarray):
        self.table, self.known = table, {}
        self.vectors = np.zeros((1024, DIM), np.float32)

    def of(self, text: str) -> np.ndarray:
        """Word vectors of a text, at least one row."""
        chunks = text.lower().split() or [""]
        if len(self.known) > WORDS_MAX:
            self.known.clear()
        known = self.known
        rows = list(map(known.get, chunks))
        if None in rows:
            first = len(known)
            new = list(dict.fromkeys(c for c, row in zip(chunks, rows, strict=True) if row is None))
            known.update(zip(new, range(first, first + len(new)), strict=True))
            if len(known) > len(self.vectors):
                grown = np.zeros((max(2 * len(self.vectors), len(known)), DIM), np.float32)
                grown[:first] = self.vectors[:first]
                self.vectors = grown
            self.vectors[first : len(known)] = _vectors(self.table, _buckets_of(new))
            rows = list(map(known.__getitem__, chunks))
        return self.vectors.take(rows, axis=0)


def _vectors(table: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The sum of the table's rows in every row of buckets."""
    total = table.take(buckets[:, 0], axis=0)
    for n in range(1, buckets.shape[1]):
        total += table.take(buckets[:, n], axis=0)
    return total


@dataclass
class Model:
    """Embeddings, filters (width -> weights, biases), the logistic layer, calibration and thresholds."""

    table: np.ndarray
    filters: dict[int, tuple[np.ndarray, np.ndarray]]
    out: np.ndarray
    shift: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    share: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    #: For languages without a threshold of their own.
    threshold: float = 0.5
    joined: np.ndarray | None = None

    def pooled(self, words: np.ndarray) -> np.ndarray:
        """The highest response of every filter, from one product with all their weights."""
        wide = max(WIDTHS) - len(words)
        if wide > 0:
            return np.concatenate([_responses(words, w, *self.filters[w]).max(axis=0) for w in WIDTHS])
        if self.joined is None:
            self.joined = np.hstack([self.filters[w][0][k] for w in WIDTHS for k in range(w)])
        all_, at, peaks = words @ self.joined, 0, []
        for w in WIDTHS:
            n = len(words) - w + 1
            total = all_[:n, at : at + FILTERS]
            for k in range(1, w):
                total = total + all_[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
            peaks.append(total.max(axis=0) + self.filters[w][1])
            at += w * FILTERS
        return np.concatenate(peaks)

    def logit(self, words: np.ndarray) -> float:
        return float(np.maximum(self.pooled(words), 0) @ self.out + self.shift)

    def probability(self, logit: float) -> float:
        if self.share is not None:
            return self.share
        z = self.scale[0] * logit + self.scale[1]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _responses(words: np.ndarray, width: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filter responses at every place; short texts are filled up with empty words."""
    if len(words) < width:
        words = np.vstack([words, np.zeros((width - len(words), DIM), np.float32)])
    total = words[: len(words) - width + 1] @ weights[0]
    for k in range(1, width):
        total += words[k : len(words) - width + 1 + k] @ weights[k]
    return total + bias


def _fresh(rng: np.random.Generator) -> Model:
    table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    table[0] = 0
    filters = {
        w: (rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32))
        for w in WIDTHS
    }
    return Model(table, filters, rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32))


#: The different words of a document, and for each of its words the place among them.
Doc = tuple[np.ndarray, np.ndarray]
#: The weights of all filters, word by word: (width, place), each for all filters of the width.
_TAPS = [(w, k) for w in WIDTHS for k in range(w)]
_TAP_FILTERS = np.concatenate([np.arange(FILTERS) + WIDTHS.index(w) * FILTERS for w, _ in _TAPS])
_TAP_PLACES = np.repeat([k for _, k in _TAPS], FILTERS)


@dataclass
class Fit:
    """A model in the making, and the sums of squared gradients of its numbers (AdaGrad)."""

    model: Model
    table: np.ndarray
    filters: dict[int, tuple[np.ndarray, np.ndarray]]
    out: np.ndarray
    shift: float = 1e-6

    @classmethod
    def start(cls, rng: np.random.Generator) -> Fit:
        model = _fresh(rng)
        squares = {w: tuple(np.full_like(p, 1e-6) for p in model.filters[w]) for w in WIDTHS}
        return cls(model, np.full_like(model.table, 1e-6), squares, np.full_like(model.out, 1e-6))

    def learn(
        self, docs: list[Doc], buckets: np.ndarray, labels: np.ndarray, weight: np.ndarray, order: np.ndarray
    ) -> None:
        """One pass over documents; ``buckets`` are those of their words."""
        model = self.model
        for at in range(0, len(order), BATCH):
            weights = np.concatenate([model.filters[w][0][k].T for w, k in _TAPS])
            taps, biases = np.zeros_like(weights), np.zeros(len(WIDTHS) * FILTERS, np.float32)
            out_grad, shift_grad = SHRINK * model.out, 0.0
            touched, changes = [], []
            for i in order[at : at + BATCH].tolist():
                unique, places = docs[i]
                words = _vectors(model.table, buckets[unique]).take(places, axis=0)
                peaks, where = [], []
                for w in WIDTHS:
                    r = _responses(words, w, *model.filters[w])
                    where.append(r.argmax(axis=0))
                    peaks.append(r[where[-1], np.arange(FILTERS)])
                pooled = np.concatenate(peaks)
                hidden = np.maximum(pooled, 0)
                error = (1 / (1 + np.exp(-np.clip(hidden @ model.out + model.shift, -30, 30))) - labels[i]) * weight[i] / BATCH
                out_grad = out_grad + error * hidden
                shift_grad += error
                back = (error * model.out * (pooled > 0)).astype(np.float32)
                biases += back
                place = np.concatenate(where)[_TAP_FILTERS] + _TAP_PLACES
                real = place < len(words)
                place = np.minimum(place, len(words) - 1)
                g = back[_TAP_FILTERS]
                taps += words[place] * (g * real)[:, None]
                live = real & (g != 0)
                if live.any():
                    touched.append(unique[places[place[live]]])
                    changes.append(weights[live] * g[live, None])
            _step(model.out, out_grad.astype(np.float32), self.out)
            self.shift += shift_grad**2
            model.shift -= RATE * shift_grad / np.sqrt(self.shift)
            for n, w in enumerate(WIDTHS):
                first = _TAPS.index((w, 0)) * FILTERS
                own = taps[first : first + w * FILTERS].reshape(w, FILTERS, DIM).transpose(0, 2, 1)
                grads = own, biases[n * FILTERS : (n + 1) * FILTERS]
                for value, gradient, square in zip(model.filters[w], grads, self.filters[w], strict=True):
                    _step(value, gradient + SHRINK * value, square)
            if touched:
                ids = buckets[np.concatenate(touched)].reshape(-1)
                real = np.flatnonzero(ids)
                rows, inverse = np.unique(ids[real], return_inverse=True)
                total = np.zeros(len(rows) * DIM, np.float32)
                at_each = (inverse[:, None] * DIM + np.arange(DIM)).reshape(-1)
                np.add.at(total, at_each, np.concatenate(changes).take(real // buckets.shape[1], axis=0).reshape(-1))
                _step(model.table, total.reshape(-1, DIM), self.table, rows)

    def changes(self, begun: Fit, part: int) -> Iterator[pa.RecordBatch]:
        """Rows of ``_CHANGES``: what was added to the table since ``begun``, and the new values of all else."""
        size = BUCKETS // SLICES
        for number in range(SLICES):
            own = slice(number * size, (number + 1) * size)
            added = [new[own] - old[own] for new, old in ((self.model.table, begun.model.table), (self.table, begun.table))]
            rows = np.flatnonzero(((added[0] != 0) | (added[1] != 0)).any(axis=1))
            yield _change(number, part, rows.astype(np.int32), *(a[rows] for a in added))
        yield _change(SLICES, part, np.zeros(0, np.int32), *(np.concatenate(v, dtype=np.float64) for v in self._dense()))

    def take(self, change: Mapping) -> None:
        """Make a row of ``_CHANGES`` one's own."""
        if change["slice"] < SLICES:
            rows = np.frombuffer(change["rows"], np.int32) + change["slice"] * (BUCKETS // SLICES)
            for table, key in ((self.model.table, "values"), (self.table, "squares")):
                table[rows] += np.frombuffer(change[key], np.float32).reshape(-1, DIM)
            return
        for old, key in zip(self._dense(), ("values", "squares"), strict=True):
            new = np.split(np.frombuffer(change[key]), np.cumsum([len(v) for v in old])[:-1])
            for value, own in zip(new[:-1], old[:-1], strict=True):
                own[:] = value  # a view of the array
            if key == "values":
                self.model.shift = float(new[-1][0])
            else:
                self.shift = float(new[-1][0])

    def _dense(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Values and squares of all but the table, flat; views, but for the shift at the end."""
        values = [p.reshape(-1) for w in WIDTHS for p in self.model.filters[w]]
        squares = [p.reshape(-1) for w in WIDTHS for p in self.filters[w]]
        return (
            [*values, self.model.out, np.array([self.model.shift])],
            [*squares, self.out, np.array([self.shift])],
        )


def _change(number: int, part: int, *arrays: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([number], pa.int32()), pa.array([part], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)]
    return pa.RecordBatch.from_arrays(columns, ["slice", "part", "rows", "values", "squares"])


def _step(value: np.ndarray, gradient: np.ndarray, square: np.ndarray, rows=...) -> None:
    square[rows] += gradient * gradient
    value[rows] -= RATE * gradient / np.sqrt(square[rows])


def _words_of(texts: Iterable[str]) -> tuple[list[Doc], np.ndarray]:
    """The texts by places of their words in a list of words, and the buckets of these words."""
    index: dict[str, int] = {}
    docs = [
        np.unique(np.fromiter((index.setdefault(c, len(index)) for c in t.lower().split() or [""]), np.int64), return_inverse=True)
        for t in texts
    ]
    return docs, _buckets_of(list(index))


def _class_weights(labels: np.ndarray, clean: int, toxic: int) -> np.ndarray:
    """Weights that make both classes count as much, for so many rows of each."""
    return np.where(labels == 1, 0.5 / max(1, toxic), 0.5 / max(1, clean)) * (clean + toxic)


def fit(texts: list[str], labels: np.ndarray, seed: int = 5) -> Model:
    """Train on texts with labels 0 and 1 (AdaGrad, balanced classes)."""
    rng = np.random.default_rng(seed)
    state = Fit.start(rng)
    docs, buckets = _words_of(texts)
    weight = _class_weights(labels, int((1 - labels).sum()), int(labels.sum()))
    for _ in range(EPOCHS):
        state.learn(docs, buckets, labels, weight, rng.permutation(len(docs)))
    return state.model


def _deal(rows: DataFrame, parts: int, seed: int) -> DataFrame:
    """Rows (doc_id, text, toxic) as blocks of words; a part's blocks lie together and in a random order."""
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed + 2)), F.lit(parts)).cast("int")
    order = F.xxhash64("doc_id", "text", F.lit(seed + 3))
    dealt = rows.select(part.alias("part"), order.alias("order"), "doc_id", "text", "toxic")
    return (
        dealt.repartitionById(parts, "part")
        .sortWithinPartitions("part", "order", "doc_id", "text")
        .select("part", "text", "toxic")
        .mapInArrow(_blocks, _BLOCKS)
    )


_BLOCKS = "part int, labels binary, ends binary, words binary, place_ends binary, places binary, buckets binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the documents of one part each."""
    texts, labels, chars, part = [], [], 0, None

    def block() -> pa.RecordBatch:
        docs, buckets = _words_of(texts)
        parts = [x for arrays in zip(*docs, strict=True) for x in (np.cumsum([len(a) for a in arrays]), np.concatenate(arrays))]
        columns = [pa.array([part], pa.int32()), *(pa.array([_packed(a)], pa.binary()) for a in (np.array(labels), *parts, buckets))]
        return pa.RecordBatch.from_arrays(columns, ["part", "labels", "ends", "words", "place_ends", "places", "buckets"])

    for batch in slices(batches):
        for own, text, toxic in zip(*batch.columns, strict=True):
            text = text.as_py()
            if texts and (own.as_py() != part or len(texts) == BLOCK_ROWS or chars + len(text) > BLOCK_CHARS):
                yield block()
                texts, labels, chars = [], [], 0
            part, chars = own.as_py(), chars + len(text)
            texts.append(text)
            labels.append(toxic.as_py())
    if texts:
        yield block()


def _packed(numbers: np.ndarray) -> bytes:
    raw = numbers.astype(np.int32).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], size, codec="zstd", asbytes=True), np.int32)


def _unpacked_block(packed: list[bytes]) -> tuple[np.ndarray, list[Doc], np.ndarray]:
    labels, ends, words, place_ends, places, buckets = map(_unpacked, packed)
    docs = list(zip(np.split(words, ends[:-1]), np.split(places, place_ends[:-1]), strict=True))
    return labels, docs, buckets.reshape(-1, 1 + len(STEMS))


def fit_parts(rows: DataFrame, clean: int, toxic: int, seed: int = 5) -> Model:
    """``fit`` for any number of rows (doc_id, text, toxic), so many of each class.

    Every part learns from all its rows in a task, from one common state; the means of what
    the parts have learnt are the state of the next pass. A word's vector is the mean of
    those parts that changed it. Parts depend on the rows only, not on the cluster.
    """
    state = Fit.start(np.random.default_rng(seed))
    blocks = _deal(rows, min(PARTS_MAX, max(1, round((clean + toxic) / PART_ROWS))), seed)
    blocks = blocks.persist(StorageLevel.DISK_ONLY)
    try:
        for epoch in range(EPOCHS):
            sent = rows.sparkSession.sparkContext.broadcast(state)
            learnt = blocks.mapInArrow(_learner(sent, clean, toxic, (seed, epoch)), _CHANGES)
            changes = learnt.groupBy("slice").applyInArrow(_mean_changes, _CHANGES).collect()
            sent.destroy()
            for change in changes:
                state.take(change)
            del learnt, changes
            release_shuffles(rows.sparkSession)
    finally:
        blocks.unpersist()
    return state.model


_CHANGES = "slice int, part int, rows binary, values binary, squares binary"


def _learner(sent: Broadcast, clean: int, toxic: int, seed: tuple[int, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        begun, state, part = sent.value, None, None
        for batch in batches:
            for row in range(batch.num_rows):
                own, *packed = (c[row].as_py() for c in batch.columns)
                if own != part:
                    if state is not None:
                        yield from state.changes(begun, part)
                    state, part, rng = deepcopy(begun), own, np.random.default_rng((*seed, own))
                labels, docs, buckets = _unpacked_block(packed)
                state.learn(docs, buckets, labels, _class_weights(labels, clean, toxic), rng.permutation(len(docs)))
        if state is not None:
            yield from state.changes(begun, part)

    return run


def _mean_changes(changes: pa.Table) -> pa.Table:
    """The mean of the parts' changes to one slice, for each row that any of them changed."""
    changes = changes.sort_by("part").to_pylist()
    number = changes[0]["slice"]
    if number == SLICES:
        mean = {k: np.mean([np.frombuffer(c[k]) for c in changes], axis=0).tobytes() for k in ("values", "squares")}
        return pa.Table.from_pylist([{"slice": number, "part": 0, "rows": b"", **mean}], _ARROW_CHANGES)
    size = BUCKETS // SLICES
    times, total = np.zeros(size), {k: np.zeros((size, DIM)) for k in ("values", "squares")}
    for change in changes:
        rows = np.frombuffer(change["rows"], np.int32)
        times[rows] += 1
        for k, sums in total.items():
            sums[rows] += np.frombuffer(change[k], np.float32).reshape(-1, DIM)
    rows = np.flatnonzero(times)
    mean = {k: (sums[rows] / times[rows, None]).astype(np.float32).tobytes() for k, sums in total.items()}
    return pa.Table.from_pylist(
        [{"slice": number, "part": 0, "rows": rows.astype(np.int32).tobytes(), **mean}], _ARROW_CHANGES
    )


_ARROW_CHANGES = pa.schema(
    [("slice", pa.int32()), ("part", pa.int32()), ("rows", pa.binary()), ("values", pa.binary()), ("squares", pa.binary())]
)


def _scale(sums: Callable[[float, float], tuple], least: float = 0.0) -> tuple[float, float]:
    """Scale and shift of the logit, by Newton steps of a logistic regression until they move by ``least`` at most.

    ``sums`` gives, for a scale and a shift, the sums over rows of r * z, r, s * z * z, s * z and s,
    where z is the logit, r the error and s the slope of the probability.
    """
    a, b = 1.0, 0.0
    for _ in range(50):
        rz, r, szz, sz, s = sums(a, b)
        g = np.array([rz + 1e-2 * (a - 1), r + 1e-3 * b])
        h = np.array([[szz + 1e-2, sz], [sz, s + 1e-3]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() <= least:
            break
    return float(max(a, 1e-3)), float(b)


def _reached(model: Model, logits: Iterable[float]) -> np.ndarray:
    """How many thresholds each row reaches."""
    return np.searchsorted(THRESHOLDS, [model.probability(z) for z in logits], side="right")


def _set_thresholds(model: Model, counts: dict[str, np.ndarray]) -> None:
    """A threshold for every language, and one for languages without rows.

    ``counts`` are a language's rows by class and number of thresholds they reach. What a
    language lacks to ``LANGUAGE_ROWS`` of a class is made up by the rows of all languages.
    """
    all_rows = sum(counts.values())
    model.threshold = _best(all_rows)
    for lang, own in sorted(counts.items()):
        lacking = np.maximum(0, LANGUAGE_ROWS - own.sum(axis=1)) / np.maximum(1, all_rows.sum(axis=1))
        model.thresholds[lang] = _best(own + all_rows * lacking[:, None])


def _best(counts: np.ndarray) -> float:
    """The threshold of the highest F1, of equal ones the nearest to 0.5."""
    reached = counts[:, ::-1].cumsum(axis=1)[:, -2::-1]
    score = 2 * reached[1] / np.maximum(1e-9, reached.sum(axis=0) + counts[1].sum())
    return max(zip(THRESHOLDS, score, strict=True), key=lambda ts: (round(ts[1], 9), -abs(ts[0] - 0.5)))[0]


def calibrate(model: Model, logits: np.ndarray, labels: np.ndarray, langs: list[str]) -> None:
    """Fit scale and shift of the probability, then a threshold for every language."""

    def sums(a: float, b: float) -> tuple:
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        r, s = p - labels, p * (1 - p) + 1e-9
        return (r * logits).sum(), r.sum(), (s * logits**2).sum(), (s * logits).sum(), s.sum()

    model.scale = _scale(sums)
    counts: dict[str, np.ndarray] = {}
    for lang, label, reached in zip(langs, labels.tolist(), _reached(model, logits.tolist()), strict=True):
        counts.setdefault(lang, np.zeros((2, len(THRESHOLDS) + 1)))[label, reached] += 1
    _set_thresholds(model, counts)


def calibrate_parts(model: Model, rows: DataFrame) -> None:
    """``calibrate`` for any number of rows (text, lang, toxic): only sums and counts reach the driver."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = sent.value
        words = Words(here.table)
        for batch in slices(batches):
            found = pa.array([here.logit(words.of(t.as_py())) for t in batch.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], found], ["lang", "toxic", "logit"])

    found = stash(rows.select("text", "lang", "toxic").mapInArrow(logits, "lang string, toxic int, logit double"), "logits")
    sent.destroy()
    z = F.col("logit")

    def sums(a: float, b: float) -> tuple:
        p = 1 / (1 + F.exp(-F.least(F.greatest(a * z + b, F.lit(-30.0)), F.lit(30.0))))
        parts = found.select(z, (p - F.col("toxic")).alias("r"), (p * (1 - p) + 1e-9).alias("s"))
        r, s = F.col("r"), F.col("s")
        return tuple(parts.agg(*(F.sum(x).alias(str(i)) for i, x in enumerate((r * z, r, s * z * z, s * z, s)))).first())

    model.scale = _scale(sums, 1e-9)
    scale = replace(model, table=model.table[:0])  # all that a probability needs, and little more

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = pa.array(_reached(scale, batch.column(2).to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], places], ["lang", "toxic", "reached"])

    places = found.mapInArrow(reached, "lang string, toxic int, reached int")
    counts: dict[str, np.ndarray] = {}
    for row in places.groupBy("lang", "toxic", "reached").count().collect():
        counts.setdefault(row["lang"], np.zeros((2, len(THRESHOLDS) + 1)))[row["toxic"], row["reached"]] = row["count"]
    _set_thresholds(model, counts)


def train(
    documents: DataFrame,
    labels: DataFrame,
    *,
    usable: Column | None = None,
    fit_rows: int = 3000,
    fit_chars: int = 20_000_000,
    seed: int = 5,
) -> Model:
    """A model from documents (doc_id, text, lang) and labels (doc_id, toxic).

    ``usable`` restricts the labelled rows that may be learnt from. Up to ``fit_rows`` of
    each class with ``fit_chars`` characters in all are learnt by the driver, more by tasks.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if known.count() <= LABELS_SENT:
        known = F.broadcast(known)
    part = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(4)) == 0
    rows = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
        .join(known, "doc_id")
        .select("doc_id", "text", "lang", "toxic", part.alias("checked"))
    )
    counts = np.zeros((2, 2), np.int64)
    for row in rows.groupBy("checked", "toxic").count().collect():
        counts[int(row["checked"]), row["toxic"]] = row["count"]
    clean, toxic = counts.sum(axis=0).tolist()
    if not (clean and toxic):
        model = _fresh(np.random.default_rng(seed))
        model.share = toxic / (clean + toxic) if clean + toxic else 0.0
        return model
    apart = bool(counts.all())
    if max(clean, toxic) > fit_rows or rows.agg(F.sum(F.length("text"))).first()[0] > fit_chars:
        model = fit_parts(rows.filter(~F.col("checked")) if apart else rows, *(counts[0] if apart else counts.sum(axis=0)).tolist(), seed)
        calibrate_parts(model, rows.filter("checked") if apart else rows)
        return model
    found = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["toxic"] for r in found], np.int64)
    checked = np.array([r["checked"] for r in found]) if apart else np.ones(len(y), bool)
    fitted = ~checked if apart else checked
    model = fit([r["text"] for r, f in zip(found, fitted, strict=True) if f], y[fitted], seed)
    words = Words(model.table)
    logits = np.array([model.logit(words.of(r["text"])) for r, c in zip(found, checked, strict=True) if c])
    calibrate(model, logits, y[checked], [r["lang"] for r, c in zip(found, checked, strict=True) if c])
    return model


def _scorer(frame: DataFrame, model: Model) -> Callable[[], Callable[[str | None], float]]:
    sent = frame.sparkSession.sparkContext.broadcast(model)

    def scorer() -> Callable[[str | None], float]:
        here = sent.value
        words = Words(here.table)
        return lambda text: here.probability(here.logit(words.of(text or "")))

    return scorer


def score(documents: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, score): the probability that a text is toxic."""
    kind = documents.schema[id_column].dataType.simpleString()
    scorer = _scorer(documents, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer()
        for batch in slices(batches):
            found = pa.array([one(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "score"])

    return documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"doc_id {kind}, score double"
    )


def reject_toxic(
    documents: DataFrame, model: Model, *, text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """``documents`` without those whose score reaches the threshold of their language; null is the empty one."""
    text, lang = (documents.columns.index(c) for c in (text_column, lang_column))
    scorer, limits, other = _scorer(documents, model), dict(model.thresholds), model.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer()
        for batch in slices(batches):
            keep = [
                one(t.as_py()) < limits.get(g.as_py() or "", other)
                for t, g in zip(batch.column(text), batch.column(lang), strict=True)
            ]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
