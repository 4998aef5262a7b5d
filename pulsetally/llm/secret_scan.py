"""Find secrets in whole texts: fixed patterns and windows of high entropy.

Patterns (``PATTERNS``) give the base spans. The method adds ``entropy`` spans: in
every candidate, a run of at least ``WINDOW`` characters of key material, a window
slides by one character; its symbol counts change by one in and one out, and with
them the Shannon entropy. A window of one character class (decimal, hexadecimal, letters
of one case, those with digits, mixed) is high above that class's threshold. Of random
keys of 32 characters more than 97 % are found, of those of one-case letters alone 85 to
90 %: long compound words have nearly their entropy, so that threshold is high.
Overlapping high windows join to one span. A span is suppressed if it is an exact value
of the allow-list, or if a pattern of it matches every part (between ``/``, ``.`` and
``=``) that the span touches: one unknown part keeps the whole span. Base spans stay.

Runs are found on bytes with numpy, so prose costs a table lookup per byte.
Everything happens in the task that reads the text: no shuffle, memory of one batch.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Rows
with equal or null ids are scanned one by one. Extra columns are ignored by
``scan_secrets`` and kept by ``redact_secrets``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsetally.llm.common import slices

# Kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORDS = (b"passw", b"secret", b"token", b"api")

#: Characters of a window, and of the shortest candidate.
WINDOW = 20
#: Character classes from narrow to wide, each with the entropy (bits a character) from which a window is high.
CLASSES = (
    ("decimal", ("[0-9]+",), 2.6),
    ("hexadecimal", ("[0-9a-f]+", "[0-9A-F]+"), 3.0),
    ("letters", ("[A-Z]?[a-z]+", "[A-Z]+"), 3.65),
    ("one case", ("[a-z0-9]+", "[A-Z0-9]+"), 3.5),
    ("mixed", (), 3.8),
)
#: Parts of these shapes are not secrets: UUIDs, words of one case or capitalised (shorter than a window), also joined
#: or with years, rulers.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"/*([a-z]{1,19}|[A-Z]{1,19}|[A-Z][a-z]{1,18})\d{0,4}"
    r"([./_=-]+([a-z]{1,19}|[A-Z]{1,19}|[A-Z][a-z]{1,18})\d{0,4})*[./_=-]*\d{0,4}[./_=-]*",
    r"(?i).*(example|placeholder|changeme|your[_-]?key|x{6}|0{8}|1234567).*",
    r"[./_=+-]+",
)
SPANS = "array<struct<kind:string,start:long,end:long,entropy:double>>"

_RUN = np.zeros(256, bool)
_RUN[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", np.uint8)] = True
_PARTS, _PIECES = re.compile(r"[/.=]+"), re.compile(r"[_+-]+")
_NLOGN = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def _classes_at(candidate: str) -> list[float]:
    """For each window start, the threshold of the narrowest class that covers the window."""
    n = len(candidate) - WINDOW + 1
    limits = [CLASSES[-1][2]] * n
    for _, patterns, limit in reversed(CLASSES):
        for pattern in patterns:
            for m in re.finditer(pattern, candidate):
                if m.end() - m.start() >= WINDOW:
                    first, last = m.start(), m.end() - WINDOW
                    limits[first : last + 1] = [limit] * (last + 1 - first)
    return limits


def entropy_spans(candidate: str, allow: re.Pattern, values: frozenset[str]) -> Iterator[tuple[int, int, float]]:
    """(start, end, highest entropy) of the joined high windows that are not allowed."""
    if len(candidate) < WINDOW or candidate in values:
        return
    limits = _classes_at(candidate)
    counts: dict[str, int] = {}
    for c in candidate[:WINDOW]:
        counts[c] = counts.get(c, 0) + 1
    total = sum(_NLOGN[n] for n in counts.values())
    full = math.log2(WINDOW)
    start, end, most = -1, -1, 0.0
    for at, limit in enumerate(limits):
        if at:
            out, into = candidate[at - 1], candidate[at + WINDOW - 1]
            if out != into:
                n = counts[out]
                total += _NLOGN[n - 1] - _NLOGN[n]
                counts[out] = n - 1
                n = counts.get(into, 0)
                total += _NLOGN[n + 1] - _NLOGN[n]
                counts[into] = n + 1
        entropy = full - total / WINDOW
        if entropy >= limit:
            if start >= 0 and at <= end:
                end, most = at + WINDOW, max(most, entropy)
            else:
                if start >= 0:
                    yield from _kept(candidate, start, end, most, allow, values)
                start, end, most = at, at + WINDOW, entropy
    if start >= 0:
        yield from _kept(candidate, start, end, most, allow, values)


def _kept(candidate, start, end, most, allow, values):
    first = max(candidate.rfind(mark, 0, start) for mark in "/.=") + 1
    last = min((at for mark in "/.=" if (at := candidate.find(mark, end)) >= 0), default=len(candidate))
    parts = [p for p in _PARTS.split(candidate[first:last]) if p]
    if parts and len(parts[-1]) <= 4 and parts[-1].isdigit() and not _PARTS.sub("", candidate[last:]):
        parts.pop()
    if candidate[start:end] not in values and not all(_allowed(p, allow, values) for p in parts):
        yield start, end, round(most, 6)


def _allowed(part, allow, values):
    """Whether the list allows the part, and every piece of it that is as long as a window."""
    return part in values or (
        allow.fullmatch(part) is not None
        and all(allow.fullmatch(p) for p in _PIECES.split(part) if WINDOW <= len(p) < len(part))
    )


def find_secrets(text: str, allow: re.Pattern, values: frozenset[str]) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, entropy) by start, then kind in the order of ``KINDS``."""
    found: list[tuple[int, int, int, float | None]] = []
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) > ASSIGN_LEAST:
        low = raw.lower()
        if any(word in low for word in KEYWORDS):
            found += (
                (m.start(), 0, m.end(), None)
                for m in ASSIGN.finditer(text)
                if m.end(2) - m.start(2) >= ASSIGN_LEAST
            )
    if len(raw) >= WINDOW:
        data = np.frombuffer(raw, np.uint8)
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _RUN[data]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[::2], edges[1::2]
        long = np.flatnonzero(ends - starts >= WINDOW)
        shift = None
        for i in long.tolist():
            begin, stop = int(starts[i]), int(ends[i])
            run = raw[begin:stop].decode("ascii")
            if len(raw) != len(text):
                if shift is None:
                    shift = np.cumsum((data & 0xC0) == 0x80)
                begin -= int(shift[begin])
            found += (
                (begin + m.start(), 1, begin + m.end(), None)
                for m in ACCESS.finditer(run)
                if m.end() - m.start() >= ACCESS_LEAST
            )
            found += (
                (begin + m.start(), 2, begin + m.end(), None)
                for m in HEX.finditer(run)
                if m.end() - m.start() >= HEX_LEAST
            )
            found += ((begin + a, 3, begin + b, e) for a, b, e in entropy_spans(run, allow, values))
    found.sort(key=lambda f: f[:3])
    return [(KINDS[kind], start, end, entropy) for start, kind, end, entropy in found]


def _rules(allow: Iterable[str], values: Iterable[str]) -> tuple[re.Pattern, frozenset[str]]:
    return re.compile("|".join(f"(?:{p})" for p in _scoped(allow)) or r"(?!)"), frozenset(values)


def _scoped(allow: Iterable[str]) -> Iterator[str]:
    """A leading (?i) holds for its own pattern only."""
    for pattern in allow:
        yield f"(?i:{pattern[4:]})" if pattern.startswith("(?i)") else pattern


def scan_secrets(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    allow: Iterable[str] = ALLOW,
    allow_values: Iterable[str] = (),
) -> DataFrame:
    """One row a document: its id as ``doc_id`` and ``spans`` (see ``SPANS``)."""
    pattern, values = _rules(allow, allow_values)
    kind = documents.schema[id_column].dataType.simpleString()
    span = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entropy", pa.float64())])
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [
                [dict(zip(("kind", "start", "end", "entropy"), s, strict=True)) for s in find_secrets(t.as_py() or "", pattern, values)]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], ["doc_id", "spans"])

    return documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(
        scan, f"doc_id {kind}, spans {SPANS}"
    )


def redact(text: str, spans: list[tuple], mask: str) -> str:
    """``text`` with every span, or chain of overlapping spans, replaced by ``mask``."""
    out, done, reach = [], 0, -1
    for _, start, end, _ in sorted(spans, key=lambda s: s[1]):
        if start >= reach:
            out += [text[done:start] if reach < 0 else text[reach:start], mask]
            reach = end
        reach = max(reach, end)
    return "".join(out) + text[max(reach, done) :]


def redact_secrets(
    documents: DataFrame,
    *,
    text_column: str = "text",
    mask: str = "[SECRET]",
    allow: Iterable[str] = ALLOW,
    allow_values: Iterable[str] = (),
) -> DataFrame:
    """``documents`` with every secret in ``text_column`` replaced by ``mask``; null stays null."""
    pattern, values = _rules(allow, allow_values)
    place = documents.columns.index(text_column)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            field = batch.schema.field(place)
            texts = [
                None if t is None else redact(t, find_secrets(t, pattern, values), mask)
                for t in (x.as_py() for x in batch.column(place))
            ]
            yield batch.set_column(place, field, pa.array(texts, field.type))

    return documents.mapInArrow(clean, documents.schema)
