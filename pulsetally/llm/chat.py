"""Chat records of many layouts as canonical turns, rendered with a loss mask.

The sorted nested field paths of a record (or of a table's schema) are hashed to a
fingerprint. A fingerprint selects a declarative mapping: the first layout whose
paths the record holds, so further fields do not matter. Each task resolves a
fingerprint once. Layouts describe a list of messages, single fields in a given order,
or a table with a row a turn.

Rendering marks turns and escapes control strings inside roles and texts: every
backslash is doubled and a backslash follows the first character of a control string.
``read_back`` undoes it, so every conversation survives the round trip. The loss
mask is a list of code point spans of the rendered text: the texts of assistant turns.

Rows of a conversation meet in one task, because a rendered conversation is one
value; other conversations are spread by their id. Null roles and texts are empty,
turns with the same number go by role, then text; a null turn number comes first; a
null conversation id is a conversation. Records of no known layout, of broken JSON
or null have no layout and null turns. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsetally.llm.common import hash64

# Fixed values of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that must not appear raw inside a role or text.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"
#: Names of roles in common layouts.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Fingerprints a task remembers.
KNOWN_MAX = 10_000


@dataclass(frozen=True)
class Layout:
    """A mapping: ``messages`` names (list, role, text); else ``fields`` gives (path, role) in order.

    Consecutive fields of one role form one turn, joined by a blank line. Fields
    outside ``needs`` may be missing.
    """

    name: str
    needs: tuple[str, ...]
    messages: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class RowLayout:
    """A table with a row a turn."""

    name: str
    conversation: str
    turn: str
    role: str
    text: str

    @property
    def needs(self) -> tuple[str, ...]:
        return self.conversation, self.turn, self.role, self.text


def _messages(name: str, where: str, role: str, text: str) -> Layout:
    return Layout(name, (f"{where}[].{role}", f"{where}[].{text}"), messages=(where, role, text))


def _pair(question: str, answer: str, between: tuple[str, ...] = ()) -> Layout:
    fields = (("system", "system"), (question, "user"), *((b, "user") for b in between), (answer, ASSISTANT))
    return Layout(f"{question}-{answer}", (question, answer), fields=fields)


LAYOUTS = (
    _messages("messages", "messages", "role", "content"),
    _messages("message-text", "messages", "role", "text"),
    _messages("conversations", "conversations", "from", "value"),
    _messages("turns", "turns", "speaker", "text"),
    _messages("dialog", "dialog", "role", "content"),
    Layout(
        "nested-prompt", ("prompt.text", "completion.text"),
        fields=(("prompt.system", "system"), ("prompt.text", "user"), ("completion.text", ASSISTANT)),
    ),
    _pair("instruction", "output", ("input",)),
    _pair("instruction", "response", ("context",)),
    _pair("prompt", "completion"),
    _pair("prompt", "response"),
    _pair("question", "answer"),
)
ROW_LAYOUTS = (
    RowLayout("turn-rows", "conv_id", "turn", "role", "text"),
    RowLayout("message-rows", "conversation_id", "message_index", "role", "content"),
)


def value_paths(value: object, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value; ``[]`` stands for list elements, null has no fields."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{prefix}[]")} or {f"{prefix}[]"}
    return {prefix}


def schema_paths(kind: T.DataType, prefix: str = "") -> set[str]:
    """The same for a schema."""
    if isinstance(kind, T.StructType):
        return {p for f in kind for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return {prefix}


def fingerprint(paths: set[str]) -> str:
    """Hash of the sorted paths, as 16 hexadecimal digits."""
    return f"{hash64(chr(10).join(sorted(paths)).encode('utf-8', 'surrogatepass')):016x}"


def _first(layouts: tuple, paths: set[str]):
    return next((x for x in layouts if paths.issuperset(x.needs)), None)


def _at(value: object, path: str) -> object:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _plain(value: object) -> str:
    """Text of a field; parts of a message that is a list of texts are joined by lines."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, list) and all(isinstance(v, dict) and isinstance(v.get("text"), str) for v in value):
        return "\n".join(v["text"] for v in value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def turns_of(record: object, layout: Layout) -> list[tuple[str, str]]:
    """Canonical (role, text) turns of a record by its mapping."""
    if layout.messages:
        where, role, text = layout.messages
        items = [m if isinstance(m, dict) else {} for m in _at(record, where) or []]
        return [(ALIASES.get(r := _plain(m.get(role)), r), _plain(m.get(text))) for m in items]
    turns: list[tuple[str, str]] = []
    for path, role in layout.fields:
        value = _plain(_at(record, path))
        if not value and path not in layout.needs:
            continue
        if turns and turns[-1][0] == role:
            turns[-1] = (role, f"{turns[-1][1]}\n\n{value}")
        else:
            turns.append((role, value))
    return turns


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
TURNS = "array<struct<role:string,text:string>>"


def _dicts(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in turns]


def turns_of_json(records: DataFrame, json_column: str, id_column: str) -> DataFrame:
    """Rows (id_column, fingerprint, layout, turns) of records held as JSON text."""
    kind = records.schema[id_column].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Layout | None] = {}
        for batch in batches:
            prints, names, turns = [], [], []
            for text in batch.column(1).to_pylist():
                try:
                    record = json.loads(text) if text is not None else None
                except ValueError:
                    record = None
                if not isinstance(record, dict):
                    prints.append(None), names.append(None), turns.append(None)
                    continue
                paths = value_paths(record)
                print_ = fingerprint(paths)
                if print_ not in known:
                    if len(known) >= KNOWN_MAX:
                        known.clear()
                    known[print_] = _first(LAYOUTS, paths)
                layout = known[print_]
                prints.append(print_)
                names.append(layout and layout.name)
                turns.append(_dicts(turns_of(record, layout)) if layout else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.string()), pa.array(names, pa.string()), pa.array(turns, _TURNS)],
                [id_column, "fingerprint", "layout", "turns"],
            )

    return records.select(id_column, json_column).mapInArrow(
        read, f"`{id_column}` {kind}, fingerprint string, layout string, turns {TURNS}"
    )


def turns_of_table(table: DataFrame, id_column: str | None = None) -> DataFrame:
    """Canonical turns of any table: (conversation id, fingerprint, layout, turns).

    A table with a row a turn is grouped by conversation; other tables hold a record
    a row, identified by ``id_column``.
    """
    paths = schema_paths(table.schema)
    layout = _first(ROW_LAYOUTS, paths)
    if layout is None:
        if id_column is None:
            raise ValueError(f"no row layout for {sorted(paths)}; name an id column for record layouts")
        record = table.select(F.col(id_column), F.to_json(F.struct(*table.columns)).alias("__record"))
        return turns_of_json(record, "__record", id_column)
    turn = F.struct(
        F.col(layout.turn).alias("turn"),
        F.coalesce(layout.role, F.lit("")).alias("role"),
        F.coalesce(layout.text, F.lit("")).alias("text"),
    )
    return (
        table.groupBy(F.col(layout.conversation).alias("conv_id"))
        .agg(F.sort_array(F.collect_list(turn)).alias("rows"))
        .select(
            "conv_id",
            F.lit(fingerprint(paths)).alias("fingerprint"),
            F.lit(layout.name).alias("layout"),
            F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"),
        )
    )


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROL:
        text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation, and the spans that count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == ASSISTANT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for part in rendered.split(END)[:-1]:
        role, _, text = part.removeprefix(TURN).partition(TEXT)
        turns.append((unescape(role), unescape(text)))
    return turns


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def render_turns(conversations: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Rows (id_column, formatted, loss_spans) of canonical turns; null turns give nulls."""
    kind = conversations.schema[id_column].dataType.simpleString()

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, masks = [], []
            for turns in batch.column(1).to_pylist():
                text, spans = (None, None) if turns is None else render([(t["role"], t["text"]) for t in turns])
                texts.append(text)
                masks.append(None if spans is None else [{"start": a, "end": b} for a, b in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(masks, _SPANS)],
                [id_column, "formatted", "loss_spans"],
            )

    return conversations.select(id_column, "turns").mapInArrow(
        rendered, f"`{id_column}` {kind}, formatted string, loss_spans array<struct<start:long,end:long>>"
    )


def read_back(formatted: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Rows (id_column, formatted, turns, loss_text) from rendered conversations and their masks."""
    kind = formatted.schema[id_column].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, losses = [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns.append(None if text is None else _dicts(parse(text)))
                losses.append(None if text is None else "".join(unescape(text[s["start"] : s["end"]]) for s in spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(turns, _TURNS), pa.array(losses, pa.string())],
                [id_column, "formatted", "turns", "loss_text"],
            )

    return formatted.select(id_column, "formatted", "loss_spans").mapInArrow(
        read, f"`{id_column}` {kind}, formatted string, turns {TURNS}, loss_text string"
    )
