import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsetally.llm.chat import (
    CONTROL, END, TEXT, TURN, escape, fingerprint, parse, read_back, render, render_turns, schema_paths,
    turns_of_json, turns_of_table, unescape, value_paths,
)

TOUGH = st.lists(st.sampled_from([*CONTROL, TURN, TEXT, END, "\\", "<", "|", ">", "[", "/", "a", "é", "\n"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), TOUGH), TOUGH), max_size=4))
def test_round_trip(turns):
    text, spans = render(turns)
    assert parse(text) == turns
    assert "".join(unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")
    for _, t in turns:
        assert not any(c in escape(t) for c in CONTROL)


RECORDS = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3},
    "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    "instruction-output": {"instruction": "q", "input": "", "output": "a"},
    "prompt-completion": {"prompt": "q", "completion": "a", "meta": {"n": [1, 2]}},
    "nested-prompt": {"prompt": {"text": "q"}, "completion": {"text": "a"}},
    "question-answer": {"question": "q", "answer": "a"},
}


def test_layouts_meet_in_canonical_turns(spark):
    rows = [(name, json.dumps(r)) for name, r in RECORDS.items()]
    rows += [("none", '{"a": 1}'), ("broken", "{"), ("null", None), ("list", "[1]"), ("input", '{"instruction": "i", "input": "x", "output": "a"}')]
    rows += [("parts", '{"messages": [{"role": "user", "content": [{"text": "x"}, {"text": "y"}]}, {"role": null, "content": null}]}')]
    frame = spark.createDataFrame([(*r, "t") for r in rows], "id string, json string, turns string")
    got = {r.id: r for r in turns_of_json(frame, "json", "id").collect()}
    for name in RECORDS:
        assert got[name].layout == name
        assert [tuple(t) for t in got[name].turns] == [("user", "q"), ("assistant", "a")]
        assert got[name].fingerprint == fingerprint(value_paths(RECORDS[name]))
    assert [tuple(t) for t in got["input"].turns] == [("user", "i\n\nx"), ("assistant", "a")]
    assert [tuple(t) for t in got["parts"].turns] == [("user", "x\ny"), ("", "")]
    assert got["none"].layout is None and got["none"].fingerprint and got["none"].turns is None
    assert all(got[n].turns is None and got[n].fingerprint is None for n in ("broken", "null", "list"))


def test_fingerprint_is_of_paths_only():
    a, b = {"x": {"y": 1, "z": [{"k": 2}]}}, {"x": {"z": [{"k": "s"}, {"k": None}], "y": None}}
    assert fingerprint(value_paths(a)) == fingerprint(value_paths(b))
    assert fingerprint(value_paths(a)) != fingerprint(value_paths({"x": {"y": 1}}))


def test_rows_of_turns(spark):
    rows = [(1, 2, "assistant", "late"), (1, 1, "user", None), (1, None, None, "first"), (1, 2, "assistant", "early"), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame([(*r, "e", "f") for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted string")
    assert "turn" in schema_paths(frame.schema)
    back = {r.conv_id: r for r in read_back(render_turns(turns_of_table(frame))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("", "first"), ("user", ""), ("assistant", "early"), ("assistant", "late")]
    assert back[1].loss_text == "earlylate" and back[None].loss_text == "x"
    assert turns_of_table(frame.limit(0)).count() == 0


def test_records_of_a_table(spark):
    frame = spark.createDataFrame([(7, "q", "a")], "id long, prompt string, response string")
    row = turns_of_table(frame, "id").first()
    assert (row.layout, [tuple(t) for t in row.turns]) == ("prompt-response", [("user", "q"), ("assistant", "a")])
    with pytest.raises(ValueError):
        turns_of_table(frame)


def test_null_turns_stay_null(spark):
    frame = spark.createDataFrame([(1, None)], "conv_id long, turns array<struct<role:string,text:string>>")
    assert read_back(render_turns(frame)).first()[1:] == (None, None, None)
