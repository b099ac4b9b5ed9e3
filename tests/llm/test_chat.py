import hashlib
import json

import pytest

from turnloom.llm import chat

TEXTS = ["plain", "", None, "\\", "<", "\\l", "\\\\<l\\", "</turn>\n", "<turn user>\n", "\n", chat.PROBE, "é😀<", "a>b\\n\\g"]


def test_round_trip(spark):
    rows = [(c, t, ("user", "assistant", "sys>tem\n<x", None)[(c + t) % 4], TEXTS[(3 * c + t) % len(TEXTS)], "x") for c in range(12) for t in range(6)]
    rows += [(None, 0, "user", "null id", "x"), (3, 2, "user", "tie", "x"), (3, None, "assistant", "no turn", "x"), (4, 4, *rows[4 * 6 + 4][2:])]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(chat.canonical_turns(df))).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
        assert [(t.role, t.text) for t in got[c].turns] == [(r[2] or "", r[3] or "") for r in mine]
        assert list(got[c].learned) == [r[3] or "" for r in mine if r[2] == "assistant"]


def test_layouts_agree(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    frames = [
        spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")], 5)], "conv_id bigint, messages array<struct<role:string,content:string>>, extra int"),
        spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "conv_id bigint, conversations array<struct<`from`:string,value:string>>"),
        spark.createDataFrame([(1, "hi", "", "yo")], "conv_id bigint, instruction string, input string, output string"),
        spark.createDataFrame([(1, "hi", "yo")], "conv_id bigint, prompt string, response string"),
        spark.createDataFrame([(1, "hi", "yo")], "conv_id bigint, question string, answer string"),
    ]
    for f in frames:
        assert [(r.role, r.text) for r in chat.canonical_turns(f).orderBy("turn").collect()] == want
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1,)], "what int"))


def test_extra_columns_take_no_part(spark):
    """Rows of turns beside a column of any name that some layout declares."""
    plain = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id bigint, turn bigint, role string, text string")
    want = [(r.conv_id, r.turn, r.role, r.text) for r in chat.canonical_turns(plain).orderBy("turn").collect()]
    for name in ("prompt", "answer", "input", "question", "output", "instruction", "response", "completion"):
        df = plain.selectExpr("*", f"'extra' as {name}", "array(named_struct('odd', 1)) as messages")
        assert [tuple(r) for r in chat.canonical_turns(df).orderBy("turn").collect()] == want
    both = spark.createDataFrame([(1, "hi", "yo", "meta")], "conv_id bigint, prompt string, response string, answer string")
    assert chat.layout_of(both.schema) == "prompt"


def test_long_and_repeated_turns(spark):
    text = "<a>\\\\ \n" * 20000
    rows = [(1, 0, "user", text), (1, 1, "assistant", text), (1, 1, "assistant", text), (2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(chat.canonical_turns(df))).collect()}
    assert [t.text for t in got[1].turns] == [text] * 3 and list(got[1].learned) == [text] * 2 and list(got[2].learned) == ["x"]


def test_json_rows_of_mixed_layouts(spark):
    bodies = [{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}, {"prompt": "hi", "completion": "yo", "meta": 1}, {"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}, {"odd": 1}, {"messages": [{"role": "user"}, {"role": "assistant", "content": "yo", "tool": 1}], "prompt": "no"}, {"turn": 4, "role": "user", "text": "hi", "answer": "no"}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "id bigint, body string")
    got = {}
    for r in chat.canonical_json_turns(df, "id", "body").orderBy("turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {**{i: [("user", "hi"), ("assistant", "yo")] for i in range(3)}, 4: [("user", None), ("assistant", "yo")], 5: [("user", "hi")]}


def test_probe(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (r,) = chat.op10_chat_formatting(spark, str(tmp_path)).collect()
    body = "\\### Assistant: </turn> ok"
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-7, 2, len(body)) and r.loss_sha256 == hashlib.sha256(body.encode()).hexdigest()
