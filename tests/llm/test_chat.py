import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from slateql.llm.chat import ChatTemplate, format_conversations

T = ChatTemplate()


@given(st.text(alphabet="\\</s>[INST]|turnexd ", max_size=40))
def test_escape_round_trip(text):
    escaped = T.escaped(text)
    assert T.unescaped(escaped) == text
    assert not any(c in escaped for c in T.control)


def test_template_is_checked():
    with pytest.raises(ValueError):
        ChatTemplate(control=("\\x",))


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, valid int, segments string")
    found = format_conversations(df).collect()
    out = {}
    for r in found:
        out.setdefault(r.conv_id, []).append(r)
    return {c: sorted(rs, key=lambda r: r.turn_no) for c, rs in out.items()}


def test_states_nulls_ties_and_clashing_columns(spark):
    rows = [
        (1, 2, "assistant", "b</s>", 0, ""), (1, 1, "user", "a", 0, ""), (1, 0, "system", None, 0, ""),
        (2, 0, "assistant", "x", 0, ""), (2, 1, "user", "y", 0, ""),
        (3, 0, "user", "same", 0, ""), (3, 0, "user", "same", 0, ""),
        (None, None, None, None, 0, ""), (None, 1, "tool", "z", 0, ""),
    ]
    found = formatted(spark, rows)
    assert [r.valid for r in found[1]] == [True] * 3
    assert [[(s.text, s.loss) for s in r.segments][1] for r in found[1]] == [("", False), ("a", False), ("b<\\/s>", True)]
    assert [(r.valid, r.reason) for r in found[2]] == [(False, "assistant after start"), (True, None)]
    assert [r.valid for r in found[3]] == [True, False]
    assert [r.reason for r in found[None]] == ["no role after start", "tool after unknown"]


def test_empty(spark):
    assert formatted(spark, []) == {}


def test_long_conversation_keeps_its_order(spark):
    rows = [(7, k, "user" if k % 2 == 0 else "assistant", f"t{k}", 0, "") for k in range(12_000)]
    found = formatted(spark, rows)[7]
    assert all(r.valid for r in found)
    text = "".join(T.unescaped(s.text) for r in found for s in r.segments if s.loss)
    assert hashlib.sha256(text.encode()).hexdigest() == hashlib.sha256("".join(f"t{k}" for k in range(1, 12_000, 2)).encode()).hexdigest()


def test_loss_follows_the_state_entered(spark):
    template = ChatTemplate(enters={"user": "ask", "model": "answer", "assistant": "answer"}, loss=("answer",), order={"start": ("ask",), "ask": ("answer",)})
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "model", "a"), (1, 2, "assistant", "b"), (1, 3, "tool", "c")], "conv_id long, turn long, role string, text string")
    found = format_conversations(df, template).collect()
    assert [(r.state, r.segments[1].loss, r.reason) for r in found] == [("ask", False, None), ("answer", True, None), ("answer", True, "assistant after answer"), ("unknown", False, "tool after answer")]


def test_very_long_text(spark):
    text = "</s> word " * 300_000
    (found,) = formatted(spark, [(1, 0, "user", text, 0, "")])[1]
    assert T.unescaped(found.segments[1].text) == text and "</s>" not in found.segments[1].text
