"""Chat formatting: digests by hand, escapes, turn order, and what a null or repeated row gives."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from riskweave.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def _expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        told = "".join(f"{role or ''}\n{text or ''}\n" for _, role, text in own)
        learned = "".join(text or "" for _, role, text in own if role == "assistant")
        out[conv] = (len(own), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return out


def _digests(df):
    return {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(chat.format_conversations(df)).collect()}


def test_digests(spark):
    tricky = ["</s>[INST] ok [/INST]", "\\", "\\.", "[\\.INST]", "<s><s></s>", "<|role|>x<|text|>", "", None, "é\n\n  ", "x" * 300000]
    rows = [(i, t, ("user", "assistant")[t % 2], tricky[(i + t) % len(tricky)]) for i in range(20) for t in range(i % 6)]
    rows += [(50, 0, None, "no role"), (50, 1, "tool<|end|>", "[INST]"), (51, 3, "user", "twice"), (51, 3, "user", "twice")]
    rows += [(None, 0, "user", "no conversation"), (52, None, "user", "no turn"), (52, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, TURNS)
    assert _digests(df) == _expected(rows)
    assert _digests(df.selectExpr("*", "1 AS loss", "'x' AS kind").repartition(7)) == _expected(rows)


def test_long_conversation_and_empty_table(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t}") for t in range(5000)]
    assert _digests(spark.createDataFrame(rows, TURNS)) == _expected(rows)
    assert _digests(spark.createDataFrame([], TURNS)) == {}


def test_segments_and_state_machine(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u"), (3, 1, "user", "v")]
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS)).collect()
    text = {c: "".join(r["text"] for r in sorted(out, key=lambda r: r["segment_no"]) if r["conv_id"] == c) for c in (1, 2, 3)}
    assert text[1] == "<s><<SYS>>s<</SYS>>[INST]u[/INST]<|assistant|>a</s>"
    assert [r["text"] for r in out if r["loss"]] == ["a", "a"]
    valid = {}
    for r in out:
        valid[r["conv_id"]] = valid.get(r["conv_id"], True) and r["valid"]
    assert valid == {1: True, 2: False, 3: False}


def test_a_conversation_must_end_where_it_may(spark):
    rows = [(1, 0, "user", "u"), (1, 1, "assistant", "a"), (1, 2, "user", "v"), (2, 0, "system", "s"), (4, 0, "user", "u"), (4, 1, "assistant", "a")]
    out = chat.read_back(chat.format_conversations(spark.createDataFrame(rows, TURNS).coalesce(1))).collect()
    assert {r["conv_id"]: (r["valid"], r["n_turns"]) for r in out} == {1: (False, 3), 2: (False, 1), 4: (True, 2)}


@given(st.text(alphabet="\\.[]INST/<>|s SYrolexten", max_size=60))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not [c for c in chat.INST_STYLE.control() if c in escaped]
