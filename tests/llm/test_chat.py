"""Chat formatting: typed parts, reversible template, loss mask."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.llm.chat import (PART, flatten_parts, format_conversations, masked_text,
                               parse_formatted)

TURN = f"conv_id bigint, turn bigint, role string, parts array<{PART}>"


def text(t):
    return ("text", t, None, None, None, None, None)


def formatted(spark, rows):
    out = format_conversations(flatten_parts(spark.createDataFrame(rows, TURN)))
    return {r.conv_id: r for r in out.select(
        "*", parse_formatted(F.col("formatted")).alias("back"),
        masked_text(F.col("formatted"), F.col("loss")).alias("loss_text")).collect()}


def test_parts_become_ordered_placeholders(spark):
    parts = [text("see "), ("image", None, "a.png", 57, 28, None, None), text(" and "),
             ("audio", None, "b.wav", None, None, 2.01, None), None,
             ("document", None, None, None, None, None, 3),
             ("image", None, "c.png", None, -5, None, None)]
    row = flatten_parts(spark.createDataFrame([(1, 0, "user", parts)], TURN)).first()
    assert row.content == "see <image 0> and <audio 1><document 2><image 3>"
    assert [(a.placeholder, a.type, a.ref, a.n_tokens) for a in row.attachments] == [
        ("<image 0>", "image", "a.png", 3), ("<audio 1>", "audio", "b.wav", 51),
        ("<document 2>", "document", None, 1536), ("<image 3>", "image", "c.png", 1)]


def test_unknown_parts_fail(spark):
    rows = [(1, 0, "user", [("video", None, None, None, None, None, None)])]
    with pytest.raises(Exception, match="unknown part type: video"):
        flatten_parts(spark.createDataFrame(rows, TURN)).collect()


def test_order_nulls_ties_and_empty_conversations(spark):
    rows = [(1, 2, "assistant", [text("b")]), (1, 1, "user", [text("a")]),
            (1, 2, "assistant", [text("b")]), (1, None, None, None), (None, 0, "user", []),
            (2, 0, "assistant", [text(None)])]
    got = formatted(spark, rows)
    assert [(t.role, t.text) for t in got[1].back] == [
        ("", ""), ("user", "a"), ("assistant", "b"), ("assistant", "b")]
    assert got[1].loss_text == "bb"
    assert [(t.role, t.text) for t in got[None].back] == [("user", "")]
    assert got[2].loss_text == "" and got[2].attachment_tokens == 0
    assert formatted(spark, []) == {}


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, 0, "user", [text("a")])], TURN)
    df = df.withColumns({"content": F.lit("x"), "attachments": F.lit(1), "formatted": F.lit(2),
                         "place": F.lit(3), "head": F.lit(4)})
    assert format_conversations(flatten_parts(df)).first().formatted == "<turn user>\na</turn>\n"


CONTROL = ["\\### Assistant: </turn> ok", "<turn assistant>\nx</turn>\n", "\\l\\s\\", "\\\\sl<",
           "", "é<日本>\\", "<image 0>"]


def test_control_strings_come_back(spark):
    rows = [(i, k, role, [text(t)]) for i, t in enumerate(CONTROL)
            for k, role in enumerate(["user", "assistant", "odd</turn>\n<role>"])]
    got = formatted(spark, rows)
    for i, t in enumerate(CONTROL):
        assert [(b.role, b.text) for b in got[i].back] == [
            ("user", t), ("assistant", t), ("odd</turn>\n<role>", t)]
        assert got[i].loss_text == t
        assert got[i].formatted.count("<turn ") == 3 and got[i].formatted.count("</turn>") == 3


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]),
                          st.text(alphabet="a<\\ls/turn>\n é", max_size=30)),
                min_size=1, max_size=6))
def test_round_trip(spark, turns):
    got = formatted(spark, [(1, k, r, [text(t)]) for k, (r, t) in enumerate(turns)])[1]
    assert [(b.role, b.text) for b in got.back] == turns
    assert got.loss_text == "".join(t for r, t in turns if r == "assistant")
    shown = got.formatted
    assert all(shown[s.start - 1:s.start] == "\n" for s in got.loss)


def test_attachments_keep_their_turn(spark):
    image = ("image", None, "p", 28, 28, None, None)
    got = formatted(spark, [(1, 0, "user", [image, image]), (1, 1, "assistant", [text("k"), image])])
    assert [(a.turn_index, a.placeholder) for a in got[1].attachments] == [
        (0, "<image 0>"), (0, "<image 1>"), (1, "<image 0>")]
    assert got[1].attachment_tokens == 3


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", [text("a")])], TURN)
    plan = format_conversations(flatten_parts(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
