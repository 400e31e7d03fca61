"""Formatted conversations, read back."""

import random

import pytest
from pyspark.sql import functions as F

from provenir.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["\\", "#", "##", "###", "### ", "</turn>", "</turn>\n", "<\\/turn>", ": ", ":", "\n", "a", "é", "🙂", "### assistant: ", "\\### ", " "]


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def in_order(rows):
    """Turns of each conversation as they should stand."""
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {conv: [(r, t) for *_, r, t in sorted(turns)] for conv, turns in by_conv.items()}


def random_rows(seed, n):
    draw = random.Random(seed)

    def words():
        return draw.choice([None, "", "".join(draw.choices(PARTS, k=draw.randrange(9)))])

    return [
        (draw.choice([None, *range(40)]), draw.choice([None, *range(-3, 12)]), draw.choice([None, "assistant", "user", "user", "odd: role\\", words()]), words())
        for _ in range(n)
    ]


def read_back(spark, rows, given=None):
    df = table(spark, rows) if given is None else given
    blocks = chat.format_conversations(df)
    whole = chat.whole_conversations(blocks, df)
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "")
    replies = F.flatten(F.transform("blocks", lambda b: chat.read_replies(b["text"], b["examples"])))
    return {r.conv_id: r for r in whole.select("conv_id", chat.read_turns(text).alias("turns"), replies.alias("replies")).collect()}


@pytest.mark.parametrize("block", [256, 3, 1])
def test_reading_back(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    rows = random_rows(block, 900)
    want, got = in_order(rows), read_back(spark, rows)
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv].turns] == turns
        assert got[conv].replies == [t for role, t in turns if role == "assistant"]


@pytest.mark.parametrize("block", [256, 2])
def test_each_reply_is_an_example_of_all_before_it(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block)
    draw = random.Random(7)
    rows = [(c, t, draw.choice(["user", "assistant", "system"]), "".join(draw.choices(PARTS, k=5))) for c in (1, 2, None) for t in range(9)]
    blocks = chat.format_conversations(table(spark, rows))
    got = chat.with_context(chat.examples(blocks), blocks)
    read = got.select("conv_id", "turn", "context", chat.read_turns(F.concat("context", "reply", F.lit(chat.END))).alias("turns"), chat.unescape(F.col("reply")).alias("reply"))
    want = in_order(rows)
    found = {(r.conv_id, r.turn): r for r in read.collect()}
    assert found.keys() == {(c, t) for c, t, role, _ in rows if role == "assistant"}
    for (conv, turn), r in found.items():
        assert [tuple(t) for t in r.turns] == want[conv][: turn + 1]
        assert r.reply == want[conv][turn][1] and r.context.endswith("### assistant: ")


def test_no_text_holds_a_mark(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choices(PARTS, k=12)) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    rows = df.select("t", "e", chat.unescape(F.col("e")).alias("back")).collect()
    assert all(r.back == r.t for r in rows)
    assert not any("###" in r.e or "</turn>" in r.e for r in rows)


def test_odd_tables(spark):
    assert chat.format_conversations(table(spark, []).limit(0)).count() == 0
    rows = [(1, 0, "user", "no reply"), (2, 5, "assistant", "x" * 2_000_000), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    named = table(spark, rows).withColumns({c: F.lit("z") for c in ("block", "examples", "turns", "b", "__conv")})
    got = read_back(spark, rows, named)
    assert got[1].replies == [] and got[2].replies == ["x" * 2_000_000] and got[3].replies == ["same", "same"]


def test_long_conversations_are_many_blocks(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.lit("t").alias("text"))
    blocks = chat.format_conversations(df)
    assert blocks.count() == -(-20_000 // chat.BLOCK_TURNS) and blocks.agg(F.max("n_turns")).first()[0] == chat.BLOCK_TURNS
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") == 1


def test_query(spark, sf_dir):
    df = queries.op13_chat_formatting(spark, sf_dir)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    own = {r.conv_id: r for r in df.collect()}[-7]
    assert own.n_turns == 2 and own.loss_chars == len(queries.AWKWARD_TURN)
