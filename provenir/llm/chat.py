r"""Chat formatting for training: one example for every reply, in DataFrame functions only.

A turn is written ``### role: text</turn>`` and a line end. What could be taken for a
mark inside a role or text is broken up by a backslash, and so is a backslash, so that
reading back is exact and a formatted text can be cut at its marks by plain search.

Each assistant turn becomes an example of its own: all preceding turns are context, and
only that reply lies under the loss mask. Written out, the contexts of a conversation
grow with the square of its turns; here a conversation is stored once, in blocks of at
most ``BLOCK_TURNS`` turn numbers, and an example names its context as the prefix of
that text. ``with_context`` writes the contexts out where they are wanted.

Plan: turns are grouped by conversation and block, the one shuffle of texts. A
conversation that holds a third of all turns is many blocks, and no step but
``with_context`` and a digest of whole conversations brings blocks together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.joins import is_small

BLOCK_TURNS = 256
# The template. No escaped text holds BEGIN or END.
BEGIN, NAMED, END = "### ", ": ", "</turn>\n"
_HEADER = r"(?s)^### ((?:[^\\:]|\\.)*+): "


def escape(text: Column) -> Column:
    """``text`` with a backslash inside whatever reads like a mark, and before backslashes."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.regexp_replace(text, "#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(NAMED))


def format_conversations(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    trained: str = "assistant",
) -> DataFrame:
    """``conv_id, block, n_turns, text, examples``: conversations in blocks of turns.

    The texts of a conversation's blocks, in order, make up the conversation. There is
    an example for every turn of the role ``trained``: ``turn, loss_begin, loss_end,
    end``, in characters of the block's text. Its context is all blocks before, and
    this one up to ``loss_begin``; the reply is what lies under the mask, from there up
    to ``loss_end``; ``end`` is behind the mark that closes the turn.

    Turns stand in the order of their number, equal ones by role, then text; repeated
    rows stay. A null turn number comes first; null roles and texts are ''. Rows with a
    null conversation are one conversation. Conversations without a reply have no
    example and are there all the same; an empty table gives no rows. A very long text
    is one turn. Other columns of ``rows``, whatever their names, are not read.
    """
    role, text = (F.coalesce(rows[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = rows[turn_col].cast("long")
    block = F.floor(F.coalesce(turn, F.lit(0)) / BLOCK_TURNS).cast("long")
    given = rows.select(
        rows[conv_col].cast("long").alias("conv_id"),
        F.when(turn.isNull(), F.lit(None)).otherwise(block).alias("block"),
        F.struct(turn.alias("turn"), role.alias("role"), text.alias("text")).alias("turn"),
    )
    blocks = given.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    written = F.transform(
        "turns",
        lambda t: F.struct(
            t["turn"].alias("turn"),
            (t["role"] == trained).alias("trained"),
            _header(t["role"]).alias("header"),
            escape(t["text"]).alias("text"),
        ),
    )
    blocks = blocks.select("conv_id", "block", written.alias("turns"))

    def place(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(turn["header"])
        end = begin + F.length(turn["text"])
        here = F.struct(
            turn["turn"].alias("turn"),
            begin.alias("loss_begin"),
            end.alias("loss_end"),
            (end + len(END)).alias("end"),
        )
        found = F.when(turn["trained"], F.array_append(state["examples"], here)).otherwise(state["examples"])
        return F.struct((end + len(END)).alias("at"), found.alias("examples"))

    none = F.array().cast("array<struct<turn: bigint, loss_begin: int, loss_end: int, end: int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("examples"))
    return blocks.select(
        "conv_id",
        "block",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["header"], t["text"], F.lit(END))), "").alias("text"),
        F.aggregate("turns", start, place, lambda s: s["examples"]).alias("examples"),
    )


def examples(blocks: DataFrame) -> DataFrame:
    """One row for every reply of formatted conversations, with the reply as it is written.

    ``conv_id, block, turn, context_end, reply``: the context is all blocks before and
    the first ``context_end`` characters of this one.
    """
    each = blocks.select("conv_id", "block", "text", F.explode("examples").alias("e"))
    return each.select(
        "conv_id",
        "block",
        F.col("e.turn").alias("turn"),
        F.col("e.loss_begin").alias("context_end"),
        _span(F.col("text"), F.col("e.loss_begin"), F.col("e.loss_end")).alias("reply"),
    )


def with_context(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """``examples`` with their contexts written out in ``context``.

    The result repeats a conversation once for each of its replies, as such examples do.
    """
    own = blocks.select("conv_id", "block", F.col("text").alias("own"))
    named = [F.col(f"e.{c}") for c in found.columns]
    here = F.col("e.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("e.block").eqNullSafe(F.col("b.block"))
    joined = found.alias("e").join(own.alias("b"), here, "left")
    joined = joined.select(*named, F.substring(F.col("b.own"), 1, F.col("e.context_end")).alias("own"))
    before = F.col("b.block").isNull() & F.col("e.block").isNotNull() | (F.col("b.block") < F.col("e.block"))
    earlier = joined.alias("e").join(
        blocks.select("conv_id", "block", "text").alias("b"),
        F.col("e.conv_id").eqNullSafe(F.col("b.conv_id")) & before,
        "left",
    )
    parts = F.when(F.col("b.text").isNotNull(), F.struct(F.col("b.block").alias("block"), F.col("b.text").alias("text")))
    grouped = earlier.groupBy(*named, F.col("e.own").alias("own")).agg(F.sort_array(F.collect_list(parts)).alias("parts"))
    context = F.concat(F.array_join(F.transform("parts", lambda p: p["text"]), ""), "own")
    return grouped.select(*found.columns, context.alias("context"))


def _span(text: Column, begin: Column, end: Column) -> Column:
    return F.substring(text, begin + 1, end - begin)


def read_turns(text: Column) -> Column:
    """The turns of formatted text, an array of ``role, text``."""
    parts = F.split(text, END)
    return F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda p: F.struct(
            unescape(F.regexp_extract(p, _HEADER, 1)).alias("role"),
            unescape(F.regexp_replace(p, _HEADER, "")).alias("text"),
        ),
    )


def read_replies(text: Column, found: Column) -> Column:
    """What lies under the loss mask of each example of a block, unescaped."""
    return F.transform(found, lambda e: unescape(_span(text, e["loss_begin"], e["loss_end"])))


def whole_conversations(blocks: DataFrame, rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """``conv_id, blocks``: the blocks of each conversation of ``rows`` in one row, in order.

    For a digest that runs through a whole conversation. Only conversations of several
    blocks move; the keys of these are found from the turn numbers alone.
    """
    number = F.floor(rows[turn_col].cast("long") / BLOCK_TURNS)
    spread = rows.groupBy(rows[conv_col].cast("long").alias("__conv")).agg(
        F.min(number).alias("low"), F.max(number).alias("high"), F.count_if(number.isNull()).alias("unplaced")
    )
    several = spread.where("low < high or (unplaced > 0 and low is not null)").select("__conv")
    several = F.broadcast(several) if is_small(several) else several
    packed = blocks.select("conv_id", F.struct("block", "n_turns", "text", "examples").alias("b"))
    same = F.col("conv_id").eqNullSafe(F.col("__conv"))
    single = packed.join(several, same, "left_anti").select("conv_id", F.array("b").alias("blocks"))
    parted = packed.join(several, same, "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("blocks"))
    return single.unionByName(parted)
