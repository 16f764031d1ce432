"""Chat formatting with Spark expressions: one string per conversation and its loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

START, MESSAGE, TURN, END = "<|im_start|>", "<|message|>", "<|turn|>", "<|im_end|>\n"
# Control strings of this template and of other common ones; none is left bare inside a text.
_CONTROL = r"\|(?:im_start|im_end|message|turn|startoftext|endoftext)\|>|/?s>|/?INST\]|</?SYS>>"
ESCAPE, ESCAPED = rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3"
UNESCAPE, UNESCAPED = rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3"


def escape(text: Column) -> Column:
    """One more backslash after the first character of each control string; undone by ``unescape``."""
    return F.regexp_replace(text, ESCAPE, ESCAPED)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, UNESCAPED)


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, segments, formatted): one row per conversation.

    Turns are sorted by (turn, role, text), nulls first, so ties and repeated rows have one order;
    every row is a turn. Adjacent turns of one role are merged into one block and stay apart inside
    it by a turn mark. Null role and null text are empty; rows without conv_id form one
    conversation. ``formatted`` joins the ``segments`` (text, loss); loss is true for the escaped
    texts of the ``trained`` role alone. An empty table gives no rows; other columns are ignored.
    """
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), text_of().alias("text"))
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    roles = F.transform("rows", lambda r: r["role"])
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(roles, 1, F.size("rows") - 1))
    pairs = F.arrays_zip(F.col("rows").alias("r"), before.alias("b"))

    def pieces(pair: Column, i: Column) -> Column:
        role = pair["r"]["role"]
        opening = F.concat(F.when(i == 0, "").otherwise(END), F.lit(START), escape(role), F.lit(MESSAGE))
        mark = F.when(pair["b"].eqNullSafe(role), F.lit(TURN)).otherwise(opening)
        return F.array(
            F.struct(mark.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(pair["r"]["text"]).alias("text"), (role == trained).alias("loss")),
        )

    last = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    segments = F.concat(F.flatten(F.transform(pairs, pieces)), last)
    chats = chats.select("conv_id", segments.alias("segments"))
    return chats.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds, unescaped, in order."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(block, r"<\|im_start\|>|<\|message\|>", 3)
        role = unescape(F.get(parts, F.lit(1)))
        texts = F.split(F.get(parts, F.lit(2)), r"<\|turn\|>", -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
