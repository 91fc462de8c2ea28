"""Preference formatting in DataFrame functions.

Chosen and rejected conversations are paired by an id.  Their longest common turn prefix is rendered once as the prompt;
what follows is rendered as two completions, each with the places of the text that a model is trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands around a turn.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _turns(rows: DataFrame, name: str) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.where(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(F.array_sort(F.collect_list(turn)).alias(name))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def _mask(turns: Column, trained: str) -> Column:
    """start:end of each trained turn's text and end mark, in code points of the completion."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(turn["role"]) + len(OPEN) + len(CLOSE)
        end = begin + F.length(turn["text"]) + len(END)
        span = F.concat(begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(turn["role"] == trained, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, start, add, lambda s: s["spans"]), ",")


def preference_rows(chosen: DataFrame, rejected: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per pair_id that has turns on both sides: pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    Both inputs have pair_id, turn, role and text.  Turns are ordered by turn, then role and text, null turns first; turns are common
    if role and text agree, whatever their numbers.  A null role or text is empty.  Rows without pair_id are left out.  Conversations
    that agree throughout give empty completions; where one is the beginning of the other its completion is empty.  Repeated rows are
    turns of their own.  Masks list start:end, comma-joined, over the completion.  Other columns are ignored.
    Texts of any length are rendered whole and unescaped, so one that holds the marks of a turn reads as a turn.  An empty table on either
    side gives an empty table.
    """
    both = _turns(chosen, "c").join(_turns(rejected, "r"), "pair_id")
    n = F.least(F.size("c"), F.size("r"))
    agree = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (F.col("c")[i]["role"] == F.col("r")[i]["role"]) & (F.col("c")[i]["text"] == F.col("r")[i]["text"]))
    first = F.array_position(agree, F.lit(False))
    both = both.withColumn("n_common", F.when(first == 0, n.cast("long")).otherwise(first - 1))
    rest = lambda x: F.slice(x, F.col("n_common").cast("int") + 1, F.size(x))
    both = both.select("pair_id", "n_common", F.slice("c", 1, F.col("n_common").cast("int")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    joined = lambda x: F.array_join(F.transform(x, _rendered), "")
    return both.select(
        "pair_id", "n_common", joined("p").alias("prompt"), joined("c").alias("chosen"), joined("r").alias("rejected"),
        _mask(F.col("c"), trained).alias("chosen_mask"), _mask(F.col("r"), trained).alias("rejected_mask"),
    )


def swapped_replies(conversations: DataFrame, trained: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations (conv_id, turn, role, text).

    The chosen conversation is the one given; the rejected one ends with the last reply of its neighbour, whose conv_id differs in
    the lowest bit, in place of its own.  Without a neighbour or a reply both are the same.
    """
    given = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = given.where(F.col("role") == trained).groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("x"))
    mine = last.select("pair_id", F.col("x.turn").alias("last"))
    theirs = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("x.text").alias("reply"))
    swaps = mine.join(theirs, "pair_id")
    here = F.coalesce((F.col("turn") == F.col("last")) & (F.col("role") == trained), F.lit(False))
    rejected = given.join(swaps, "pair_id", "left").select("pair_id", "turn", "role", F.when(here, F.col("reply")).otherwise(F.col("text")).alias("text"))
    return given, rejected
