"""Preference pairs for training: a shared prompt, and two completions with their masks.

A pair has a chosen and a rejected conversation.  Their longest common prefix of turns (same role and text) is rendered once
as the prompt; what follows on each side is its completion, whose mask holds the spans of characters that an assistant
wrote, which are the ones to learn from.  A turn is rendered as ``<|role|>``, a line break, the text, ``<|end|>``, a line break.

Defined cases: rows without a conversation or a turn number are left out; a null role is ``unknown``, a null text empty; of
rows with the same conversation and turn the least by role and text counts, so repeated rows count once; turns are taken in
ascending order, whatever their numbers; texts of any length are kept whole; equal sides give two empty completions; empty
tables give an empty result.  A conversation is one row, so its turns together must fit one (two billion bytes).
Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislemetrics.session import materialise

ASSISTANT = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>), the turns in order."""
    turn = F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = turns.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(turn).alias("said"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "said")))
    return one.groupBy("conv_id").agg(F.transform(ordered, lambda t: t["said"]).alias("turns"))


def with_swapped_replies(talks: DataFrame) -> DataFrame:
    """Pairs (pair_id, chosen, rejected) from conversations that have an assistant's turn.

    Chosen is the conversation up to the assistant's last turn; rejected has there the last reply of the next conversation
    by id, the last conversation that of the first.  Only ids and replies are put in order, by ranges of ids; where a range
    ends, the first reply of the next one is lent.  A single conversation has nobody to borrow from, and equal sides.
    """
    place = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), ASSISTANT).cast("int") + 1
    cut = talks.where(F.exists("turns", lambda t: t["role"] == ASSISTANT)).withColumn("last", place)
    cut = materialise(cut.select("conv_id", F.slice("turns", 1, F.col("last")).alias("chosen")), "preference-chosen")
    ranges = cut.select("conv_id", F.element_at("chosen", -1).alias("reply")).repartitionByRange("conv_id")
    ranges = materialise(ranges.withColumn("range", F.spark_partition_id()), "preference-replies")
    order = Window.partitionBy("range").orderBy("conv_id")
    inside = ranges.withColumn("other", F.lead("reply").over(order))
    # One row a range: the first reply of the next range that has any, the last range's being the first one's.
    first = ranges.groupBy("range").agg(F.min_by("reply", "conv_id").alias("reply"))
    whole = Window.partitionBy(F.lit(0)).orderBy("range")
    circle = F.coalesce(F.lead("reply").over(whole), F.first("reply").over(whole))
    lent = inside.join(first.select("range", circle.alias("next")), "range").select("conv_id", F.coalesce("other", "next").alias("reply"))
    before = F.slice("chosen", F.lit(1), F.size("chosen") - 1)
    paired = cut.join(lent, "conv_id")
    return paired.select(F.col("conv_id").alias("pair_id"), "chosen", F.concat(before, F.array("reply")).alias("rejected"))


def _rendered(turns: Column) -> Column:
    parts = F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n")))
    return F.array_join(parts, "")


def _mask(turns: Column) -> Column:
    """Spans (start, end) of the assistant's texts in the rendered turns, code points, end exclusive."""

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == ASSISTANT, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + 8).alias("at"), spans.alias("spans"))

    none = F.array().cast("array<struct<start: int, end: int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda state: state["spans"])


def preference_rows(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_shared, prompt, chosen, rejected, chosen_mask, rejected_mask) of pairs (pair_id, chosen, rejected).

    The sides are arrays of (role, text); n_shared counts the turns of the prompt.
    """
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differ = F.transform(F.arrays_zip("chosen", "rejected"), lambda both: ~both["chosen"].eqNullSafe(both["rejected"]))
    first = F.array_position(differ, True).cast("int")
    shared = F.when(first > 0, F.least(shorter, first - 1)).otherwise(shorter)
    cut = pairs.withColumn("n_shared", shared)
    rest = {side: F.slice(side, F.col("n_shared") + 1, F.size(side)) for side in ("chosen", "rejected")}
    return cut.select(
        "pair_id",
        F.col("n_shared").cast("long").alias("n_shared"),
        _rendered(F.slice("chosen", F.lit(1), F.col("n_shared"))).alias("prompt"),
        *(_rendered(turns).alias(side) for side, turns in rest.items()),
        *(_mask(turns).alias(f"{side}_mask") for side, turns in rest.items()),
    )


def digests(rows: DataFrame) -> DataFrame:
    """``preference_rows`` with each mask as start:end, joined by commas."""

    def joined(mask: str) -> Column:
        return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(mask)

    return rows.select("pair_id", "n_shared", "prompt", "chosen", "rejected", joined("chosen_mask"), joined("rejected_mask"))
