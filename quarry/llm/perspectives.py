"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that speaker as the
assistant and all others as users under their names; only the assistant's content and its end
marker are trained on. System turns stay system turns in every rendering and give no perspective.

The result has one row per conversation, perspective and turn, so a conversation of any length stays
spread over many tasks: the rendering of a dialogue is its segments in the order of turn. The participants
of each conversation come from a pre-aggregated distinct, joined back by the conversation alone; the
output is what the operator asks for, turns times participants. ``render`` assembles whole dialogues from it.

Delimiters inside texts and names can't open or close a turn: ``<|im_`` becomes ``<\\|im_``; line breaks in names become blanks.

Defined results: a null speaker is the participant ``unknown``; a null text is empty; a null conversation id is a
conversation of its own; a null turn stays null and sorts last; repeated rows stay repeated; a conversation of
system turns alone has no perspective and no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<\\|im_"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: str = "system") -> DataFrame:
    """conv_id, perspective, turn, speaker, role, segment, mask_start, mask_end, trained.

    ``segment[mask_start:mask_end]`` (code points) is what the loss covers; empty unless the role is assistant."""
    said = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"), _safe(F.coalesce(F.col(text_col), F.lit(""))).alias("content"))
    who = said.where(F.col("speaker") != system).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    rows = said.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("perspective")
    rows = rows.withColumn("role", F.when(F.col("speaker") == system, "system").when(own, "assistant").otherwise("user"))
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), _safe(F.translate("speaker", "\r\n", "  ")))).otherwise(""), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("segment", F.concat(F.col("head"), F.col("content"), F.lit(CLOSE + "\n")))
    trained = F.col("role") == "assistant"
    start = F.when(trained, F.length("head")).otherwise(0).cast("long")
    end = F.when(trained, F.length("segment") - 1).otherwise(0).cast("long")
    return rows.select("conv_id", "perspective", "turn", "speaker", "role", "segment", start.alias("mask_start"), end.alias("mask_end"), trained.alias("trained"))


def place(rotated: DataFrame) -> DataFrame:
    """``rotated`` with ``begin``: where the turn's segment stands in its dialogue, turns in order (code points). A dialogue streams through a window, it isn't held."""
    before = Window.partitionBy("conv_id", "perspective").orderBy(F.col("turn").isNull(), "turn", "speaker", "segment").rowsBetween(Window.unboundedPreceding, -1)
    return rotated.withColumn("begin", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)))


def render(rotated: DataFrame) -> DataFrame:
    """One row per conversation and perspective: conv_id, perspective, text, masks (array of begin and end of what the loss covers).

    For dialogues that fit in one string (2 GB); ``place`` gives the same masks turn by turn for longer ones."""
    part = F.struct("begin", "segment", F.when(F.col("trained"), F.struct((F.col("begin") + F.col("mask_start")).alias("begin"), (F.col("begin") + F.col("mask_end")).alias("end"))).alias("mask"))
    whole = place(rotated).groupBy("conv_id", "perspective").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    masks = F.filter(F.transform("parts", lambda x: x["mask"]), lambda m: m.isNotNull())
    return whole.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("text"), masks.alias("masks"))
