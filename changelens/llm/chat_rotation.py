"""Perspective rotation of multi-party dialogues: one rendering per participant, with that speaker as the assistant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import ordered_totals

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
UNNAMED = "unknown"


def _plain(text: Column) -> Column:
    """Markers inside a text are broken by a backslash, so only the renderer writes them."""
    for marker in (OPEN, CLOSE):
        text = F.replace(text, F.lit(marker), F.lit(marker.replace("<|", "<\\|")))
    return text


def rotate(turns: DataFrame, conversation: str = "conv_id", order: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation, perspective and turn; the rows of a perspective, by ``position``, concatenate to its dialogue.

    Columns: conv_id, perspective, position, turn, speaker, rendered, char_start
    (in the dialogue) and mask_start, mask_end: the part to train on, which is the text and end mark
    of the perspective's own turns (null elsewhere).  Other speakers are users
    with their names; system turns stay as they are and have no perspective.

    A null speaker is called ``unknown``; null text is empty; a null
    conversation is one of its own; ties of ``order`` go by speaker, then text.
    A conversation of system turns alone has no rows.  Dialogues stay rows, as a
    conversation has no bound: positions and offsets come from a range sort of
    the whole table, not from one task per conversation.
    """
    who = F.coalesce(F.col(f"`{speaker}`"), F.lit(UNNAMED))
    rows = turns.select(F.col(f"`{conversation}`").alias("conv_id"), F.col(f"`{order}`").alias("turn"), who.alias("speaker"),
                        _plain(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"), F.monotonically_increasing_id().alias("__row"))
    parts = rows.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("__c"), F.col("speaker").alias("perspective")).distinct()
    rows = rows.join(parts, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")
    mine = F.col("speaker") == F.col("perspective")
    head = F.when(mine, "assistant").when(F.col("speaker") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), "speaker"))
    rows = rows.withColumn("__head", F.length(F.concat(F.lit(OPEN), head, F.lit("\n"))))
    rows = rows.withColumn("rendered", F.concat(F.lit(OPEN), head, F.lit("\n"), "text", F.lit(CLOSE + "\n")))
    rows = rows.select("conv_id", "perspective", "turn", "speaker", "rendered", "__head", "__row", F.md5("text").alias("__hash"),
                       F.lit(1).alias("__one"), F.length("rendered").alias("__size"))
    rows = ordered_totals(rows, ["conv_id", "perspective", "turn", "speaker", "__hash", "__row"],
                          {"__one": "__rows", "__size": "__chars"}, "chat-turns")
    first = rows.groupBy(F.col("conv_id").alias("__c"), F.col("perspective").alias("__p")).agg(
        F.min("__rows").alias("__row0"), F.min("__chars").alias("__char0"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("perspective") == F.col("__p")))
    start = F.col("__chars") - F.col("__char0")
    own = F.col("speaker") == F.col("perspective")
    return rows.select("conv_id", "perspective", (F.col("__rows") - F.col("__row0")).alias("position"), "turn", "speaker", "rendered",
                       start.alias("char_start"), F.when(own, start + F.col("__head")).alias("mask_start"),
                       F.when(own, start + F.col("__size") - 1).alias("mask_end"))
