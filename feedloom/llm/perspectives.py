"""Chat formatting from each participant's side, in DataFrame functions alone.

For every participant of a conversation the dialogue is rendered with that speaker as assistant, the others as
named users, and a mask that trains on the assistant's words. The result has one row per message and
perspective, with its place in the rendered dialogue, so that a dialogue of any length is never held in one
task or row; ``joined`` puts the pieces of ordinary dialogues together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grouping import sum_before

SYSTEM = "system"
END = "<|end|>\n"
#: Turns whose lengths are summed before dialogues are ordered, so no task orders a whole long one.
TURNS = 256


def _head(role: Column, speaker: Column) -> Column:
    name = F.when(speaker.isNotNull(), F.concat(F.lit(" name="), speaker)).otherwise(F.lit(""))
    return F.concat(F.lit("<|"), role, F.when(role == "user", name).otherwise(F.lit("")), F.lit("|>\n"))


def rotate(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text"
) -> DataFrame:
    """Per message and perspective: conversation, ``perspective``, turn, ``chat_role``, ``name``, ``rendered``,
    ``start``, ``length``, ``train_start``, ``train_end`` (code points in the rendered dialogue; equal if not trained).

    Participants are the speakers but ``system``, whose messages stay system messages in every perspective. A
    null speaker is an unnamed user and no participant; a null text is empty. Messages are ordered by turn
    (null first), speaker, text; repeated rows are rendered once each. Null conversations form one. A
    conversation without participants gives no rows, nor does an empty table. Other columns are not read.
    """
    kind = turns.schema[conversation].dataType
    rows = turns.select(
        F.coalesce(F.col(conversation).cast("string"), F.lit("\0")).alias("c"), F.col(turn).alias("t"),
        F.col(speaker).alias("s"), F.coalesce(F.col(text), F.lit("")).alias("x"),
    )
    sides = rows.filter(F.col("s").isNotNull() & (F.col("s") != SYSTEM)).select("c", F.col("s").alias("perspective")).distinct()
    role = F.when(F.col("s") == F.col("perspective"), "assistant").when(F.col("s") == SYSTEM, SYSTEM).otherwise(F.lit("user"))
    each = rows.join(sides, "c").withColumn("chat_role", role).withColumn("head", _head(F.col("chat_role"), F.col("s")))
    each = each.withColumn("rendered", F.concat("head", "x", F.lit(END))).withColumn("length", F.length("rendered").cast("bigint"))
    placed = sum_before(
        each, ["c", "perspective"], F.coalesce(F.floor(F.col("t") / TURNS), F.lit(-(1 << 62))), ["t", "s", "x"], F.col("length").cast("double"), "start"
    ).withColumn("start", F.col("start").cast("bigint"))
    end, trained = F.col("start") + F.col("length"), F.col("chat_role") == "assistant"
    return placed.select(
        F.when(F.col("c") != "\0", F.col("c")).cast(kind).alias(conversation), "perspective", F.col("t").alias(turn), "chat_role",
        F.when(F.col("chat_role") == "user", F.col("s")).alias("name"), "rendered", "start", "length",
        F.when(trained, F.col("start") + F.length("head")).otherwise(end).alias("train_start"),
        # the end mark is trained, the line break after it is not
        F.when(trained, end - 1).otherwise(end).alias("train_end"),
    )


def joined(pieces: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, perspective, dialogue, spans): whole dialogues, for conversations that fit a row."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "rendered", "train_start", "train_end")))
    return pieces.groupBy(conversation, "perspective").agg(ordered.alias("p")).select(
        conversation, "perspective", F.array_join("p.rendered", "").alias("dialogue"),
        F.transform(
            F.filter("p", lambda m: m["train_start"] < m["train_end"]), lambda m: F.struct(m["train_start"].alias("start"), m["train_end"].alias("end"))
        ).alias("spans"),
    )
