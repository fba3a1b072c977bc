"""Chat data: turns to messages and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.running import number_rows


def collect_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turns to one row of ordered messages per conversation, the form of formats with one record each.

    Where rows of messages will do, `flatten_turns` gathers nothing.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("role"), F.col("text").alias("content"))))
    messages = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return turns.groupBy(conv).agg(messages.alias("messages"))


def flatten_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", source: Column | None = None) -> DataFrame:
    """One row per message with its index and the length of its conversation, whatever that length.

    Running numbers cross task borders, and the lengths are counts that combine before they shuffle.
    """
    rows = turns.select(F.col(conv).alias("conversation_id"), F.col(turn).alias("_turn"), "role", F.col("text").alias("content"), (F.lit("") if source is None else source).alias("source_file"))
    lengths = rows.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("conversation_length"))
    numbered = number_rows(rows, ["conversation_id"], ["_turn"], "_n").join(lengths, "conversation_id")
    return numbered.select("conversation_id", "source_file", (F.col("_n") - 1).alias("message_index"), "role", "content", "conversation_length")


def flatten_conversations(conversations: DataFrame, conv: str = "conv_id", source: str | None = None) -> DataFrame:
    """One row per message of collected conversations, with its index and the length of the conversation."""
    source_file = F.col(source) if source else F.lit("")
    return conversations.select(
        F.col(conv).alias("conversation_id"),
        source_file.alias("source_file"),
        F.size("messages").alias("conversation_length"),
        F.posexplode("messages").alias("message_index", "m"),
    ).select("conversation_id", "source_file", "message_index", "m.role", "m.content", "conversation_length")


def chat_jsonl(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    return conversations.select(conv, F.to_json(F.struct("messages")).alias("json"))
