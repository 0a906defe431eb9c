"""Conversations and their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import constants as K
from marginalia.operators.retrieval import top_k


def listing(messages: DataFrame) -> DataFrame:
    """Per conversation: message count and first user message ('' when there is none)."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("message_count"),
        F.max("turn").alias("last_turn"),
        F.coalesce(first, F.lit("")).alias("preview"),
    )


def recent_conversations(messages: DataFrame, limit: int = 50) -> DataFrame:
    return listing(messages).orderBy(F.desc("last_turn"), "conversation_id").limit(limit)


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The newest n messages of every conversation, to be shown oldest first.

    Only n rows per conversation and partition reach the shuffle, whatever its length.
    """
    newest = top_k(messages, "conversation_id", [F.desc("turn")], n, "_back")
    return newest.drop("_back").orderBy("conversation_id", "turn")


def pruned(messages: DataFrame, keep: int = K.KEEP_MESSAGES) -> DataFrame:
    """The table after dropping all but the newest messages of each conversation."""
    return top_k(messages, "conversation_id", [F.desc("turn")], keep, "_back").drop("_back")


def without(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove whole conversations; the same call serves headers and messages."""
    return messages.join(gone.select("conversation_id").distinct(), "conversation_id", "left_anti")


def sessions(activity: DataFrame, gap: str, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """Runs of activity per user with no pause of ``gap`` or more. Works on streams too.

    In batch, rows are first counted by stretches of time as long as the gap, which combines where
    they are read: two rows of a stretch are never a gap apart, so they share a session. Only the
    stretches meet per user.
    """

    def runs(df: DataFrame, keys: list, start: str, length, n) -> DataFrame:
        return (
            df.groupBy(*keys, F.session_window(start, length).alias("_w"))
            .agg(n.alias("n"))
            .select(key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n")
        )

    if activity.isStreaming:
        return runs(activity, [key], ts, gap, F.count(F.lit(1)))
    width = F.expr(f"unix_micros(timestamp_seconds(0) + interval {gap})")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    stretches = activity.groupBy(key, F.floor(at / width).alias("_stretch")).agg(
        F.min(F.col(ts).cast("timestamp")).alias("_first"), F.min(at).alias("_a"), F.max(at).alias("_b"), F.count(F.lit(1)).alias("n")
    )
    length = F.concat((F.col("_b") - F.col("_a") + width).cast("string"), F.lit(" microseconds"))
    return runs(stretches, [key], "_first", length, F.sum("n"))
