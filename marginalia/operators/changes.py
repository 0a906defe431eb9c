"""What changed between two states of a folder, and applying it to the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X


def classify(current: DataFrame, tracked: DataFrame) -> DataFrame:
    """(note_path, change): new, modified, deleted or unchanged.

    An equal modification time settles it without looking at hashes.
    """
    now = current.select("note_path", F.col("mtime").alias("_m1"), F.col("hash").alias("_h1"))
    old = tracked.select("note_path", F.col("mtime").alias("_m0"), F.col("hash").alias("_h0"))
    change = (
        F.when(F.col("_h0").isNull() & F.col("_m0").isNull(), "new")
        .when(F.col("_h1").isNull() & F.col("_m1").isNull(), "deleted")
        .when(F.col("_m0") == F.col("_m1"), "unchanged")
        .when(F.col("_h0") == F.col("_h1"), "unchanged")
        .otherwise("modified")
    )
    return now.join(old, "note_path", "full_outer").select("note_path", change.alias("change"))


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def upsert(base: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Keep base rows without a new version, add all new rows."""
    return base.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def delete(base: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def removed(base: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), list(keys), "left_semi")


def apply_to_chunks(chunks: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Index rows after a run: rows of deleted and modified notes go, fresh rows come in.

    ``fresh`` holds the chunks of new and modified notes only.
    """
    stale = changes.where(F.col("change").isin("deleted", "modified"))
    return delete(chunks, stale, "note_path").unionByName(fresh)


def stamped(changes: DataFrame, current: DataFrame, counts: DataFrame, at: str) -> DataFrame:
    """Tracker rows of the notes that a run processed."""
    done = changes.where(F.col("change").isin("new", "modified")).select("note_path")
    return (
        current.join(done, "note_path", "left_semi")
        .join(counts, "note_path", "left")
        .select(
            "note_path",
            "mtime",
            "hash",
            F.lit(at).alias("indexed_at"),
            F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"),
        )
    )


def apply_to_tracker(tracker: DataFrame, changes: DataFrame, current: DataFrame, counts: DataFrame, at: str) -> DataFrame:
    """Tracker rows after a run: processed notes are stamped, deleted ones leave."""
    left = delete(tracker, changes.where("change = 'deleted'"), "note_path")
    return upsert(left, stamped(changes, current, counts, at), "note_path")


def stale_metadata(current: DataFrame, metadata: DataFrame) -> DataFrame:
    """Notes whose metadata is missing or was made from other content."""
    made = metadata.select("note_path", F.col("content_hash").alias("_h"))
    return current.join(made, "note_path", "left").where(~F.col("hash").eqNullSafe(F.col("_h"))).drop("_h")


def duplicate_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content_hash, first_key) of rows whose trimmed text occurred under an earlier key.

    Each hash is reduced to its first key before rows meet it again, so a text copied
    very often is still one small row on the reduced side.
    """
    hashed = texts.select(key, X.hash16(X.strip(F.col(text))).alias("content_hash"))
    firsts = hashed.groupBy("content_hash").agg(F.min(key).alias("first_key"))
    return hashed.join(firsts, "content_hash").where(F.col(key) != F.col("first_key"))


def already_processed(incoming: DataFrame, processed: DataFrame, text: str) -> DataFrame:
    """Incoming rows whose trimmed text was processed before."""
    seen = processed.select(X.hash16(X.strip(F.col(text))).alias("_h")).distinct()
    return incoming.withColumn("_h", X.hash16(X.strip(F.col(text)))).join(seen, "_h", "left_semi").drop("_h")
