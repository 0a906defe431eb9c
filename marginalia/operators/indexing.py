"""Bring the chunk, vector and tracker tables up to date with a folder of notes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import changes, notes, stored_index
from marginalia.session import materialize, scratch
from marginalia.sources.versions import Append, Replace, Store, Table, Version


@dataclass(frozen=True)
class Indexed:
    """Tables after a run, and what the run did."""

    chunks: DataFrame
    tracker: DataFrame
    changes: DataFrame
    fresh: DataFrame


def reindex(files: DataFrame, tracker: DataFrame, chunks: DataFrame, run: str, full: bool = False) -> Indexed:
    """Apply the current files (note_path, content, mtime) to the stored tables.

    Only new and modified notes are parsed and cut; chunks of modified and deleted notes go. The
    tracker keeps the true number of chunks of every note. ``full`` cuts every note again,
    whatever the tracker says. Both tables are new frames; the stored ones stay as they are.
    """
    current = files.select("note_path", "mtime", F.sha1(F.col("content").cast("binary")).alias("hash"))
    found = changes.classify(current, tracker)
    if full:
        found = found.withColumn("change", F.when(F.col("change") == "unchanged", "modified").otherwise(F.col("change")))
    found = materialize(found, "changes")
    todo = found.where(F.col("change").isin("new", "modified"))
    texts = files.select("note_path", "content").join(todo.select("note_path"), "note_path", "left_semi")
    fresh = materialize(notes.chunk(notes.parse(texts)), "fresh-chunks")
    counts = fresh.groupBy("note_path").agg(F.count(F.lit(1)).alias("chunk_count"))
    return Indexed(
        changes.apply_to_chunks(chunks, found, fresh.select(*chunks.columns)),
        changes.apply_to_tracker(tracker, found, current, counts, run),
        found,
        fresh,
    )


def fresh_vectors(fresh: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(chunk_id, note_path, embedding) of chunks, from their embedding text."""
    text = X.embedding_text(F.col("heading_path"), F.col("chunk_text"))
    return fresh.select("chunk_id", "note_path", embed(text).alias("embedding"))


def revector(vectors: DataFrame, indexed: Indexed, embed: Callable[[Column], Column]) -> DataFrame:
    """(chunk_id, note_path, embedding) after a run: rows of changed notes go, ``embed`` gives the
    vectors of the fresh chunks."""
    stale = indexed.changes.where(F.col("change").isin("deleted", "modified"))
    return changes.delete(vectors, stale, "note_path").unionByName(fresh_vectors(indexed.fresh, embed).select(*vectors.columns))


# --- committed runs ---------------------------------------------------------------------


def tables(mtime: str = "timestamp", buckets: int = 16) -> dict[str, Table]:
    """Tables of a stored index; those that go by note are touched in the same buckets."""
    return {
        "chunks": Table(
            "note_path string, note_title string, note_folder string, note_date string, chunk_index int, "
            "heading_path array<string>, chunk_text string, chunk_id string, checksum string",
            "note_path", buckets, ("note_path", "chunk_index"),
        ),
        "vectors": Table("chunk_id string, note_path string, embedding array<float>", "note_path", buckets),
        "tracker": Table(f"note_path string, mtime {mtime}, hash string, indexed_at string, chunk_count long", "note_path", buckets),
        **stored_index.tables(buckets),
    }


def commit_run(
    store: Store, files: DataFrame, run: str, embed: Callable[[Column], Column] | None = None, full: bool = False,
    touched: DataFrame | None = None, mark: tuple[str, int] | None = None,
) -> Version:
    """Bring every table of a store up to date with files (note_path, content, mtime), visible at once.

    ``files`` is the whole folder, or, where ``touched`` (note_path) is given, what is left of those
    notes; other notes then stay as they are and their buckets are not read. Only new and modified
    notes are cut, embedded and indexed. With a ``mark`` that is in the store nothing happens.
    """
    base = store.current()
    if mark and base.marks.get(mark[0], -1) >= mark[1]:
        return base
    with scratch(store.spark):
        return _commit(store, base, files, run, embed, full, touched, mark)


def _commit(
    store: Store, base: Version, files: DataFrame, run: str, embed: Callable[[Column], Column] | None, full: bool,
    touched: DataFrame | None, mark: tuple[str, int] | None,
) -> Version:
    tracker = store.read("tracker", version=base) if touched is None else store.lookup("tracker", touched, base)
    current = files.select("note_path", "mtime", F.sha1(F.col("content").cast("binary")).alias("hash"))
    found = changes.classify(current, tracker)
    if full:
        found = found.withColumn("change", F.when(F.col("change") == "unchanged", "modified").otherwise(F.col("change")))
    found = materialize(found.where("change <> 'unchanged'"), "changes")
    todo = found.where(F.col("change").isin("new", "modified"))
    texts = files.select("note_path", "content").join(todo.select("note_path"), "note_path", "left_semi")
    fresh = materialize(notes.chunk(notes.parse(texts)), "fresh-chunks")
    counts = fresh.groupBy("note_path").agg(F.count(F.lit(1)).alias("chunk_count"))
    stale = found.where(F.col("change").isin("deleted", "modified")).select("note_path")
    old = materialize(store.lookup("chunks", stale, base), "stale-chunks")
    lexical, props = stored_index.deltas(store, base, fresh, old, stale)
    made: dict[str, Replace | Append] = {
        "chunks": Replace(stale, fresh),
        "tracker": Replace(found, changes.stamped(found, current, counts, run)),
        **lexical,
    }
    if embed is not None:
        made["vectors"] = Replace(stale, fresh_vectors(fresh, embed))
    props |= {"last_new": todo.where("change = 'new'").count(), "last_chunks": fresh.count()}
    return store.commit(made, props, mark)
