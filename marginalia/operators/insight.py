"""Entities, key phrases, action items and suggestions over note metadata.

Metadata has note_path, summary, key_phrases, entities[text, entity_type, confidence] and
action_items[text, confidence, priority].
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators.retrieval import top_k, vector_topk


def entities(metadata: DataFrame, entity_type: str | None = None) -> DataFrame:
    rows = metadata.select("note_path", F.posexplode("entities").alias("pos", "e")).select("note_path", "pos", "e.*")
    return rows if entity_type is None else rows.where(F.col("entity_type") == entity_type)


def entity_rollup(rows: DataFrame) -> DataFrame:
    """Distinct entities by lower-cased text and type: first spelling, notes, best confidence.

    Notes are counted; ``entities`` itself is the long form of which notes.
    """
    return rows.groupBy(F.lower("text").alias("key"), "entity_type").agg(
        F.min_by("text", F.struct("note_path", "pos")).alias("text"),
        F.count_distinct("note_path").alias("n_notes"),
        F.max("confidence").alias("max_confidence"),
    ).orderBy(F.lower("text"), "entity_type")


def insight_cards(metadata: DataFrame) -> DataFrame:
    """One row of totals. Distinct counts run over their own exploded rows."""
    notes = metadata.agg(
        F.count(F.lit(1)).alias("notes"),
        F.count_if(F.col("summary") != "").alias("notes_with_summary"),
        F.sum(F.size("action_items")).alias("action_items"),
        F.sum(F.size(F.filter("action_items", lambda a: a["priority"] == "high"))).alias("high_priority"),
    )
    phrases = metadata.select(F.explode("key_phrases").alias("p")).agg(F.count_distinct(F.lower("p")).alias("n"))
    things = entities(metadata).agg(F.count_distinct(F.lower("text"), "entity_type").alias("n"))
    return notes.select(
        "*",
        phrases.select("n").scalar().alias("key_phrases"),
        things.select("n").scalar().alias("entities"),
    )


def entity_type_counts(metadata: DataFrame) -> DataFrame:
    return entities(metadata).groupBy("entity_type").agg(F.count_distinct(F.lower("text")).alias("n"))


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "medium", 1).when(priority == "low", 2).otherwise(3)


def action_items(metadata: DataFrame) -> DataFrame:
    rows = metadata.select("note_path", F.posexplode("action_items").alias("pos", "a")).select("note_path", "pos", "a.*")
    return rows.withColumn("rank", priority_rank(F.col("priority"))).orderBy("rank", "note_path", "pos")


def related_notes(
    note_vectors: DataFrame, chunks: DataFrame, metadata: DataFrame, search_k: int = 50, keep: int = 10
) -> DataFrame:
    """(note_path, target_path, similarity, rk, shared): nearest other notes of every note.

    ``note_vectors`` has (note_path, embedding); ``chunks`` has (chunk_id, note_path,
    embedding). Shared entities come from the target's list, in its order. Pairs are
    bounded by the nearest notes kept; entities never meet across all notes.
    """
    hits = vector_topk(chunks, note_vectors, "chunk_id", "note_path", k=search_k, min_similarity=0.0)
    owner = chunks.select("chunk_id", F.col("note_path").alias("target_path"))
    best = (
        hits.join(owner, "chunk_id")
        .where(F.col("target_path") != F.col("note_path"))
        .groupBy("note_path", "target_path")
        .agg(F.max("similarity").alias("similarity"))
    )
    near = top_k(best, "note_path", [F.desc("similarity"), F.asc("target_path")], keep)
    own = metadata.select("note_path", F.transform("entities", lambda e: F.lower(e["text"])).alias("_own"))
    other = metadata.select(F.col("note_path").alias("target_path"), F.transform("entities", lambda e: e["text"]).alias("_other"))
    empty = F.array().cast("array<string>")
    shared = F.filter(F.coalesce("_other", empty), lambda t: F.array_contains(F.col("_own"), F.lower(t)))
    return (
        near.join(own, "note_path")
        .join(other, "target_path", "left")
        .select("note_path", "target_path", F.round("similarity", 4).alias("similarity"), "rk", shared.alias("shared"))
    )


def link_suggestions(related: DataFrame, metadata: DataFrame, limit: int = 10) -> DataFrame:
    """(note_path, target_path, anchor, confidence, reason, rk) from shared entities, and from
    entities that are the title of a note not yet suggested."""
    shared = related.select(
        "note_path",
        "target_path",
        F.posexplode(F.slice("shared", 1, 2)).alias("pos", "anchor"),
        F.col("similarity").alias("confidence"),
        "rk",
    ).select(
        "note_path", "target_path", "anchor", "confidence", F.lit(0).alias("kind"), F.col("rk").alias("o1"), F.col("pos").alias("o2"),
        F.concat(F.lit("Shared entity: "), "anchor").alias("reason"),
    )
    # one entity per lower-cased text: the place of its first mention, the values of its last
    own = (
        entities(metadata)
        .groupBy("note_path", F.lower("text").alias("_t"))
        .agg(F.min("pos").alias("_first"), F.max(F.struct("pos", "text", "confidence")).alias("_e"))
    )
    # several notes may share a title: the last path wins, but never the source note itself
    titles = (
        metadata.select(F.lower(X.title_of_path(F.col("note_path"))).alias("_t"), "note_path")
        .groupBy("_t")
        .agg(F.max("note_path").alias("_last"))
    )
    others = (
        metadata.select(F.lower(X.title_of_path(F.col("note_path"))).alias("_t"), "note_path")
        .join(titles, "_t")
        .where(F.col("note_path") != F.col("_last"))
        .groupBy("_t")
        .agg(F.max("note_path").alias("_next"))
    )
    target = F.when(F.col("_last") != F.col("note_path"), F.col("_last")).otherwise(F.col("_next"))
    by_title = (
        own.join(titles, "_t")
        .join(others, "_t", "left")
        .select(
            "note_path",
            target.alias("target_path"),
            F.col("_e.text").alias("anchor"),
            F.col("_e.confidence").alias("confidence"),
            F.lit(1).alias("kind"),
            F.col("_first").alias("o1"),
            F.lit(0).alias("o2"),
            F.concat(F.lit("Entity matches note title: "), F.col("_e.text")).alias("reason"),
        )
        .where("target_path IS NOT NULL")
    )
    fresh = by_title.join(shared.select("note_path", "target_path").distinct(), ["note_path", "target_path"], "left_anti")
    order = F.struct((-F.col("confidence")).alias("_c"), "kind", "o1", "o2")
    unique = (
        shared.unionByName(fresh)
        .groupBy("note_path", "target_path", "anchor")
        .agg(F.min(F.struct(order.alias("o"), "confidence", "reason")).alias("_b"))
        .select("note_path", "target_path", "anchor", "_b.confidence", "_b.reason", F.col("_b.o").alias("_o"))
    )
    return top_k(unique, "note_path", [F.asc("_o"), F.asc("target_path"), F.asc("anchor")], limit).drop("_o")


def tag_suggestions(related: DataFrame, metadata: DataFrame, pool: int = 20, keep: int = 10) -> DataFrame:
    """(note_path, tag, confidence, sources, rk): key phrases of related notes by summed similarity.

    The best ``pool`` phrases are taken before the note's own ones are dropped.
    """
    phrases = metadata.select(F.col("note_path").alias("target_path"), F.posexplode("key_phrases").alias("pos", "p"))
    votes = related.join(phrases, "target_path").withColumn("tag", X.strip(F.lower("p"))).where("tag != ''")
    sizes = related.groupBy("note_path").agg(F.count(F.lit(1)).alias("_n"))
    scored = votes.groupBy("note_path", "tag").agg(
        F.round(F.sum("similarity"), 4).alias("score"),
        F.min(F.struct("rk", "pos")).alias("_first"),
        F.array_sort(F.collect_list(F.struct("rk", "pos", "target_path"))).alias("_src"),
    )
    best = top_k(scored, "note_path", [F.desc("score"), F.asc("_first")], pool, "_r")
    own = metadata.select("note_path", F.explode("key_phrases").alias("p")).select("note_path", X.strip(F.lower("p")).alias("tag")).distinct()
    kept = top_k(best.join(own, ["note_path", "tag"], "left_anti"), "note_path", [F.asc("_r")], keep)
    # nine places first: that drops the noise of the division, so halves round up everywhere
    share = F.round(F.least(F.col("score") / F.greatest(F.col("_n"), F.lit(1)), F.lit(1.0)), 9)
    confidence = F.round(share, 3)
    sources = F.transform(F.slice("_src", 1, 5), lambda s: s["target_path"])
    return kept.join(sizes, "note_path").select(
        "note_path", "tag", confidence.alias("confidence"), sources.alias("sources"), "rk"
    )
