"""After retrieval: rerank scores, labels, citations, link expansion, best chunk per note."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import constants as K
from marginalia.functions import text as X
from marginalia.operators.retrieval import top_k
from marginalia.session import materialize


def with_scores(candidates: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """Attach ``rerank_score`` from a score table; unscored rows fall back to similarity * 10."""
    joined = candidates.join(scores.select(*keys, F.col("rerank_score").alias("_s")), keys, "left")
    return joined.withColumn("rerank_score", F.coalesce("_s", F.col("similarity") * 10)).drop("_s")


def with_scorer(candidates: DataFrame, query: str, text: str, scorer: Callable) -> DataFrame:
    """Attach ``rerank_score`` from a user function over batches of (query, text) pairs."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in batches:
            yield pd.Series(scorer(list(queries), list(texts)), dtype="float64")

    return candidates.withColumn("rerank_score", score(F.col(query), F.col(text)))


def parse_scores(raw: Column, n: Column, similarities: Column) -> Column:
    """Model reply -> n scores: a JSON array of that length, else the first n numbers in the
    text, else similarity * 10."""
    listed = F.from_json(raw, "array<double>")
    numbers = F.transform(
        F.regexp_extract_all(raw, F.lit(r"\b(\d+(?:\.\d+)?)\b"), F.lit(1)), lambda t: t.cast("double")
    )
    complete = (F.size(listed) == n) & F.forall(listed, lambda v: v.isNotNull())
    return (
        F.when(F.coalesce(complete, F.lit(False)), listed)
        .when(F.size(numbers) >= n, F.slice(numbers, F.lit(1), n))
        .otherwise(F.transform(similarities, lambda s: s * 10))
    )


def rerank(candidates: DataFrame, query_id: str, key: str, top_n: int = K.RERANK_TOP_N) -> DataFrame:
    return top_k(
        candidates.drop("rk"), query_id, [F.desc("rerank_score"), F.desc("rrf"), F.asc(key)], top_n
    )


def labels(queries: DataFrame, candidates: DataFrame, query_id: str, top_n: int = K.RERANK_TOP_N) -> DataFrame:
    """(query, label, n_candidates, best_score).

    Risk is looked for among all candidates, relevance only among the top n. The best score
    decides relevance: all of the top n are below the threshold exactly when the best one is.
    """
    risky = (F.col("similarity") > K.HALLUCINATION_SIMILARITY) & (
        F.col("rerank_score") < K.HALLUCINATION_THRESHOLD
    )
    seen = candidates.groupBy(query_id).agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.bool_or(risky).alias("_risk"),
        F.max("rerank_score").alias("best_score"),
    )
    label = (
        F.when(F.col("n_candidates").isNull() | F.lit(top_n < 1), "NO_RESULTS")
        .when(F.col("_risk"), "HALLUCINATION_RISK")
        .when(F.col("best_score") < K.RERANK_THRESHOLD, "IRRELEVANT")
        .otherwise("PASS")
    )
    return (
        queries.select(query_id)
        .join(seen, query_id, "left")
        .select(
            query_id,
            label.alias("label"),
            F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
            F.coalesce("best_score", F.lit(0.0)).alias("best_score"),
        )
    )


def citations(ranked: DataFrame, chunks: DataFrame, query_id: str, key: str) -> DataFrame:
    """Ranked chunks with their payload and a 200-character snippet. A chunk that is no longer
    stored has no payload and is left out."""
    payload = chunks.select(key, "note_path", "note_title", "heading_path", "chunk_text")
    # written down, so that its size is known and few ranked rows do not have all texts shuffled
    return materialize(ranked, "ranked").join(payload, key).select(
        query_id,
        key,
        "rk",
        "note_path",
        "note_title",
        F.coalesce(F.array_join("heading_path", " > "), F.lit("")).alias("heading"),
        X.snippet(F.col("chunk_text")).alias("snippet"),
        "similarity",
        "rerank_score",
    )


def best_chunk_per_note(hits: DataFrame, query_id: str, note: str, score: str, key: str) -> DataFrame:
    """One row per (query, note): its best chunk. A max over structs combines map-side."""
    best = F.max(F.struct(F.col(score), (-F.col("rk")).alias("_neg"), F.col(key)))
    return hits.groupBy(query_id, note).agg(best.alias("_b")).select(
        query_id, note, F.col(f"_b.{key}").alias(key), F.col(f"_b.{score}").alias(score)
    )


def dedupe_to_notes(ranked: DataFrame, query_id: str, note: str) -> DataFrame:
    """First chunk of each note keeps the order; notes are ranked again from 1."""
    firsts = ranked.groupBy(query_id, note).agg(F.min("rk").alias("_first"))
    w = Window.partitionBy(query_id).orderBy("_first")
    return firsts.select(query_id, note, F.row_number().over(w).alias("rk"))


def resolve_titles(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Attach ``dst_path`` for a link title, case ignored; one title held by several notes
    gives the first path. Unknown titles are dropped."""
    asked = links.select(F.lower("dst_title").alias("_t")).distinct()
    named = notes.select(F.lower("note_title").alias("_t"), "note_path").join(asked, "_t", "left_semi")
    titles = named.groupBy("_t").agg(F.min("note_path").alias("dst_path"))
    return links.join(titles, F.lower("dst_title") == F.col("_t")).drop("_t")


def first_chunks(chunks: DataFrame) -> DataFrame:
    """(note_path, note_title, chunk_text) of the lowest chunk index of every note."""
    return chunks.groupBy("note_path").agg(
        F.min_by(F.struct("note_title", "chunk_text"), "chunk_index").alias("_c")
    ).select("note_path", "_c.note_title", "_c.chunk_text")


def expand_links(
    ranked: DataFrame, chunks: DataFrame, query_id: str, max_linked: int = K.MAX_LINKED
) -> DataFrame:
    """Follow links of ranked candidates to notes not yet retrieved, in rank and link order.

    ``ranked`` carries (query, rk, note_path, note_title, chunk_text).
    """
    links = ranked.select(
        query_id,
        "rk",
        F.col("note_title").alias("linked_from"),
        F.posexplode(X.wiki_links(F.col("chunk_text"))).alias("pos", "dst_title"),
    )
    resolved = resolve_titles(links, chunks.select("note_path", "note_title"))
    have = ranked.select(query_id, F.col("note_path").alias("dst_path")).distinct()
    fresh = (
        resolved.join(have, [query_id, "dst_path"], "left_anti")
        .groupBy(query_id, "dst_path")
        .agg(F.min(F.struct("rk", "pos", "linked_from")).alias("_f"))
    )
    kept = top_k(
        fresh.select(query_id, "dst_path", "_f.*"), query_id, [F.asc("rk"), F.asc("pos")], max_linked, "linked_rank"
    )
    kept = materialize(kept, "linked")  # only their notes are looked through for first chunks
    wanted = chunks.join(kept.select(F.col("dst_path").alias("note_path")).distinct(), "note_path", "left_semi")
    heads = first_chunks(wanted).withColumnRenamed("note_path", "dst_path")
    return kept.join(heads, "dst_path").select(
        query_id,
        "linked_rank",
        F.col("dst_path").alias("note_path"),
        "note_title",
        "chunk_text",
        "linked_from",
    )


def context_text(ranked: DataFrame, linked: DataFrame | None, query_id: str) -> DataFrame:
    """Numbered context per query; the lists are bounded by top-n and max-linked."""

    def bracket(c: Column, left: str, right: str) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(left), c, F.lit(right))).otherwise("")

    header = F.concat(
        F.lit("["),
        F.col("rk").cast("string"),
        F.lit("]"),
        bracket(F.col("note_folder"), " [", "]"),
        bracket(F.col("note_date"), " (", ")"),
        F.lit(" "),
        F.col("note_title"),
        bracket(F.array_join("heading_path", " > "), " > ", ""),
        F.lit("\n"),
        F.col("chunk_text"),
    )

    def joined(rank: str, sep: str) -> Column:
        parts = F.array_sort(F.collect_list(F.struct(F.col(rank), F.col("_p"))))
        return F.array_join(F.transform(parts, lambda s: s["_p"]), sep)

    main = ranked.withColumn("_p", header).groupBy(query_id).agg(joined("rk", "\n\n---\n\n").alias("context"))
    if linked is None:
        return main
    piece = F.concat(
        F.lit("[C"),
        F.col("linked_rank").cast("string"),
        F.lit("]"),
        bracket(X.folder_of_path(F.col("note_path")), " [", "]"),
        F.lit(" "),
        F.col("note_title"),
        F.lit(" (linked from: "),
        F.col("linked_from"),
        F.lit(")\n"),
        F.col("chunk_text"),
    )
    extra = linked.withColumn("_p", piece).groupBy(query_id).agg(joined("linked_rank", "\n\n").alias("_x"))
    tail = F.concat(
        F.lit("\n\n---\n\nCONNECTED NOTES (linked from retrieved results):\n\n"), F.col("_x")
    )
    return main.join(extra, query_id, "left").select(
        query_id, F.concat("context", F.coalesce(tail, F.lit(""))).alias("context")
    )
