"""Retrieval quality against expected notes: recall, precision, reciprocal rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.session import materialize


def per_query(queries: DataFrame, expected: DataFrame, retrieved: DataFrame, query_id: str, note: str) -> DataFrame:
    """Metrics for every query.

    ``expected`` may repeat a note: each repeat counts for recall. ``retrieved`` has a rank
    ``rk`` per (query, note). A query that expects nothing has recall 1; one that retrieved
    nothing has precision 0.
    """
    want = expected.groupBy(query_id, note).agg(F.count(F.lit(1)).alias("_want"))
    both = want.join(retrieved.select(query_id, note, "rk"), [query_id, note], "full_outer")
    hit = F.col("_want").isNotNull() & F.col("rk").isNotNull()

    def found(k: int):
        return F.sum(F.when(hit & (F.col("rk") <= k), F.col("_want")).otherwise(0))

    per = both.groupBy(query_id).agg(
        F.coalesce(F.sum("_want"), F.lit(0)).alias("n_expected"),
        found(5).alias("_f5"),
        found(10).alias("_f10"),
        F.count_if(hit & (F.col("rk") <= 5)).alias("_p5"),
        F.count_if(F.col("rk") <= 5).alias("_top5"),
        F.min(F.when(hit, F.col("rk"))).alias("_first"),
    )

    def recall(c: str):
        none_expected = F.coalesce("n_expected", F.lit(0)) == 0
        return F.when(none_expected, F.lit(1.0)).otherwise(F.coalesce(F.col(c), F.lit(0)) / F.col("n_expected"))

    return queries.select(query_id).join(per, query_id, "left").select(
        query_id,
        F.coalesce("n_expected", F.lit(0)).cast("long").alias("n_expected"),
        F.round(recall("_f5"), 6).alias("recall_at_5"),
        F.round(recall("_f10"), 6).alias("recall_at_10"),
        F.round(F.when(F.col("_top5") > 0, F.col("_p5") / F.col("_top5")).otherwise(0.0), 6).alias("precision_at_5"),
        F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 6).alias("mrr"),
        F.coalesce(recall("_f5") == 1.0, F.lit(False)).alias("passed"),
    )


def averages(metrics: DataFrame, *group: str) -> DataFrame:
    def mean(c: str):
        return F.round(F.avg(c), 6).alias(f"avg_{c}")

    return metrics.groupBy(*group).agg(
        F.count(F.lit(1)).alias("num_queries"),
        mean("recall_at_5"),
        mean("recall_at_10"),
        mean("precision_at_5"),
        mean("mrr"),
        F.count_if("passed").alias("num_passed"),
        F.count_if(F.col("n_expected") == 0).alias("num_without_truth"),
    )


def passage_matches(
    passages: DataFrame,
    documents: DataFrame,
    passage_id: str,
    passage: str,
    doc_id: str,
    text: str,
    anchor_words: int = 3,
) -> DataFrame:
    """(passage_id, doc_id) where the document text holds the passage.

    Inner words of a passage must appear as whole consecutive words, so documents meet passages
    on such a group of words by equality. A passage of two words ends one word and begins the
    next; one of a single word is part of a word. They meet on pieces of words of just the lengths
    that occur among the passages. Only pairs found that way are checked in full. An empty
    passage is held by nothing.
    """
    words = F.split(F.col(passage), r"\s+")
    passages = passages.where(F.length(passage) > 0).select(passage_id, passage, words.alias("_p"))
    inner = F.least(F.lit(anchor_words), F.size("_p") - 2)
    sizes = [r[0] for r in passages.where(inner > 0).select(inner.alias("n")).distinct().collect()]  # at most anchor_words
    texts = documents.select(doc_id, F.split(F.col(text), r"\s+").alias("_w"))
    met = [_inner_words(passages.where(inner == n), texts, doc_id, n) for n in sizes]
    met += [_word_edges(passages.where(F.size("_p") == 2), texts, doc_id), _word_parts(passages.where(F.size("_p") == 1), texts, doc_id)]
    met = [m for m in met if m is not None]
    if not met:
        none = T.StructType([passages.schema[passage_id], documents.schema[doc_id]])
        return documents.sparkSession.createDataFrame([], none)
    pairs = reduce(DataFrame.unionByName, [m.select(passage_id, passage, doc_id) for m in met]).distinct()
    pairs = materialize(pairs, "met")  # few pairs need no shuffle of all texts
    return (
        pairs.join(documents.select(doc_id, text), doc_id)
        .where(F.contains(F.col(text), F.col(passage)))
        .select(passage_id, doc_id)
    )


def _inner_words(passages: DataFrame, texts: DataFrame, doc_id: str, n: int) -> DataFrame:
    """Passages and texts that share the first ``n`` inner words."""
    anchored = passages.withColumn("_a", F.array_join(F.slice("_p", 2, n), " "))
    spans = F.transform(F.sequence(F.lit(1), F.size("_w") - F.lit(n - 1)), lambda i: F.array_join(F.slice("_w", i, n), " "))
    found = texts.where(F.size("_w") >= n).select(doc_id, F.explode(F.array_distinct(spans)).alias("_a"))
    return found.join(anchored, "_a")


def _word_edges(passages: DataFrame, texts: DataFrame, doc_id: str) -> DataFrame | None:
    """Two-word passages and texts with a word that ends and a next word that begins like them."""
    left, right = F.length(F.col("_p")[0]), F.length(F.col("_p")[1])
    lengths = [tuple(r) for r in passages.select(left, right).distinct().collect()]  # bounded by the lengths of words
    edges = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in lengths]
    if not edges:
        return None
    neighbours = F.arrays_zip(F.slice("_w", 1, F.size("_w") - 1).alias("x"), F.slice("_w", 2, F.size("_w")).alias("y"))
    pieces = F.flatten(F.transform(neighbours, lambda n: F.transform(
        F.array(*edges), lambda e: F.concat(F.right(n["x"], e["a"]), F.lit(" "), F.left(n["y"], e["b"]))
    )))
    found = texts.where(F.size("_w") >= 2).select(doc_id, F.explode(F.array_distinct(pieces)).alias("_a"))
    return found.join(passages.withColumn("_a", F.array_join("_p", " ")), "_a")


def _word_parts(passages: DataFrame, texts: DataFrame, doc_id: str) -> DataFrame | None:
    """One-word passages and texts with a word that has them as a part."""
    lengths = [r[0] for r in passages.select(F.length(F.col("_p")[0])).distinct().collect()]
    if not lengths:
        return None
    parts = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substring(w, i, n))
    every = F.flatten(F.transform("_w", lambda w: F.flatten(F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(w)), lambda n: parts(w, n)
    ))))
    found = texts.select(doc_id, F.explode(F.array_distinct(every)).alias("_a"))
    return found.join(passages.withColumn("_a", F.col("_p")[0]), "_a")
