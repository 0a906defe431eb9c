"""Retrieval, ranking and evaluation over documents, benchmark questions and embeddings.

One document is one chunk: its indexed fields are id, source, language and text. The
question with number i is asked with the vector number i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import clusters, evaluate, ranking, retrieval
from marginalia.plans.registry import Tables, query
from marginalia.session import materialize, shared_dir
from marginalia.sources import tables

FIELDS = ["doc_id", "source", "lang", "text"]


def corpus(t: Tables) -> DataFrame:
    return t.spread("documents").select("doc_id", "source", "lang", "text")


def vectors(t: Tables) -> DataFrame:
    """Vectors of known chunks; a vector without its chunk is not a candidate."""
    vec = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return vec.join(t.documents.select("doc_id"), "doc_id", "left_semi")


def questions(t: Tables) -> DataFrame:
    vec = t.embeddings.select(F.col("vec_id").alias("item_id"), "embedding")
    return t.benchmark.select("item_id", "text").join(vec, "item_id", "left")


def hybrid_hits(t: Tables) -> DataFrame:
    return retrieval.hybrid(corpus(t), vectors(t), questions(t), "doc_id", FIELDS, "item_id", "text")


def judged(t: Tables) -> DataFrame:
    """Known judgments as rerank scores, the same for every question."""
    return t.labels.select("doc_id", (F.col("quality") * 6.0 + 2.0 - F.col("toxic")).alias("rerank_score"))


def scored_hits(t: Tables) -> DataFrame:
    return ranking.with_scores(hybrid_hits(t), judged(t), ["doc_id"])


def chunk_rows(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("note_path"),
        F.concat(F.lit("Doc "), "doc_id").alias("note_title"),
        F.array("lang").alias("heading_path"),
        F.col("text").alias("chunk_text"),
    )


BM25 = """
qw AS (
  SELECT item_id, unnest(string_split_regex(trim(translate(text, '"''()*-+:^~', '          ')), '\\s+')) AS w
  FROM benchmark),
q AS (
  SELECT item_id, array_to_string(regexp_extract_all(strip_accents(lower(w)), '[\\p{L}\\p{N}]+'), ' ') AS term,
         count(*) AS weight
  FROM qw WHERE len(regexp_extract_all(w, '[\\p{L}\\p{N}]+')) > 0 GROUP BY ALL),
toks AS (
  SELECT doc_id, regexp_extract_all(strip_accents(lower(
    concat_ws(' ', doc_id::VARCHAR, source, lang, text))), '[\\p{L}\\p{N}]+') AS tk FROM documents),
st AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM toks),
post AS (
  SELECT doc_id, dl, term, count(*) AS tf
  FROM (SELECT doc_id, len(tk) AS dl, unnest(tk) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (
  SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf
  FROM dfs, st),
bm AS (
  SELECT item_id, doc_id,
         round(sum(weight * idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6)::DOUBLE AS score
  FROM q JOIN post USING (term) JOIN idf USING (term), st GROUP BY ALL),
lex AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rk FROM bm
  QUALIFY rk <= 50)"""

VEC = """
vs AS (
  SELECT q.vec_id AS item_id, c.vec_id AS doc_id,
         round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings q JOIN benchmark b ON b.item_id = q.vec_id,
    (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) c),
den AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS rk FROM vs
  QUALIFY rk <= 30),
den3 AS (SELECT * FROM den WHERE similarity >= 0.3)"""

HYBRID = (
    BM25
    + ","
    + VEC
    + """,
fused AS (
  SELECT coalesce(d.item_id, l.item_id) AS item_id, coalesce(d.doc_id, l.doc_id) AS doc_id,
         coalesce(d.similarity, 0.0)::DOUBLE AS similarity, coalesce(l.score, 0.0)::DOUBLE AS bm25,
         round(coalesce(1.0::DOUBLE / (60 + d.rk), 0) + coalesce(1.0::DOUBLE / (60 + l.rk), 0), 10) AS rrf
  FROM den3 d FULL JOIN lex l ON d.item_id = l.item_id AND d.doc_id = l.doc_id),
hyb AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id)::INTEGER AS rk FROM fused
  QUALIFY rk <= 10),
scored AS (
  SELECT h.*, coalesce(lb.quality * 6.0 + 2.0 - lb.toxic, h.similarity * 10)::DOUBLE AS rerank_score
  FROM hyb h LEFT JOIN labels lb USING (doc_id)),
top5 AS (
  SELECT * FROM (SELECT * EXCLUDE (rk), row_number() OVER (
    PARTITION BY item_id ORDER BY rerank_score DESC, rrf DESC, doc_id)::INTEGER AS rk
  FROM scored) WHERE rk <= 5)"""
)

TRUTH = """
split AS (SELECT item_id, string_split_regex(text, '\\s+') AS w FROM benchmark),
passage AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 11], ' ') AS p
  FROM split, LATERAL (SELECT unnest(range(1, greatest(len(w) - 11, 1) + 1)) AS i) s),
truth AS (SELECT DISTINCT item_id, doc_id FROM passage JOIN documents ON contains(text, p))"""

METRICS = (
    HYBRID
    + ","
    + TRUTH
    + """,
m AS (
  SELECT b.item_id,
    (SELECT count(*) FROM truth x WHERE x.item_id = b.item_id) AS n_expected,
    (SELECT count(*) FROM truth x JOIN hyb h USING (item_id, doc_id) WHERE x.item_id = b.item_id AND h.rk <= 5) AS f5,
    (SELECT count(*) FROM truth x JOIN hyb h USING (item_id, doc_id) WHERE x.item_id = b.item_id) AS f10,
    (SELECT count(*) FROM hyb h WHERE h.item_id = b.item_id AND h.rk <= 5) AS top5,
    (SELECT min(h.rk) FROM truth x JOIN hyb h USING (item_id, doc_id) WHERE x.item_id = b.item_id) AS first
  FROM benchmark b),
metrics AS (
  SELECT item_id, n_expected::BIGINT AS n_expected,
    round(CASE WHEN n_expected = 0 THEN 1.0 ELSE f5::DOUBLE / n_expected END, 6)::DOUBLE AS recall_at_5,
    round(CASE WHEN n_expected = 0 THEN 1.0 ELSE f10::DOUBLE / n_expected END, 6)::DOUBLE AS recall_at_10,
    round(CASE WHEN top5 = 0 THEN 0.0 ELSE f5::DOUBLE / top5 END, 6)::DOUBLE AS precision_at_5,
    round(coalesce(1.0::DOUBLE / first, 0), 6)::DOUBLE AS mrr,
    n_expected = 0 OR f5 = n_expected AS passed
  FROM m)"""
)


@query("bm25_topk", f"WITH {BM25} SELECT item_id, doc_id, score, rk::INTEGER AS rk FROM lex WHERE rk <= 10")
def bm25_topk(t: Tables) -> DataFrame:
    return retrieval.bm25_topk(corpus(t), t.benchmark, "doc_id", FIELDS, "item_id", "text", k=10)


@query(
    "inverted_index",
    f"WITH {BM25} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS cf, max(tf)::BIGINT AS max_tf FROM post GROUP BY term",
)
def inverted_index(t: Tables) -> DataFrame:
    post = retrieval.postings(corpus(t), "doc_id", FIELDS)
    return post.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf")
    )


@query("vector_topk_exact", f"WITH {VEC} SELECT item_id, doc_id, similarity, rk::INTEGER AS rk FROM den3")
def vector_topk_exact(t: Tables) -> DataFrame:
    asked = questions(t).where(F.col("embedding").isNotNull())
    return retrieval.vector_topk(vectors(t), asked, "doc_id", "item_id")


@query("vector_topk_blocked", f"WITH {VEC} SELECT item_id, doc_id, similarity, rk::INTEGER AS rk FROM den")
def vector_topk_blocked(t: Tables) -> DataFrame:
    """The plan used when the query side is too large to share: bounded block pairs."""
    asked = questions(t).where(F.col("embedding").isNotNull())
    return retrieval.vector_topk(
        vectors(t), asked, "doc_id", "item_id", min_similarity=None, broadcast_bytes=0
    )


@query("vector_topk_clustered", f"WITH {VEC} SELECT item_id, doc_id, similarity, rk::INTEGER AS rk FROM den3")
def vector_topk_clustered(t: Tables) -> DataFrame:
    """The same rows from vectors in clusters, most of which a question never meets."""
    asked = questions(t).where(F.col("embedding").isNotNull())
    return clusters.topk(clusters.build(vectors(t), "doc_id"), asked, "item_id").hits


@query("rrf_hybrid", f"WITH {HYBRID} SELECT item_id, doc_id, similarity, bm25, rrf, rk FROM hyb")
def rrf_hybrid(t: Tables) -> DataFrame:
    return hybrid_hits(t)


@query(
    "retrieval_labels",
    f"""WITH {HYBRID},
    agg AS (SELECT item_id, count(*) AS n, max(rerank_score) AS best,
                   bool_or(similarity > 0.7 AND rerank_score < 3.0) AS risk FROM scored GROUP BY item_id)
    SELECT b.item_id, CASE WHEN n IS NULL THEN 'NO_RESULTS' WHEN risk THEN 'HALLUCINATION_RISK'
             WHEN best < 5.0 THEN 'IRRELEVANT' ELSE 'PASS' END AS label,
           coalesce(n, 0)::BIGINT AS n_candidates, coalesce(best, 0)::DOUBLE AS best_score
    FROM benchmark b LEFT JOIN agg USING (item_id)""",
)
def retrieval_labels(t: Tables) -> DataFrame:
    return ranking.labels(t.benchmark, scored_hits(t), "item_id")


@query(
    "citations",
    f"""WITH {HYBRID}
    SELECT t5.item_id, t5.doc_id, t5.rk, d.source || '/' || d.doc_id || '.md' AS note_path,
           'Doc ' || d.doc_id AS note_title, d.lang AS heading,
           CASE WHEN length(d.text) > 200 THEN d.text[1:200] || '...' ELSE d.text END AS snippet,
           t5.similarity, t5.rerank_score
    FROM top5 t5 LEFT JOIN documents d USING (doc_id)""",
)
def citations(t: Tables) -> DataFrame:
    top = ranking.rerank(scored_hits(t), "item_id", "doc_id")
    return ranking.citations(top, chunk_rows(t), "item_id", "doc_id")


@query(
    "render_context",
    f"""WITH {HYBRID}
    SELECT item_id, string_agg('[' || rk || '] [' || d.source || '] Doc ' || d.doc_id || ' > ' || d.lang
             || chr(10) || d.text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rk) AS context
    FROM top5 JOIN documents d USING (doc_id) GROUP BY item_id""",
)
def render_context(t: Tables) -> DataFrame:
    top = materialize(ranking.rerank(scored_hits(t), "item_id", "doc_id"), "ranked").join(chunk_rows(t), "doc_id")
    top = top.withColumn("note_folder", X.folder_of_path(F.col("note_path"))).withColumn(
        "note_date", F.lit(None).cast("string")
    )
    return ranking.context_text(top, None, "item_id")


def truth(t: Tables) -> DataFrame:
    """An item is expected where a document holds twelve words in a row of its text."""
    words = F.split("text", r"\s+")
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 11, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 12), " "))
    passages = t.benchmark.select("item_id", F.explode(F.array_distinct(spans)).alias("passage"))
    return evaluate.passage_matches(passages, t.spread("documents"), "item_id", "passage", "doc_id", "text").distinct()


def metric_rows(t: Tables) -> DataFrame:
    notes = ranking.dedupe_to_notes(hybrid_hits(t), "item_id", "doc_id")
    return evaluate.per_query(t.benchmark, truth(t), notes, "item_id", "doc_id")


@query("eval_truth", f"WITH {TRUTH} SELECT item_id, doc_id FROM truth")
def eval_truth(t: Tables) -> DataFrame:
    return truth(t)


@query("eval_recall_precision_mrr", f"WITH {METRICS} SELECT * FROM metrics")
def eval_recall_precision_mrr(t: Tables) -> DataFrame:
    return metric_rows(t)


_AVG = """count(*)::BIGINT AS num_queries, round(avg(recall_at_5), 6)::DOUBLE AS avg_recall_at_5,
    round(avg(recall_at_10), 6)::DOUBLE AS avg_recall_at_10, round(avg(precision_at_5), 6)::DOUBLE AS avg_precision_at_5,
    round(avg(mrr), 6)::DOUBLE AS avg_mrr, count(*) FILTER (passed)::BIGINT AS num_passed,
    count(*) FILTER (n_expected = 0)::BIGINT AS num_without_truth"""


@query("eval_report", f"WITH {METRICS} SELECT {_AVG} FROM metrics")
def eval_report(t: Tables) -> DataFrame:
    return evaluate.averages(metric_rows(t))


@query(
    "eval_report_sink",
    f"""WITH {METRICS} SELECT 'hybrid' AS model, 'run-1' AS run_at, item_id, recall_at_5, mrr FROM metrics""",
)
def eval_report_sink(t: Tables) -> DataFrame:
    """Per-question results written as one run of the report folder and read back."""
    path = shared_dir(t.spark, "eval")
    rows = metric_rows(t).select("item_id", "recall_at_5", "mrr")
    tables.write_eval_report(rows, path, "hybrid", "run-1")
    schema = "item_id long, recall_at_5 double, mrr double, model string, run_at string"
    return t.spark.read.schema(schema).json(path)


@query(
    "eval_by_tag",
    f"""WITH {METRICS},
    tags AS (SELECT item_id, unnest(['group-' || (item_id % 4), CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END]) AS tag
             FROM benchmark)
    SELECT tag, {_AVG} FROM tags JOIN metrics USING (item_id) GROUP BY tag""",
)
def eval_by_tag(t: Tables) -> DataFrame:
    tags = F.array(
        F.concat(F.lit("group-"), F.col("item_id") % 4),
        F.when(F.length("text") > 200, "long").otherwise("short"),
    )
    tagged = t.benchmark.select("item_id", F.explode(tags).alias("tag"))
    return evaluate.averages(tagged.join(metric_rows(t), "item_id"), "tag")


@query(
    "capture_connections",
    f"""WITH {HYBRID}
    SELECT item_id, h.doc_id, d.source || '/' || d.doc_id || '.md' AS note_path, round(rrf, 4) AS score,
      CASE WHEN lb.quality = 1 THEN 'Summary of ' || d.doc_id
           ELSE regexp_replace(d.text[1:150], '^\\s+|\\s+$', '', 'g') END AS snippet
    FROM hyb h JOIN documents d USING (doc_id) LEFT JOIN labels lb USING (doc_id)
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, h.doc_id) <= 5""",
)
def capture_connections(t: Tables) -> DataFrame:
    """Best chunk per note, five notes, a summary in place of the snippet where one exists."""
    notes = ranking.best_chunk_per_note(
        hybrid_hits(t).withColumn("note", F.col("doc_id")), "item_id", "note", "rrf", "doc_id"
    )
    top = materialize(retrieval.top_k(notes, "item_id", [F.desc("rrf"), F.asc("doc_id")], 5), "ranked")
    summaries = t.labels.where("quality = 1").select(
        "doc_id", F.concat(F.lit("Summary of "), "doc_id").alias("summary")
    )
    return (
        top.join(chunk_rows(t), "doc_id")
        .join(summaries, "doc_id", "left")
        .select(
            "item_id",
            "doc_id",
            "note_path",
            F.round("rrf", 4).alias("score"),
            F.coalesce(F.nullif("summary", F.lit("")), X.short_snippet(F.col("chunk_text"))).alias("snippet"),
        )
    )


@query(
    "score_parse",
    """SELECT item_id, CASE item_id % 4 WHEN 0 THEN item_id % 10 WHEN 1 THEN 7.5 WHEN 2 THEN item_id % 7 ELSE 2.0 END::DOUBLE AS s1,
      CASE item_id % 4 WHEN 0 THEN 3.5 WHEN 1 THEN item_id % 9 WHEN 2 THEN 4 ELSE 5.0 END::DOUBLE AS s2
    FROM benchmark""",
)
def score_parse(t: Tables) -> DataFrame:
    """Four reply shapes: a JSON list, prose with numbers, a longer list, no usable numbers."""
    i = F.col("item_id")
    raw = (
        F.when(i % 4 == 0, F.concat(F.lit("["), i % 10, F.lit(", 3.5]")))
        .when(i % 4 == 1, F.concat(F.lit("Scores: 7.5 and then "), i % 9, F.lit(".")))
        .when(i % 4 == 2, F.concat(F.lit("["), i % 7, F.lit(", 4, 9]")))
        .otherwise("no scores given")
    )
    scores = ranking.parse_scores(raw, F.lit(2), F.array(F.lit(0.2), F.lit(0.5)))
    return t.benchmark.select("item_id", scores.alias("s")).select(
        "item_id", F.col("s")[0].alias("s1"), F.col("s")[1].alias("s2")
    )
