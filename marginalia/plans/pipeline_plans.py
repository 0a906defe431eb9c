"""From files to cited notes: parse, chunk, index, retrieve, fuse, one place per note.

The notes are those of the orders, several chunks each; a question is asked for every nation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import models
from marginalia.operators import indexing, notes, ranking, retrieval, stored_index
from marginalia.plans.fixtures import cat, order_notes
from marginalia.plans.registry import Tables, query
from marginalia.session import materialize, shared_dir
from marginalia.sources.versions import Store

FIELDS = ["note_title", "heading", "chunk_text"]


def chunked(t: Tables, files: DataFrame | None = None) -> DataFrame:
    """All chunks of all notes, written once: index, vectors and citations read them."""
    parts = notes.chunk(notes.parse((order_notes(t) if files is None else files).select("note_path", "content")))
    return materialize(parts.withColumn("heading", F.array_join("heading_path", " > ")), "chunks")


def asked(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    return t.nation.select(
        n.cast("long").alias("question_id"),
        cat("order of customer ", n * 3 + 1, " with status ", F.when(n % 2 == 0, "O").otherwise("F")).alias("question"),
    )


def lexical(t: Tables, chunks: DataFrame) -> DataFrame:
    return retrieval.bm25_topk(chunks, asked(t), "chunk_id", FIELDS, "question_id", "question")


def _vector_no(t: Tables) -> tuple[DataFrame, int]:
    return t.embeddings.select("vec_id", "embedding"), t.embeddings.count()


def chunk_vectors(t: Tables, chunks: DataFrame) -> DataFrame:
    """The stored vectors stand in for a model: a chunk has the vector of its order and place."""
    vectors, n = _vector_no(t)
    order = F.regexp_extract("note_path", r"(\d+)\.md$", 1).cast("long")
    numbered = chunks.select("chunk_id", ((order * 2 + F.col("chunk_index")) % n).alias("vec_id"))
    return numbered.join(vectors, "vec_id").select("chunk_id", "embedding")


CHUNK_SQL = r"""
c AS (
  SELECT o_orderkey, i AS chunk_index, 'orders/' || o_orderkey || '.md' AS note_path, 'Order ' || o_orderkey AS note_title,
    CASE i WHEN 0 THEN 'Order ' || o_orderkey ELSE 'Order ' || o_orderkey || ' > Short > Status' END AS heading,
    CASE i WHEN 0 THEN 'Order ' || o_orderkey || ' of customer ' || o_custkey || ' was placed with priority ' || o_orderpriority ||
      ' and is expected to be followed up by the team that looks after this customer.'
    ELSE 'The order stands at   status ' || o_orderstatus || '.' || chr(10) || 'Anyone who changes the status is asked to' ||
      ' write a line here, with the reason and with the name of the person spoken to.' END AS chunk_text
  FROM orders, range(2) r(i)),
chunk AS (
  SELECT *, sha1(note_path || '|' || replace(heading, ' > ', '|') || '|' || chunk_index || '|' ||
    regexp_replace(chunk_text, '\s+', ' ', 'g'))[1:16] AS chunk_id FROM c),
asked AS (
  SELECT n_nationkey::BIGINT AS question_id, 'order of customer ' || (n_nationkey * 3 + 1) || ' with status ' ||
    CASE n_nationkey % 2 WHEN 0 THEN 'O' ELSE 'F' END AS question FROM nation),
q AS (
  SELECT question_id, lower(w) AS term, count(*) AS weight
  FROM (SELECT question_id, unnest(string_split(question, ' ')) AS w FROM asked) GROUP BY ALL),
toks AS (
  SELECT chunk_id, regexp_extract_all(lower(concat_ws(' ', note_title, heading, chunk_text)), '[\p{L}\p{N}]+') AS tk FROM chunk),
st AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM toks),
post AS (
  SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(tk) AS dl, unnest(tk) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
idf AS (
  SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM dfs, st),
bm AS (
  SELECT question_id, chunk_id,
    round(sum(weight * idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6)::DOUBLE AS score
  FROM q JOIN post USING (term) JOIN idf USING (term), st GROUP BY ALL),
lex AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rk FROM bm QUALIFY rk <= 50)"""

NOTE_SQL = (
    CHUNK_SQL
    + r""",
pair AS (
  SELECT q.vec_id AS question_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings q JOIN asked ON q.vec_id = asked.question_id, embeddings v),
vs AS (
  SELECT p.question_id, k.chunk_id, p.similarity
  FROM pair p JOIN chunk k ON p.vec_id = (k.o_orderkey * 2 + k.chunk_index) % (SELECT count(*) FROM embeddings)),
den AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY similarity DESC, chunk_id) AS rk FROM vs QUALIFY rk <= 30),
den3 AS (SELECT * FROM den WHERE similarity >= 0.3),
fused AS (
  SELECT coalesce(d.question_id, l.question_id) AS question_id, coalesce(d.chunk_id, l.chunk_id) AS chunk_id,
    round(coalesce(1.0::DOUBLE / (60 + d.rk), 0) + coalesce(1.0::DOUBLE / (60 + l.rk), 0), 10) AS rrf
  FROM den3 d FULL JOIN lex l ON d.question_id = l.question_id AND d.chunk_id = l.chunk_id),
hyb AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rrf DESC, chunk_id)::INTEGER AS rk FROM fused QUALIFY rk <= 10),
best AS (
  SELECT question_id, note_path, chunk_id, rrf, rk FROM hyb JOIN chunk USING (chunk_id)
  QUALIFY row_number() OVER (PARTITION BY question_id, note_path ORDER BY rk) = 1)"""
)


@query(
    "chunk_index_topk",
    f"""WITH {CHUNK_SQL} SELECT question_id, note_path, chunk_index::INTEGER AS chunk_index, heading, score, rk::INTEGER AS rk
    FROM lex JOIN chunk USING (chunk_id)""",
)
def chunk_index_topk(t: Tables) -> DataFrame:
    """BM25 over the chunks of parsed notes."""
    chunks = chunked(t)
    return lexical(t, chunks).join(chunks.select("chunk_id", "note_path", "chunk_index", "heading"), "chunk_id").drop("chunk_id")


def fused_chunks(t: Tables, chunks: DataFrame) -> DataFrame:
    """Lexical and vector lists of chunks, fused, for every question."""
    vectors, _ = _vector_no(t)
    questions = asked(t).join(vectors.withColumnRenamed("vec_id", "question_id"), "question_id", "left")
    dense = retrieval.vector_topk(chunk_vectors(t, chunks), questions.where("embedding IS NOT NULL"), "chunk_id", "question_id")
    return retrieval.fuse(lexical(t, chunks), dense, "question_id", "chunk_id")


def linked_files(t: Tables) -> DataFrame:
    """The notes of the orders with a date in the head and links to two other orders at the end."""
    k = F.col("o_orderkey")
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    links = cat("See [[Order ", k + 1, "]] and [[order ", k * 2, "|other]].\n")
    return order_notes(t).select("note_path", cat("---\ndate: '2024-01-", day, "'\n---\n", F.col("content"), links).alias("content"))


_LINKED_SQL = NOTE_SQL.replace("c AS (", "c0 AS (", 1).replace(
    "chunk AS (",
    """c AS (SELECT * REPLACE (chunk_text || CASE chunk_index WHEN 1 THEN chr(10) || 'See [[Order ' || (o_orderkey + 1) || ']] and [[order ' ||
    (o_orderkey * 2) || '|other]].' ELSE '' END AS chunk_text) FROM c0),
chunk AS (""",
    1,
) + """,
top AS (SELECT question_id, rk, chunk.* FROM hyb JOIN chunk USING (chunk_id)),
pointed AS (
  SELECT question_id, rk, 0 AS pos, o_orderkey + 1 AS dst, note_title FROM top WHERE chunk_index = 1
  UNION ALL SELECT question_id, rk, 1, o_orderkey * 2, note_title FROM top WHERE chunk_index = 1),
fresh AS (
  SELECT question_id, dst, min(rk * 10 + pos) AS o, min_by(note_title, rk * 10 + pos) AS linked_from
  FROM pointed WHERE dst IN (SELECT o_orderkey FROM orders) AND (question_id, dst) NOT IN (SELECT (question_id, o_orderkey) FROM top) GROUP BY ALL),
kept AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY o)::INTEGER AS linked_rank FROM fresh QUALIFY linked_rank <= 3),
linked AS (SELECT question_id, linked_rank, k.note_path, k.note_title, k.chunk_text, linked_from
  FROM kept JOIN chunk k ON k.o_orderkey = dst AND k.chunk_index = 0)"""


@query(
    "retrieved_links",
    f"""WITH {_LINKED_SQL} SELECT * FROM linked""",
)
def retrieved_links(t: Tables) -> DataFrame:
    """First chunks of the notes that retrieved chunks link to and that were not retrieved."""
    chunks = chunked(t, linked_files(t))
    ranked = fused_chunks(t, chunks).join(chunks.select("chunk_id", "note_path", "note_title", "chunk_text"), "chunk_id")
    return ranking.expand_links(materialize(ranked, "fused"), chunks, "question_id")


@query(
    "retrieved_context",
    f"""WITH {_LINKED_SQL},
    main AS (
      SELECT question_id, string_agg('[' || rk || '] [orders] (2024-01-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0') || ') ' || note_title || ' > ' || heading
        || chr(10) || chunk_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rk) AS context FROM top GROUP BY question_id),
    more AS (
      SELECT question_id, string_agg('[C' || linked_rank || '] [orders] ' || note_title || ' (linked from: ' || linked_from || ')' || chr(10) || chunk_text,
        chr(10) || chr(10) ORDER BY linked_rank) AS x FROM linked GROUP BY question_id)
    SELECT question_id, context || coalesce(chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'CONNECTED NOTES (linked from retrieved results):' ||
      chr(10) || chr(10) || x, '') AS context FROM main LEFT JOIN more USING (question_id)""",
)
def retrieved_context(t: Tables) -> DataFrame:
    """The numbered context of every question: its retrieved chunks, then the notes they link to."""
    chunks = chunked(t, linked_files(t))
    payload = chunks.select("chunk_id", "note_path", "note_title", "note_folder", "note_date", "heading_path", "chunk_text")
    ranked = materialize(fused_chunks(t, chunks).join(payload, "chunk_id"), "fused")
    return ranking.context_text(ranked, ranking.expand_links(ranked, chunks, "question_id"), "question_id")


@query(
    "chunk_hybrid_notes",
    f"""WITH {NOTE_SQL} SELECT b.question_id, row_number() OVER (PARTITION BY b.question_id ORDER BY b.rk)::INTEGER AS rk, b.note_path, k.note_title,
      k.heading, CASE WHEN length(k.chunk_text) > 200 THEN k.chunk_text[1:200] || '...' ELSE k.chunk_text END AS snippet, b.rrf AS similarity
    FROM best b JOIN chunk k USING (chunk_id)""",
)
def chunk_hybrid_notes(t: Tables) -> DataFrame:
    """Lexical and vector lists of chunks, fused; of each note its best chunk is cited."""
    chunks = chunked(t)
    placed = materialize(fused_chunks(t, chunks).join(chunks.select("chunk_id", "note_path"), "chunk_id"), "fused")  # read twice
    best = ranking.best_chunk_per_note(placed, "question_id", "note_path", "rrf", "chunk_id")
    order = ranking.dedupe_to_notes(placed, "question_id", "note_path")
    ranked = best.join(order, ["question_id", "note_path"]).select(
        "question_id", "chunk_id", "rk", F.col("rrf").alias("similarity"), F.lit(0.0).alias("rerank_score")
    )
    return ranking.citations(ranked, chunks, "question_id", "chunk_id").drop("chunk_id", "rerank_score")


# --- incremental indexing ---------------------------------------------------------------

_EDIT = "\nEdited."


def edited(key: Column, content: Column) -> Column:
    """Content of a note now, by the last digit of its order."""
    return F.when((key % 10).isin(2, 4), F.concat(content, F.lit(_EDIT.strip()))).otherwise(content)


def folder_states(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(files before, files now): by the last digit of the order a note is new (0), gone (1), edited
    (2), only touched (3) or edited with its old time (4)."""
    k = F.col("o_orderkey") % 10
    files = order_notes(t)
    before = files.where(k != 0).select("note_path", "content", F.lit(1).alias("mtime"))
    now = files.where(k != 1).select("note_path", edited(F.col("o_orderkey"), F.col("content")).alias("content"), F.when(k.isin(2, 3), 2).otherwise(1).alias("mtime"))
    return before, now


def indexed(t: Tables, full: bool = False) -> indexing.Indexed:
    """The folder as it was is indexed in run 1; run 2 brings the tables up to date."""
    before, now = folder_states(t)
    chunks = notes.chunk(notes.parse(before.select("note_path", "content"))).limit(0)
    tracker = t.spark.createDataFrame([], "note_path string, mtime int, hash string, indexed_at string, chunk_count long")
    first = indexing.reindex(before, tracker, chunks, "run-1")
    return indexing.reindex(now, materialize(first.tracker, "tracker"), materialize(first.chunks, "chunks"), "run-2", full)


def after_sql(edited: str) -> str:
    """Chunks after run 2, for the digits whose edit is seen."""
    return f"""{CHUNK_SQL.split('asked AS')[0].split('chunk AS')[0]}
e AS (
  SELECT o_orderkey, note_path, chunk_index, heading, chunk_text ||
    CASE WHEN chunk_index = 1 AND o_orderkey % 10 IN ({edited}) THEN chr(10) || 'Edited.' ELSE '' END AS chunk_text
  FROM c WHERE o_orderkey % 10 <> 1),
after AS (
  SELECT *, sha1(note_path || '|' || replace(heading, ' > ', '|') || '|' || chunk_index || '|' ||
    regexp_replace(chunk_text, '\\s+', ' ', 'g'))[1:16] AS chunk_id FROM e)"""


@query("reindex_chunks", f"WITH {after_sql('2')} SELECT note_path, chunk_index::INTEGER AS chunk_index, chunk_id, chunk_text FROM after")
def reindex_chunks(t: Tables) -> DataFrame:
    return indexed(t).chunks.select("note_path", "chunk_index", "chunk_id", "chunk_text")


@query("reindex_full", f"WITH {after_sql('2, 4')} SELECT note_path, chunk_index::INTEGER AS chunk_index, chunk_id, chunk_text FROM after")
def reindex_full(t: Tables) -> DataFrame:
    return indexed(t, full=True).chunks.select("note_path", "chunk_index", "chunk_id", "chunk_text")


@query(
    "reindex_tracker",
    """SELECT 'orders/' || o_orderkey || '.md' AS note_path,
      CASE WHEN o_orderkey % 10 = 2 THEN 2 ELSE 1 END AS mtime,
      CASE WHEN o_orderkey % 10 IN (0, 2) THEN 'run-2' ELSE 'run-1' END AS indexed_at, 2::BIGINT AS chunk_count
    FROM orders WHERE o_orderkey % 10 <> 1""",
)
def reindex_tracker(t: Tables) -> DataFrame:
    return indexed(t).tracker.select("note_path", "mtime", "indexed_at", "chunk_count")


# --- committed runs ---------------------------------------------------------------------


def _sizes():
    """A model that any engine can follow: two numbers from the length of the text."""

    def make():
        return lambda texts: [[len(s) % 97, len(s) % 89] for s in texts]

    return lambda text: models.embed(text, make)


def committed(t: Tables) -> Store:
    """A store with both states of the folder committed one after the other."""
    before, now = folder_states(t)
    store = Store(t.spark, shared_dir(t.spark, "index"), indexing.tables("int"))
    indexing.commit_run(store, before, "run-1", _sizes())
    indexing.commit_run(store, now, "run-2", _sizes())
    return store


_VECTOR_SQL = f"""WITH {after_sql('2')}, v AS (SELECT note_path, chunk_index, chunk_id, length(heading || chr(10) || chunk_text) AS n FROM after)
    SELECT note_path, chunk_index::INTEGER AS chunk_index, chunk_id, (n % 97)::DOUBLE AS first, (n % 89)::DOUBLE AS second FROM v"""


def _shown(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    return chunks.select("note_path", "chunk_index", "chunk_id").join(vectors.drop("note_path"), "chunk_id").select(
        "note_path", "chunk_index", "chunk_id",
        F.col("embedding")[0].cast("double").alias("first"), F.col("embedding")[1].cast("double").alias("second"),
    )


@query("revector", _VECTOR_SQL)
def revector(t: Tables) -> DataFrame:
    """Vectors of run 1, then only those of changed notes made anew."""
    before, _ = folder_states(t)
    old = materialize(notes.chunk(notes.parse(before.select("note_path", "content"))), "chunks")
    after = indexed(t)
    vectors = materialize(indexing.fresh_vectors(old, _sizes()), "vectors")
    return _shown(after.chunks, indexing.revector(vectors, after, _sizes()))


@query(
    "committed_index",
    _VECTOR_SQL.replace("SELECT note_path, chunk_index::", "SELECT note_path, indexed_at, chunk_count, chunk_index::", 1).replace(
        "FROM v", """FROM v JOIN (SELECT 'orders/' || o_orderkey || '.md' AS note_path, 2::BIGINT AS chunk_count,
        CASE WHEN o_orderkey % 10 IN (0, 2) THEN 'run-2' ELSE 'run-1' END AS indexed_at FROM orders) USING (note_path)""",
    ),
)
def committed_index(t: Tables) -> DataFrame:
    """Chunks, vectors and tracker of one version of the store."""
    store = committed(t)
    now = store.current()
    tracker = store.read("tracker", version=now).select("note_path", "indexed_at", "chunk_count")
    return _shown(store.read("chunks", version=now), store.read("vectors", version=now)).join(tracker, "note_path")


_NOW_SQL = CHUNK_SQL.replace("c AS (", "c0 AS (", 1).replace(
    "chunk AS (",
    """c AS (SELECT * REPLACE (chunk_text || CASE WHEN chunk_index = 1 AND o_orderkey % 10 = 2 THEN chr(10) || 'Edited.' ELSE '' END AS chunk_text)
  FROM c0 WHERE o_orderkey % 10 <> 1),
chunk AS (""",
    1,
)


@query(
    "stored_index_topk",
    f"""WITH {_NOW_SQL} SELECT question_id, note_path, chunk_index::INTEGER AS chunk_index, heading, score, rk::INTEGER AS rk
    FROM lex JOIN chunk USING (chunk_id)""",
)
def stored_index_topk(t: Tables) -> DataFrame:
    """BM25 from the stored index after a run has changed it."""
    store = committed(t)
    hits = stored_index.topk(store, asked(t), "question_id", "question").hits
    chunks = store.read("chunks").select("chunk_id", "note_path", "chunk_index", F.array_join("heading_path", " > ").alias("heading"))
    return hits.join(chunks, "chunk_id").drop("chunk_id")


@query(
    "stored_index_terms",
    f"""WITH {_NOW_SQL} SELECT term, df, n AS n_docs, round(avgdl, 6)::DOUBLE AS avg_dl FROM dfs, st""",
)
def stored_index_terms(t: Tables) -> DataFrame:
    """Document frequencies and figures that the runs kept up to date."""
    store = committed(t)
    now = store.current()
    df = store.read("terms", version=now).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    n = now.props["n_docs"]
    return df.withColumn("n_docs", F.lit(n).cast("long")).withColumn("avg_dl", F.round(F.lit(now.props["total_dl"] / max(n, 1)), 6))
