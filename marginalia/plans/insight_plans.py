"""Metadata, replies of extractors, entities and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import dates as D
from marginalia.functions import models
from marginalia.functions import text as X
from marginalia.operators import insight, ranking, responses
from marginalia.operators.changes import delete, upsert
from marginalia.plans.fixtures import METADATA, cat, metadata, replies_json
from marginalia.plans.note_plans import STATES, states
from marginalia.plans.registry import Tables, query
from marginalia.session import materialize, shared_dir
from marginalia.sources import tables


@query(
    "entity_list",
    f"WITH {METADATA} SELECT note_path, pos::INTEGER AS pos, text, entity_type, confidence FROM ent WHERE entity_type = 'language'",
)
def entity_list(t: Tables) -> DataFrame:
    return insight.entities(metadata(t), "language")


@query(
    "entity_rollup",
    f"""WITH {METADATA} SELECT lower(text) AS key, entity_type, arg_min(text, (note_path, pos)) AS text,
    count(DISTINCT note_path)::BIGINT AS n_notes, max(confidence) AS max_confidence FROM ent GROUP BY 1, 2""",
)
def entity_rollup(t: Tables) -> DataFrame:
    return insight.entity_rollup(insight.entities(metadata(t)))


@query(
    "insight_cards",
    f"""WITH {METADATA} SELECT (SELECT count(*) FROM md)::BIGINT AS notes, (SELECT count(*) FROM md WHERE summary <> '')::BIGINT AS notes_with_summary,
      (SELECT count(*) FROM md)::BIGINT AS action_items, (SELECT count(*) FROM md WHERE priority = 'high')::BIGINT AS high_priority,
      (SELECT count(DISTINCT lower(phrase)) FROM phr)::BIGINT AS key_phrases,
      (SELECT count(*) FROM (SELECT DISTINCT lower(text), entity_type FROM ent))::BIGINT AS entities""",
)
def insight_cards(t: Tables) -> DataFrame:
    return insight.insight_cards(metadata(t))


@query(
    "entity_type_counts",
    f"WITH {METADATA} SELECT entity_type, count(DISTINCT lower(text))::BIGINT AS n FROM ent GROUP BY 1",
)
def entity_type_counts(t: Tables) -> DataFrame:
    return insight.entity_type_counts(metadata(t))


@query(
    "action_items",
    f"""WITH {METADATA} SELECT note_path, 'Do ' || doc_id AS text, coalesce(priority, '') AS priority,
    CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END::INTEGER AS rank FROM md""",
)
def action_items(t: Tables) -> DataFrame:
    return insight.action_items(metadata(t)).select("note_path", "text", F.coalesce("priority", F.lit("")).alias("priority"), "rank")


@query(
    "metadata_page",
    f"WITH {METADATA} SELECT note_path, summary FROM md ORDER BY note_path LIMIT 40 OFFSET 20",
)
def metadata_page(t: Tables) -> DataFrame:
    return tables.page(metadata(t), "note_path", 20, 40).select("note_path", "summary")


@query(
    "metadata_ops",
    f"""WITH {METADATA} SELECT note_path, CASE WHEN doc_id % 3 = 0 THEN 'renewed' ELSE summary END AS summary,
      (2 + (doc_id % 4 = 0)::INTEGER)::INTEGER AS n_entities, (SELECT max(text) FROM ent e WHERE e.doc_id = md.doc_id) AS last_entity
    FROM md WHERE doc_id % 5 <> 2""",
)
def metadata_ops(t: Tables) -> DataFrame:
    """Nested rows written as JSON text, read back, some replaced by key, some deleted."""
    path = shared_dir(t.spark, "metadata")
    rows = metadata(t)
    tables.encode_metadata(rows).write.parquet(path)
    stored = tables.decode_metadata(t.spark.read.parquet(path))
    new = rows.where("doc_id % 3 = 0").withColumn("summary", F.lit("renewed"))
    left = delete(upsert(stored, new, "note_path"), rows.where("doc_id % 5 = 2"), "note_path")
    texts = F.transform("entities", lambda e: e["text"])
    return left.select("note_path", "summary", F.size("entities").alias("n_entities"), F.array_max(texts).alias("last_entity"))


# --- suggestions ----------------------------------------------------------------------

RELATED = (
    METADATA
    + """,
pair AS (
  SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
  FROM embeddings a, embeddings b),
p50 AS (SELECT * FROM pair QUALIFY row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) <= 50),
rel0 AS (
  SELECT p.src, p.dst, p.sim, a.note_path, b.note_path AS target_path
  FROM p50 p JOIN md a ON a.doc_id = p.src JOIN md b ON b.doc_id = p.dst WHERE p.sim >= 0 AND p.src <> p.dst),
rel AS (
  SELECT src, dst, note_path, target_path, round(sim::DECIMAL(18, 6), 4)::DOUBLE AS similarity,
    row_number() OVER (PARTITION BY src ORDER BY sim DESC, target_path)::INTEGER AS rk FROM rel0 QUALIFY rk <= 10),
sh AS (
  SELECT rel.src, rel.dst, t.text, (row_number() OVER (PARTITION BY rel.src, rel.dst ORDER BY t.pos) - 1) AS spos
  FROM rel JOIN ent t ON t.doc_id = rel.dst
  WHERE EXISTS (SELECT 1 FROM ent s WHERE s.doc_id = rel.src AND lower(s.text) = lower(t.text)))"""
)


def related(t: Tables) -> DataFrame:
    """Notes that have both metadata and a vector, against the chunks of such notes."""
    notes = metadata(t).select("doc_id", "note_path")
    vectors = notes.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    chunks = vectors.select(F.col("doc_id").alias("chunk_id"), "note_path", "embedding")
    return insight.related_notes(vectors.select("note_path", "embedding"), chunks, metadata(t))


def stored_related(t: Tables) -> DataFrame:
    """Related notes written down: suggestions read them several times."""
    return materialize(related(t), "related")


@query(
    "related_notes",
    f"""WITH {RELATED} SELECT note_path, target_path, similarity, rk,
      coalesce((SELECT string_agg(text, ',' ORDER BY spos) FROM sh WHERE sh.src = rel.src AND sh.dst = rel.dst), '') AS shared FROM rel""",
)
def related_notes(t: Tables) -> DataFrame:
    return related(t).withColumn("shared", F.array_join("shared", ","))


@query(
    "link_suggestions",
    f"""WITH {RELATED},
    own AS (SELECT doc_id, note_path, lower(text) AS lt, min(pos) AS p0, arg_max(text, pos) AS text, arg_max(confidence, pos) AS confidence
      FROM ent GROUP BY ALL),
    s1 AS (SELECT rel.note_path, rel.target_path, sh.text AS anchor, rel.similarity AS confidence, 0 AS kind, rel.rk AS o1, sh.spos AS o2,
        'Shared entity: ' || sh.text AS reason FROM rel JOIN sh USING (src, dst) WHERE spos < 2),
    s2 AS (SELECT own.note_path, md.note_path AS target_path, own.text AS anchor, own.confidence, 1 AS kind, own.p0 AS o1, 0 AS o2,
        'Entity matches note title: ' || own.text AS reason FROM own JOIN md ON md.doc_id::VARCHAR = own.lt AND md.note_path <> own.note_path
      WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.note_path = own.note_path AND s1.target_path = md.note_path)),
    u AS (SELECT * FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2)
      QUALIFY row_number() OVER (PARTITION BY note_path, target_path, anchor ORDER BY confidence DESC, kind, o1, o2) = 1)
    SELECT note_path, target_path, anchor, confidence, reason, row_number() OVER (
      PARTITION BY note_path ORDER BY confidence DESC, kind, o1, o2, target_path, anchor)::INTEGER AS rk FROM u QUALIFY rk <= 10""",
)
def link_suggestions(t: Tables) -> DataFrame:
    return insight.link_suggestions(stored_related(t), metadata(t))


@query(
    "tag_suggestions",
    f"""WITH {RELATED},
    v AS (SELECT rel.src, rel.note_path, lower(trim(phrase)) AS tag, similarity, rel.rk, phr.pos, rel.target_path
      FROM rel JOIN phr ON phr.doc_id = rel.dst),
    sc AS (SELECT src, note_path, tag, round(sum(similarity), 4) AS score, min(rk * 10 + pos) AS first,
        array_to_string(list(target_path ORDER BY rk, pos)[1:5], ',') AS sources FROM v GROUP BY ALL),
    pool AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, first) AS r FROM sc QUALIFY r <= 20),
    kept AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY r)::INTEGER AS rk FROM pool
      WHERE NOT EXISTS (SELECT 1 FROM phr WHERE phr.doc_id = pool.src AND lower(trim(phrase)) = pool.tag) QUALIFY rk <= 10)
    SELECT note_path, tag, round(least(score::DOUBLE / (SELECT count(*) FROM rel WHERE rel.src = kept.src), 1.0::DOUBLE)::DECIMAL(18, 9), 3)::DOUBLE AS confidence,
      sources, rk FROM kept""",
)
def tag_suggestions(t: Tables) -> DataFrame:
    return insight.tag_suggestions(stored_related(t), metadata(t)).withColumn("sources", F.array_join("sources", ","))


# --- replies --------------------------------------------------------------------------


@query(
    "metadata_typing",
    """SELECT source || '/' || doc_id || '.md' AS note_path, doc_id % 7 <> 0 AS ok,
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Summary of ' || doc_id END AS summary,
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang || ',phase ' || (doc_id % 7) END AS phrases,
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE source || '/project/0.9;x' || doc_id || '/unknown/0.5' END AS entities,
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'due 3/' || (doc_id % 28 + 1) || '/24=2024-03-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ||
        '/reference/0.5;then=2024-01-02/deadline/0.7;some day=/reference/0.5' END AS dates,
      CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Do ' || doc_id || '/high/0.5;later//0.5' END AS actions FROM documents""",
)
def metadata_typing(t: Tables) -> DataFrame:
    def flat(name: str, show) -> DataFrame:
        return F.array_join(F.transform(name, show), ";").alias(name)

    def text(c):
        return c.cast("string")

    blank = F.lit("")
    out = responses.typed(replies_json(t))
    return out.select(
        "note_path",
        "ok",
        "summary",
        F.array_join("key_phrases", ",").alias("phrases"),
        flat("entities", lambda e: F.concat_ws("/", e["text"], e["entity_type"], text(e["confidence"]))),
        flat("dates", lambda d: F.concat(d["text"], F.lit("="), F.concat_ws("/", F.coalesce(d["normalized_date"], blank), d["date_type"], text(d["confidence"])))),
        flat("action_items", lambda a: F.concat_ws("/", a["text"], F.coalesce(a["priority"], blank), text(a["confidence"]))).alias("actions"),
    )


@query(
    "date_normalize",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
        WHEN 2 THEN '20' || strftime(o_orderdate, '%y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS normalized FROM orders""",
)
def date_normalize(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(k % 5 == 0, cat("on ", F.date_format(d, "yyyy-M-d"), ", then 1/2/2003"))
        .when(k % 5 == 1, cat("by ", F.date_format(d, "M/d/yyyy"), "."))
        .when(k % 5 == 2, F.date_format(d, "MM/dd/yy"))
        .when(k % 5 == 3, cat("x/9/9 ", F.date_format(d, "yyyy-MM-dd"), " 3/4/05"))
        .otherwise(cat("no date 123/456 ", k))
    )
    return t.orders.select("o_orderkey", F.coalesce(D.normalize_mention(text), F.lit("")).alias("normalized"))


@query(
    "segment_validate",
    """SELECT event_id, event_id % 6 IN (0, 1) AS valid_class, event_id % 6 IN (0, 5) AS valid_segments FROM events""",
)
def segment_validate(t: Tables) -> DataFrame:
    """Six shapes of classification and of segment list, most of them wrong in one way."""
    i = F.col("event_id")
    classes = [
        cat('{"note_type": "note", "tasks": null, "existing_note": "N ', i, '"}'),
        cat('```json\n{"note_type": "event", "tasks": [{"text": "t', i, '"}]}\n```'),
        cat('{"note_type": "memo ', i, '"}'),
        cat('{"note_type": "note", "tasks": "t', i, '"}'),
        cat('{"note_type": "project", "existing_note": ', i, "}"),
        cat('["note", ', i, "]"),
    ]
    lists = [
        cat('[{"content": "a', i, '"}, {"content": null, "topic": "b"}]'),
        cat('[{"content": "a', i, '"}, {"topic": "b"}]'),
        cat('[{"content": "a', i, '"}, "b"]'),
        cat('{"content": "a', i, '"}'),
        cat('[{"content": "a', i),
        F.lit("[]"),
    ]

    def pick(options):
        out = F.lit(None).cast("string")
        for n, option in enumerate(options):
            out = F.when(i % 6 == n, option).otherwise(out)
        return out

    return t.events.select(
        "event_id",
        responses.valid_classification(pick(classes)).alias("valid_class"),
        responses.valid_segments(pick(lists)).alias("valid_segments"),
    )


@query(
    "metadata_refresh",
    f"""WITH {STATES} SELECT outcome, count(*)::BIGINT AS n FROM (
      SELECT CASE WHEN doc_id % 10 IN (3, 5, 6, 7, 8, 9) AND doc_id % 13 <> 5 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'extracted' END AS outcome
      FROM cur) GROUP BY outcome""",
)
def metadata_refresh(t: Tables) -> DataFrame:
    current, tracked = states(t)
    number = F.regexp_extract("note_path", r"/(\d+)\.md$", 1).cast("long")
    stored = tracked.where(number % 13 != 5).select("note_path", F.col("hash").alias("content_hash"))
    outcomes = responses.refresh(current, stored, replies_json(t))
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_PROMPT_SQL = """'Title: Doc ' || doc_id || chr(10) || 'Path: ' || source || '/' || doc_id || '.md' || chr(10) || chr(10) || 'Content:' || chr(10) ||
  CASE WHEN length(now) > 12000 THEN now[1:12000] || chr(10) || chr(10) || '[... truncated ...]' ELSE now END"""


def title_model():
    """Stands in for a model: summary and length of the prompt; fails for every seventh document."""

    def reply(prompt: str) -> str:
        title = prompt.split("\n", 1)[0].removeprefix("Title: ")
        if int(title.removeprefix("Doc ")) % 7 == 0:
            raise RuntimeError("no answer")
        return '{"summary": "%s", "key_phrases": ["%d"]}' % (title, len(prompt))

    return reply


@query(
    "metadata_extract",
    f"""WITH d AS (SELECT *, text || CASE WHEN doc_id % 10 = 2 THEN chr(10) || 'Edited.' ELSE '' END AS now FROM documents),
    o AS (SELECT *, CASE WHEN doc_id % 10 = 1 THEN 'gone' WHEN doc_id % 7 = 0 THEN 'failed'
        WHEN doc_id % 10 = 2 AND length(text) > 12000 THEN 'cached' WHEN doc_id % 10 IN (0, 2) THEN 'extracted' ELSE 'skipped' END AS outcome FROM d
      WHERE NOT (doc_id % 10 = 1 AND doc_id % 7 = 0))
    SELECT source || '/' || doc_id || '.md' AS note_path, outcome, CASE WHEN outcome = 'failed' THEN 'RuntimeError: no answer' END AS error,
      CASE WHEN outcome NOT IN ('failed', 'gone') THEN 'Doc ' || doc_id END AS summary,
      CASE WHEN outcome NOT IN ('failed', 'gone') THEN length({_PROMPT_SQL}) END::BIGINT AS prompt_length FROM o""",
)
def metadata_extract(t: Tables) -> DataFrame:
    """A second run over the documents: by last digit new (0), gone (1), edited (2) or unchanged.
    Only what is stale is sent to the extractor, and what failed before. An edit behind the end of
    the prompt leaves the prompt as it was, so its reply is known."""
    i = F.col("doc_id")

    def notes(docs: DataFrame) -> DataFrame:
        path = cat(F.col("source"), "/", i, ".md")
        prompt = X.prompt_text(cat("Doc ", i), path, F.create_map().cast("map<string,string>"), F.col("text"))
        return docs.select(path.alias("note_path"), F.sha1(F.col("text").cast("binary")).alias("hash"), prompt.alias("prompt"))

    docs = t.spread("documents").select("doc_id", "source", "text")
    edit = F.when(i % 10 == 2, F.concat("text", F.lit("\nEdited."))).otherwise(F.col("text"))
    first = responses.extract_stale(notes(docs.where(i % 10 != 0)), *responses.no_metadata(docs), "titles", title_model)
    now = notes(docs.where(i % 10 != 1).withColumn("text", edit))
    second = responses.extract_stale(now, first.metadata, first.cache, "titles", title_model)
    known = second.metadata.select("note_path", "summary", F.element_at("key_phrases", 1).cast("long").alias("prompt_length"))
    return second.outcomes.join(known, "note_path", "left")


@query(
    "extraction_prompts",
    """SELECT doc_id, md5('Title: Doc ' || doc_id || chr(10) || 'Path: ' || source || '/' || doc_id || '.md' || chr(10) || chr(10) ||
      CASE WHEN doc_id % 2 = 0 THEN 'Frontmatter:' || chr(10) || '  lang: ' || lang || chr(10) || chr(10) ELSE '' END || 'Content:' || chr(10) ||
      CASE WHEN length(text) > 12000 THEN text[1:12000] || chr(10) || chr(10) || '[... truncated ...]' ELSE text END) AS digest FROM documents""",
)
def extraction_prompts(t: Tables) -> DataFrame:
    """Prompt texts; only the prompt is bounded in length, as the prompt's own rule says."""
    i = F.col("doc_id")
    meta = F.when(i % 2 == 0, F.create_map(F.lit("lang"), F.col("lang"))).otherwise(F.create_map().cast("map<string,string>"))
    prompt = X.prompt_text(cat("Doc ", i), cat(F.col("source"), "/", i, ".md"), meta, F.col("text"))
    return t.documents.select("doc_id", F.md5(prompt.cast("binary")).alias("digest"))


# --- model boundaries -----------------------------------------------------------------


@query(
    "hash_embed",
    """SELECT doc_id, 256 AS dim,
      CASE WHEN len(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+')) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
    FROM documents""",
)
def hash_embed(t: Tables) -> DataFrame:
    """Size and length of vectors from hashed words. Which word meets which number is a fixed hash
    of this engine, so the twin states what must hold of any: unit length unless wordless."""
    out = models.hash_embed(t.spread("documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@query(
    "embed_udf",
    "SELECT doc_id, (length(text) % 97)::DOUBLE AS first, (length(text) % 89)::DOUBLE AS second FROM documents",
)
def embed_udf(t: Tables) -> DataFrame:
    def make():
        return lambda texts: [[len(s) % 97, len(s) % 89] for s in texts]

    vec = models.embed(F.col("text"), make)
    return t.documents.select("doc_id", vec.alias("v")).select(
        "doc_id", F.col("v")[0].cast("double").alias("first"), F.col("v")[1].cast("double").alias("second")
    )


@query(
    "score_udf",
    "SELECT doc_id, ((length(text) + length(source)) % 11)::DOUBLE AS rerank_score FROM documents",
)
def score_udf(t: Tables) -> DataFrame:
    def scorer(queries, texts):
        return [(len(q) + len(x)) % 11 for q, x in zip(queries, texts)]

    return ranking.with_scorer(t.documents, "source", "text", scorer).select("doc_id", "rerank_score")


@query(
    "extract_udf",
    """SELECT doc_id, doc_id % 9 <> 4 AS ok, CASE WHEN doc_id % 9 = 4 THEN '' ELSE '{"n": ' || doc_id || '}' END AS value,
      CASE WHEN doc_id % 9 = 4 THEN 'ValueError: no answer for ' || doc_id ELSE '' END AS error FROM documents""",
)
def extract_udf(t: Tables) -> DataFrame:
    def make():
        def model(prompt: str) -> str:
            if int(prompt) % 9 == 4:
                raise ValueError(f"no answer for {prompt}")
            return f'{{"n": {prompt}}}'

        return model

    out = t.documents.select("doc_id", models.extract(F.col("doc_id").cast("string"), make).alias("r"))
    blank = F.lit("")
    return out.select("doc_id", "r.ok", F.coalesce("r.value", blank).alias("value"), F.coalesce("r.error", blank).alias("error"))
