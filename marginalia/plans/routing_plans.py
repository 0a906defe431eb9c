"""Capture routing, living documents, appends, dimensions and keyed-table checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import changes, responses, routing
from marginalia.plans.fixtures import SEGMENTS, cat, existing_titles, replies_json, segments
from marginalia.plans.registry import Tables, query
from marginalia.plans.task_plans import iso
from marginalia.session import shared_dir
from marginalia.sources import tables


@query(
    "subcategory_remap",
    f"""WITH {SEGMENTS} SELECT event_id, category, CASE WHEN category = 'Personal' AND sub_project = 'Yoga' THEN 'General' ELSE sub_project END AS sub_project FROM seg""",
)
def subcategory_remap(t: Tables) -> DataFrame:
    out = routing.remap_sub_project(segments(t), tables.categories(t.spark))
    return out.select("event_id", "category", "sub_project")


@query("route_segments", f"WITH {SEGMENTS} SELECT event_id, route, folder, tasks_to_daily FROM routed")
def route_segments(t: Tables) -> DataFrame:
    return routing.route(segments(t), existing_titles(t)).select("event_id", "route", "folder", "tasks_to_daily")


@query(
    "route_writes",
    f"""WITH {SEGMENTS} SELECT route, folder, count(*)::BIGINT AS n, count(*) FILTER (tasks_to_daily)::BIGINT AS n_with_tasks FROM routed GROUP BY ALL""",
)
def route_writes(t: Tables) -> DataFrame:
    """Captures written by route in one job, then counted from what was written."""
    path = shared_dir(t.spark, "routes")
    routing.write_routes(routing.route(segments(t), existing_titles(t)), path)
    return t.spark.read.parquet(path).groupBy("route", "folder").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("tasks_to_daily").alias("n_with_tasks")
    )


@query(
    "file_names",
    f"""WITH {SEGMENTS},
    made AS (SELECT event_id, folder, safe_title, row_number() OVER (PARTITION BY folder, safe_title ORDER BY event_id) AS rn FROM routed WHERE route = 'create')
    SELECT event_id, folder, CASE
        WHEN folder = '10_Notes' AND safe_title = 'Untitled' THEN 'Untitled ' || CASE WHEN rn = 1 THEN 1 ELSE rn + 1 END
        WHEN rn = 1 THEN safe_title ELSE safe_title || ' ' || (rn - 1) END AS file_title FROM made""",
)
def file_names(t: Tables) -> DataFrame:
    """New notes get free names; 'Untitled' and 'Untitled 2' exist among the notes already."""
    made = routing.route(segments(t), existing_titles(t)).where("route = 'create'")
    used = t.region.where("r_regionkey IN (0, 2)").select(
        F.lit("10_Notes").alias("folder"),
        F.when(F.col("r_regionkey") == 0, "Untitled").otherwise("Untitled 2").alias("title"),
    )
    return routing.file_names(made, existing_titles(t).unionByName(used), "event_id").select(
        "event_id", "folder", "file_title"
    )


@query(
    "inbox_route",
    """SELECT doc_id, CASE WHEN dup THEN 'duplicate' WHEN doc_id % 7 = 0 THEN '_failed' ELSE '_processed' END AS outcome,
      CASE WHEN dup OR doc_id % 7 = 0 THEN '' ELSE 'Summary of ' || doc_id END AS file_title
    FROM (SELECT doc_id, sha1(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) IN (
      SELECT sha1(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) FROM documents WHERE doc_id % 20 = 0) AS dup
      FROM documents WHERE doc_id % 20 <> 0)""",
)
def inbox_route(t: Tables) -> DataFrame:
    """Captures against an archive (every 20th text): copies are skipped, replies that do not
    parse send the file to the failed folder."""
    texts = t.spread("documents").select("doc_id", "text")
    archive, inbox = texts.where("doc_id % 20 = 0"), texts.where("doc_id % 20 <> 0")
    copies = changes.already_processed(inbox, archive, "text").select("doc_id", F.lit(True).alias("dup"))
    answers = responses.typed(replies_json(t)).select("doc_id", "ok", "summary")
    dup = F.coalesce("dup", F.lit(False))
    joined = inbox.select("doc_id").join(copies, "doc_id", "left").join(answers, "doc_id")
    return joined.select(
        "doc_id",
        F.when(dup, "duplicate").when(~F.col("ok"), "_failed").otherwise("_processed").alias("outcome"),
        F.when(dup | ~F.col("ok"), "").otherwise(X.safe_file_name(F.col("summary"))).alias("file_title"),
    )


@query(
    "living_doc_history",
    """SELECT user_id, row_number() OVER w AS version, event_id, strftime(ts, '%Y-%m-%d') AS valid_from,
      coalesce(strftime(lead(ts) OVER w, '%Y-%m-%d'), '') AS valid_to, lead(ts) OVER w IS NULL AS current
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def living_doc_history(t: Tables) -> DataFrame:
    out = routing.living_history(t.events.select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"])
    return out.select(
        "user_id", "version", "event_id", iso("ts").alias("valid_from"), iso("valid_to"), "current"
    )


@query(
    "living_doc_append",
    """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS section,
      '### ' || strftime(ts, '%Y-%m-%d') AS heading, event_type || ' ' || event_id AS body FROM events""",
)
def living_doc_append(t: Tables) -> DataFrame:
    rows = t.events.select(
        "user_id", "ts", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"),
        cat(F.col("event_type"), " ", F.col("event_id")).alias("body"),
    )
    return routing.appended_sections(rows, "user_id", ["ts", "event_id"], "date", "body")


@query(
    "append_if_absent",
    """WITH n AS (SELECT doc_id, text FROM documents),
    i AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text[11:40] ELSE 'New item ' || (doc_id % 3) END AS item, doc_id % 5 AS o FROM documents
          UNION ALL SELECT doc_id, 'New item ' || (doc_id % 3), 9 FROM documents)
    SELECT doc_id AS date, item AS text, min(o)::BIGINT AS o FROM i JOIN n USING (doc_id) WHERE NOT contains(n.text, item) GROUP BY doc_id, item""",
)
def append_if_absent(t: Tables) -> DataFrame:
    """Each document is the note of its day; items already in its text are not added again."""
    i = F.col("doc_id")
    notes = t.documents.select(i.alias("date"), F.col("text").alias("content"))
    new = cat("New item ", i % 3)
    first = t.documents.select(
        i.alias("date"), F.when(i % 2 == 0, F.substring("text", 11, 30)).otherwise(new).alias("text"), (i % 5).alias("o")
    )
    again = t.documents.select(i.alias("date"), new.alias("text"), F.lit(9).cast("long").alias("o"))
    return routing.absent_items(first.unionByName(again), notes, "o")


@query(
    "event_if_absent",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Visit ' || (o_custkey % 4) AS title,
      CASE WHEN o_orderkey % 2 = 0 THEN '- 9:15 — Visit ' || (o_custkey % 4) ELSE '- Visit ' || (o_custkey % 4) || ' (through 2001-12-31)' END AS bullet
    FROM orders o WHERE o_orderkey % 3 = 0 AND NOT EXISTS (
      SELECT 1 FROM orders h WHERE h.o_orderkey % 3 <> 0 AND h.o_orderdate = o.o_orderdate AND h.o_custkey % 4 = o.o_custkey % 4)""",
)
def event_if_absent(t: Tables) -> DataFrame:
    """Orders not divisible by 3 are in the calendar already, as bullets; the others come in."""
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 4
    rows = t.orders.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), cat("Visit ", c).alias("title"),
        F.when(k % 2 == 0, "9:15").otherwise("").alias("time"), F.when(k % 2 == 1, "2001-12-31").otherwise("").alias("end_date"),
    ).withColumn("bullet", routing.event_bullet(F.col("title"), F.col("time"), F.col("end_date")))
    have = rows.where("o_orderkey % 3 != 0").select("date", routing.event_title(F.col("bullet")).alias("title"))
    return routing.absent_events(rows.where("o_orderkey % 3 = 0"), have).select("o_orderkey", "date", "title", "bullet")


# --- tables and dimensions ------------------------------------------------------------


@query(
    "point_counts",
    """SELECT 'found' AS name, count(*)::BIGINT AS n FROM documents WHERE doc_id = 17
    UNION ALL SELECT 'missing', count(*)::BIGINT FROM documents WHERE doc_id = -1
    UNION ALL SELECT 'cleared', 0 UNION ALL SELECT 'all', count(*)::BIGINT FROM documents""",
)
def point_counts(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id")
    return tables.counts(
        found=tables.point_lookup(docs, "doc_id", 17),
        missing=tables.point_lookup(docs, "doc_id", -1),
        cleared=tables.cleared(docs),
        all=docs,
    )


@query(
    "index_counts",
    """SELECT 'vector_count' AS name, count(*)::BIGINT AS n FROM embeddings UNION ALL SELECT 'lexical_count', count(*)::BIGINT FROM documents""",
)
def index_counts(t: Tables) -> DataFrame:
    return tables.counts(vector_count=t.embeddings, lexical_count=t.documents)


@query(
    "model_check",
    """SELECT 'dim-' || max(len(embedding)) AS stored_model, 'dim-64' AS current_model, max(len(embedding)) = 64 AS matches FROM embeddings""",
)
def model_check(t: Tables) -> DataFrame:
    stored = t.embeddings.agg(cat("dim-", F.max(F.size("embedding"))).alias("embedding_model"))
    return tables.model_matches(stored, "dim-64")


@query(
    "groundtruth_roundtrip",
    """SELECT text AS query, 'src' || item_id || ',src' || item_id AS expected, 'group-' || (item_id % 4) AS tags FROM benchmark""",
)
def groundtruth_roundtrip(t: Tables) -> DataFrame:
    path = shared_dir(t.spark, "truth")
    note = cat("src", F.col("item_id"))
    tables.write_ground_truth(
        t.benchmark.select(
            F.col("text").alias("query"),
            F.array(note, note).alias("expected_notes"),
            F.array(cat("group-", F.col("item_id") % 4)).alias("tags"),
        ),
        path,
    )
    back = tables.read_ground_truth(t.spark, path)
    return back.select("query", F.array_join("expected_notes", ",").alias("expected"), F.array_join("tags", ",").alias("tags"))


@query(
    "category_dim",
    """SELECT o_orderpriority AS category, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS sub_projects
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def category_dim(t: Tables) -> DataFrame:
    """Categories written as settings lines with described sub-projects, then read back."""
    path = shared_dir(t.spark, "settings")
    pairs = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("o_orderpriority").alias("name"), "c_mktsegment")
        .distinct()
    )
    entry = F.struct(F.col("c_mktsegment").alias("key"), cat("about ", F.col("c_mktsegment")).alias("value"))
    pairs.groupBy("name").agg(F.map_from_entries(F.collect_list(entry)).alias("sub_projects")).write.json(path)
    dim = tables.categories(t.spark, path)
    return dim.select("category", F.array_join(F.array_sort("sub_projects"), ",").alias("sub_projects"))


@query(
    "ci_sort",
    "SELECT lower(p_brand) AS key, count(*)::BIGINT AS n FROM part GROUP BY 1",
)
def ci_sort(t: Tables) -> DataFrame:
    """Case-insensitive order of names that differ in case only by where they stand."""
    mixed = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")).otherwise(F.lower("p_brand"))
    return (
        t.part.select(F.collate(mixed, "UNICODE_CI").alias("name"))
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.lower(F.collate("name", "UTF8_BINARY"))).alias("key"))
        .orderBy("name")
        .select("key", "n")
    )
