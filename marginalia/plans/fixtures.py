"""Notes, dated notes and replies rendered from the tables, one row at a time.

No rendering step groups rows, so fixtures grow with their table and never build one
large text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.plans.registry import Tables

# notes made of short rows that a task renders and parses; a split of the table may hold millions
NOTES_PER_TASK = 50_000


def cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def note_path() -> Column:
    """``<source>/<id>.md``; every seventh note has a dated file name in a folder of its own."""
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    return F.when(
        F.col("doc_id") % 7 == 0, cat(F.col("source"), "/", F.col("doc_id"), "/2024-02-", day, ".md")
    ).otherwise(cat(F.col("source"), "/", F.col("doc_id"), ".md"))


def notes_md(t: Tables) -> DataFrame:
    """(doc_id, note_path, content). Even ids have a head block, with a quoted date for multiples
    of 4, a plain one, which is no text, for the others, and a number as title for multiples of
    10; odd multiples of 11 have
    neither head nor level-one heading; multiples of 3 end with links; multiples of 5 skip a
    heading level and come back."""
    i = F.col("doc_id")
    day = F.lpad((i % 28 + 1).cast("string"), 2, "0")
    head = F.when(i % 2 == 0, cat(
        "---\ntitle: ", F.when(i % 10 == 0, "2024").otherwise(cat("Doc ", i)),
        "\ndate: ", F.when(i % 4 == 0, cat('"2024-01-', day, '"')).otherwise(cat("2024-01-", day)), "\n---\n",
    )).otherwise("")
    h1 = F.when((i % 2 == 1) & (i % 11 == 0), "").otherwise(cat("# Doc ", i, "\n\n"))
    tail = F.when(
        i % 3 == 0,
        cat(
            "### Tail\nSee [[Doc ", i + 1, "]] and [[doc ", i + 2, "#part|that]] again [[Doc ", i + 1,
            "|x]] but not `[[Doc ", i + 3, "]]`.\n",
        ),
    ).otherwise("")
    deep = F.when(i % 5 == 0, cat("#### Deep\nDeep note of ", i, ".\n## Again\nBack at two for ", i, ".\n")).otherwise("")
    content = cat(head, h1, "## ", F.col("lang"), "\n", F.col("text"), "\n", tail, deep)
    return t.spread("documents").select("doc_id", note_path().alias("note_path"), content.alias("content"))


NOTES = """
notes AS (
  SELECT *, CASE WHEN doc_id % 7 = 0
      THEN source || '/' || doc_id || '/2024-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '.md'
      ELSE source || '/' || doc_id || '.md' END AS note_path,
    (doc_id % 2 = 1 AND doc_id % 11 = 0) AS bare,
    CASE WHEN doc_id % 2 = 1 AND doc_id % 11 = 0
      THEN CASE WHEN doc_id % 7 = 0 THEN '2024-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ELSE doc_id::VARCHAR END
      ELSE 'Doc ' || doc_id END AS note_title,
    CASE WHEN doc_id % 4 = 0 THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0')
         WHEN doc_id % 7 = 0 THEN '2024-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ELSE '' END AS note_date
  FROM documents)"""


def order_notes(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """(o_orderkey, note_path, content): one note per order with a long, a short and a long section."""
    k = F.col("o_orderkey")
    long_a = cat(
        "Order ", k, " of customer ", F.col("o_custkey"), " was placed with priority ", F.col("o_orderpriority"),
        " and is expected to be followed up by the team that looks after this customer.",
    )
    long_b = cat(
        "The order stands at   status ", F.col("o_orderstatus"), ".\nAnyone who changes the status is asked to",
        " write a line here, with the reason and with the name of the person spoken to.",
    )
    content = cat("# Order ", k, "\n", long_a, "\n\n## Short\nToo short to keep.\n\n### Status\n", long_b, "\n")
    return (t.spread("orders", NOTES_PER_TASK) if orders is None else orders).select(
        "o_orderkey", cat("orders/", k, ".md").alias("note_path"), content.alias("content")
    )


def daily_md(t: Tables) -> DataFrame:
    """(o_orderkey, note_path, content): one dated note per order with every kind of line,
    including lines that must be ignored."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.to_date("o_orderdate")
    mark = F.when(F.col("o_orderstatus") == "F", "x").when(F.col("o_orderstatus") == "P", "/").otherwise(" ")

    def iso(d: Column) -> Column:
        return F.date_format(d, "yyyy-MM-dd")

    topics = F.array(*[F.lit(w) for w in TOPICS])
    content = cat(
        "# Daily\n- [ ] outside tasks\n## Focus\n- Focus on customer ", c % 50, "\n- \n## Notes\n- Note about the ",
        F.get(topics, (k % 7).cast("int")), " of order ", k, "\nplain line\n## Tasks\n- [ ] Loose end ", c, "\n### ",
        F.col("o_orderpriority"), "\n- [/] Start review of ", c, " (due: ", iso(F.date_add(day, 10)), ")\n#### Area ", c % 5,
        "\n- [x] Close file, part ", c, " ! (due: bad)\n-[ ] Follow up customer ", c, " (due: ",
        iso(F.date_add(day, (k % 30).cast("int"))), ")\n### Other\n* not a task\n- [", mark, "] Call \"customer\" ", c,
        "\n## Events\n- 9:30 — Meeting with ", c, "\nno bullet\n- All day at ", k % 7, " (through ",
        iso(F.date_add(day, 3)), ")\n- 14:05 - Review ", c, "\n## Tasks\n- [ ] Second section ", k,
        "\n## Focus\n- Repeat focus\n",
    )
    return t.spread("orders", NOTES_PER_TASK).select(
        "o_orderkey", cat("v", k, "/00_Daily/", iso(day), ".md").alias("note_path"), content.alias("content")
    )


TOPICS = ["garden", "budget", "travel", "server", "health", "music", "report"]

DAILY = """
ord AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderdate::DATE AS d, o_orderpriority AS pr,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'in_progress' ELSE 'open' END AS st,
    'v' || o_orderkey || '/00_Daily/' || strftime(o_orderdate, '%Y-%m-%d') || '.md' AS note_path
  FROM orders),
dtask AS (
  SELECT k, note_path, d AS source_date, '' AS category, '' AS sub_project, 9 AS line_number, 'open' AS status,
    NULL::DATE AS due_date, 'Loose end ' || c AS text, 'loose end ' || c AS normalized FROM ord
  UNION ALL SELECT k, note_path, d, pr, '', 11, 'in_progress', d + 10, 'Start review of ' || c, 'start review of ' || c FROM ord
  UNION ALL SELECT k, note_path, d, pr, 'Area ' || (c % 5), 13, 'done', NULL, 'Close file, part ' || c || ' ! (due: bad)',
    'close file part ' || c || ' due bad' FROM ord
  UNION ALL SELECT k, note_path, d, pr, 'Area ' || (c % 5), 14, 'open', d + (k % 30)::INTEGER,
    'Follow up customer ' || c, 'follow up customer ' || c FROM ord
  UNION ALL SELECT k, note_path, d, 'Other', '', 17, st, NULL, 'Call "customer" ' || c, 'call customer ' || c FROM ord),
devent AS (
  SELECT k, note_path, d AS date, 19 AS line_number, '9:30' AS time, NULL::DATE AS end_date, 'Meeting with ' || c AS title FROM ord
  UNION ALL SELECT k, note_path, d, 21, '', d + 3, 'All day at ' || (k % 7) FROM ord
  UNION ALL SELECT k, note_path, d, 22, '14:05', NULL, 'Review ' || c FROM ord),
dctx AS (
  SELECT k, note_path, d AS date, 'focus' AS section, 3 AS line_number, 'Focus on customer ' || (c % 50) AS item FROM ord
  UNION ALL SELECT k, note_path, d, 'notes', 6, 'Note about the ' ||
    ['garden', 'budget', 'travel', 'server', 'health', 'music', 'report'][(k % 7 + 1)::INTEGER] || ' of order ' || k FROM ord
  UNION ALL SELECT k, note_path, d, 'focus', 26, 'Repeat focus' FROM ord)"""


def order_tasks(t: Tables) -> DataFrame:
    """Orders as task appearances: the customer is the task, priority and segment its place."""
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("open")
    due = F.when(k % 3 != 0, F.date_add(day, (k % 40).cast("int")))
    segment = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("sub_project"))
    return t.orders.join(segment, "o_custkey").select(
        cat("Follow up customer ", F.col("o_custkey"), "!").alias("text"),
        status.alias("status"),
        day.alias("source_date"),
        F.col("o_orderpriority").alias("category"),
        "sub_project",
        k.alias("line_number"),
        due.alias("due_date"),
        cat("follow up customer ", F.col("o_custkey")).alias("normalized"),
        F.date_format(day, "yyyy-MM-dd").alias("note_path"),
    )


APPEARANCES = """
app AS (
  SELECT 'Follow up customer ' || o_custkey || '!' AS text,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'in_progress' ELSE 'open' END AS status,
    o_orderdate::DATE AS source_date, o_orderpriority AS category, c_mktsegment AS sub_project, o_orderkey AS line_number,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE + (o_orderkey % 40)::INTEGER END AS due_date,
    'follow up customer ' || o_custkey AS normalized, strftime(o_orderdate, '%Y-%m-%d') AS note_path
  FROM orders JOIN customer ON c_custkey = o_custkey)"""

AGGREGATE = """
task AS (
  SELECT *, status = 'done' AS completed,
    CASE WHEN status = 'done' THEN 0 ELSE DATE '2001-08-01' - first_date END::INTEGER AS days_open
  FROM (
    SELECT category, sub_project, normalized, arg_min(text, (source_date, line_number)) AS text,
      arg_max(status, (source_date, line_number)) AS status,
      arg_max(due_date, (source_date, line_number)) FILTER (due_date IS NOT NULL) AS due_date,
      min(source_date) AS first_date, max(source_date) AS latest_date, count(*)::BIGINT AS appearance_count
    FROM app GROUP BY category, sub_project, normalized))"""


def metadata(t: Tables) -> DataFrame:
    """Extracted metadata per document: entities name its source, language and at times the
    next note's title."""
    i = F.col("doc_id")

    def entity(text, kind: str, confidence) -> Column:
        return F.struct(text.alias("text"), F.lit(kind).alias("entity_type"), confidence.alias("confidence"))

    entities = F.array(
        entity(F.col("source"), "project", F.lit(0.9)),
        entity(F.when(i % 2 == 1, F.upper("lang")).otherwise(F.col("lang")), "language", 0.5 + (i % 5) / 10.0),
        entity(F.when(i % 4 == 0, (i + 1).cast("string")), "note", 0.6 + (i % 3) / 10.0),
    )
    priority = F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit(None)), (i % 4).cast("int"))
    return t.documents.select(
        "doc_id",
        cat(F.col("source"), "/", i, ".md").alias("note_path"),
        F.when(i % 6 == 0, "").otherwise(cat("Summary of ", i)).alias("summary"),
        F.array(cat(" ", F.upper("lang")), cat("Phase ", i % 7), cat("group ", i % 13)).alias("key_phrases"),
        F.filter(entities, lambda e: e["text"].isNotNull()).alias("entities"),
        F.array(F.struct(cat("Do ", i).alias("text"), F.lit(0.8).alias("confidence"), priority.alias("priority"))).alias(
            "action_items"
        ),
    )


METADATA = """
md AS (SELECT doc_id, source || '/' || doc_id || '.md' AS note_path, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'Summary of ' || doc_id END AS summary,
    ['high', 'medium', 'low', NULL][(doc_id % 4 + 1)::INTEGER] AS priority FROM documents),
ent AS (
  SELECT doc_id, source || '/' || doc_id || '.md' AS note_path, 0 AS pos, source AS text, 'project' AS entity_type, 0.9::DOUBLE AS confidence FROM documents
  UNION ALL SELECT doc_id, source || '/' || doc_id || '.md', 1, CASE WHEN doc_id % 2 = 1 THEN upper(lang) ELSE lang END, 'language',
    0.5 + (doc_id % 5) / 10.0::DOUBLE FROM documents
  UNION ALL SELECT doc_id, source || '/' || doc_id || '.md', 2, (doc_id + 1)::VARCHAR, 'note', 0.6 + (doc_id % 3) / 10.0::DOUBLE FROM documents WHERE doc_id % 4 = 0),
phr AS (
  SELECT doc_id, 0 AS pos, ' ' || upper(lang) AS phrase FROM documents UNION ALL SELECT doc_id, 1, 'Phase ' || (doc_id % 7) FROM documents
  UNION ALL SELECT doc_id, 2, 'group ' || (doc_id % 13) FROM documents)"""


def replies_json(t: Tables) -> DataFrame:
    """(doc_id, note_path, raw): extraction replies; every 7th is cut off, every 11th fenced."""
    i = F.col("doc_id")
    good = cat(
        '{"summary": "Summary of ', i, '", "key_phrases": ["', F.col("lang"), '", "phase ', i % 7,
        '"], "entities": [{"text": "', F.col("source"), '", "entity_type": "project", "confidence": 0.9}, "stray", {"text": "x', i,
        '"}], "dates": [{"text": "due 3/', i % 28 + 1, '/24"}, {"text": "then", "normalized_date": "2024-01-02", "date_type": "deadline",',
        ' "confidence": 0.7}, {"text": "some day"}], "action_items": [{"text": "Do ', i, '", "priority": "high"}, 5, {"text": "later"}]}',
    )
    raw = (
        F.when(i % 7 == 0, F.substring(good, 1, 25))
        .when(i % 11 == 0, cat("```json\n", good, "\n```"))
        .otherwise(good)
    )
    return t.documents.select("doc_id", cat(F.col("source"), "/", i, ".md").alias("note_path"), raw.alias("raw"))


SEGMENT_TYPES = ["daily_note", "note", "project", "concept", "living_document", "event", "mystery"]


def segments(t: Tables) -> DataFrame:
    """Events as classified captures: type, existing note, living document, tasks."""
    i, u = F.col("event_id"), F.col("user_id")
    kinds = F.array(*[F.lit(k) for k in SEGMENT_TYPES])
    return t.events.select(
        "event_id",
        "ts",
        F.get(kinds, (i % 7).cast("int")).alias("note_type"),
        F.when(u % 5 == 0, cat("Note ", u)).alias("existing_note"),
        F.when(i % 2 == 0, "Grocery List").when(i % 3 == 0, "Recipe Ideas").otherwise("Unknown").alias("living_doc_name"),
        (F.get_json_object("props", "$.k").cast("int") % 3).alias("n_tasks"),
        F.get(F.array(F.lit("Work"), F.lit("Personal"), F.lit("Hobby")), (u % 3).cast("int")).alias("category"),
        F.get(F.array(F.lit("Health"), F.lit("Yoga"), F.lit("Chores"), F.lit("")), (i % 4).cast("int")).alias("sub_project"),
        F.when(u % 4 == 0, "??? / !!").otherwise(cat("Idea: no. ", u % 10, "?")).alias("title"),
    )


SEGMENTS = """
seg AS (
  SELECT event_id, ts, ['daily_note', 'note', 'project', 'concept', 'living_document', 'event', 'mystery'][(event_id % 7 + 1)::INTEGER] AS note_type,
    CASE WHEN user_id % 5 = 0 THEN 'Note ' || user_id END AS existing_note,
    CASE WHEN event_id % 2 = 0 THEN 'Grocery List' WHEN event_id % 3 = 0 THEN 'Recipe Ideas' ELSE 'Unknown' END AS living_doc_name,
    (props->>'k')::INTEGER % 3 AS n_tasks, ['Work', 'Personal', 'Hobby'][(user_id % 3 + 1)::INTEGER] AS category,
    ['Health', 'Yoga', 'Chores', ''][(event_id % 4 + 1)::INTEGER] AS sub_project,
    CASE WHEN user_id % 4 = 0 THEN 'Untitled' ELSE 'Idea no ' || (user_id % 10) END AS safe_title FROM events),
ttl AS (
  SELECT DISTINCT CASE WHEN user_id % 3 = 0 THEN '10_Notes' ELSE '30_Concepts' END AS folder, 'Note ' || user_id AS title FROM events WHERE user_id % 4 <> 1),
routed AS (
  SELECT seg.*, h.folder AS have,
    CASE WHEN h.folder IS NOT NULL THEN 'append'
      WHEN note_type = 'living_document' AND living_doc_name = 'Grocery List' THEN 'living_replace'
      WHEN note_type = 'living_document' AND living_doc_name = 'Recipe Ideas' THEN 'living_append'
      WHEN note_type = 'event' THEN 'event' WHEN note_type = 'daily_note' THEN 'daily' ELSE 'create' END AS route,
    CASE WHEN h.folder IS NOT NULL THEN h.folder WHEN note_type IN ('event', 'daily_note') THEN '00_Daily'
      WHEN note_type = 'project' THEN '20_Projects' WHEN note_type = 'concept' THEN '30_Concepts' ELSE '10_Notes' END AS folder,
    n_tasks > 0 AND note_type NOT IN ('daily_note', 'living_document', 'event') AS tasks_to_daily
  FROM seg LEFT JOIN (SELECT title, min(folder) AS folder FROM ttl GROUP BY title) h ON h.title = seg.existing_note)"""


def existing_titles(t: Tables) -> DataFrame:
    u = F.col("user_id")
    return t.events.where(u % 4 != 1).select(
        F.when(u % 3 == 0, "10_Notes").otherwise("30_Concepts").alias("folder"), cat("Note ", u).alias("title")
    ).distinct()
