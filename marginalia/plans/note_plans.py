"""Note parsing, chunking, links and incremental indexing over rendered notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions.splitting import window_pieces
from marginalia.operators import changes, notes, ranking
from marginalia.plans.fixtures import NOTES, cat, notes_md, order_notes
from marginalia.plans.registry import Tables, query
from marginalia.session import materialize, shared_dir
from marginalia.sources import notes as files

SECTIONS = (
    NOTES
    + """,
secs AS (
  SELECT doc_id, note_path, 0 AS ord, CASE WHEN bare THEN lang ELSE 'Doc ' || doc_id || ' > ' || lang END AS heading,
         regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS txt FROM notes
  UNION ALL
  SELECT doc_id, note_path, 1, CASE WHEN bare THEN lang ELSE 'Doc ' || doc_id || ' > ' || lang END || ' > Tail',
         'See [[Doc ' || (doc_id + 1) || ']] and [[doc ' || (doc_id + 2) || '#part|that]] again [[Doc ' || (doc_id + 1)
         || '|x]] but not `[[Doc ' || (doc_id + 3) || ']]`.' FROM notes WHERE doc_id % 3 = 0
  UNION ALL
  SELECT doc_id, note_path, 2, CASE WHEN bare THEN lang ELSE 'Doc ' || doc_id || ' > ' || lang END
         || CASE WHEN doc_id % 3 = 0 THEN ' > Tail' ELSE '' END || ' > Deep',
         'Deep note of ' || doc_id || '.' FROM notes WHERE doc_id % 5 = 0
  UNION ALL
  SELECT doc_id, note_path, 3, CASE WHEN bare THEN '' ELSE 'Doc ' || doc_id || ' > ' END || 'Again',
         'Back at two for ' || doc_id || '.' FROM notes WHERE doc_id % 5 = 0)"""
)

LINKS = (
    NOTES
    + """,
lk AS (
  SELECT doc_id, note_path AS src_path, 0 AS pos, 'Doc ' || (doc_id + 1) AS dst_title FROM notes WHERE doc_id % 3 = 0
  UNION ALL
  SELECT doc_id, note_path, 1, 'doc ' || (doc_id + 2) FROM notes WHERE doc_id % 3 = 0),
titles AS (SELECT lower(note_title) AS lt, min(note_path) AS dst_path FROM notes GROUP BY 1),
res AS (SELECT lk.*, dst_path FROM lk JOIN titles ON lower(dst_title) = lt)"""
)


def parsed(t: Tables) -> DataFrame:
    return notes.parse(notes_md(t).select("note_path", "content"))


@query(
    "frontmatter_title",
    f"WITH {NOTES} SELECT note_path, note_title, (doc_id % 2 = 0) AS has_head FROM notes",
)
def frontmatter_title(t: Tables) -> DataFrame:
    return parsed(t).select("note_path", "note_title", (F.size("frontmatter") > 0).alias("has_head"))


@query(
    "frontmatter_nested",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || '|phase ' || (doc_id % 7) WHEN 1 THEN lang || '|' || source ELSE lang END AS tags,
      CASE WHEN doc_id % 3 < 2 THEN 'Author of "' || doc_id || '"' END AS author,
      CASE WHEN doc_id % 3 = 0 THEN 'b' || doc_id END AS second_place, CASE WHEN doc_id % 3 = 0 THEN doc_id % 100 END AS age,
      CASE WHEN doc_id % 3 = 0 THEN 'first line ' || doc_id || ' and second' || chr(10) END AS summary,
      (doc_id % 3 = 0)::BOOLEAN AS draft FROM documents""",
)
def frontmatter_nested(t: Tables) -> DataFrame:
    """Lists in both spellings, nested maps, typed and folded values of the head block."""
    i = F.col("doc_id")
    block = cat(
        "---\ntitle: Doc\ntags:\n  - ", F.col("lang"), "\n  - phase ", i % 7, "\nauthor:\n  name: 'Author of \"", i, "\"'\n  age: ", i % 100,
        "\n  places: [a, 'b", i, "']\nsummary: >\n  first line ", i, "\n  and second\ndraft: yes # so far\n---\n",
    )
    inline = cat("---\ntags: [", F.col("lang"), ", \"", F.col("source"), "\"]\nauthor: {name: \"Author of \\\"", i, "\\\"\"}\ndraft: false\n---\n")
    plain = cat("---\ntags: ", F.col("lang"), "\nauthor: ~\ndraft: no\n---\n")
    head = F.when(i % 3 == 0, block).when(i % 3 == 1, inline).otherwise(plain)
    content = F.concat(head, F.lit("# Doc\n"), F.col("text"))
    at = lambda path, kind="string": F.try_variant_get("head", path, kind)
    return t.spread("documents").select("doc_id", F.array_join(notes.tags(content), "|").alias("tags"), notes.head_values(content).alias("head")).select(
        "doc_id", "tags", at("$.author.name").alias("author"), at("$.author.places[1]").alias("second_place"),
        at("$.author.age", "bigint").alias("age"), at("$.summary").alias("summary"), at("$.draft", "boolean").alias("draft"),
    )


@query("folder_date", f"WITH {NOTES} SELECT note_path, source AS note_folder, note_date FROM notes")
def folder_date(t: Tables) -> DataFrame:
    return parsed(t).select("note_path", "note_folder", "note_date")


@query(
    "sections",
    f"""WITH {SECTIONS} SELECT note_path, (row_number() OVER (PARTITION BY note_path ORDER BY ord) - 1)::INTEGER AS section,
    heading, length(txt)::INTEGER AS n_chars, md5(txt) AS digest FROM secs""",
)
def sections(t: Tables) -> DataFrame:
    return (
        parsed(t)
        .select("note_path", F.posexplode(notes.sections(F.col("body"))).alias("section", "s"))
        .select(
            "note_path",
            "section",
            F.array_join("s.heading_path", " > ").alias("heading"),
            F.length("s.text").alias("n_chars"),
            F.md5(F.col("s.text").cast("binary")).alias("digest"),
        )
    )


@query("chunks")
def chunks(t: Tables) -> DataFrame:
    """All chunks of all notes. Splitting recurses over 14 separators, so there is no SQL
    twin; tests compare it with a direct reading of the rule."""
    return notes.chunk(parsed(t)).withColumn("heading", F.array_join("heading_path", " > ")).drop("heading_path")


@query(
    "chunk_ids",
    """WITH base AS (
      SELECT o_orderkey, 'orders/' || o_orderkey || '.md' AS note_path, 0 AS chunk_index, 'Order ' || o_orderkey AS heads,
        'Order ' || o_orderkey || ' of customer ' || o_custkey || ' was placed with priority ' || o_orderpriority ||
        ' and is expected to be followed up by the team that looks after this customer.' AS norm FROM orders
      UNION ALL
      SELECT o_orderkey, 'orders/' || o_orderkey || '.md', 1, 'Order ' || o_orderkey || '|Short|Status',
        'The order stands at status ' || o_orderstatus || '. Anyone who changes the status is asked to' ||
        ' write a line here, with the reason and with the name of the person spoken to.' FROM orders)
    SELECT note_path, chunk_index::INTEGER AS chunk_index, replace(heads, '|', ' > ') AS heading,
      sha1(note_path || '|' || heads || '|' || chunk_index || '|' || norm)[1:16] AS chunk_id,
      sha1(norm)[1:16] AS checksum FROM base""",
)
def chunk_ids(t: Tables) -> DataFrame:
    parts = notes.chunk(notes.parse(order_notes(t).select("note_path", "content")))
    return parts.select(
        "note_path", "chunk_index", F.array_join("heading_path", " > ").alias("heading"), "chunk_id", "checksum"
    )


@query(
    "embedding_text",
    """SELECT 'orders/' || o_orderkey || '.md' AS note_path, 'Order ' || o_orderkey || chr(10) || 'Order ' || o_orderkey ||
      ' of customer ' || o_custkey || ' was placed with priority ' || o_orderpriority ||
      ' and is expected to be followed up by the team that looks after this customer.' AS embedding_text FROM orders
    UNION ALL
    SELECT 'orders/' || o_orderkey || '.md', 'Order ' || o_orderkey || ' > Short > Status' || chr(10) ||
      'The order stands at   status ' || o_orderstatus || '.' || chr(10) || 'Anyone who changes the status is asked to' ||
      ' write a line here, with the reason and with the name of the person spoken to.' FROM orders""",
)
def embedding_text(t: Tables) -> DataFrame:
    parts = notes.chunk(notes.parse(order_notes(t).select("note_path", "content")))
    return parts.select(
        "note_path", X.embedding_text(F.col("heading_path"), F.col("chunk_text")).alias("embedding_text")
    )


def _cut(start: str, size: int, overlap: int) -> str:
    """SQL for the end of the window at ``start``: the last space that still moves forward."""
    window = f"text[{start} + 1:{start} + {size}]"
    space = f"({start} + {size} - instr(reverse({window}), ' '))"
    return (
        f"CASE WHEN {start} + {size} >= length(text) THEN length(text) "
        f"WHEN instr({window}, ' ') > 0 AND {space} - {overlap} > {start} THEN {space} ELSE {start} + {size} END"
    )


def _force_cte(name: str, size: int, overlap: int) -> str:
    step = f"greatest(e - {overlap}, s + 1)"
    return f"""{name} AS (
      SELECT doc_id, text, 0 AS piece_no, 0::BIGINT AS s, ({_cut('0', size, overlap)})::BIGINT AS e FROM documents
      UNION ALL
      SELECT doc_id, text, piece_no + 1, ({step})::BIGINT, ({_cut(step, size, overlap)})::BIGINT
      FROM {name} WHERE e < length(text))"""


@query(
    "force_split",
    f"""WITH RECURSIVE {_force_cte('w1', 700, 100)}, {_force_cte('w2', 200, 40)}
    SELECT doc_id, 700 AS size, piece_no::INTEGER AS piece_no,
           regexp_replace(text[s + 1:e], '^\\s+|\\s+$', '', 'g') AS piece FROM w1
    UNION ALL
    SELECT doc_id, 200, piece_no::INTEGER, regexp_replace(text[s + 1:e], '^\\s+|\\s+$', '', 'g') FROM w2""",
)
def force_split(t: Tables) -> DataFrame:
    def cut(size: int, overlap: int) -> DataFrame:
        return t.spread("documents").select(
            "doc_id",
            F.lit(size).alias("size"),
            F.posexplode(window_pieces(size, overlap)(F.col("text"))).alias("piece_no", "piece"),
        )

    return cut(700, 100).unionByName(cut(200, 40))


@query("wiki_links", f"WITH {LINKS} SELECT src_path, pos::INTEGER AS pos, dst_title FROM lk")
def wiki_links(t: Tables) -> DataFrame:
    return notes.links(parsed(t))


@query("link_resolve", f"WITH {LINKS} SELECT src_path, pos::INTEGER AS pos, dst_title, dst_path FROM res")
def link_resolve(t: Tables) -> DataFrame:
    all_notes = parsed(t)
    return ranking.resolve_titles(notes.links(all_notes), all_notes)


@query(
    "linked_context",
    f"""WITH {LINKS},
    cand AS (
      SELECT item_id, d.doc_id, (d.doc_id - item_id * 3)::INTEGER + 1 AS rk FROM benchmark, documents d
      WHERE d.doc_id BETWEEN item_id * 3 AND item_id * 3 + 3),
    have AS (SELECT item_id, note_path AS dst_path FROM cand JOIN notes USING (doc_id)),
    fresh AS (
      SELECT item_id, dst_path, min(rk * 10 + pos) AS o, min_by(doc_id, rk * 10 + pos) AS from_id
      FROM cand JOIN res USING (doc_id) ANTI JOIN have USING (item_id, dst_path) GROUP BY ALL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY o)::INTEGER AS linked_rank, dst_path AS note_path,
      n.note_title, md5(n.text) AS digest, src.note_title AS linked_from
    FROM fresh JOIN notes n ON n.note_path = dst_path JOIN notes src ON src.doc_id = from_id
    QUALIFY linked_rank <= 3""",
)
def linked_context(t: Tables) -> DataFrame:
    """Question i has documents 3i to 3i+3 as ranked candidates; their links lead on."""
    rows = notes.parse(notes_md(t).join(t.documents.select("doc_id", "text"), "doc_id"))
    asked = t.benchmark.select("item_id", F.posexplode(F.sequence(F.col("item_id") * 3, F.col("item_id") * 3 + 3)).alias("p", "doc_id"))
    ranked = asked.join(rows, "doc_id").select(
        "item_id", (F.col("p") + 1).alias("rk"), "note_path", "note_title", F.col("body").alias("chunk_text")
    )
    stored = rows.select("note_path", "note_title", F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"))
    out = ranking.expand_links(ranked, stored, "item_id")
    return out.withColumn("digest", F.md5(F.col("chunk_text").cast("binary"))).drop("chunk_text")


GLOBS = ["http://*/fr/*", "*.html", "https://m.th?*", "*#top"]


@query(
    "path_exclude",
    """SELECT page_id, url, NOT (url GLOB 'http://*/fr/*' OR url GLOB '*.html' OR url GLOB 'https://m.th?*' OR url GLOB '*#top')
       AS included FROM pages""",
)
def path_exclude(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url", files.included(F.col("url"), GLOBS).alias("included"))


@query(
    "source_scan",
    """SELECT 'site=' || (page_id % 5) || '/page=' || page_id AS note_dir, (page_id % 5)::VARCHAR AS site,
      octet_length(encode(html || chr(10)))::BIGINT AS n_bytes, sha1(html || chr(10)) AS hash, html[1:40] AS head
    FROM pages WHERE page_id % 5 <> 3""",
)
def source_scan(t: Tables) -> DataFrame:
    """Pages written as one file each, then scanned, fingerprinted and read back."""
    root = shared_dir(t.spark, "scan")
    page = F.col("page_id")
    pages = t.spread("pages").select((page % 5).alias("site"), page.alias("page"), F.col("html").alias("value"))
    files.write_texts(pages, root, "site", "page")
    found = files.scan(t.spark, root, "*.txt", excludes=["site=3/*"])
    return found.where(F.is_valid_utf8("content")).select(
        F.regexp_replace("note_path", "/[^/]*$", "").alias("note_dir"),
        F.regexp_extract("note_path", "site=([0-9]+)", 1).alias("site"),
        F.col("length").alias("n_bytes"),
        files.content_hash().alias("hash"),
        F.substring(files.note_text(), 1, 40).alias("head"),
    )


@query(
    "scan_globs",
    """SELECT 'site=' || (page_id % 5) || '/page=' || page_id AS note_dir, 1::BIGINT AS n FROM pages
       WHERE (page_id % 5 = 1 OR page_id % 5 = 2 OR page_id::VARCHAR LIKE '%7') AND page_id % 5 <> 3""",
)
def scan_globs(t: Tables) -> DataFrame:
    """Several patterns, of which some match the same files; every file comes once."""
    root = shared_dir(t.spark, "scan")
    page = F.col("page_id")
    t.spread("pages").select((page % 5).alias("site"), page.alias("page"), F.col("html").alias("value")).write.partitionBy(
        "site", "page"
    ).text(root)
    found = files.scan(t.spark, root, ["site=1/*.txt", "site=2/*.txt", "**/page=*7/*.txt"], excludes=["site=3/*"])
    where = F.regexp_replace("note_path", "/[^/]*$", "").alias("note_dir")
    return found.groupBy(where).agg(F.count(F.lit(1)).alias("n"))


@query(
    "bad_utf8_quarantine",
    """SELECT page_id::VARCHAR AS note_path, (octet_length(encode(html)) + 1)::BIGINT AS n_bytes, 'invalid UTF-8' AS reason
       FROM pages WHERE page_id % 9 = 0
       UNION ALL SELECT page_id::VARCHAR, length(html)::BIGINT, 'ok' FROM pages WHERE page_id % 9 <> 0""",
)
def bad_utf8_quarantine(t: Tables) -> DataFrame:
    raw = F.encode("html", "UTF-8")
    binary = F.when(F.col("page_id") % 9 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    found = t.pages.select(F.col("page_id").cast("string").alias("note_path"), binary.alias("content"))
    good = files.readable(found).select(
        "note_path", F.length("content").cast("long").alias("n_bytes"), F.lit("ok").alias("reason")
    )
    return files.quarantined(found).unionByName(good)


# --- two states of the documents --------------------------------------------------------

STATES = """
cur AS (
  SELECT doc_id, source || '/' || doc_id || '.md' AS note_path,
    CASE WHEN doc_id % 10 IN (2, 3) THEN 2 ELSE 1 END AS mtime,
    sha1(CASE WHEN doc_id % 10 IN (2, 4) THEN text || ' edited' ELSE text END) AS hash
  FROM documents WHERE doc_id % 10 <> 1),
old AS (
  SELECT doc_id, source || '/' || doc_id || '.md' AS note_path, 1 AS mtime, sha1(text) AS hash
  FROM documents WHERE doc_id % 10 <> 0),
cls AS (
  SELECT coalesce(c.note_path, o.note_path) AS note_path,
    CASE WHEN o.note_path IS NULL THEN 'new' WHEN c.note_path IS NULL THEN 'deleted'
         WHEN c.mtime = o.mtime OR c.hash = o.hash THEN 'unchanged' ELSE 'modified' END AS change
  FROM cur c FULL JOIN old o USING (note_path))"""


def states(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(current, tracked): some documents appear, some vanish, some change with or without a
    new modification time."""
    i = F.col("doc_id")
    path = cat(F.col("source"), "/", i, ".md").alias("note_path")
    text = F.when((i % 10).isin(2, 4), F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    current = t.documents.where(i % 10 != 1).select(
        path, F.when((i % 10).isin(2, 3), 2).otherwise(1).alias("mtime"), F.sha1(text.cast("binary")).alias("hash")
    )
    tracked = t.documents.where(i % 10 != 0).select(
        path, F.lit(1).alias("mtime"), F.sha1(F.col("text").cast("binary")).alias("hash")
    )
    return current, tracked


@query("file_changes", f"WITH {STATES} SELECT note_path, change FROM cls")
def file_changes(t: Tables) -> DataFrame:
    return changes.classify(*states(t))


@query("change_summary", f"WITH {STATES} SELECT change, count(*)::BIGINT AS n FROM cls GROUP BY change")
def change_summary(t: Tables) -> DataFrame:
    return changes.summary(changes.classify(*states(t)))


@query(
    "tracker_ops",
    f"""WITH {STATES} SELECT note_path, coalesce(c.mtime, o.mtime)::INTEGER AS mtime,
      coalesce(CASE WHEN change <> 'unchanged' THEN c.hash END, o.hash) AS hash,
      CASE WHEN change = 'unchanged' THEN 'run-1' ELSE 'run-2' END AS indexed_at,
      (CASE WHEN change = 'unchanged' THEN 1 ELSE 2 END)::BIGINT AS chunk_count
    FROM (SELECT cls.*, CASE WHEN change <> 'unchanged' THEN cur.mtime END AS m FROM cls LEFT JOIN cur USING (note_path)) x
    LEFT JOIN (SELECT note_path, mtime, hash FROM cur) c2 USING (note_path)
    LEFT JOIN old o USING (note_path)
    LEFT JOIN (SELECT cur.* FROM cur JOIN cls USING (note_path) WHERE change <> 'unchanged') c USING (note_path)
    WHERE change <> 'deleted'""",
)
def tracker_ops(t: Tables) -> DataFrame:
    current, tracked = states(t)
    tracker = tracked.withColumn("indexed_at", F.lit("run-1")).withColumn("chunk_count", F.lit(1).cast("long"))
    found = materialize(changes.classify(current, tracked), "changes")
    counts = current.select("note_path", F.lit(2).alias("chunk_count"))
    return changes.apply_to_tracker(tracker, found, current, counts, "run-2")


@query(
    "incremental_index",
    f"""WITH {STATES} SELECT note_path, CASE WHEN change = 'unchanged' THEN 'run-1' ELSE 'run-2' END AS version
    FROM cls WHERE change <> 'deleted'""",
)
def incremental_index(t: Tables) -> DataFrame:
    """Only rows of changed notes are rebuilt; the others stay as they were."""
    current, tracked = states(t)
    found = materialize(changes.classify(current, tracked), "changes")
    stored = tracked.select("note_path", F.lit("run-1").alias("version"))
    todo = found.where(F.col("change").isin("new", "modified"))
    fresh = current.join(todo, "note_path", "left_semi").select("note_path", F.lit("run-2").alias("version"))
    return changes.apply_to_chunks(stored, found, fresh)


@query(
    "upsert_chunks",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS version FROM documents""",
)
def upsert_chunks(t: Tables) -> DataFrame:
    base = t.documents.select("doc_id", F.lit("first").alias("version"))
    new = t.documents.where("doc_id % 3 = 0").select("doc_id", F.lit("second").alias("version"))
    return changes.upsert(base, new, "doc_id")


@query(
    "delete_by_note",
    """SELECT source, count(*) FILTER (keep)::BIGINT AS n_left, count(*) FILTER (NOT keep)::BIGINT AS n_removed
    FROM (SELECT source, source NOT IN ('src1', 'src2') AS keep FROM documents) GROUP BY source""",
)
def delete_by_note(t: Tables) -> DataFrame:
    base = t.documents.select("doc_id", "source")
    gone = base.where(F.col("source").isin("src1", "src2")).select("source")
    left = changes.delete(base, gone, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n_left"))
    out = changes.removed(base, gone, "source").groupBy("source").agg(F.count(F.lit(1)).alias("n_removed"))
    return left.join(out, "source", "full_outer").select(
        "source",
        F.coalesce("n_left", F.lit(0)).cast("long").alias("n_left"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
    )


@query(
    "stale_metadata",
    """SELECT source || '/' || doc_id || '.md' AS note_path,
      sha1(CASE WHEN doc_id % 10 IN (2, 4) THEN text || ' edited' ELSE text END) AS hash
    FROM documents WHERE doc_id % 10 <> 1 AND (doc_id % 10 IN (0, 2, 4) OR doc_id % 13 = 5)""",
)
def stale_metadata(t: Tables) -> DataFrame:
    current, tracked = states(t)
    number = F.regexp_extract("note_path", r"/(\d+)\.md$", 1).cast("long")
    metadata = tracked.where(number % 13 != 5).select("note_path", F.col("hash").alias("content_hash"))
    return changes.stale_metadata(current, metadata).select("note_path", "hash")


@query(
    "dup_by_hash",
    """WITH h AS (SELECT doc_id, sha1(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))[1:16] AS content_hash FROM documents)
    SELECT doc_id, content_hash, f AS first_key FROM h JOIN (SELECT content_hash, min(doc_id) AS f FROM h GROUP BY 1) USING (content_hash)
    WHERE doc_id <> f""",
)
def dup_by_hash(t: Tables) -> DataFrame:
    return changes.duplicate_texts(t.spread("documents"), "doc_id", "text")


@query(
    "title_inventory",
    """SELECT lang AS note_folder, 'Doc ' || doc_id AS note_title, row_number() OVER (
         PARTITION BY lang ORDER BY lower('Doc ' || doc_id))::INTEGER AS rk FROM documents QUALIFY rk <= 75""",
)
def title_inventory(t: Tables) -> DataFrame:
    titled = t.documents.select(F.col("lang").alias("note_folder"), cat("Doc ", F.col("doc_id")).alias("note_title"))
    return notes.title_inventory(titled)


@query(
    "dated_notes",
    f"""WITH {NOTES} SELECT note_path, CASE WHEN doc_id % 7 = 0 THEN '2024-02-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ELSE doc_id::VARCHAR END AS title,
      source AS folder, doc_id % 7 = 0 AS dated FROM notes""",
)
def dated_notes(t: Tables) -> DataFrame:
    """Display title and top folder of a path, and whether its file name is dated."""
    path = F.col("note_path")
    return notes_md(t).select(
        "note_path", X.title_of_path(path).alias("title"), X.folder_of_path(path).alias("folder"), files.dated(path).alias("dated")
    )
