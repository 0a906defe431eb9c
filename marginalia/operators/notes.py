"""Note text -> front matter, title, sections, chunks and links.

Every step works inside one note's row: nested splits in place of line windows, so the
whole path from raw text to chunks needs no shuffle and no per-note sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import constants as K
from marginalia.functions import headblock
from marginalia.functions import text as X
from marginalia.functions.splitting import section_pieces

_FRONT = r"(?s)^---[ \t]*\n(.*?)\n---[ \t]*(?:\n|$)"


# what a plain value of the head block reads as when it is no text: nothing, truth values, numbers,
# dates, lists and maps
_NO_TEXT = (
    r"(?i)^(|~|null|true|false|yes|no|on|off|[-+]?[0-9][0-9_]*(\.[0-9]*)?(e[-+]?[0-9]+)?|[-+]?\.[0-9]+(e[-+]?[0-9]+)?"
    r"|0x[0-9a-f]+|[-+]?\.inf|\.nan|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ].*)?|[\[{].*)$"
)
_QUOTED = r"""^(["'])(.*)\1$"""


def _head_pairs(content: Column) -> Column:
    """Key and value, as written, of every line of the head block; a later key wins."""
    head = F.regexp_extract(content, _FRONT, 1)
    lines = F.filter(F.split(head, "\n"), lambda s: s.rlike(r"^[^\s:#-][^:]*:"))
    pairs = F.transform(
        lines,
        lambda s: F.struct(
            X.strip(F.regexp_extract(s, r"^([^:]+):", 1)).alias("key"),
            X.strip(F.regexp_extract(s, r"^[^:]+:(.*)$", 1)).alias("value"),
        ),
    )

    def last_of_key(ps: Column) -> Column:
        return F.filter(
            ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda later: later["key"] == p["key"])
        )

    return X.bind(pairs, last_of_key)


def _unquoted(pairs: Column) -> Column:
    return F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), F.regexp_replace(p["value"], _QUOTED, "$2").alias("value")))
    )


def front_matter(content: Column) -> Column:
    """Flat ``key: value`` pairs of the head block as a map; a later key wins."""
    return _unquoted(_head_pairs(content))


def text_values(content: Column) -> Column:
    """Those pairs of the head block whose value is a text: quoted, or no number, date and so on."""
    return _unquoted(F.filter(_head_pairs(content), lambda p: p["value"].rlike(_QUOTED) | ~p["value"].rlike(_NO_TEXT)))


def head_values(content: Column) -> Column:
    """The head block with its lists, nested maps and typed values, as a VARIANT."""
    return headblock.values(F.nullif(F.regexp_extract(content, _FRONT, 1), F.lit("")))


def tags(content: Column) -> Column:
    """The tags of the head block, a list or one text."""
    return headblock.texts(head_values(content), "$.tags")


def body(content: Column) -> Column:
    return F.regexp_replace(content, _FRONT, "")


def note_title(path: Column, meta: Column, text: Column) -> Column:
    """Front matter title, if it is a text, else first level-one heading, else the file stem."""
    h1 = X.strip(F.regexp_extract(text, r"(?m)^[ \t]*# (.*)$", 1))
    has_h1 = F.regexp_like(text, F.lit(r"(?m)^[ \t]*# "))
    return F.coalesce(F.element_at(meta, "title"), F.when(has_h1, h1), X.stem(path))


def note_date(path: Column, meta: Column) -> Column:
    """Front matter date, if it is a text, else the date a dated file name consists of, else ''."""
    named = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(\d{4}-\d{2}-\d{2})\.md$", 1)
    return F.coalesce(F.nullif(F.element_at(meta, "date"), F.lit("")), named)


def parse(files: DataFrame) -> DataFrame:
    """(note_path, content, ...) -> notes with title, body, folder, date and front matter.
    Other columns are passed on."""
    raw = X.unify_newlines(F.col("content"))
    extra = [c for c in files.columns if c not in ("note_path", "content")]
    return (
        files.select("note_path", raw.alias("_raw"), *extra)
        .select("note_path", *extra, front_matter(F.col("_raw")).alias("frontmatter"),
                text_values(F.col("_raw")).alias("_meta"), body(F.col("_raw")).alias("body"))
        .select(
            "note_path",
            note_title(F.col("note_path"), F.col("_meta"), F.col("body")).alias("note_title"),
            X.folder_of_path(F.col("note_path")).alias("note_folder"),
            note_date(F.col("note_path"), F.col("_meta")).alias("note_date"),
            "frontmatter",
            "body",
            *extra,
        )
    )


def _outline(text: Column, path: Column, level: int) -> Column:
    """Split by headings of one level, then each block by the next deeper level.

    A block starts at its heading, so a shallower heading always closes deeper ones and
    skipped levels simply give no split.
    """
    if level > 6:
        return F.array(F.struct(path.alias("heading_path"), X.strip(text).alias("text")))
    parts = F.split(text, rf"\n(?=#{{{level}}}[ \t]+\S)")

    def block(part: Column, i: Column) -> Column:
        title = X.strip(F.regexp_extract(part, r"^#+[ \t]+([^\n]*)", 1))
        rest = F.concat(F.lit("\n"), F.regexp_replace(part, r"^[^\n]*\n?", ""))
        inner_path = F.concat(path, F.when(i > 0, F.array(title)).otherwise(F.array().cast("array<string>")))
        return _outline(F.when(i > 0, rest).otherwise(part), inner_path, level + 1)

    return F.flatten(F.transform(parts, block))


def sections(text: Column) -> Column:
    """Ordered array of (heading_path, text), empty sections left out."""
    found = _outline(F.concat(F.lit("\n"), text), F.array().cast("array<string>"), 1)
    return F.filter(found, lambda s: s["text"] != "")


def chunk(notes: DataFrame) -> DataFrame:
    """Notes -> chunks. The index counts kept pieces of the note from 0."""
    cut = notes.withColumn("_s", sections(F.col("body"))).withColumn(
        "_p", section_pieces(F.transform("_s", lambda s: s["text"]))
    )
    rows = F.flatten(
        F.zip_with(
            "_s",
            "_p",
            lambda s, ps: F.transform(
                ps, lambda p: F.struct(s["heading_path"].alias("heading_path"), X.strip(p).alias("chunk_text"))
            ),
        )
    )
    kept = F.filter(rows, lambda r: F.length(r["chunk_text"]) >= K.MIN_CHUNK_SIZE)
    return (
        cut.select("note_path", "note_title", "note_folder", "note_date", F.posexplode(kept).alias("chunk_index", "_c"))
        .select("note_path", "note_title", "note_folder", "note_date", "chunk_index", "_c.heading_path", "_c.chunk_text")
        .withColumn(
            "chunk_id",
            X.chunk_id(F.col("note_path"), F.col("heading_path"), F.col("chunk_index"), F.col("chunk_text")),
        )
        .withColumn("checksum", X.text_checksum(F.col("chunk_text")))
    )


def links(notes: DataFrame) -> DataFrame:
    """(src_path, pos, dst_title) for every distinct link of a note."""
    return notes.select(
        F.col("note_path").alias("src_path"),
        F.posexplode(X.wiki_links(F.col("body"))).alias("pos", "dst_title"),
    )


def title_inventory(notes: DataFrame, per_folder: int = 75) -> DataFrame:
    """First titles of every folder in case-insensitive order."""
    from marginalia.operators.retrieval import top_k

    return top_k(
        notes.select("note_folder", "note_title"),
        "note_folder",
        [F.lower("note_title"), F.asc("note_title")],
        per_folder,
    )
