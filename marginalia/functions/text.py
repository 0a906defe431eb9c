"""Text expressions: every function takes and returns Columns and stays inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import constants as K

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with one mark, paired with their base letter."""
    marked, base = [], []
    for code in range(0xC0, 0x250):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) > 1 and unicodedata.combining(parts[1]) and parts[0].isascii():
            marked.append(char)
            base.append(parts[0])
    return "".join(marked), "".join(base)


_MARKED, _BASE = _accent_table()


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Remove all leading and trailing whitespace, newlines and tabs included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def unify_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def fold(c: Column) -> Column:
    """Case- and accent-insensitive form used by the index."""
    return F.translate(F.lower(c), _MARKED, _BASE)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_words(c: Column) -> Column:
    """Query text -> words, with the query language's own signs blanked out."""
    blanked = F.translate(c, K.QUERY_SPECIAL_CHARS, " " * len(K.QUERY_SPECIAL_CHARS))
    return F.filter(F.split(strip(blanked), r"\s+"), lambda w: w != "")


def strip_due(c: Column) -> Column:
    return F.regexp_replace(c, K.DUE_DATE_PATTERN, "")


def due_text(c: Column) -> Column:
    """The trailing ``(due: ...)`` date as text, NULL when there is none."""
    return F.nullif(F.regexp_extract(c, K.DUE_DATE_PATTERN, 1), F.lit(""))


def drop_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def task_key(c: Column) -> Column:
    return collapse(drop_punctuation(F.lower(strip(strip_due(c)))))


def project_key(c: Column) -> Column:
    bare = F.lower(F.regexp_replace(c, r"\.md$", ""))
    return F.regexp_replace(drop_punctuation(bare), r"\s+", "")


def checkbox_status(mark: Column) -> Column:
    return (
        F.when(mark == "/", "in_progress").when(F.lower(mark) == "x", "done").otherwise("open")
    )


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def title_of_path(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def folder_of_path(path: Column) -> Column:
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("")


def snippet(c: Column, size: int = 200) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def short_snippet(c: Column, size: int = 150) -> Column:
    return strip(F.substring(c, 1, size))


def safe_file_name(title: Column) -> Column:
    kept = strip(F.regexp_replace(title, r"[^\p{L}\p{N} _-]", ""))
    return F.when(F.coalesce(kept, F.lit("")) == "", "Untitled").otherwise(kept)


def strip_fence(c: Column) -> Column:
    """Take the body out of a fenced code block; other text is unchanged."""
    body = F.regexp_replace(strip(c), r"^```[^\n]*\n", "")
    return F.when(strip(c).startswith("```"), strip(F.regexp_replace(body, r"\n?```$", ""))).otherwise(
        strip(c)
    )


def wiki_links(c: Column) -> Column:
    """Distinct link targets in order of first appearance, code spans ignored."""
    clean = F.regexp_replace(F.regexp_replace(c, r"```[\s\S]*?```", ""), r"`[^`]+`", "")
    found = F.regexp_extract_all(clean, F.lit(K.WIKI_LINK_PATTERN), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda t: t != ""))


def content_words(c: Column) -> Column:
    """Lower-case ASCII words longer than two letters that are not stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in K.STOPWORDS])
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def embedding_text(heading_path: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.nullif(F.array_join(heading_path, " > "), F.lit("")), text)


def hash16(c: Column) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, 16)


def text_checksum(c: Column) -> Column:
    return hash16(collapse(c))


def chunk_id(path: Column, heading_path: Column, index: Column, text: Column) -> Column:
    return hash16(
        F.concat(
            path,
            F.lit("|"),
            F.array_join(heading_path, "|"),
            F.lit("|"),
            index.cast("string"),
            F.lit("|"),
            collapse(text),
        )
    )


def exclude_regex(globs: list[str]) -> str:
    """Shell globs -> one alternation; ``*`` and ``?`` also match a slash."""
    out = []
    for glob in globs:
        piece = "".join(
            ".*" if ch == "*" else "." if ch == "?" else (ch if ch.isalnum() or ch in "_/ " else "\\" + ch)
            for ch in glob
        )
        out.append(piece)
    return "^(?:" + "|".join(out) + ")$"


def prompt_text(title: Column, path: Column, frontmatter: Column, content: Column) -> Column:
    """Text handed to a metadata extractor: header, flat front matter, bounded content."""
    cut = F.when(
        F.length(content) > K.EXTRACTION_MAX_CHARS,
        F.concat(F.substring(content, 1, K.EXTRACTION_MAX_CHARS), F.lit("\n\n[... truncated ...]")),
    ).otherwise(content)
    pairs = F.transform(
        F.map_entries(frontmatter), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"])
    )
    head = F.when(
        F.size(frontmatter) > 0,
        F.concat(F.lit("Frontmatter:\n"), F.array_join(pairs, "\n"), F.lit("\n\n")),
    ).otherwise("")
    return F.concat(
        F.lit("Title: "), title, F.lit("\nPath: "), path, F.lit("\n\n"), head, F.lit("Content:\n"), cut
    )


def token_count_label(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / F.lit(1_000_000.0)), F.lit("M")))
        .when(n >= 1_000, F.concat(F.format_string("%.1f", n / F.lit(1_000.0)), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def cost_label(c: Column) -> Column:
    return F.when(c < 0.01, "$0.00").otherwise(F.concat(F.lit("$"), F.format_string("%.2f", c)))
