"""Task reports and project sections as ordered lines.

A report is a frame of lines with sort keys, never one large text: it is written by
sorting on the keys, so a category holding most of all tasks is still spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import constants as K
from marginalia.functions import dates as D
from marginalia.functions import text as X
from marginalia.operators.namefinder import names_in
from marginalia.operators import tasks as T
from marginalia.session import materialize

# fixed values: table head of a task report
TABLE_HEAD = ["| Status | Task | Added | Due | Timeline |", "|:---:|------|:---:|:---:|:---:|"]
ORDER = ["k1", "k2", "kind", "k3", "k4", "line"]


def _line(df: DataFrame, kind: int, k1, k2, k3, k4, line) -> DataFrame:
    return df.select(
        k1.alias("k1"), k2.alias("k2"), F.lit(kind).alias("kind"), k3.alias("k3"), k4.alias("k4"), line.alias("line")
    )


def _task_row(as_of: str, status: Column) -> Column:
    due = F.coalesce(D.iso(F.col("due_date")), F.lit(""))
    label = D.due_label(F.col("due_date"), as_of, F.col("completed"))
    return F.concat(
        F.lit("| "), status, F.lit(" | "), "text", F.lit(" | [["), D.iso(F.col("first_date")), F.lit("]] | "),
        due, F.lit(" | "), label, F.lit(" |"),
    )


def open_report(tasks: DataFrame, as_of: str) -> DataFrame:
    """Open tasks by category and sub-project, due dates first. Head lines have k1 = ''."""
    empty = F.lit("")
    still = tasks.where("status != 'done'").withColumn(
        "_cat", F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorized"))
    )
    # headings come from the few (category, sub-project) pairs, each once
    subs = still.groupBy("_cat", "sub_project").agg(F.lit(0).alias("_"))
    cats = subs.groupBy("_cat").agg(F.lit(0).alias("_"))
    heads = F.array(
        F.struct(F.lit(1).alias("kind"), F.when(F.col("sub_project") != "", F.concat(F.lit("### "), "sub_project")).alias("line")),
        F.struct(F.lit(2).alias("kind"), F.lit(TABLE_HEAD[0]).alias("line")),
        F.struct(F.lit(3).alias("kind"), F.lit(TABLE_HEAD[1]).alias("line")),
    )
    sub_lines = subs.select("_cat", "sub_project", F.inline(heads)).where("line IS NOT NULL")
    status = F.when(F.col("status") == "in_progress", "In Progress").otherwise("Open")
    due = F.coalesce(D.iso(F.col("due_date")), F.lit("9999-99-99"))
    cat, sub = F.col("_cat"), F.col("sub_project")
    return (
        _line(cats, 0, cat, empty, empty, empty, F.concat(F.lit("## "), cat))
        .unionByName(
            sub_lines.select(cat.alias("k1"), sub.alias("k2"), "kind", empty.alias("k3"), empty.alias("k4"), "line")
        )
        .unionByName(_line(still, 4, cat, sub, due, D.iso(F.col("first_date")), _task_row(as_of, status)))
    )


def completed_report(tasks: DataFrame) -> DataFrame:
    """Done tasks by completion day, newest first: k1 sorts as days before a far date."""
    empty = F.lit("")
    done = tasks.where("status = 'done'").withColumn(
        "_k", F.lpad(F.datediff(F.to_date(F.lit("9999-12-31")), "latest_date").cast("string"), 9, "0")
    )
    days = done.select("_k", "latest_date").distinct()
    place = F.concat(
        F.lit(" *("), "category",
        F.when(F.col("sub_project") != "", F.concat(F.lit(" > "), "sub_project")).otherwise(""), F.lit(")*"),
    )
    row = F.concat(F.lit("- [x] "), "text", F.lit(" [["), D.iso(F.col("first_date")), F.lit("]]"), place)
    return _line(days, 0, F.col("_k"), empty, empty, empty, F.concat(F.lit("## "), D.iso(F.col("latest_date")))).unionByName(
        _line(done, 1, F.col("_k"), empty, D.iso(F.col("first_date")), F.col("normalized"), row)
    )


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Write a report's lines in order as text files that concatenate in name order."""
    lines.orderBy(*(order or ORDER)).select("line").write.mode("errorifexists").text(path)


def digest(df: DataFrame) -> tuple[int, int]:
    """(rows, order-free hash sum) of a frame, to tell whether it changed."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)"))).first()
    return int(n), int(total)


def write_if_changed(lines: DataFrame, path: str, previous: DataFrame | None) -> bool:
    if previous is not None and digest(lines) == digest(previous):
        return False
    write_lines(lines, path)
    return True


# --- reading reports back ---------------------------------------------------------------


def read_statuses(lines: DataFrame) -> DataFrame:
    """(normalized, status) from report lines (``line_no``, ``line``); the last line wins."""
    s = X.strip(F.col("line"))
    cells = F.transform(F.split("_s", r"\|"), X.strip)
    base = lines.select("line_no", s.alias("_s")).withColumn("_cells", cells)
    is_row = F.col("_s").startswith("|") & F.col("_s").endswith("|") & (F.length("_s") > 1)
    status_cell, task_cell = F.get("_cells", F.lit(1)), F.get("_cells", F.lit(2))
    in_table = (
        is_row & (F.size("_cells") >= 4) & ~task_cell.startswith("--") & (task_cell != "Task") & (status_cell != "Status")
    )
    in_list = ~is_row & F.col("_s").rlike(K.CHECKBOX_PATTERN)
    table_status = (
        F.when(F.lower(status_cell) == "in progress", "in_progress").when(F.lower(status_cell) == "done", "done").otherwise("open")
    )
    table_text = X.strip(F.regexp_replace(task_cell, r"\[\[\d{4}-\d{2}-\d{2}\]\]", ""))
    list_text = X.strip(
        F.regexp_replace(F.regexp_extract("_s", K.CHECKBOX_PATTERN, 2), r"\s*\[\[\d{4}-\d{2}-\d{2}\]\].*$", "")
    )
    found = base.where(in_table | in_list).select(
        "line_no",
        X.task_key(F.when(is_row, table_text).otherwise(list_text)).alias("normalized"),
        F.when(is_row, table_status)
        .otherwise(X.checkbox_status(F.regexp_extract("_s", K.CHECKBOX_PATTERN, 1)))
        .alias("status"),
    )
    return found.where("normalized != ''").groupBy("normalized").agg(F.max_by("status", "line_no").alias("status"))


def read_due_dates(lines: DataFrame) -> DataFrame:
    """(normalized, due_date) from table lines with at least six cells; the last line wins."""
    s = X.strip(F.col("line"))
    base = lines.select("line_no", s.alias("_s")).where(
        F.col("_s").startswith("|") & F.col("_s").endswith("|") & (F.length("_s") > 1)
    )
    base = base.withColumn("_cells", F.transform(F.split("_s", r"\|"), X.strip))
    status_cell, task_cell = F.get("_cells", F.lit(1)), F.get("_cells", F.lit(2))
    rows = base.where(
        (F.size("_cells") >= 6) & ~task_cell.startswith("--") & (task_cell != "Task") & (status_cell != "Status")
    )
    text = X.strip(F.regexp_replace(task_cell, r"\[\[\d{4}-\d{2}-\d{2}\]\]", ""))
    return (
        rows.select("line_no", X.task_key(text).alias("normalized"), F.get("_cells", F.lit(4)).alias("due"))
        .where("normalized != ''")
        .groupBy("normalized")
        .agg(F.max_by("due", "line_no").alias("due_date"))
    )


# --- projects ---------------------------------------------------------------------------


def match_projects(projects: DataFrame, subs: DataFrame) -> DataFrame:
    """(project, sub_project) where either normalised name contains the other."""
    left = projects.select("project", X.project_key(F.col("project")).alias("_p"))
    right = subs.where("sub_project != ''").select("sub_project", X.project_key(F.col("sub_project")).alias("_s"))
    pairs = names_in(right, left, "_s", "_p").select("_p", "_s").union(names_in(left, right, "_p", "_s").select("_p", "_s")).distinct()
    return left.join(pairs, "_p").join(right, "_s").select("project", "sub_project")


def mentions(projects: DataFrame, notes: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """(project, date, note_path, line_number, line) for recent notes bullets naming a project.

    A normalised name holds no space and no punctuation, so it can only occur inside one
    word of a line. Distinct words are searched for names once; lines then meet the
    matches by equality.
    """
    recent = notes.where((F.col("section") == "notes") & (F.col("date") >= F.date_sub(D.as_day(as_of), days)))
    line = F.concat(F.lit("- "), "item")
    words = recent.select(
        "date", "note_path", "line_number", line.alias("line"),
        F.explode(F.array_distinct(F.split(F.lower("item"), r"[\s\p{Punct}]+"))).alias("_w"),
    ).where("_w != ''")
    names = projects.select("project", X.project_key(F.col("project")).alias("_p"))
    hits = names_in(words, names, "_w", "_p")
    return (
        words.join(hits, "_w")
        .join(names, "_p")
        .select("project", "date", "note_path", "line_number", "line")
        .distinct()
    )


def project_sections(matches: DataFrame, tasks: DataFrame, found: DataFrame, as_of: str) -> DataFrame:
    """Generated lines of every project with matching open tasks or recent mentions:
    (project, part, k1, k2, line). Matched tasks and mentions are written once, since every
    part of a section reads them."""
    empty = F.lit("")
    still = materialize(tasks.where(~F.col("completed")).join(matches, "sub_project"), "project-tasks")
    found = materialize(found, "project-mentions")
    due = F.coalesce(D.iso(F.col("due_date")), F.lit("9999-99-99"))
    active = still.select("project").union(found.select("project")).distinct()

    def rows(df, part, k1, k2, line):
        return df.select("project", F.lit(part).alias("part"), k1.alias("k1"), k2.alias("k2"), line.alias("line"))

    def fixed(df, part, text):
        return rows(df, part, empty, empty, F.lit(text))

    out = fixed(active, 0, "## Open Tasks").unionByName(fixed(active, 1, K.AUTO_START))
    have = still.select("project").distinct()
    out = out.unionByName(fixed(have, 2, TABLE_HEAD[0])).unionByName(fixed(have, 3, TABLE_HEAD[1]))
    out = out.unionByName(
        rows(still, 4, due, F.concat_ws(" ", D.iso(F.col("first_date")), *T.KEY), _task_row(as_of, F.lit("Open")))
    )
    out = out.unionByName(fixed(active.join(have, "project", "left_anti"), 4, "*No matching open tasks.*"))
    out = out.unionByName(fixed(active, 5, "")).unionByName(fixed(active, 6, K.AUTO_END))
    out = out.unionByName(fixed(active, 10, "## Recent Notes")).unionByName(fixed(active, 11, K.AUTO_START))
    named = found.select("project").distinct()
    # newest day first: the key counts days back from a far date
    back = F.lpad(F.datediff(F.to_date(F.lit("9999-12-31")), "date").cast("string"), 9, "0")
    days = found.select("project", "date").distinct()
    out = out.unionByName(rows(days, 12, back, empty, F.concat(F.lit("**[["), D.iso(F.col("date")), F.lit("]]**"))))
    place = F.concat_ws(" ", F.col("note_path"), F.lpad(F.col("line_number").cast("string"), 9, "0"))
    out = out.unionByName(rows(found, 12, back, place, F.col("line")))
    out = out.unionByName(
        fixed(active.join(named, "project", "left_anti"), 12, "*No recent notes mentioning this project.*")
    )
    return out.unionByName(fixed(active, 13, "")).unionByName(fixed(active, 14, K.AUTO_END))


def replace_section(content: Column, heading: str, section_text: Column) -> Column:
    """Put new text into a note: over the marked section of that heading, else at the end."""
    span = rf"(?ms)^\Q{heading}\E\s*\n\Q{K.AUTO_START}\E\n.*?\Q{K.AUTO_END}\E"
    block = F.concat(F.lit(f"{heading}\n{K.AUTO_START}\n"), section_text, F.lit(f"\n{K.AUTO_END}"))
    # split once rather than replace: the new text may hold characters special to a replacement
    parts = F.split(content, span, 2)
    ended = F.when(content.endswith("\n"), content).otherwise(F.concat(content, F.lit("\n")))
    return F.when(
        F.size(parts) == 2, F.concat(F.get(parts, F.lit(0)), block, F.get(parts, F.lit(1)))
    ).otherwise(F.concat(ended, F.lit("\n"), block, F.lit("\n")))
