"""Task appearances -> tasks, filters, buckets, counts and keyed updates.

An appearance has text, status, source_date, category, sub_project, line_number,
due_date, normalized and note_path. Groups only ever go through aggregates that combine
map-side, so a task that appears in a third of all notes is one small partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import dates as D

KEY = ["category", "sub_project", "normalized"]


def position() -> Column:
    """Order of appearances: file name, then line."""
    return F.struct("source_date", "note_path", "line_number")


def aggregate(appearances: DataFrame, as_of: str) -> DataFrame:
    """One row per (category, sub_project, normalized)."""
    at = position()
    grouped = appearances.groupBy(*KEY).agg(
        F.min_by("text", at).alias("text"),
        F.max_by("status", at).alias("status"),
        F.max_by("due_date", F.when(F.col("due_date").isNotNull(), at)).alias("due_date"),
        F.min("source_date").alias("first_date"),
        F.max("source_date").alias("latest_date"),
        F.count(F.lit(1)).alias("appearance_count"),
    )
    done = F.col("status") == "done"
    return grouped.withColumn("completed", done).withColumn(
        "days_open", F.when(done, 0).otherwise(F.datediff(D.as_day(as_of), F.col("first_date")))
    )


def with_due_label(tasks: DataFrame, as_of: str) -> DataFrame:
    due, done = F.col("due_date"), F.col("completed")
    return tasks.withColumn("label", D.due_label(due, as_of, done)).withColumn(
        "band", D.due_band(due, as_of, done)
    )


def select_tasks(
    tasks: DataFrame,
    category: str | None = None,
    completed: bool | None = None,
    status: str | None = None,
    sub_project: str | None = None,
) -> DataFrame:
    wanted = {"category": category, "completed": completed, "status": status, "sub_project": sub_project}
    for name, value in wanted.items():
        if value is not None:
            tasks = tasks.where(F.col(name) == value)
    return tasks


def upcoming(tasks: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Open tasks that are overdue or due within the given days."""
    return tasks.where(~F.col("completed") & (F.col("due_date") <= F.date_add(D.as_day(as_of), days)))


def search(tasks: DataFrame, text: str) -> DataFrame:
    needle = F.lit(text.lower())
    found = F.lit(False)
    for name in ("text", "category", "sub_project"):
        found = found | F.contains(F.lower(name), needle)
    return tasks.where(found)


def card_predicates(as_of: str) -> dict[str, Column]:
    """The five stat cards as conditions."""
    is_open = ~F.col("completed")
    due = F.col("due_date")
    return {
        "active": is_open,
        "overdue": is_open & F.coalesce(due < D.as_day(as_of), F.lit(False)),
        "due_today": is_open & F.coalesce(due == D.as_day(as_of), F.lit(False)),
        "in_progress": F.col("status") == "in_progress",
        "completed": F.col("completed"),
    }


def stat_cards(tasks: DataFrame, as_of: str) -> DataFrame:
    return tasks.agg(*[F.count_if(cond).alias(name) for name, cond in card_predicates(as_of).items()])


def category_counts(tasks: DataFrame) -> DataFrame:
    """Open tasks per category and sub-project, plus one total row per category."""
    named = tasks.where(~F.col("completed")).select(
        F.coalesce(F.nullif("category", F.lit("")), F.lit("Uncategorized")).alias("category"), "sub_project"
    )
    return (
        named.rollup("category", "sub_project")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("sub_project").alias("_total"))
        .where("category IS NOT NULL")
        .select(
            "category",
            F.coalesce("sub_project", F.lit("")).alias("sub_project"),
            (F.col("_total") == 1).alias("is_total"),
            "n",
        )
        .orderBy("category", F.desc("is_total"), "sub_project")
    )


def subproject_urgency(tasks: DataFrame) -> DataFrame:
    """Sub-projects with their earliest due date, the most urgent first, then the larger."""
    return (
        tasks.groupBy("category", "sub_project")
        .agg(F.min("due_date").alias("earliest_due"), F.count(F.lit(1)).alias("n"))
        .orderBy("category", F.asc_nulls_last("earliest_due"), F.desc("n"), "sub_project")
    )


def briefing(tasks: DataFrame, as_of: str, aging_days: int = 3) -> DataFrame:
    """Open tasks in exclusive buckets: overdue by due date, due today, aging by age."""
    due, today = F.col("due_date"), D.as_day(as_of)
    old = due.isNull() & (F.col("days_open") > aging_days) & (F.col("status") == "open")
    bucket = F.when(due < today, "overdue").when(due == today, "due_today").when(old, "aging")
    return (
        tasks.where(~F.col("completed"))
        .withColumn("bucket", bucket)
        .where("bucket IS NOT NULL")
        .orderBy("bucket", F.asc_nulls_last("due_date"), F.desc("days_open"), *KEY)
    )


def by_due(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.asc_nulls_last("due_date"), "first_date", *KEY)


# --- keyed updates ----------------------------------------------------------------------


def overlay(base: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Rows of both, where the top frame wins on equal keys."""
    return top.unionByName(base.join(top.select(key), key, "left_anti"))


def sync_state(appearances: DataFrame, desired: DataFrame) -> DataFrame:
    """Push desired status and due date (by normalized text only) to all appearances.

    ``desired`` has one row per normalized text. A missing desired due date never clears one.
    Adds ``status_changed`` and ``due_changed``.
    """
    want = desired.select("normalized", F.col("status").alias("_ws"), F.col("due_date").alias("_wd"))
    joined = appearances.join(want, "normalized", "left")
    new_status = F.coalesce("_ws", "status")
    new_due = F.coalesce("_wd", "due_date")
    return (
        joined.withColumn("status_changed", ~new_status.eqNullSafe(F.col("status")))
        .withColumn("due_changed", ~new_due.eqNullSafe(F.col("due_date")))
        .withColumn("status", new_status)
        .withColumn("due_date", new_due)
        .drop("_ws", "_wd")
    )


def sync_summary(synced: DataFrame, as_of: str) -> DataFrame:
    """Open and done tasks after a sync, and how many notes it changed."""
    changed = F.col("status_changed") | F.col("due_changed")
    notes = synced.where(changed).agg(F.count_distinct("note_path").alias("notes_updated"))
    return aggregate(synced, as_of).agg(
        F.count_if(~F.col("completed")).alias("open_tasks"),
        F.count_if("completed").alias("done_tasks"),
        F.coalesce(F.max(notes.select("notes_updated").scalar()), F.lit(0)).alias("notes_updated"),
    )


def update_latest(appearances: DataFrame, updates: DataFrame) -> DataFrame:
    """Change status or due date of the latest appearance of each updated task.

    ``updates`` has the task key, ``new_status`` and ``new_due`` (NULL leaves as is, '' clears
    the due date).
    """
    latest = (
        appearances.join(updates.select(*KEY), KEY, "left_semi")
        .groupBy(*KEY)
        .agg(F.max(position()).alias("_last"))
    )
    plan = updates.join(latest, KEY).select(*KEY, "new_status", "new_due", "_last")
    hit = F.coalesce(position() == F.col("_last"), F.lit(False))
    return (
        appearances.join(plan, KEY, "left")
        .withColumn("status", F.when(hit, F.coalesce("new_status", "status")).otherwise(F.col("status")))
        .withColumn(
            "due_date",
            F.when(hit & (F.col("new_due") == ""), F.lit(None).cast("date"))
            .when(hit & F.col("new_due").isNotNull(), F.try_to_date("new_due", "yyyy-MM-dd"))
            .otherwise(F.col("due_date")),
        )
        .drop("new_status", "new_due", "_last")
    )


def reassign(appearances: DataFrame, moves: DataFrame) -> DataFrame:
    """Move every appearance of a task to a new category and sub-project."""
    plan = moves.select(*KEY, F.col("new_category").alias("_nc"), F.coalesce("new_sub_project", F.lit("")).alias("_ns"))
    return (
        appearances.join(plan, KEY, "left")
        .withColumn("sub_project", F.when(F.col("_nc").isNotNull(), F.col("_ns")).otherwise(F.col("sub_project")))
        .withColumn("category", F.coalesce("_nc", "category"))
        .drop("_nc", "_ns")
    )


def moves_by_substring(tasks: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (substring, new category, new sub-project) -> moves for the first matching task.

    The first task is the one that appeared first. Rules are a short list written by the
    user, so each task row checks them in place.
    """
    options = F.array(
        *[
            F.struct(
                F.lit(i).alias("rule"),
                F.lit(sub.lower()).alias("needle"),
                F.lit(cat).alias("new_category"),
                F.lit(subp).alias("new_sub_project"),
            )
            for i, (sub, cat, subp) in enumerate(rules)
        ]
    )
    hits = F.filter(options, lambda o: F.contains(F.lower("text"), o["needle"]))
    order = F.struct("first_date", *KEY)
    first = (
        tasks.select("first_date", *KEY, F.explode(hits).alias("o"))
        .select("first_date", *KEY, "o.rule", "o.new_category", "o.new_sub_project")
        .groupBy("rule", "new_category", "new_sub_project")
        .agg(F.min(order).alias("_f"))
    )
    same = (F.col("_f.category") == F.col("new_category")) & (F.col("_f.sub_project") == F.col("new_sub_project"))
    return first.where(~same).select(
        "rule", *[F.col(f"_f.{k}").alias(k) for k in KEY], "new_category", "new_sub_project"
    )
