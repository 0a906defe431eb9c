"""Where captured text goes: routes, file names, duplicate checks, living documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import constants as K
from marginalia.functions import text as X
from marginalia.operators.skew import numbered_in_group


def remap_sub_project(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Unknown sub-projects of a known category become 'General' where the category has it.

    Works on streams as well: the category table is static and small, and Spark broadcasts
    it only while it is.
    """
    dim = categories.select("category", F.col("sub_projects").alias("_subs"))
    unknown = (F.coalesce("sub_project", F.lit("")) != "") & ~F.array_contains("_subs", F.col("sub_project"))
    general = F.array_contains("_subs", F.lit("General"))
    return (
        rows.join(dim, "category", "left")
        .withColumn("sub_project", F.when(unknown & general, "General").otherwise(F.col("sub_project")))
        .drop("_subs")
    )


def route(segments: DataFrame, titles: DataFrame) -> DataFrame:
    """Add ``route`` (append, living_replace, living_append, event, daily or create), ``folder``
    and ``tasks_to_daily``.

    ``titles`` has (folder, title) of existing notes. A found existing note comes before the
    note type; the notes folder comes before the concepts folder.
    """
    notes, concepts = K.FOLDERS["notes"], K.FOLDERS["concepts"]
    known = (
        titles.where(F.col("folder").isin(notes, concepts))
        .groupBy(F.col("title").alias("existing_note"))
        .agg(F.min("folder").alias("_have"))
    )
    kind = F.col("note_type")
    living = F.create_map(*[F.lit(v) for name, (_, mode) in K.LIVING_DOCUMENTS.items() for v in (name, mode)])
    mode = F.when(kind == "living_document", F.element_at(living, F.col("living_doc_name")))
    where = (
        F.when(F.col("_have").isNotNull(), "append")
        .when(mode.isNotNull(), F.concat(F.lit("living_"), mode))
        .when(kind == "event", "event")
        .when(kind == "daily_note", "daily")
        .otherwise("create")
    )
    folder = (
        F.when(F.col("_have").isNotNull(), F.col("_have"))
        .when(kind.isin("event", "daily_note"), K.FOLDERS["daily"])
        .when(kind == "project", K.FOLDERS["projects"])
        .when(kind == "concept", concepts)
        .otherwise(notes)
    )
    to_daily = (F.col("n_tasks") > 0) & ~kind.isin("daily_note", "living_document", "event")
    # captures that name no note are most of all; a join would send them to one task
    columns = ["existing_note", *[c for c in segments.columns if c != "existing_note"]]
    named = segments.where(F.col("existing_note").isNotNull()).join(known, "existing_note", "left")
    unnamed = segments.where(F.col("existing_note").isNull()).withColumn("_have", F.lit(None).cast("string"))
    return (
        named.select(*columns, "_have").unionByName(unnamed.select(*columns, "_have"))
        .withColumn("route", where)
        .withColumn("folder", folder)
        .withColumn("tasks_to_daily", to_daily)
        .drop("_have")
    )


def write_routes(routed: DataFrame, path: str) -> None:
    """Write all routes in one job, one folder per route."""
    routed.write.mode("errorifexists").partitionBy("route").parquet(path)


def file_names(created: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """Give every created note a safe file title not used in its folder.

    Equal titles are numbered in order: the plain title if it is free, then ' 1', ' 2', …
    around the numbers in use, among them those that titles of this batch end in. One title may
    belong to a third of all rows, so rows are numbered piece by piece and never gathered.
    """
    named = created.withColumn("_safe", X.safe_file_name(F.col("title")))
    ranked = numbered_in_group(named, ["folder", "_safe"], [order], "_rn")
    # slots in use for a base title: 0 is the plain title, n is 'title n'
    taken = (
        existing.select(
            "folder",
            F.col("title").alias("_t"),
            F.explode(
                F.array(
                    F.struct(F.col("title").alias("_safe"), F.lit(0).cast("long").alias("slot")),
                    F.struct(
                        F.regexp_replace("title", r" [1-9]\d*$", "").alias("_safe"),
                        F.nullif(F.regexp_extract("title", r" ([1-9]\d*)$", 1), F.lit("")).cast("long").alias("slot"),
                    ),
                )
            ).alias("s"),
        )
        .select("folder", "s._safe", "s.slot")
        .where("slot IS NOT NULL")
    )
    ends = F.nullif(F.regexp_extract("_safe", r" ([1-9]\d*)$", 1), F.lit("")).cast("long")
    own = named.select("folder", F.regexp_replace("_safe", r" [1-9]\d*$", "").alias("_safe"), ends.alias("slot"))
    taken = taken.unionByName(own.where("slot IS NOT NULL")).distinct()
    # a used slot with f free slots before it sorts ahead of new row f + 1, so the place of a
    # row among rows and used slots is its slot
    used = numbered_in_group(taken, ["folder", "_safe"], ["slot"], "_i").select(
        "folder", "_safe", (F.col("slot") - F.col("_i") + 2).alias("_rn"), F.lit(0).alias("_new")
    )
    merged = ranked.withColumn("_new", F.lit(1)).unionByName(used, allowMissingColumns=True)
    placed = numbered_in_group(merged, ["folder", "_safe"], ["_rn", "_new"], "_n").where("_new = 1")
    slot = F.col("_n") - 1
    return placed.withColumn(
        "file_title", F.when(slot == 0, F.col("_safe")).otherwise(F.concat("_safe", F.lit(" "), slot.cast("string")))
    ).drop("_safe", "_rn", "_new", "_n")


def absent_items(items: DataFrame, notes: DataFrame, order: str) -> DataFrame:
    """Items (date, text) whose text does not occur in the note of that date.

    A date may have several notes: an item that one of them holds is not absent. Equal items of
    a batch are added once, in order.
    """
    firsts = items.groupBy("date", "text").agg(F.min(order).alias(order))
    have = notes.select("date", F.col("content").alias("_content"))
    held = F.bool_or(F.contains(F.col("_content"), F.col("text")))
    found = firsts.join(have, "date", "left").groupBy("date", "text", order).agg(F.coalesce(held, F.lit(False)).alias("_held"))
    return found.where(~F.col("_held")).drop("_held")


def event_title(bullet: Column) -> Column:
    """Title of an event bullet without its time and end date."""
    plain = F.regexp_replace(X.strip(bullet), r"^-\s*", "")
    untimed = F.regexp_replace(plain, r"^\d{1,2}:\d{2}\s*[—–-]\s*", "")
    return X.strip(F.regexp_replace(untimed, r"\s*\(through\s+\d{4}-\d{2}-\d{2}\)\s*$", ""))


def absent_events(events: DataFrame, existing: DataFrame) -> DataFrame:
    """Events (date, title) not yet in the calendar (date, title) of their day."""
    have = existing.select("date", X.strip(F.col("title")).alias("_t")).distinct()
    return (
        events.withColumn("_t", X.strip(F.col("title")))
        .join(have, ["date", "_t"], "left_anti")
        .drop("_t")
    )


def event_bullet(title: Column, time: Column, end_date: Column) -> Column:
    start = F.when(F.coalesce(time, F.lit("")) != "", F.concat(F.lit("- "), time, F.lit(" — "), title)).otherwise(
        F.concat(F.lit("- "), title)
    )
    return F.when(
        F.coalesce(end_date, F.lit("")) != "", F.concat(start, F.lit(" (through "), end_date, F.lit(")"))
    ).otherwise(start)


def living_history(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Replace semantics as history: every update is a version; the next one closes it.

    Adds ``version``, ``valid_to`` (the first order column of the next version) and
    ``current``. Versions meet their successor by number, so a document with very many
    updates is spread like any other rows.
    """
    versions = numbered_in_group(updates, [key], order, "version")
    follow = versions.select(key, (F.col("version") - 1).alias("version"), F.col(order[0]).alias("valid_to"))
    return versions.join(follow, [key, "version"], "left").withColumn("current", F.col("valid_to").isNull())


def appended_sections(updates: DataFrame, key: str, order: list[str], date: str, body: str) -> DataFrame:
    """Append semantics: ordered dated sections (key, section, heading, body)."""
    rows = numbered_in_group(updates, [key], order, "section")
    return rows.select(key, "section", F.concat(F.lit("### "), F.col(date)).alias("heading"), F.col(body).alias("body"))
