"""Events, calendar grids, daily context, weekly review and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import dates as D
from marginalia.operators import calendar, daily, reports, tasks, weekly
from marginalia.plans.fixtures import AGGREGATE, APPEARANCES, DAILY, cat, daily_md, order_tasks
from marginalia.plans.registry import Tables, query
from marginalia.plans.task_plans import AS_OF, DUE_LABEL, aggregated, iso, sql_iso
from marginalia.session import materialize

WEEK = "2001-07-02"


@query(
    "event_parse",
    f"WITH {DAILY} SELECT note_path, {sql_iso('date')}, line_number, time, {sql_iso('end_date')}, title FROM devent",
)
def event_parse(t: Tables) -> DataFrame:
    return daily.events(daily_md(t)).select("note_path", iso("date"), "line_number", "time", iso("end_date"), "title")


SHIPMENTS = """
ev AS (
  SELECT 'Ship ' || l_orderkey || '-' || l_linenumber AS title, o_orderdate::DATE AS date, '' AS time,
    CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate::DATE END AS end_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate)"""


def shipments(t: Tables) -> DataFrame:
    """Line items as events from order to shipping; odd lines are single-day."""
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    return (
        lines.join(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey")
        .where("l_shipdate >= o_orderdate")
        .select(
            cat("Ship ", F.col("o_orderkey"), "-", F.col("l_linenumber")).alias("title"),
            F.to_date("o_orderdate").alias("date"),
            F.lit("").alias("time"),
            F.when(F.col("l_linenumber") % 2 == 0, F.to_date("l_shipdate")).alias("end_date"),
        )
    )


@query(
    "event_overlap",
    f"""WITH {SHIPMENTS} SELECT title, {sql_iso('date')}, {sql_iso('end_date')} FROM ev
    WHERE coalesce(end_date, date) >= DATE '2001-07-01' AND date <= DATE '2001-07-10'""",
)
def event_overlap(t: Tables) -> DataFrame:
    return calendar.overlapping(shipments(t), "2001-07-01", "2001-07-10").select("title", iso("date"), iso("end_date"))


@query(
    "event_overlap_join",
    f"""WITH {SHIPMENTS}, rng AS (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS s FROM orders),
    r AS (SELECT s, (s + INTERVAL 9 DAY)::DATE AS e FROM rng)
    SELECT strftime(s, '%Y-%m-%d') AS range_start, count(*)::BIGINT AS n, min(title) AS first_title, max(title) AS last_title
    FROM r JOIN ev ON coalesce(end_date, date) >= s AND date <= e GROUP BY s""",
)
def event_overlap_join(t: Tables) -> DataFrame:
    """Every month's first ten days against all events."""
    start = F.to_date(F.date_trunc("month", "o_orderdate"))
    ranges = t.orders.select(start.alias("range_start")).distinct().withColumn("range_end", F.date_add("range_start", 9))
    return (
        calendar.overlap_join(shipments(t), ranges)
        .groupBy("range_start")
        .agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("first_title"), F.max("title").alias("last_title"))
        .select(iso("range_start"), "n", "first_title", "last_title")
    )


@query(
    "event_order",
    f"""WITH {DAILY} SELECT strftime(date, '%Y-%m-%d') AS date, time, title, row_number() OVER (
      PARTITION BY note_path ORDER BY time = '', time, title)::INTEGER AS shown FROM devent""",
)
def event_order(t: Tables) -> DataFrame:
    """Display order inside a day's note: timed events first, by their time text."""
    from pyspark.sql import Window

    w = Window.partitionBy("note_path").orderBy(F.col("time") == "", "time", "title")
    return daily.events(daily_md(t)).select(iso("date"), "time", "title", F.row_number().over(w).alias("shown"))


SPINE = f"spine AS (SELECT (DATE '{WEEK}' + i::INTEGER) AS day FROM range(7) r(i))"


@query(
    "calendar_grid",
    f"""WITH {APPEARANCES},{AGGREGATE},{SHIPMENTS},{SPINE}
    SELECT strftime(day, '%Y-%m-%d') AS day, (SELECT count(*) FROM task WHERE due_date = day)::BIGINT AS n_tasks,
      (SELECT count(*) FROM ev WHERE end_date IS NULL AND date = day)::BIGINT AS n_events FROM spine""",
)
def calendar_grid(t: Tables) -> DataFrame:
    grid = calendar.week_grid(aggregated(t), shipments(t), WEEK, 7)
    return grid.select(iso("day"), "n_tasks", "n_events")


@query(
    "day_counts",
    f"""WITH {APPEARANCES},{AGGREGATE},{SHIPMENTS},{SPINE},
    x AS (SELECT day, (SELECT count(*) FROM ev WHERE day >= date AND day <= coalesce(end_date, date))::BIGINT AS n_events,
      (SELECT count(*) FROM task WHERE due_date = day)::BIGINT AS n_tasks FROM spine)
    SELECT strftime(day, '%Y-%m-%d') AS day, n_events, n_tasks, n_tasks > 0 AND day < DATE '2001-07-04' AS has_overdue,
      n_tasks > 0 AND day = DATE '2001-07-04' AS has_due_soon FROM x""",
)
def day_counts(t: Tables) -> DataFrame:
    out = calendar.day_counts(aggregated(t), shipments(t), WEEK, 7, "2001-07-04")
    return out.select(iso("day"), "n_events", "n_tasks", "has_overdue", "has_due_soon")


@query(
    "agenda_lanes",
    f"""WITH {APPEARANCES},{AGGREGATE},{SHIPMENTS}
    SELECT 'task' AS kind, CASE WHEN due_date IS NULL THEN 'no_due' WHEN due_date < DATE '{AS_OF}' THEN 'overdue'
      ELSE 'scheduled' END AS lane, count(*)::BIGINT AS n FROM task GROUP BY ALL
    UNION ALL SELECT 'event', CASE WHEN end_date IS NULL THEN 'single_day' ELSE 'multi_day' END, count(*)::BIGINT FROM ev GROUP BY ALL""",
)
def agenda_lanes(t: Tables) -> DataFrame:
    per_task = aggregated(t).select(F.lit("task").alias("kind"), calendar.task_lane(AS_OF).alias("lane"))
    per_event = shipments(t).select(F.lit("event").alias("kind"), calendar.event_lane().alias("lane"))
    return per_task.union(per_event).groupBy("kind", "lane").agg(F.count(F.lit(1)).alias("n"))


# --- daily context and weekly review ----------------------------------------------------


@query("daily_context", f"WITH {DAILY} SELECT note_path, {sql_iso('date')}, section, line_number, item FROM dctx")
def daily_context(t: Tables) -> DataFrame:
    return daily.context(daily_md(t)).select("note_path", iso("date"), "section", "line_number", "item")


@query(
    "context_lookback",
    f"""WITH {DAILY} SELECT note_path, {sql_iso('date')}, section, item FROM dctx
    WHERE dctx.date = (SELECT max(date) FROM dctx WHERE date BETWEEN DATE '2001-08-04' - 4 AND DATE '2001-08-04' - 1)""",
)
def context_lookback(t: Tables) -> DataFrame:
    found = daily.latest_context(daily.context(daily_md(t)), "2001-08-04")
    return found.select("note_path", iso("date"), "section", "item")


@query(
    "focus_days",
    f"""WITH {DAILY} SELECT strftime(date, '%G-W%V') AS week_key, item,
      string_agg(strftime(date, '%a'), ', ' ORDER BY date) AS days FROM dctx WHERE section = 'focus' GROUP BY ALL""",
)
def focus_days(t: Tables) -> DataFrame:
    return weekly.focus_days(daily.context(daily_md(t)))


TOPIC_SQL = """
wd AS (
  SELECT DISTINCT strftime(date, '%G-W%V') AS week_key, date, unnest(regexp_extract_all(lower(item), '[a-zA-Z]+')) AS word FROM dctx),
topic AS (
  SELECT week_key, word, count(DISTINCT date)::BIGINT AS n_days FROM wd
  WHERE length(word) > 2 AND word NOT IN ('the', 'about') GROUP BY ALL HAVING count(DISTINCT date) >= 3),
topics AS (
  SELECT *, row_number() OVER (PARTITION BY week_key ORDER BY n_days DESC, word)::INTEGER AS rk FROM topic QUALIFY rk <= 10)"""


@query("recurring_topics", f"WITH {DAILY},{TOPIC_SQL} SELECT * FROM topics")
def recurring_topics(t: Tables) -> DataFrame:
    return weekly.recurring_topics(daily.context(daily_md(t)))


@query(
    "weekly_tasks",
    f"""WITH {APPEARANCES} SELECT strftime(source_date, '%G-W%V') AS week_key, category, sub_project, normalized,
      arg_max(status, (source_date, line_number)) AS status FROM app GROUP BY ALL""",
)
def weekly_tasks(t: Tables) -> DataFrame:
    return weekly.week_tasks(order_tasks(t)).select("week_key", *tasks.KEY, "status")


@query(
    "weekly_review",
    f"""WITH {DAILY},{TOPIC_SQL},
    wt AS (
      SELECT strftime(source_date, '%G-W%V') AS wk, category, sub_project, normalized,
        CASE WHEN category = '' THEN 'Uncategorized' ELSE category END AS cat,
        arg_min(text, (source_date, note_path, line_number)) AS text, arg_max(status, (source_date, note_path, line_number)) AS status,
        arg_max(due_date, (source_date, note_path, line_number)) FILTER (due_date IS NOT NULL) AS due, min(source_date) AS fd
      FROM dtask GROUP BY ALL),
    wk AS (SELECT DISTINCT date_trunc('week', d)::DATE AS s, strftime(d, '%G-W%V') AS wk FROM ord),
    lines AS (
      SELECT wk, 0 AS part, lpad(i::VARCHAR, 2, '0') AS k1, '' AS k2, ['---', 'type: weekly', 'week: ' || wk,
        'start_date: ' || strftime(s, '%Y-%m-%d'), 'end_date: ' || strftime(s + 6, '%Y-%m-%d'), 'generated: {AS_OF}', '---', '',
        '# Week ' || ltrim(strftime(s, '%V'), '0') || ' — ' || strftime(s, '%b %-d') || '–' || strftime(s + 6, '%b %-d, %Y'), ''][i + 1] AS line
      FROM wk, range(10) r(i)
      UNION ALL SELECT wk, (i * 10 + 10)::INTEGER, '', '', ['## Focus Areas', '## Completed', '## Still Open',
        '## Notes & Observations', '## Recurring Topics'][i + 1] FROM wk, range(5) r(i)
      UNION ALL SELECT wk, (i * 10 + 12)::INTEGER, '', '', '' FROM wk, range(5) r(i)
      UNION ALL SELECT strftime(date, '%G-W%V'), 11, item, '', '- ' || item || ' (' || string_agg(strftime(date, '%a'), ', ' ORDER BY date) || ')'
        FROM dctx WHERE section = 'focus' GROUP BY 1, item
      UNION ALL SELECT DISTINCT wk, CASE WHEN status = 'done' THEN 21 ELSE 31 END, cat, '', '### ' || cat FROM wt
      UNION ALL SELECT wk, CASE WHEN status = 'done' THEN 21 ELSE 31 END, cat, strftime(fd, '%Y-%m-%d') || ' ' || normalized,
        CASE WHEN status = 'done' THEN '- ' || text ELSE '- [ ] ' || text || coalesce(' (due: ' || strftime(due, '%Y-%m-%d') || ')', '') END FROM wt
      UNION ALL SELECT strftime(date, '%G-W%V'), 41, strftime(date, '%Y-%m-%d') || ' ' || note_path || ' ' || lpad(line_number::VARCHAR, 9, '0'),
        '', '- ' || item FROM dctx WHERE section = 'notes'
      UNION ALL SELECT wk.wk, 51, '', '', coalesce((SELECT string_agg(word, ', ' ORDER BY rk) FROM topics t WHERE t.week_key = wk.wk),
        '*No recurring topics detected*') FROM wk)
    SELECT wk AS week_key, part, k1, k2, line FROM lines""",
)
def weekly_review(t: Tables) -> DataFrame:
    """All weekly notes as ordered lines, one job for all weeks. The parsed rows are written
    once: every part of the review reads them."""
    notes = daily_md(t)
    items = materialize(daily.context(notes), "context")
    return weekly.review_lines(items, materialize(daily.tasks(notes), "tasks"), AS_OF)


# --- projects -------------------------------------------------------------------------

PROJECTS = """
proj AS (SELECT DISTINCT p_name AS project, replace(p_name, ' ', '') AS pk FROM part),
sub AS (
  SELECT DISTINCT string_split(p_name, ' ')[2] AS sub_project, string_split(p_name, ' ')[2] AS sk FROM part
  UNION SELECT DISTINCT 'The ' || p_name || ' - Plan.md', 'the' || replace(p_name, ' ', '') || 'plan' FROM part WHERE p_size = 1),
pm AS (SELECT project, sub_project FROM proj JOIN sub ON contains(pk, sk) OR contains(sk, pk))"""


def projects(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_name").alias("project")).distinct()


def sub_projects(t: Tables) -> DataFrame:
    noun = t.part.select(F.get(F.split("p_name", " "), F.lit(1)).alias("sub_project"))
    plan = t.part.where("p_size = 1").select(cat("The ", F.col("p_name"), " - Plan.md").alias("sub_project"))
    return noun.union(plan).distinct()


@query("project_match", f"WITH {PROJECTS} SELECT project, sub_project FROM pm")
def project_match(t: Tables) -> DataFrame:
    return reports.match_projects(projects(t), sub_projects(t))


VISITS = """
visit AS (
  SELECT c_custkey, DATE '2001-06-01' + (c_custkey % 62)::INTEGER AS date, 'visits/' || c_custkey || '.md' AS note_path,
    (c_custkey % 9)::INTEGER AS line_number,
    CASE WHEN c_custkey % 4 = 0 THEN 'Saw nothing of note'
         WHEN c_custkey % 4 = 1 THEN 'Visit to a ' || c_mktsegment || '-dealer, customer ' || c_custkey
         ELSE 'Asked about pre' || lower(c_mktsegment) || 's and ' || c_mktsegment || '.' END AS item FROM customer),
seg AS (SELECT DISTINCT c_mktsegment AS project, lower(c_mktsegment) AS pk FROM customer),
found AS (
  SELECT project, date, note_path, line_number, '- ' || item AS line FROM visit JOIN seg ON contains(lower('- ' || item), pk)
  WHERE date >= DATE '2001-08-01' - 30)"""


def visits(t: Tables) -> DataFrame:
    c, s = F.col("c_custkey"), F.col("c_mktsegment")
    item = (
        F.when(c % 4 == 0, "Saw nothing of note")
        .when(c % 4 == 1, cat("Visit to a ", s, "-dealer, customer ", c))
        .otherwise(cat("Asked about pre", F.lower(s), "s and ", s, "."))
    )
    return t.customer.select(
        F.lit("notes").alias("section"),
        F.date_add(D.as_day("2001-06-01"), (c % 62).cast("int")).alias("date"),
        cat("visits/", c, ".md").alias("note_path"),
        (c % 9).cast("int").alias("line_number"),
        item.alias("item"),
    )


def segments(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_mktsegment").alias("project")).distinct()


@query(
    "project_mentions",
    f"WITH {VISITS} SELECT project, {sql_iso('date')}, note_path, line_number, line FROM found",
)
def project_mentions(t: Tables) -> DataFrame:
    found = reports.mentions(segments(t), visits(t), AS_OF)
    return found.select("project", iso("date"), "note_path", "line_number", "line")


@query(
    "render_project_sections",
    f"""WITH {APPEARANCES},{AGGREGATE},{VISITS},
    st AS (SELECT seg.project, task.*, due_date - DATE '{AS_OF}' AS n FROM task JOIN seg ON seg.project = task.sub_project WHERE NOT completed),
    act AS (SELECT project FROM st UNION SELECT project FROM found),
    fixed(part, line) AS (VALUES (0, '## Open Tasks'), (1, '<!-- AUTO-GENERATED: Do not edit below this line -->'), (5, ''),
      (6, '<!-- END AUTO-GENERATED -->'), (10, '## Recent Notes'), (11, '<!-- AUTO-GENERATED: Do not edit below this line -->'),
      (13, ''), (14, '<!-- END AUTO-GENERATED -->'), (2, '| Status | Task | Added | Due | Timeline |'), (3, '|:---:|------|:---:|:---:|:---:|'))
    SELECT project, part::INTEGER AS part, '' AS k1, '' AS k2, line FROM act, fixed
    UNION ALL SELECT project, 4, coalesce(strftime(due_date, '%Y-%m-%d'), '9999-99-99'),
      strftime(first_date, '%Y-%m-%d') || ' ' || category || ' ' || sub_project || ' ' || normalized,
      '| Open | ' || text || ' | [[' || strftime(first_date, '%Y-%m-%d') || ']] | ' || coalesce(strftime(due_date, '%Y-%m-%d'), '') ||
      ' | ' || {DUE_LABEL} || ' |' FROM st
    UNION ALL SELECT DISTINCT project, 12, lpad((DATE '9999-12-31' - date)::VARCHAR, 9, '0'), '', '**[[' || strftime(date, '%Y-%m-%d') || ']]**' FROM found
    UNION ALL SELECT project, 12, lpad((DATE '9999-12-31' - date)::VARCHAR, 9, '0'), note_path || ' ' || lpad(line_number::VARCHAR, 9, '0'), line FROM found""",
)
def render_project_sections(t: Tables) -> DataFrame:
    tasks_now = materialize(aggregated(t), "tasks")
    matches = reports.match_projects(segments(t), tasks_now.select("sub_project").distinct())
    found = reports.mentions(segments(t), visits(t), AS_OF)
    return reports.project_sections(matches, tasks_now, found, AS_OF)
