"""Tasks: parsing dated notes, aggregation, filters, buckets, reports and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import dates as D
from marginalia.functions import text as X
from marginalia.operators import daily, reports, tasks
from marginalia.plans.fixtures import AGGREGATE, APPEARANCES, DAILY, cat, daily_md, order_tasks
from marginalia.plans.registry import Tables, query
from marginalia.session import materialize

AS_OF = "2001-08-01"
TASKS = f"WITH {APPEARANCES},{AGGREGATE}"


def iso(name: str):
    return F.coalesce(D.iso(F.col(name)), F.lit("")).alias(name)


def sql_iso(name: str) -> str:
    return f"coalesce(strftime({name}, '%Y-%m-%d'), '') AS {name}"


def aggregated(t: Tables) -> DataFrame:
    return tasks.aggregate(order_tasks(t), AS_OF)


@query(
    "task_parse",
    f"""WITH {DAILY} SELECT note_path, {sql_iso('source_date')}, category, sub_project, line_number, status,
    {sql_iso('due_date')}, text, normalized FROM dtask""",
)
def task_parse(t: Tables) -> DataFrame:
    return daily.tasks(daily_md(t)).select(
        "note_path", iso("source_date"), "category", "sub_project", "line_number", "status", iso("due_date"), "text", "normalized"
    )


@query(
    "task_aggregate",
    f"""{TASKS} SELECT category, sub_project, normalized, text, status, {sql_iso('due_date')}, {sql_iso('first_date')},
    {sql_iso('latest_date')}, appearance_count FROM task""",
)
def task_aggregate(t: Tables) -> DataFrame:
    return aggregated(t).select(
        *tasks.KEY, "text", "status", iso("due_date"), iso("first_date"), iso("latest_date"), "appearance_count"
    )


@query("task_days_open", f"{TASKS} SELECT category, sub_project, normalized, completed, days_open FROM task")
def task_days_open(t: Tables) -> DataFrame:
    return aggregated(t).select(*tasks.KEY, "completed", "days_open")


DUE_LABEL = """CASE WHEN due_date IS NULL OR completed THEN '' WHEN n < -1 THEN (-n) || ' days overdue'
  WHEN n = -1 THEN '1 day overdue' WHEN n = 0 THEN 'Today' WHEN n = 1 THEN 'Tomorrow' ELSE 'in ' || n || ' days' END"""


@query(
    "due_label",
    f"""{TASKS} SELECT category, sub_project, normalized, {DUE_LABEL} AS label,
      CASE WHEN due_date IS NULL OR completed THEN 'none' WHEN n <= 1 THEN 'urgent' WHEN n <= 3 THEN 'soon'
           WHEN n <= 7 THEN 'week' ELSE 'later' END AS band
    FROM (SELECT *, due_date - DATE '{AS_OF}' AS n FROM task)""",
)
def due_label(t: Tables) -> DataFrame:
    return tasks.with_due_label(aggregated(t), AS_OF).select(*tasks.KEY, "label", "band")


@query(
    "task_filters",
    f"""{TASKS} SELECT category, sub_project, normalized, status FROM task
    WHERE category = '2-HIGH' AND NOT completed AND status = 'open' AND sub_project = 'BUILDING'""",
)
def task_filters(t: Tables) -> DataFrame:
    return tasks.select_tasks(
        aggregated(t), category="2-HIGH", completed=False, status="open", sub_project="BUILDING"
    ).select(*tasks.KEY, "status")


@query(
    "task_upcoming",
    f"""{TASKS} SELECT category, sub_project, normalized, {sql_iso('due_date')} FROM task
    WHERE NOT completed AND due_date <= DATE '{AS_OF}' + 7""",
)
def task_upcoming(t: Tables) -> DataFrame:
    return tasks.by_due(tasks.upcoming(aggregated(t), AS_OF)).select(*tasks.KEY, iso("due_date"))


@query(
    "task_search",
    f"""{TASKS} SELECT category, sub_project, normalized FROM task
    WHERE contains(lower(text), 'mer 12') OR contains(lower(category), 'mer 12') OR contains(lower(sub_project), 'mer 12')""",
)
def task_search(t: Tables) -> DataFrame:
    return tasks.search(aggregated(t), "Mer 12").select(*tasks.KEY)


@query(
    "task_card_filters",
    f"""{TASKS} SELECT card, category, sub_project, normalized FROM (
      SELECT 'active' AS card, * FROM task WHERE NOT completed
      UNION ALL SELECT 'overdue', * FROM task WHERE NOT completed AND due_date < DATE '{AS_OF}'
      UNION ALL SELECT 'due_today', * FROM task WHERE NOT completed AND due_date = DATE '{AS_OF}'
      UNION ALL SELECT 'in_progress', * FROM task WHERE status = 'in_progress'
      UNION ALL SELECT 'completed', * FROM task WHERE completed)""",
)
def task_card_filters(t: Tables) -> DataFrame:
    """Each task once per card it belongs to."""
    cards = tasks.card_predicates(AS_OF)
    names = F.array_compact(F.array(*[F.when(cond, name) for name, cond in cards.items()]))
    return aggregated(t).select(F.explode(names).alias("card"), *tasks.KEY)


@query(
    "task_stat_cards",
    f"""{TASKS} SELECT count(*) FILTER (NOT completed)::BIGINT AS active,
      count(*) FILTER (NOT completed AND due_date < DATE '{AS_OF}')::BIGINT AS overdue,
      count(*) FILTER (NOT completed AND due_date = DATE '{AS_OF}')::BIGINT AS due_today,
      count(*) FILTER (status = 'in_progress')::BIGINT AS in_progress, count(*) FILTER (completed)::BIGINT AS completed FROM task""",
)
def task_stat_cards(t: Tables) -> DataFrame:
    return tasks.stat_cards(aggregated(t), AS_OF)


@query(
    "task_category_rollup",
    f"""{TASKS} SELECT category, coalesce(sub_project, '') AS sub_project, grouping(sub_project) = 1 AS is_total,
      count(*)::BIGINT AS n FROM task WHERE NOT completed GROUP BY ROLLUP (category, sub_project) HAVING category IS NOT NULL""",
)
def task_category_rollup(t: Tables) -> DataFrame:
    return tasks.category_counts(aggregated(t))


@query(
    "subproject_urgency",
    f"""{TASKS} SELECT category, sub_project, coalesce(strftime(min(due_date), '%Y-%m-%d'), '') AS earliest_due,
    count(*)::BIGINT AS n FROM task GROUP BY category, sub_project""",
)
def subproject_urgency(t: Tables) -> DataFrame:
    return tasks.subproject_urgency(aggregated(t)).select("category", "sub_project", iso("earliest_due"), "n")


@query(
    "briefing_buckets",
    f"""{TASKS} SELECT category, sub_project, normalized, days_open, {sql_iso('due_date')},
      CASE WHEN due_date < DATE '{AS_OF}' THEN 'overdue' WHEN due_date = DATE '{AS_OF}' THEN 'due_today'
           WHEN due_date IS NULL AND days_open > 3 AND status = 'open' THEN 'aging' END AS bucket
    FROM task WHERE NOT completed AND bucket IS NOT NULL""",
)
def briefing_buckets(t: Tables) -> DataFrame:
    return tasks.briefing(aggregated(t), AS_OF).select(*tasks.KEY, "days_open", iso("due_date"), "bucket")


@query(
    "completed_by_day",
    f"""{TASKS} SELECT {sql_iso('latest_date')}, count(*)::BIGINT AS n,
      dense_rank() OVER (ORDER BY latest_date DESC)::INTEGER AS day_rank
    FROM task WHERE completed GROUP BY task.latest_date""",
)
def completed_by_day(t: Tables) -> DataFrame:
    """Days with completed tasks, newest first. Rows are reduced to days before ranking."""
    from pyspark.sql import Window

    days = aggregated(t).where("completed").groupBy("latest_date").agg(F.count(F.lit(1)).alias("n"))
    ranked = days.withColumn("day_rank", F.dense_rank().over(Window.orderBy(F.desc("latest_date"))))
    return ranked.select(iso("latest_date"), "n", "day_rank")


OPEN_LINES = f"""
still AS (SELECT *, due_date - DATE '{AS_OF}' AS n FROM task WHERE status <> 'done'),
openrep AS (
  SELECT DISTINCT category AS k1, '' AS k2, 0 AS kind, '' AS k3, '' AS k4, '## ' || category AS line FROM still
  UNION ALL SELECT DISTINCT category, sub_project, 1, '', '', '### ' || sub_project FROM still
  UNION ALL SELECT DISTINCT category, sub_project, 2, '', '', '| Status | Task | Added | Due | Timeline |' FROM still
  UNION ALL SELECT DISTINCT category, sub_project, 3, '', '', '|:---:|------|:---:|:---:|:---:|' FROM still
  UNION ALL SELECT category, sub_project, 4, coalesce(strftime(due_date, '%Y-%m-%d'), '9999-99-99'), strftime(first_date, '%Y-%m-%d'),
    '| ' || CASE WHEN status = 'in_progress' THEN 'In Progress' ELSE 'Open' END || ' | ' || text || ' | [[' ||
    strftime(first_date, '%Y-%m-%d') || ']] | ' || coalesce(strftime(due_date, '%Y-%m-%d'), '') || ' | ' || {DUE_LABEL} || ' |' FROM still)"""


@query("render_task_report", f"{TASKS},{OPEN_LINES} SELECT * FROM openrep")
def render_task_report(t: Tables) -> DataFrame:
    return reports.open_report(aggregated(t), AS_OF)


@query(
    "render_completed_report",
    f"""{TASKS}, done AS (SELECT *, lpad((DATE '9999-12-31' - latest_date)::VARCHAR, 9, '0') AS k FROM task WHERE completed)
    SELECT DISTINCT k AS k1, '' AS k2, 0 AS kind, '' AS k3, '' AS k4, '## ' || strftime(latest_date, '%Y-%m-%d') AS line FROM done
    UNION ALL SELECT k, '', 1, strftime(first_date, '%Y-%m-%d'), normalized,
      '- [x] ' || text || ' [[' || strftime(first_date, '%Y-%m-%d') || ']] *(' || category || ' > ' || sub_project || ')*' FROM done""",
)
def render_completed_report(t: Tables) -> DataFrame:
    return reports.completed_report(aggregated(t))


@query(
    "task_report_read",
    f"""{TASKS} SELECT normalized, arg_max(status, (category, sub_project, coalesce(due_date, DATE '9999-12-31'), first_date)) AS status,
      coalesce(strftime(arg_max(coalesce(due_date, DATE '9999-12-31'), (category, sub_project, coalesce(due_date, DATE '9999-12-31'), first_date)), '%Y-%m-%d'), '')
        .replace('9999-12-31', '') AS due_date
    FROM task WHERE status <> 'done' GROUP BY normalized""",
)
def task_report_read(t: Tables) -> DataFrame:
    """The open report read back into desired statuses and due dates, last line per task."""
    written = materialize(reports.open_report(aggregated(t), AS_OF), "report")
    lines = written.select(F.struct("k1", "k2", "kind", "k3", "k4", "line").alias("line_no"), "line")
    return reports.read_statuses(lines).join(reports.read_due_dates(lines), "normalized")


# --- updates --------------------------------------------------------------------------

DESIRED = """
want AS (
  SELECT 'follow up customer ' || c_custkey AS normalized,
    CASE WHEN c_custkey % 10 = 0 THEN 'done' ELSE 'in_progress' END AS status,
    CASE WHEN c_custkey % 3 = 0 THEN DATE '2001-09-01' END AS due_date
  FROM customer WHERE c_custkey % 5 = 0)"""


def desired(t: Tables) -> DataFrame:
    """Wanted states: in progress for every fifth customer, overlaid by done for every tenth."""
    c = F.col("c_custkey")
    key = cat("follow up customer ", c).alias("normalized")
    due = F.when(c % 3 == 0, F.to_date(F.lit("2001-09-01"))).alias("due_date")
    base = t.customer.where(c % 5 == 0).select(key, F.lit("in_progress").alias("status"), due)
    top = t.customer.where(c % 10 == 0).select(key, F.lit("done").alias("status"), due)
    return tasks.overlay(base, top, "normalized")


SYNCED = """
syn AS (
  SELECT a.* EXCLUDE (status, due_date), coalesce(w.status, a.status) AS status, coalesce(w.due_date, a.due_date) AS due_date,
    coalesce(w.status, a.status) <> a.status AS status_changed,
    coalesce(w.due_date, a.due_date) IS DISTINCT FROM a.due_date AS due_changed
  FROM app a LEFT JOIN want w USING (normalized))"""


@query("status_overlay", f"WITH {DESIRED} SELECT normalized, status, {sql_iso('due_date')} FROM want")
def status_overlay(t: Tables) -> DataFrame:
    return desired(t).select("normalized", "status", iso("due_date"))


@query(
    "state_sync",
    f"""WITH {APPEARANCES},{DESIRED},{SYNCED} SELECT line_number, category, normalized, status, {sql_iso('due_date')},
    status_changed, due_changed FROM syn""",
)
def state_sync(t: Tables) -> DataFrame:
    return tasks.sync_state(order_tasks(t), desired(t)).select(
        "line_number", "category", "normalized", "status", iso("due_date"), "status_changed", "due_changed"
    )


@query(
    "sync_summary",
    f"""WITH {APPEARANCES},{DESIRED},{SYNCED},
    agg AS (SELECT arg_max(status, (source_date, line_number)) AS st FROM syn GROUP BY category, sub_project, normalized)
    SELECT count(*) FILTER (st <> 'done')::BIGINT AS open_tasks, count(*) FILTER (st = 'done')::BIGINT AS done_tasks,
      (SELECT count(DISTINCT note_path) FROM syn WHERE status_changed OR due_changed)::BIGINT AS notes_updated FROM agg""",
)
def sync_summary(t: Tables) -> DataFrame:
    synced = materialize(tasks.sync_state(order_tasks(t), desired(t)), "synced")
    return tasks.sync_summary(synced, AS_OF)


UPDATES = """
upd AS (
  SELECT category, sub_project, normalized, CASE WHEN n % 2 = 0 THEN 'done' END AS new_status,
    CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN '2001-12-24' END AS new_due
  FROM (SELECT DISTINCT category, sub_project, normalized, regexp_extract(normalized, '[0-9]+$')::INTEGER AS n FROM app)
  WHERE n % 4 < 2)"""


def updates(t: Tables) -> DataFrame:
    n = F.regexp_extract("normalized", "[0-9]+$", 0).cast("int")
    keys = order_tasks(t).select(*tasks.KEY).distinct().where(n % 4 < 2)
    return keys.select(
        *tasks.KEY,
        F.when(n % 2 == 0, "done").alias("new_status"),
        F.when(n % 3 == 0, "").when(n % 3 == 1, "2001-12-24").alias("new_due"),
    )


@query(
    "task_update",
    f"""WITH {APPEARANCES},{UPDATES},
    j AS (SELECT app.*, new_status, new_due, row_number() OVER (
        PARTITION BY category, sub_project, normalized ORDER BY source_date DESC, line_number DESC) = 1 AS hit
      FROM app LEFT JOIN upd USING (category, sub_project, normalized))
    SELECT line_number, CASE WHEN hit THEN coalesce(new_status, status) ELSE status END AS status,
      CASE WHEN hit AND new_due IS NOT NULL THEN new_due ELSE coalesce(strftime(due_date, '%Y-%m-%d'), '') END AS due_date FROM j""",
)
def task_update(t: Tables) -> DataFrame:
    return tasks.update_latest(order_tasks(t), updates(t)).select("line_number", "status", iso("due_date"))


@query(
    "task_reassign",
    f"""WITH {APPEARANCES},{UPDATES} SELECT line_number,
      CASE WHEN u.normalized IS NULL THEN app.category ELSE 'Moved' END AS category,
      CASE WHEN u.normalized IS NULL THEN app.sub_project WHEN u.new_status = 'done' THEN 'Done pile' ELSE '' END AS sub_project
    FROM app LEFT JOIN upd u USING (category, sub_project, normalized)""",
)
def task_reassign(t: Tables) -> DataFrame:
    moves = updates(t).select(
        *tasks.KEY,
        F.lit("Moved").alias("new_category"),
        F.when(F.col("new_status") == "done", "Done pile").alias("new_sub_project"),
    )
    return tasks.reassign(order_tasks(t), moves).select("line_number", "category", "sub_project")


RULES = [("customer 1", "Personal", "Errands"), ("CUSTOMER 77!", "Work", ""), ("er 25", "Personal", "Health"), ("nobody", "Work", "")]
_RULE_ROWS = ", ".join(f"({i}, '{s.lower()}', '{c}', '{p}')" for i, (s, c, p) in enumerate(RULES))


@query(
    "bulk_recategorize",
    f"""{TASKS}, rules(rule, needle, new_category, new_sub_project) AS (VALUES {_RULE_ROWS})
    SELECT rule, category, sub_project, normalized, new_category, new_sub_project FROM (
      SELECT *, row_number() OVER (PARTITION BY rule ORDER BY first_date, category, sub_project, normalized) AS rn
      FROM rules JOIN task ON contains(lower(text), needle)) WHERE rn = 1""",
)
def bulk_recategorize(t: Tables) -> DataFrame:
    return tasks.moves_by_substring(aggregated(t), RULES)


@query(
    "task_lookup",
    f"""{TASKS} SELECT category, sub_project, normalized, status, appearance_count FROM task
    WHERE category = '1-URGENT' AND normalized = 'follow up customer 42'""",
)
def task_lookup(t: Tables) -> DataFrame:
    """Point lookup by composite key, given as raw text."""
    wanted = t.customer.where("c_custkey = 42").select(
        F.lit("1-URGENT").alias("category"),
        F.col("c_mktsegment").alias("sub_project"),
        X.task_key(F.lit("Follow up, customer 42! (due: 2001-01-01)")).alias("normalized"),
    )
    return aggregated(t).join(wanted, tasks.KEY, "left_semi").select(*tasks.KEY, "status", "appearance_count")
