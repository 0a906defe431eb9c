"""Usage, logs, runs and conversations over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import conversations as C
from marginalia.operators import usage as U
from marginalia.plans.fixtures import cat
from marginalia.plans.registry import Tables, query
from marginalia.plans.task_plans import iso
from marginalia.session import shared_dir
from marginalia.sources import logs, tables

AS_OF = "2024-01-30"

USAGE = """
priced(m, provider, model, ir, orr) AS (VALUES (0, 'anthropic', 'claude-haiku-4-5', 1.0, 5.0), (1, 'anthropic', 'claude-sonnet-4-5', 3.0, 15.0),
  (2, 'openai', 'gpt-4o-mini', 0.15, 0.6), (3, 'ollama', 'local', 0.0, 0.0), (4, 'openai', 'unknown', 0.0, 0.0)),
us AS (
  SELECT event_id, ts, user_id, provider, model, event_type AS usage_type, (k * 1000)::BIGINT AS input_tokens, (k * 10)::BIGINT AS output_tokens,
    ((k * 1000) * ir + (k * 10) * orr)::DOUBLE / 1000000 AS cost
  FROM (SELECT *, (props->>'k')::INTEGER AS k FROM events) e JOIN priced ON m = user_id % 5)"""


def usage(t: Tables) -> DataFrame:
    """Events as model calls: the user picks the model, ``k`` sets the tokens."""
    u = F.col("user_id") % 5
    k = F.get_json_object("props", "$.k").cast("long")
    rows = t.events.select(
        "event_id",
        "ts",
        "user_id",
        F.when(u <= 1, "anthropic").when(u == 3, "ollama").otherwise("openai").alias("provider"),
        F.when(u == 0, "claude-haiku-4-5").when(u == 1, "claude-sonnet-4-5").when(u == 2, "gpt-4o-mini")
        .when(u == 3, "local").otherwise("unknown").alias("model"),
        F.col("event_type").alias("usage_type"),
        (k * 1000).alias("input_tokens"),
        (k * 10).alias("output_tokens"),
    )
    return U.with_cost(rows, tables.pricing(t.spark))


def query_log(t: Tables) -> DataFrame:
    """Events as a query log: type is the label (one type unlabelled), value the latency."""
    return t.events.select(
        F.col("event_id").alias("query_id"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("retrieval_label"),
        F.col("value").alias("latency_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("citation_count"),
    )


def messages(t: Tables) -> DataFrame:
    return t.conversations.withColumnRenamed("conv_id", "conversation_id")


@query(
    "usage_cost",
    f"WITH {USAGE} SELECT event_id, provider, model, round(cost, 6)::DOUBLE AS cost FROM us",
)
def usage_cost(t: Tables) -> DataFrame:
    return usage(t).select("event_id", "provider", "model", F.round("cost", 6).alias("cost"))


@query(
    "usage_grouping_sets",
    f"""WITH {USAGE}, s AS (SELECT * FROM us WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22')
    SELECT dimension, name, round(sum(cost), 6)::DOUBLE AS cost, count(*)::BIGINT AS calls, sum(input_tokens)::BIGINT AS input_tokens,
      sum(output_tokens)::BIGINT AS output_tokens
    FROM (SELECT 'provider' AS dimension, provider AS name, * FROM s UNION ALL SELECT 'usage_type', usage_type, * FROM s
          UNION ALL SELECT 'total', '', * FROM s) GROUP BY dimension, name""",
)
def usage_grouping_sets(t: Tables) -> DataFrame:
    return U.summary(U.between(usage(t), "2024-01-08", "2024-01-22"))


@query(
    "daily_cost",
    f"""WITH {USAGE} SELECT strftime(ts, '%Y-%m-%d') AS day, provider, round(sum(cost), 6)::DOUBLE AS cost, count(*)::BIGINT AS calls
    FROM us GROUP BY ALL""",
)
def daily_cost(t: Tables) -> DataFrame:
    return U.daily_cost(usage(t)).select(iso("day"), "provider", "cost", "calls")


@query(
    "daily_totals",
    f"""WITH {USAGE}, p AS (SELECT strftime(ts, '%Y-%m-%d') AS day, provider, round(sum(cost), 6)::DOUBLE AS cost, count(*) AS calls
      FROM us GROUP BY ALL)
    SELECT day, round(sum(cost), 6)::DOUBLE AS cost, sum(calls)::BIGINT AS calls, string_agg(provider, ',' ORDER BY provider) AS providers
    FROM p GROUP BY day""",
)
def daily_totals(t: Tables) -> DataFrame:
    names = F.array_join(F.map_keys("by_provider"), ",")
    return U.daily_totals(usage(t)).select(iso("day"), "cost", "calls", names.alias("providers"))


@query(
    "weekly_cost",
    f"""WITH {USAGE} SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, provider, round(sum(cost), 6)::DOUBLE AS cost,
    count(*)::BIGINT AS calls FROM us GROUP BY ALL""",
)
def weekly_cost(t: Tables) -> DataFrame:
    return U.weekly_cost(usage(t)).select(iso("week"), "provider", "cost", "calls")


@query(
    "cost_spine",
    f"""WITH {USAGE}, sp AS (SELECT (DATE '2024-02-03' - i::INTEGER) AS day FROM range(30) r(i))
    SELECT strftime(day, '%Y-%m-%d') AS day, round(coalesce(sum(cost), 0), 6)::DOUBLE AS cost, count(event_id)::BIGINT AS calls
    FROM sp LEFT JOIN us ON ts::DATE = day GROUP BY day""",
)
def cost_spine(t: Tables) -> DataFrame:
    """Thirty days ending after the data does, so some days are empty."""
    return U.cost_spine(usage(t), "2024-02-03", 30).select(iso("day"), "cost", "calls")


@query(
    "cost_alert",
    f"""WITH {USAGE}, d AS (SELECT round(coalesce(sum(cost), 0), 6)::DOUBLE AS today_cost, count(*)::BIGINT AS today_calls
      FROM us WHERE ts::DATE = DATE '{AS_OF}')
    SELECT today_cost, today_calls, CASE WHEN today_cost >= 1.0 THEN printf('Today''s LLM cost ($%.2f) exceeds $1.00 threshold', today_cost)
      ELSE '' END AS cost_alert FROM d""",
)
def cost_alert(t: Tables) -> DataFrame:
    return U.cost_alert(usage(t), AS_OF)


@query(
    "cost_axis",
    f"""WITH {USAGE}, p AS (SELECT provider, ts::DATE AS day, round(sum(cost), 6)::DOUBLE AS c FROM us GROUP BY ALL)
    SELECT provider, CASE WHEN max(c) <= 0 THEN 0.10 ELSE round(ceil(round(max(c) / 0.05, 6)) * 0.05, 2) END::DOUBLE AS axis_top FROM p GROUP BY provider""",
)
def cost_axis(t: Tables) -> DataFrame:
    """Upper end of each provider's daily cost chart."""
    top = U.daily_cost(usage(t)).groupBy("provider").agg(F.max("cost").alias("c"))
    return top.select("provider", U.axis_ceiling(F.col("c")).alias("axis_top"))


_LABEL = "CASE WHEN event_type = 'error' THEN 'UNKNOWN' ELSE event_type END"


def _stats_sql(source: str) -> str:
    aggs = """count(*)::BIGINT AS n, round(avg(value), 2)::DOUBLE AS avg_latency_ms,
      round(avg((props->>'k')::INTEGER), 2)::DOUBLE AS avg_citations"""
    return f"SELECT {_LABEL} AS label, {aggs} FROM {source} GROUP BY 1 UNION ALL SELECT '', {aggs} FROM {source}"


@query("querylog_stats", _stats_sql("events"))
def querylog_stats(t: Tables) -> DataFrame:
    return U.query_log_stats(query_log(t))


@query("querylog_stats_recent", _stats_sql("(SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000)"))
def querylog_stats_recent(t: Tables) -> DataFrame:
    """The report over the newest 10,000 entries, as the log viewer shows it."""
    return U.query_log_stats(query_log(t), last=10_000)


@query(
    "latency_table",
    """WITH s AS (SELECT event_type AS stage, round(arg_max(value, (ts, event_id)), 2)::DOUBLE AS last_ms, avg(value) AS m, arg_max(value, (ts, event_id)) AS l
      FROM events GROUP BY 1)
    SELECT stage, last_ms, round(m, 2)::DOUBLE AS mean_ms FROM s
    UNION ALL SELECT 'total', round(sum(l), 2)::DOUBLE, round(sum(m), 2)::DOUBLE FROM s""",
)
def latency_table(t: Tables) -> DataFrame:
    timings = t.events.select("event_id", "ts", F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return U.latency_table(timings)


TRACKER = "tr AS (SELECT doc_id, (n_chars // 700 + 1)::BIGINT AS chunk_count, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS indexed_at FROM documents)"


def tracker(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        (F.floor(F.col("n_chars") / 700) + 1).cast("long").alias("chunk_count"),
        cat("2024-01-", F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("indexed_at"),
    )


@query(
    "index_stats",
    f"WITH {TRACKER} SELECT count(*)::BIGINT AS file_count, coalesce(sum(chunk_count), 0)::BIGINT AS total_chunks, max(indexed_at) AS last_indexed_at FROM tr",
)
def index_stats(t: Tables) -> DataFrame:
    return U.index_stats(tracker(t))


@query(
    "admin_stats",
    f"""WITH {USAGE}, d AS (SELECT round(coalesce(sum(cost), 0), 6)::DOUBLE AS today_cost, count(*)::BIGINT AS today_calls
      FROM us WHERE ts::DATE = DATE '{AS_OF}')
    SELECT (SELECT count(*) FROM events)::BIGINT AS total_queries, (SELECT round(avg(value), 2) FROM events)::DOUBLE AS avg_latency_ms,
      (SELECT count(DISTINCT conv_id) FROM conversations)::BIGINT AS total_conversations,
      (SELECT count(*) FROM documents)::BIGINT AS index_file_count, (SELECT count(*) FROM us)::BIGINT AS total_llm_calls,
      (SELECT round(sum(cost), 6) FROM us)::DOUBLE AS total_llm_cost, today_cost, today_calls,
      CASE WHEN today_cost >= 1.0 THEN printf('Today''s LLM cost ($%.2f) exceeds $1.00 threshold', today_cost) ELSE '' END AS cost_alert FROM d""",
)
def admin_stats(t: Tables) -> DataFrame:
    return U.admin_stats(usage(t), query_log(t), messages(t), tracker(t), AS_OF)


@query(
    "run_status",
    """WITH r AS (SELECT user_id AS job, max(ts) FILTER (event_type IN ('click', 'view', 'purchase')) AS d,
        max(ts) FILTER (event_type = 'error') AS f FROM events GROUP BY user_id),
      h AS (SELECT *, (epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(d))) / 3600.0 AS h FROM r)
    SELECT job, CASE WHEN f IS NOT NULL AND (d IS NULL OR f > d) THEN 'failed' WHEN d IS NULL THEN 'unknown' WHEN h > 25 THEN 'stale' ELSE 'ok' END AS status,
      coalesce(strftime(d, '%Y-%m-%d %H:%M:%S'), '') AS last_sync, round(h, 1)::DOUBLE AS hours_ago FROM h""",
)
def run_status(t: Tables) -> DataFrame:
    """Each user's events as one job's runs; errors are failures, sign-ups are neither."""
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "failed").when(kind.isin("click", "view", "purchase"), "completed")
    runs = t.events.select(F.col("user_id").alias("job"), outcome.alias("outcome"), "ts")
    return U.run_status(runs, "2024-02-01 00:00:00")


@query(
    "display_formats",
    f"""WITH {USAGE}, x AS (SELECT provider, model, sum(input_tokens)::BIGINT AS n, round(sum(cost), 6) AS c, min(ts)::DATE AS a, max(ts)::DATE AS b FROM us GROUP BY ALL)
    SELECT provider, model, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000.0::DOUBLE) WHEN n >= 1000 THEN printf('%.1fK', n / 1000.0::DOUBLE)
        ELSE n::VARCHAR END AS tokens, CASE WHEN c < 0.01 THEN '$0.00' ELSE printf('$%.2f', c::DOUBLE) END AS cost,
      strftime(a, '%a, %b %-d') AS first_day, strftime(a, '%b %-d') || ' – ' || strftime(b, '%b %-d, %Y') AS span FROM x""",
)
def display_formats(t: Tables) -> DataFrame:
    sums = usage(t).groupBy("provider", "model").agg(
        F.sum("input_tokens").alias("n"), F.round(F.sum("cost"), 6).alias("c"), F.min("ts").alias("a"), F.max("ts").alias("b")
    )
    return sums.select(
        "provider",
        "model",
        X.token_count_label(F.col("n")).alias("tokens"),
        X.cost_label(F.col("c")).alias("cost"),
        F.date_format("a", "EEE, MMM d").alias("first_day"),
        F.concat(F.date_format("a", "MMM d"), F.lit(" – "), F.date_format("b", "MMM d, yyyy")).alias("span"),
    )


# --- logs -----------------------------------------------------------------------------


@query(
    "log_roundtrip",
    """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'q' || event_id AS query, event_type AS retrieval_label,
      ((props->>'k')::INTEGER)::INTEGER AS citation_count, round(value * 1.0, 2)::DOUBLE AS latency_ms FROM events WHERE event_id % 10 <> 3""",
)
def log_roundtrip(t: Tables) -> DataFrame:
    """Entries written as JSON lines, a tenth of them cut off in the middle, then read back."""
    path = shared_dir(t.spark, "querylog")
    entry = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
            cat("q", F.col("event_id")).alias("query"),
            F.col("event_type").alias("retrieval_label"),
            F.get_json_object("props", "$.k").cast("int").alias("citation_count"),
            F.round("value", 2).alias("latency_ms"),
        )
    )
    line = F.when(F.col("event_id") % 10 == 3, F.substring(entry, 1, 30)).otherwise(entry)
    t.events.select(line.alias("value")).write.text(path)
    return logs.read_queries(t.spark, path).select(
        "timestamp", "query", "retrieval_label", "citation_count", "latency_ms"
    )


@query(
    "usage_append",
    f"WITH {USAGE} SELECT strftime(ts, '%Y-%m-%d') AS date, provider, count(*)::BIGINT AS n FROM us GROUP BY ALL",
)
def usage_append(t: Tables) -> DataFrame:
    """Usage appended in two runs to the day-partitioned log, then read back."""
    path = shared_dir(t.spark, "usage")
    rows = usage(t)
    logs.append_usage(rows.where("event_id % 2 = 0"), path)
    logs.append_usage(rows.where("event_id % 2 = 1"), path)
    stored = t.spark.read.parquet(path)
    return stored.groupBy(F.col("date").cast("string").alias("date"), "provider").agg(F.count(F.lit(1)).alias("n"))


@query(
    "recent_usage",
    f"WITH {USAGE} SELECT event_id, provider, model, usage_type, input_tokens FROM us ORDER BY event_id DESC LIMIT 50",
)
def recent_usage(t: Tables) -> DataFrame:
    return logs.recent_usage(usage(t), 50, "event_id").select("event_id", "provider", "model", "usage_type", "input_tokens")


# --- conversations --------------------------------------------------------------------


@query(
    "conv_list",
    """SELECT conv_id AS conversation_id, count(*)::BIGINT AS message_count, max(turn) AS last_turn,
      coalesce(arg_min(text, turn) FILTER (role = 'user'), '') AS preview FROM conversations GROUP BY conv_id""",
)
def conv_list(t: Tables) -> DataFrame:
    return C.listing(messages(t))


@query(
    "conv_list_recent",
    """SELECT conv_id AS conversation_id, count(*)::BIGINT AS message_count FROM conversations GROUP BY conv_id
       ORDER BY max(turn) DESC, conv_id LIMIT 50""",
)
def conv_list_recent(t: Tables) -> DataFrame:
    return C.recent_conversations(messages(t)).select("conversation_id", "message_count")


_KEEP = "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4"


@query("conv_recent", f"SELECT conv_id AS conversation_id, turn, role, text FROM conversations {_KEEP}")
def conv_recent(t: Tables) -> DataFrame:
    return C.last_messages(messages(t), 4).select("conversation_id", "turn", "role", "text")


@query(
    "conv_prune",
    f"""SELECT conv_id AS conversation_id, count(*)::BIGINT AS n, min(turn) AS first_turn
    FROM (SELECT * FROM conversations {_KEEP}) GROUP BY conv_id""",
)
def conv_prune(t: Tables) -> DataFrame:
    kept = C.pruned(messages(t), 4)
    return kept.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first_turn"))


@query(
    "conv_delete",
    "SELECT conv_id AS conversation_id, turn FROM conversations WHERE conv_id % 3 <> 1",
)
def conv_delete(t: Tables) -> DataFrame:
    gone = messages(t).where("conversation_id % 3 = 1")
    return C.without(messages(t), gone).select("conversation_id", "turn")


@query(
    "conv_count",
    "SELECT count(DISTINCT conv_id)::BIGINT AS conversations, count(*)::BIGINT AS messages FROM conversations",
)
def conv_count(t: Tables) -> DataFrame:
    return messages(t).agg(
        F.count_distinct("conversation_id").alias("conversations"), F.count(F.lit(1)).alias("messages")
    )


SESSIONS = """
g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events),
s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
ses AS (SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start,
  strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS session_end, count(*)::BIGINT AS n FROM s GROUP BY user_id, sid)"""


@query("activity_sessions", f"WITH {SESSIONS} SELECT * FROM ses")
def activity_sessions(t: Tables) -> DataFrame:
    acts = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return C.sessions(acts, "6 hours").select(
        "user_id",
        F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"),
        F.date_format("session_end", "yyyy-MM-dd HH:mm:ss").alias("session_end"),
        "n",
    )
