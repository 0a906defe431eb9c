"""Usage, cost, query-log and run-log summaries.

Prices per million tokens give costs in whole millionths of a dollar, so sums are rounded to
six places: that removes the noise of summing in any order without touching a real digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import constants as K
from marginalia.functions import dates as D


def with_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``cost`` in dollars; models without a price cost nothing."""
    total = F.col("input_tokens") * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate")
    return (
        usage.join(prices, ["provider", "model"], "left")
        .withColumn("cost", F.coalesce(total / 1_000_000, F.lit(0.0)))
        .drop("input_rate", "output_rate")
    )


def between(usage: DataFrame, since: str | None = None, until: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows with since <= ts < until; the bounds reach the parquet scan."""
    if since is not None:
        usage = usage.where(F.col(ts) >= F.lit(since).cast(usage.schema[ts].dataType))
    if until is not None:
        usage = usage.where(F.col(ts) < F.lit(until).cast(usage.schema[ts].dataType))
    return usage


def _sums() -> list:
    return [
        F.round(F.sum("cost"), 6).alias("cost"),
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    ]


def summary(usage: DataFrame) -> DataFrame:
    """By provider, by usage type and in total, in one pass: (dimension, name, sums)."""
    sets = usage.groupingSets(
        [[F.col("provider")], [F.col("usage_type")], []], F.col("provider"), F.col("usage_type")
    ).agg(*_sums(), F.grouping("provider").alias("_gp"), F.grouping("usage_type").alias("_gt"))
    dimension = F.when(F.col("_gp") == 0, "provider").when(F.col("_gt") == 0, "usage_type").otherwise("total")
    name = F.when(F.col("_gp") == 0, F.col("provider")).when(F.col("_gt") == 0, F.col("usage_type")).otherwise("")
    return sets.select(
        dimension.alias("dimension"), name.alias("name"), "cost", "calls", "input_tokens", "output_tokens"
    )


def daily_cost(usage: DataFrame) -> DataFrame:
    return usage.groupBy(F.to_date("ts").alias("day"), "provider").agg(
        F.round(F.sum("cost"), 6).alias("cost"), F.count(F.lit(1)).alias("calls")
    )


def daily_totals(usage: DataFrame) -> DataFrame:
    """Per day: cost, calls and a provider -> cost map. Days hold one row per provider here."""
    per = daily_cost(usage)
    return per.groupBy("day").agg(
        F.round(F.sum("cost"), 6).alias("cost"),
        F.sum("calls").alias("calls"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "cost")))).alias("by_provider"),
    )


def weekly_cost(usage: DataFrame) -> DataFrame:
    return usage.groupBy(D.week_start(F.col("ts")).alias("week"), "provider").agg(
        F.round(F.sum("cost"), 6).alias("cost"), F.count(F.lit(1)).alias("calls")
    )


def cost_spine(usage: DataFrame, as_of: str, days: int) -> DataFrame:
    """The last ``days`` days up to as_of, days without usage at zero."""
    from marginalia.operators.calendar import day_spine

    start = F.date_sub(D.as_day(as_of), days - 1)
    per_day = (
        usage.where(F.to_date("ts").between(start, D.as_day(as_of)))
        .groupBy(F.to_date("ts").alias("day"))
        .agg(F.round(F.sum("cost"), 6).alias("cost"), F.count(F.lit(1)).alias("calls"))
    )
    spine = day_spine(usage.sparkSession, as_of, days).select(F.date_sub("day", days - 1).alias("day"))
    return spine.join(per_day, "day", "left").select(
        "day", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("calls", F.lit(0)).cast("long").alias("calls")
    )


def cost_alert(usage: DataFrame, as_of: str, threshold: float = K.COST_ALERT_THRESHOLD) -> DataFrame:
    """One row: today's cost, calls and an alert text ('' below the threshold)."""
    today = usage.where(F.to_date("ts") == D.as_day(as_of)).agg(
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("today_cost"), F.count(F.lit(1)).alias("today_calls")
    )
    text = F.concat(
        F.lit("Today's LLM cost ($"), F.format_string("%.2f", "today_cost"),
        F.lit(f") exceeds ${threshold:.2f} threshold"),
    )
    return today.withColumn("cost_alert", F.when(F.col("today_cost") >= threshold, text).otherwise(""))


def query_log_stats(log: DataFrame, last: int | None = None) -> DataFrame:
    """Per label and in total (label ''): queries, mean latency, mean citations.

    ``last`` restricts to the newest entries.
    """
    rows = log if last is None else log.orderBy(F.desc("timestamp"), F.desc("query_id")).limit(last)
    labelled = rows.withColumn("label", F.coalesce("retrieval_label", F.lit("UNKNOWN")))
    return (
        labelled.rollup("label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(F.coalesce("latency_ms", F.lit(0.0))), 2).alias("avg_latency_ms"),
            F.round(F.avg(F.coalesce("citation_count", F.lit(0))), 2).alias("avg_citations"),
        )
        .withColumn("label", F.coalesce("label", F.lit("")))
    )


def latency_table(timings: DataFrame) -> DataFrame:
    """Per stage the last and the mean time, and the sum of means as stage 'total'."""
    per = timings.groupBy("stage").agg(
        F.max_by("ms", F.struct("ts", "event_id")).alias("last_ms"), F.avg("ms").alias("_mean")
    )
    stages = per.select("stage", F.round("last_ms", 2).alias("last_ms"), F.round("_mean", 2).alias("mean_ms"))
    total = per.agg(F.round(F.sum("last_ms"), 2).alias("last_ms"), F.round(F.sum("_mean"), 2).alias("mean_ms"))
    return stages.unionByName(total.withColumn("stage", F.lit("total")).select("stage", "last_ms", "mean_ms"))


def axis_ceiling(value):
    """A round upper end for a cost axis: the next multiple of five cents, ten cents when empty."""
    return F.when(value <= 0, 0.10).otherwise(F.round(F.ceil(F.round(value / 0.05, 6)) * 0.05, 2))


def index_stats(tracker: DataFrame) -> DataFrame:
    return tracker.agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"),
        F.max("indexed_at").alias("last_indexed_at"),
    )


def admin_stats(usage: DataFrame, log: DataFrame, conversations: DataFrame, tracker: DataFrame, as_of: str) -> DataFrame:
    """One row that combines query, conversation, index and cost totals."""
    queries = log.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 2).alias("ms"))
    convs = conversations.agg(F.count_distinct("conversation_id").alias("n"))
    return cost_alert(usage, as_of).select(
        queries.select("n").scalar().alias("total_queries"),
        queries.select("ms").scalar().alias("avg_latency_ms"),
        convs.select("n").scalar().alias("total_conversations"),
        index_stats(tracker).select("file_count").scalar().alias("index_file_count"),
        usage.agg(F.count(F.lit(1)).alias("n")).select("n").scalar().alias("total_llm_calls"),
        usage.agg(F.round(F.sum("cost"), 6).alias("c")).select("c").scalar().alias("total_llm_cost"),
        "today_cost",
        "today_calls",
        "cost_alert",
    )


def run_status(runs: DataFrame, as_of: str, stale_hours: int = K.STALE_AFTER_HOURS) -> DataFrame:
    """Per job: last completed run, hours since, and ok / stale / failed / unknown.

    A failure newer than the last completion wins. Rows carry (job, outcome, ts).
    """
    now = F.lit(as_of).cast("timestamp")
    last = runs.groupBy("job").agg(
        F.max(F.when(F.col("outcome") == "completed", F.col("ts").cast("timestamp"))).alias("_done"),
        F.max(F.when(F.col("outcome") == "failed", F.col("ts").cast("timestamp"))).alias("_fail"),
    )
    hours = (F.unix_timestamp(now) - F.unix_timestamp("_done")) / 3600.0
    status = (
        F.when(F.col("_fail").isNotNull() & (F.col("_done").isNull() | (F.col("_fail") > F.col("_done"))), "failed")
        .when(F.col("_done").isNull(), "unknown")
        .when(hours > stale_hours, "stale")
        .otherwise("ok")
    )
    return last.select(
        "job",
        status.alias("status"),
        F.coalesce(F.date_format("_done", "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("last_sync"),
        F.round(hours, 1).alias("hours_ago"),
    )
