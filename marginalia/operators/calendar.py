"""Calendar events and days: overlap, day grids, week keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import dates as D
from marginalia.session import materialize


def last_day() -> Column:
    return F.coalesce("end_date", "date")


def overlapping(events: DataFrame, start: str, end: str) -> DataFrame:
    """Events that touch the closed range."""
    return events.where((last_day() >= D.as_day(start)) & (F.col("date") <= D.as_day(end))).orderBy("date", "time")


def overlap_join(events: DataFrame, ranges: DataFrame, bucket_days: int = 7) -> DataFrame:
    """All (range, event) rows whose closed intervals touch.

    Both sides are cut into day buckets and meet by equality; a pair that shares several
    buckets is kept only in the first of them. The ranges are written down first: Spark then knows
    their size, and while it is small the events, once per bucket, are not shuffled.
    """
    ranges = materialize(ranges, "ranges")

    def bucket(day: Column) -> Column:
        return F.floor(F.unix_date(day) / bucket_days).cast("int")

    left = events.withColumn("_b", F.explode(F.sequence(bucket(F.col("date")), bucket(F.greatest(last_day(), F.col("date"))))))
    right = ranges.withColumn("_b", F.explode(F.sequence(bucket(F.col("range_start")), bucket(F.col("range_end")))))
    first = F.greatest(bucket(F.col("date")), bucket(F.col("range_start")))
    touch = (last_day() >= F.col("range_start")) & (F.col("date") <= F.col("range_end"))
    return left.join(right, "_b").where(touch & (F.col("_b") == first)).drop("_b")


def day_spine(spark: SparkSession, start: str, days: int) -> DataFrame:
    return spark.range(days).select(F.date_add(D.as_day(start), F.col("id").cast("int")).alias("day"))


def week_grid(tasks: DataFrame, events: DataFrame, start: str, days: int) -> DataFrame:
    """Per day: tasks due and single-day events."""
    inside = F.col("day").between(D.as_day(start), F.date_add(D.as_day(start), days - 1))
    due = tasks.withColumnRenamed("due_date", "day").where(inside).groupBy("day").agg(F.count(F.lit(1)).alias("n_tasks"))
    single = (
        events.where("end_date IS NULL").withColumnRenamed("date", "day").where(inside)
        .groupBy("day").agg(F.count(F.lit(1)).alias("n_events"))
    )
    spine = day_spine(tasks.sparkSession, start, days)
    return spine.join(due, "day", "left").join(single, "day", "left").select(
        "day",
        F.coalesce("n_tasks", F.lit(0)).cast("long").alias("n_tasks"),
        F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"),
    )


def day_counts(tasks: DataFrame, events: DataFrame, start: str, days: int, as_of: str) -> DataFrame:
    """Per day: spanning events, tasks due, overdue and due-now flags.

    An event is clipped to the shown days before it is spread over them, so even a very long
    one gives at most one row per shown day.
    """
    first, final = D.as_day(start), F.date_add(D.as_day(start), days - 1)
    shown = events.where((last_day() >= first) & (F.col("date") <= final) & (last_day() >= F.col("date")))
    span = F.sequence(F.greatest(F.col("date"), first), F.least(last_day(), final))
    per_event = shown.select(F.explode(span).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("n_events"))
    due = (
        tasks.withColumnRenamed("due_date", "day")
        .where(F.col("day").between(first, final))
        .groupBy("day")
        .agg(F.count(F.lit(1)).alias("n_tasks"))
    )
    tasks_here = F.coalesce("n_tasks", F.lit(0)) > 0
    spine = day_spine(tasks.sparkSession, start, days)
    return spine.join(per_event, "day", "left").join(due, "day", "left").select(
        "day",
        F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"),
        F.coalesce("n_tasks", F.lit(0)).cast("long").alias("n_tasks"),
        (tasks_here & (F.col("day") < D.as_day(as_of))).alias("has_overdue"),
        (tasks_here & (F.col("day") == D.as_day(as_of))).alias("has_due_soon"),
    )


def task_lane(as_of: str) -> Column:
    """Agenda lane of a task: no due date, overdue, or on its day."""
    due = F.col("due_date")
    return F.when(due.isNull(), "no_due").when(due < D.as_day(as_of), "overdue").otherwise("scheduled")


def event_lane() -> Column:
    return F.when(F.col("end_date").isNotNull(), "multi_day").otherwise("single_day")
