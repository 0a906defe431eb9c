"""Date expressions; every 'today' is an explicit argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_day(value: str | Column) -> Column:
    return value if isinstance(value, Column) else F.to_date(F.lit(value))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def days_until(due: Column, as_of: str | Column) -> Column:
    return F.datediff(due, as_day(as_of))


def due_label(due: Column, as_of: str | Column, done: Column) -> Column:
    n = days_until(due, as_of)
    return (
        F.when(due.isNull() | done, "")
        .when(n < -1, F.concat((-n).cast("string"), F.lit(" days overdue")))
        .when(n == -1, "1 day overdue")
        .when(n == 0, "Today")
        .when(n == 1, "Tomorrow")
        .otherwise(F.concat(F.lit("in "), n.cast("string"), F.lit(" days")))
    )


def due_band(due: Column, as_of: str | Column, done: Column) -> Column:
    n = days_until(due, as_of)
    return (
        F.when(due.isNull() | done, "none")
        .when(n <= 1, "urgent")
        .when(n <= 3, "soon")
        .when(n <= 7, "week")
        .otherwise("later")
    )


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def week_key(day: Column) -> Column:
    """ISO week as ``YYYY-Www``."""
    year = F.extract(F.lit("YEAROFWEEK"), day)
    return F.format_string("%d-W%02d", year.cast("int"), F.weekofyear(day))


def day_name(day: Column) -> Column:
    return F.date_format(day, "EEE")


def normalize_mention(text: Column) -> Column:
    """First ISO or month/day/year date in the text as ``YYYY-MM-DD``, else NULL."""
    first = F.regexp_extract(
        text, r"\b(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{2,4})\b", 0
    )
    parts = F.split(first, "[-/]")
    us_year = F.when(F.length(parts[2]) == 2, F.concat(F.lit("20"), parts[2])).otherwise(parts[2])
    return (
        F.when(first == "", F.lit(None).cast("string"))
        .when(
            first.contains("-"),
            F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")),
        )
        .otherwise(F.concat_ws("-", us_year, F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0")))
    )
