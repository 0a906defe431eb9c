"""Registry of named queries over the driver tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.session import configure, deal

QueryFn = Callable[["Tables"], DataFrame]

MOST_ROWS = 100_000  # texts that one task reads where they lie
DEALT_ROWS = 10_000  # texts a task where they are dealt out, while that gives
DEALT_TASKS = 200  # tasks at most: to so many Spark writes rows straight to files, to more it gathers them in memory first


class Tables:
    """Lazy access to the parquet tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, rows_per_task: int | None = None) -> DataFrame:
        """A text table for CPU-heavy parsing. A table whose rows lie in fewer pieces than there are
        cores, or in a piece of more than ``MOST_ROWS``, is dealt out; others are read as they lie.
        Where its rows are short but costly, it is dealt out in tasks of at most about
        ``rows_per_task`` rows. The pieces that hold rows are counted, from the files' footers:
        a row group is read whole by one split, so splits may be many and all but one empty."""
        df = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        pieces = df.groupBy(F.spark_partition_id().alias("piece")).agg(F.count(F.lit(1)).alias("n"))
        found = pieces.agg(F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
        rows = found["rows"] or 0
        if rows_per_task:
            return deal(df, max(-(-rows // rows_per_task), cores))
        if found["pieces"] >= cores and found["most"] <= MOST_ROWS:
            return df
        return deal(df, max(min(-(-rows // DEALT_ROWS), DEALT_TASKS), cores))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under a name, with the SQL that must give the same rows."""

    def wrap(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return wrap


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(_ORACLES)
