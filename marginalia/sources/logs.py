"""Append-only logs: JSON lines for queries, day-partitioned parquet for usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_LOG = (
    "timestamp string, query string, conversation_id string, retrieval_label string, "
    "citation_ids array<string>, citation_count int, latency_ms double"
)


def append_queries(entries: DataFrame, path: str) -> None:
    entries.withColumn("latency_ms", F.round("latency_ms", 2)).write.mode("append").json(path)


def read_queries(spark: SparkSession, path: str, schema: str = QUERY_LOG) -> DataFrame:
    """All well-formed entries; lines that are not JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def recent_queries(log: DataFrame, limit: int = 100) -> DataFrame:
    """The newest entries, newest first."""
    return log.orderBy(F.desc("timestamp")).limit(limit)


def append_usage(rows: DataFrame, path: str) -> None:
    """Append usage rows (with a ``ts`` column), one folder per day."""
    rows.withColumn("date", F.to_date("ts")).write.mode("append").partitionBy("date").parquet(path)


def recent_usage(usage: DataFrame, limit: int = 50, key: str = "usage_id") -> DataFrame:
    return usage.orderBy(F.desc(key)).limit(limit)
