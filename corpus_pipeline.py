"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept. Until the
last, stages return the columns of ``documents``; the last repeats rows as often as the mix takes
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontam, jaccard, linededup, mixing, quality
from marginalia.llm.members import maybe_in
from marginalia.session import configure, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in one; n_chars follows the text."""
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    done = linededup.dedup_lines(docs.select("doc_id", "text", others))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return done.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest doc_id stays. Rows that repeat
    a doc_id and text count once; rows without a doc_id or without words stay."""
    classes = materialize(jaccard.link_classes(docs), "classes")
    gone = materialize(classes.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    doubtful = maybe_in(gone, "doc_id")(F.col("doc_id"))
    checked = docs.where(doubtful).join(gone, "doc_id", "left_anti").select(*docs.columns)
    kept = docs.where(~doubtful).unionByName(checked)
    again = materialize(classes.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come out at their target weights; rows are repeated as often as taken."""
    return mixing.emit(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Expectation-maximisation over vote patterns is no SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
