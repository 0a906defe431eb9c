"""Keyed tables and small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import constants as K
from marginalia.session import literal_rows


def point_lookup(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def cleared(table: DataFrame) -> DataFrame:
    """The table without rows, to overwrite it with."""
    return table.where(F.lit(False))


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of several tables in one frame."""
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def pricing(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, K.PRICING, ["provider", "model", "input_rate", "output_rate"])


def categories(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(category, sub_projects) from a settings file of JSON lines, else the defaults.

    Unreadable settings give the defaults too.
    """
    rows = [(name, ",".join(subs)) for name, subs in K.DEFAULT_CATEGORIES.items()]
    fallback = literal_rows(spark, rows, ["category", "subs"]).select(
        "category", F.filter(F.split("subs", ","), lambda s: s != "").alias("sub_projects")
    )
    if path is None:
        return fallback
    schema = "name string, sub_projects map<string,string>"
    found = (
        spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("name IS NOT NULL")
        .select(F.col("name").alias("category"), F.map_keys(F.coalesce("sub_projects", F.create_map())).alias("sub_projects"))
    )
    return fallback if found.isEmpty() else found


def write_ground_truth(queries: DataFrame, path: str) -> None:
    """(query, expected_notes, tags) as JSON lines."""
    queries.write.mode("errorifexists").json(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query string, expected_notes array<string>, tags array<string>").json(path)


def write_eval_report(report: DataFrame, path: str, model: str, run_at: str) -> None:
    """One JSON folder per run, named by model and time."""
    report.withColumn("model", F.lit(model)).withColumn("run_at", F.lit(run_at)).write.mode("append").partitionBy(
        "model", "run_at"
    ).json(path)


def model_matches(stored: DataFrame, model: str) -> DataFrame:
    """(stored_model, current_model, matches) of a one-row table of index properties."""
    return stored.select(
        F.col("embedding_model").alias("stored_model"),
        F.lit(model).alias("current_model"),
        F.coalesce(F.col("embedding_model") == model, F.lit(False)).alias("matches"),
    )


def encode_metadata(metadata: DataFrame) -> DataFrame:
    """Nested metadata columns as JSON text, for exchange with text-only stores."""
    nested = ["key_phrases", "entities", "dates", "action_items"]
    return metadata.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in metadata.columns])


PAGE_LIMIT = 200

METADATA_FIELDS = {
    "key_phrases": "array<string>",
    "entities": "array<struct<text:string,entity_type:string,confidence:double>>",
    "dates": "array<struct<text:string,normalized_date:string,date_type:string,confidence:double>>",
    "action_items": "array<struct<text:string,confidence:double,priority:string>>",
}


def decode_metadata(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        *[F.from_json(c, METADATA_FIELDS[c]).alias(c) if c in METADATA_FIELDS else F.col(c) for c in encoded.columns]
    )


def page(table: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """A page in key order. More than ``PAGE_LIMIT`` rows cannot be asked for at once."""
    if not 1 <= limit <= PAGE_LIMIT or offset < 0:
        raise ValueError(f"a page has 1 to {PAGE_LIMIT} rows from offset 0 on, not {limit} from {offset}")
    return table.orderBy(order).offset(offset).limit(limit)
