"""Boundaries where a user's model meets the engine: embedders, scorers, extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import text as X


def embed(text: Column, make_embedder: Callable[[], Callable[[list[str]], list]]) -> Column:
    """Vectors from a user embedder, loaded once per task and called once per batch."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make_embedder()
        for batch in batches:
            yield pd.Series([[float(v) for v in vec] for vec in embedder(batch.tolist())])

    return run(text)


def hash_embed(df: DataFrame, text: str, dim: int = 256, out: str = "embedding") -> DataFrame:
    """Deterministic unit vectors from hashed word counts, without leaving the JVM."""
    with_tokens = df.withColumn("_tok", X.tokens(F.col(text)))
    counted = HashingTF(numFeatures=dim, inputCol="_tok", outputCol="_tf").transform(with_tokens)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_tok", "_tf", "_unit")


_OUTCOME = T.StructType(
    [
        T.StructField("ok", T.BooleanType()),
        T.StructField("value", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def extract(prompt: Column, make_model: Callable[[], Callable[[str], str]]) -> Column:
    """Text replies of a user model as struct(ok, value, error); a failing row fails alone."""

    @F.pandas_udf(_OUTCOME)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for batch in batches:
            rows = []
            for prompt_text in batch:
                try:
                    rows.append((True, model(prompt_text), None))
                except Exception as exc:  # the user's code may raise anything
                    rows.append((False, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(rows, columns=["ok", "value", "error"])

    return run(prompt)
