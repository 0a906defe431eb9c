"""Clustered top-k against the plain scan: same rows, fewer vectors compared."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.operators import clusters, retrieval

VEC = "array<float>"


def pairs(df, q, key):
    return sorted((r[q], r[key], r.similarity, r.rk) for r in df.collect())


@pytest.mark.parametrize("gate,bytes_", [(None, 1 << 26), (0.3, 1 << 26), (None, 2000)])
def test_same_rows_as_the_plain_scan(spark, gate, bytes_):
    rng = random.Random(3)
    vec = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    rows = [(i, vec()) for i in range(300)] + [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(300, 500)]  # a hot direction of ties
    rows += [(900, None), (901, [1.0]), (902, [1.0, None, 0.0, 0.0]), (903, [0.0] * 4)]
    asked = [(i, vec()) for i in range(15)] + [(98, [0.0] * 4), (99, None)]
    chunks = spark.createDataFrame(rows, f"id long, embedding {VEC}").repartition(4)
    queries = spark.createDataFrame(asked, f"q long, embedding {VEC}")
    want = retrieval.vector_topk(chunks, queries, "id", "q", k=7, min_similarity=gate)
    got = clusters.topk(clusters.build(chunks, "id"), queries, "q", k=7, min_similarity=gate, broadcast_bytes=bytes_)
    assert pairs(got.hits, "q", "id") == pairs(want, "q", "id")


def test_clusters_that_cannot_matter_are_not_compared(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(25, 16))
    points = np.repeat(middles, 80, axis=0) + rng.normal(scale=0.08, size=(2000, 16))
    chunks = spark.createDataFrame([(f"c{i:05d}", p.tolist()) for i, p in enumerate(points)], f"id string, embedding {VEC}")
    queries = chunks.where(F.substring("id", 5, 2) == "07").select(F.col("id").alias("q"), "embedding")
    index = clusters.build(chunks, "id", n_clusters=40)
    got = clusters.topk(index, queries, "q", k=10)
    assert pairs(got.hits, "q", "id") == pairs(retrieval.vector_topk(chunks, queries, "id", "q", k=10), "q", "id")
    scored = [r.scored for r in got.scored.collect()]
    assert len(scored) == queries.count() and sum(scored) < 0.25 * 2000 * len(scored)
    # later rows join the same centres
    again = clusters.build(chunks, "id", centres=index.centres)
    assert (again.spans[:, 2] == index.spans[:, 2]).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], f"id long, embedding {VEC}")
    some = spark.createDataFrame([(1, [1.0, 0.0])], f"id long, embedding {VEC}")
    ask = spark.createDataFrame([(1, [1.0, 0.0])], f"q long, embedding {VEC}")
    assert clusters.topk(clusters.build(none, "id"), ask, "q").hits.count() == 0
    assert clusters.topk(clusters.build(some, "id"), ask.limit(0), "q").hits.count() == 0
    assert [tuple(r) for r in clusters.topk(clusters.build(some, "id"), ask, "q").hits.select("q", "id", "rk").collect()] == [(1, 1, 1)]
