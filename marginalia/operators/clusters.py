"""Exact cosine top-k that leaves out whole clusters of vectors.

Vectors are grouped around centres by k-means. Angles between unit vectors obey the triangle
inequality: a vector at angle ``a`` from a centre lies at least ``|t - a|`` from a question at angle
``t`` from that centre. So the range of angles of a cluster bounds the best similarity it can hold,
and a vector's own angle bounds it alone. Questions first score their most promising clusters; the
k-th similarity found there rules out the rest, but for what may still hold a better vector, which is
scored next. Nothing is approximate: the centres only decide how much is left out.

Only the centres are fitted on a sample, of at most ``SAMPLE_ROWS`` vectors; every vector is assigned.
The table lies in ranges of (cluster, angle, key), so a cluster of a third of all rows is spread over
many tasks, and clusters that are not asked for are skipped by the file statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import constants as K
from marginalia.functions.vectors import TopK, complete, matrix, tiles
from marginalia.operators.retrieval import BROADCAST_BYTES, top_k
from marginalia.session import configure, materialize

SAMPLE_ROWS = 20_000
MOST_CLUSTERS = 1024
SLACK = 2e-6  # radians and similarity; above the error of rounding to six digits


@dataclass(frozen=True)
class Clustered:
    """rows: (key, vector, cluster, angle), written. centres: unit vectors. spans: per cluster the
    least and largest angle and the number of vectors."""

    rows: DataFrame
    key: str
    vector: str
    centres: np.ndarray
    spans: np.ndarray


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def fit_centres(rows: DataFrame, key: str, vector: str = "embedding", n_clusters: int | None = None, seed: int = 7) -> np.ndarray:
    """Unit centres of the vectors, about the root of their number of them, from a bounded sample."""
    there = rows.where(F.exists(vector, lambda x: x != 0))
    n = there.count()
    wanted = min(n_clusters or max(1, round(n**0.5)), MOST_CLUSTERS, max(n, 1))
    sample = there.select(key, vector).orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS)
    sample = materialize(sample.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features")), "cluster-sample")
    if wanted < 2:
        dim = rows.select(F.max(F.size(vector))).first()[0] or 1
        return np.eye(1, dim)
    model = KMeans(k=wanted, seed=seed, maxIter=8, initMode="random", distanceMeasure="cosine").fit(sample)
    return _unit(np.array(model.clusterCenters()))


def build(rows: DataFrame, key: str, vector: str = "embedding", n_clusters: int | None = None, centres: np.ndarray | None = None) -> Clustered:
    """Assign every vector to its nearest centre. Rows without a whole vector take no part, as in
    ``vector_topk``; a zero vector lies at a right angle to everything. With ``centres`` of an
    earlier build nothing is fitted."""
    configure(rows.sparkSession)
    dim = rows.agg(F.coalesce(F.mode(F.when(F.size(vector) > 0, F.size(vector)), True), F.lit(0))).first()[0]
    whole = rows.where(complete(vector, dim)).select(key, vector)
    if centres is None:
        centres = fit_centres(whole, key, vector, n_clusters)
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # at most MOST_CLUSTERS vectors

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        for batch in batches:
            vectors = matrix(batch.column(1))
            best, angle = np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            for tile in tiles(len(middle), len(vectors)):
                near = vectors[tile] @ middle.T
                best[tile] = near.argmax(axis=1)
                angle[tile] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(angle)], [key, vector, "cluster", "angle"])

    fields = [*whole.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("angle", T.DoubleType())]
    assigned = whole.mapInArrow(nearest, T.StructType(fields))
    placed = materialize(assigned, "assigned").repartitionByRange("cluster", "angle", key).sortWithinPartitions("cluster", "angle")
    placed = materialize(placed, "clusters")
    found = placed.groupBy("cluster").agg(F.min("angle"), F.max("angle"), F.count(F.lit(1))).collect()  # a row a centre
    spans = np.zeros((len(centres), 3))
    for cluster, low, high, n in found:
        spans[cluster] = low, high, n
    return Clustered(placed, key, vector, centres, spans)


@dataclass(frozen=True)
class Nearest:
    """hits: (query, key, similarity, rk). scored: (query, scored), vectors that were compared."""

    hits: DataFrame
    scored: DataFrame


def _bounds(angles: np.ndarray, spans: np.ndarray) -> np.ndarray:
    apart = np.maximum(np.maximum(angles - spans[:, 1], spans[:, 0] - angles), 0)
    return np.where(spans[:, 2] > 0, np.cos(np.minimum(apart, np.pi)), -np.inf)


def _first(bounds: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Per question its best clusters, until they hold k vectors; two at least."""
    order = np.argsort(-bounds, axis=1, kind="stable")
    before = np.cumsum(counts[order], axis=1) - counts[order]
    chosen = (before < k) | (np.arange(bounds.shape[1]) < 2)
    out = np.zeros(bounds.shape, bool)
    np.put_along_axis(out, order, chosen, axis=1)
    return out & np.isfinite(bounds)


def _scan(index: Clustered, side: tuple, schema: T.StructType, k: int) -> DataFrame:
    """Best k of the asked clusters per question and task, and a row without key that says how many
    vectors were compared. ``side`` is (ids, unit vectors, angles to centres, asked, farthest), where
    ``farthest`` is the largest angle at which a vector can still count."""
    asked_clusters = [int(c) for c in np.flatnonzero(side[3].any(axis=0))]
    rows = index.rows.where(F.col("cluster").isin(asked_clusters)) if asked_clusters else index.rows.where(F.lit(False))
    shared = index.rows.sparkSession.sparkContext.broadcast(side)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted, angles, asked, farthest = shared.value
        best, compared = TopK(len(ids), k), np.zeros(len(ids))
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), dtype=object)
            vectors, cluster = matrix(batch.column(1)), batch.column(2).to_numpy()
            own = batch.column(3).to_numpy()
            for c in np.unique(cluster):
                who, here = np.flatnonzero(asked[:, c]), np.flatnonzero(cluster == c)
                for tile in tiles(len(who), len(here)):
                    may = np.abs(angles[who, c][:, None] - own[here[tile]]) <= farthest[who][:, None]
                    some, rest = may.any(axis=0), may.any(axis=1)
                    if some.any():
                        chosen, asking = here[tile][some], who[rest]
                        best.add(np.round(wanted[asking] @ vectors[chosen].T, 6), keys[chosen], asking)
                        compared[asking] += len(chosen)
        sizes = [len(s) for s in best.scores]
        q = np.concatenate([np.repeat(np.arange(len(ids)), sizes), np.flatnonzero(compared)]).astype(int)
        found = [x for part in best.ids for x in part] + [None] * int((compared > 0).sum())
        values = np.concatenate([*best.scores, compared[compared > 0]])
        kinds = [f.dataType.simpleString() for f in schema]
        arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in q], arrow[kinds[0]]), pa.array(found, arrow[kinds[1]]), pa.array(values, pa.float64())], [f.name for f in schema]
        )

    return rows.select(index.key, index.vector, "cluster", "angle").mapInArrow(scan, schema)


def topk(
    index: Clustered, queries: DataFrame, query_id: str, vector: str = "embedding", k: int = K.VECTOR_TOP_K,
    min_similarity: float | None = K.MIN_SIMILARITY, broadcast_bytes: int = BROADCAST_BYTES,
) -> Nearest:
    """The same rows as ``retrieval.vector_topk`` over the indexed vectors. Questions whose matrix,
    with its angles to the centres, is larger than ``broadcast_bytes`` are answered in passes of
    that size. Keys are not null and query ids are not repeated."""
    dim = index.centres.shape[1]
    asked = queries.where(complete(vector, dim)).select(query_id, vector)
    schema = T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(index.key, index.rows.schema[index.key].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])
    passes = max(1, -(-asked.count() * (dim + 2 * len(index.centres)) * 8 // broadcast_bytes))
    order = [F.desc("similarity"), F.asc(index.key)]
    results = []
    for i in range(passes):
        table = asked.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == i).toArrow()
        if not table.num_rows:
            continue
        ids, wanted = np.array(table[query_id].to_pylist(), dtype=object), matrix(table[vector].combine_chunks())
        angles = np.arccos(np.clip(wanted @ index.centres.T, -1, 1))
        bounds = _bounds(angles, index.spans)
        first = _first(bounds, index.spans[:, 2], k)
        early = materialize(_scan(index, (ids, wanted, angles, first, np.full(len(ids), np.pi + 1)), schema, k), "first-clusters")
        ranked = top_k(early.where(F.col(index.key).isNotNull()), query_id, order, k)
        least = dict(ranked.where(F.col("rk") == k).select(query_id, "similarity").collect())  # a number per question of the pass
        floor = np.array([least.get(q, -np.inf) for q in ids])
        if min_similarity is not None:
            floor = np.maximum(floor, min_similarity)
        rest = ~first & (bounds + SLACK >= floor[:, None])
        farthest = np.where(floor > -1, np.arccos(np.clip(floor - SLACK, -1, 1)) + SLACK, np.pi + 1)
        late = materialize(_scan(index, (ids, wanted, angles, rest, farthest), schema, k), "clusters-left")
        results.append(early.unionByName(late))
    both = results[0] if results else queries.sparkSession.createDataFrame([], schema)
    for more in results[1:]:
        both = both.unionByName(more)
    hits = top_k(both.where(F.col(index.key).isNotNull()), query_id, order, k)
    if min_similarity is not None:
        hits = hits.where(F.col("similarity") >= min_similarity)
    scored = both.where(F.col(index.key).isNull()).groupBy(query_id).agg(F.sum("similarity").cast("long").alias("scored"))
    return Nearest(hits, scored)
