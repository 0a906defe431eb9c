"""Retrieval over a corpus for many queries at once: BM25, cosine, rank fusion.

A corpus frame has one row per chunk with a key column; query frames have one row per
query. Every list is ranked by rounded score, then key, so results do not depend on
partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions import constants as K
from marginalia.functions import text as X
from marginalia.functions.vectors import TopK, complete, matrix, nearest, tiles
from marginalia.session import literal_rows, materialize

# the query matrix is shared with every task up to this size; beyond it both sides are blocked
BROADCAST_BYTES = 64 * 1024 * 1024
VECTOR_BLOCK_ROWS = 20_000
SHARED_QUERIES = 4_096  # more questions than that do not have a list of their own in every task


# --- lexical --------------------------------------------------------------------------


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """(query, term, weight): one row per distinct term; a repeated word counts again.

    A word that tokenises to several tokens is a phrase: its term is the tokens joined by
    a space, which meets the corpus as an n-gram.
    """
    word = F.explode(X.query_words(F.col(text))).alias("word")
    return (
        queries.select(F.col(query_id), word)
        .select(query_id, F.array_join(X.tokens(F.col("word")), " ").alias("term"))
        .where("term != ''")
        .groupBy(query_id, "term")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def phrase_lengths(terms: DataFrame) -> tuple[int, ...]:
    """Lengths, in tokens, that occur among the query terms."""
    sizes = terms.select(F.size(F.split("term", " ")).alias("n")).distinct().collect()
    return tuple(sorted({1, *(r["n"] for r in sizes)}))


def _grams(tokens: Column, lengths: tuple[int, ...]) -> Column:
    """All runs of tokens of the given lengths."""
    out = []
    for n in lengths:
        starts = F.sequence(F.lit(1), F.size(tokens) - F.lit(n - 1))
        grams = tokens if n == 1 else F.transform(starts, lambda i, n=n: F.array_join(F.slice(tokens, i, n), " "))
        out.append(F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>")))
    return F.concat(*out)


def tokenized(corpus: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, one token array per field, dl): dl counts the tokens of all fields."""
    parts = [X.tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"_t{i}") for i, f in enumerate(fields)]
    length = sum((F.size(f"_t{i}") for i in range(1, len(fields))), F.size("_t0"))
    return corpus.select(key, *parts).withColumn("dl", length.cast("long"))


# a term no text can hold: one such row per chunk carries the chunk's length
_CHUNK = "\x00chunk"


def postings(
    corpus: DataFrame, key: str, fields: list[str], lengths: tuple[int, ...] = (1,), vocabulary: DataFrame | None = None
) -> DataFrame:
    """Inverted index rows (key, dl, term, tf).

    All tokens of one row are in one task, so the map-side combine already gives final
    counts and the shuffle moves one row per (chunk, term). With a vocabulary only its
    terms are kept, before any shuffle.
    """
    toks = tokenized(corpus, key, fields)
    grams = F.concat(*[_grams(F.col(f"_t{i}"), lengths) for i in range(len(fields))])
    rows = toks.select(key, "dl", F.explode(grams).alias("term"))
    if vocabulary is not None:
        rows = rows.join(vocabulary.select("term").distinct(), "term", "left_semi")
    return rows.groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_index(corpus: DataFrame, key: str, fields: list[str], terms: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Index rows for the terms of a batch of queries, plus one length row per chunk.

    Written once to the shared folder: lengths, document counts and scores all read it, so
    the corpus text is read and cut into words a single time. Terms are counted where the text
    is read; what is shuffled is one row per (chunk, term).
    """
    toks = tokenized(corpus, key, fields)
    grams = F.concat(*[_grams(F.col(f"_t{i}"), lengths) for i in range(len(fields))], F.array(F.lit(_CHUNK)))
    wanted = terms.select("term").distinct().union(literal_rows(terms.sparkSession, [(_CHUNK,)], ["term"]))
    rows = (
        toks.select(key, "dl", F.explode(grams).alias("term"))
        .join(wanted, "term", "left_semi")
        .groupBy(key, "dl", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    return materialize(rows, "postings")


def corpus_stats(index: DataFrame) -> DataFrame:
    """(n_docs, avg_dl) from the length rows of a query index."""
    return index.where(F.col("term") == _CHUNK).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))


def term_stats(index: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf); the idf never falls below a small positive floor."""
    n = stats.select("n_docs").scalar()
    df = index.where(F.col("term") != _CHUNK).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.select("term", "df", F.when(idf > 0, idf).otherwise(F.lit(K.BM25_IDF_FLOOR)).alias("idf"))


def top_k(df: DataFrame, query_id: str, order: list[Column], k: int, rank: str = "rk") -> DataFrame:
    """Best k rows per query; Spark prunes each partition to k rows before the shuffle."""
    w = Window.partitionBy(query_id).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _counted(corpus: DataFrame, key: str, fields: list[str], vocabulary: list[str], lengths: tuple[int, ...]) -> DataFrame:
    """(key, dl, found): the terms of the vocabulary in every row, counted where the text is read.

    ``found`` holds numbers of terms and their counts, so an index row is one row per chunk and
    nothing is shuffled, whatever the number of words.
    """
    toks = tokenized(corpus, key, fields)
    grams = F.concat(*[_grams(F.col(f"_t{i}"), lengths) for i in range(len(fields))])
    shared = corpus.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([corpus.schema[key], *T.StructType.fromDDL("dl long, found array<struct<term:int,tf:long>>")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(shared.value, type=pa.string())
        for batch in batches:
            lists = batch.column(2)
            words = lists.flatten()
            numbers = pc.index_in(words.cast(pa.string()), known)
            there = pc.is_valid(numbers).to_numpy(zero_copy_only=False)
            rows = pc.list_parent_indices(lists).to_numpy()[there]
            pairs, tf = np.unique(rows.astype(np.int64) * len(known) + numbers.drop_null().to_numpy(), return_counts=True)
            at = np.searchsorted(pairs, np.arange(batch.num_rows + 1, dtype=np.int64) * len(known))
            found = pa.StructArray.from_arrays(
                [pa.array((pairs % max(len(known), 1)).astype(np.int32)), pa.array(tf.astype(np.int64))], names=["term", "tf"]
            )
            found = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=[key, "dl", "found"])

    return materialize(toks.select(key, "dl", grams.alias("_g")).mapInArrow(count, schema), "counted")


def _scan_topk(index: DataFrame, asked: pa.Table, avg_dl: float, n_terms: int, key: str, query_id: str, k: int, schema: T.StructType) -> DataFrame:
    """The k best rows per question and task of an index of one row per key."""
    asked = asked.sort_by("term")
    starts = np.searchsorted(asked["term"].to_numpy(), np.arange(n_terms + 1))
    numbers = {q: i for i, q in enumerate(dict.fromkeys(asked[query_id].to_pylist()))}
    names = np.array([*numbers, None], dtype=object)[:-1]
    query = np.array([numbers[q] for q in asked[query_id].to_pylist()], dtype=np.int64)
    shared = index.sparkSession.sparkContext.broadcast((names, query, asked["w"].to_numpy(), starts))
    out = _arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, query, weight, starts = shared.value
        best = TopK(len(names), k)
        for batch in batches:
            lists = batch.column(2)
            keys = np.array(batch.column(0).to_pylist(), dtype=object)
            found = lists.flatten()
            rows = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            term, tf = found.field("term").to_numpy(), found.field("tf").to_numpy().astype(np.float64)
            dl = batch.column(1).to_numpy().astype(np.float64)[rows]
            part = tf * (K.BM25_K1 + 1) / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * dl / avg_dl))
            met = starts[term + 1] - starts[term]  # questions a posting meets
            ends = np.concatenate([[0], np.cumsum(met)])
            for tile in _row_tiles(rows, ends, batch.num_rows, len(names)):
                a, b = np.searchsorted(rows, [tile.start, tile.stop])
                width = tile.stop - tile.start
                posting = np.repeat(np.arange(a, b), met[a:b])
                at = starts[term[posting]] + np.arange(ends[a], ends[b]) - ends[posting]
                cell = query[at] * width + (rows[posting] - tile.start)
                scores = np.bincount(cell, weights=weight[at] * part[posting], minlength=len(names) * width)
                hit = np.bincount(cell, minlength=len(names) * width) > 0
                scores = np.where(hit, np.round(scores, 6), -np.inf).reshape(len(names), width)
                best.add(scores, keys[tile])
        yield _emit(best, names, out)

    return index.mapInArrow(scan, schema)


def _row_tiles(rows: np.ndarray, ends: np.ndarray, n_rows: int, n_queries: int, most: int = 4 << 20) -> Iterator[slice]:
    """Slices of rows with at most ``most`` cells, and as many meetings of postings and questions
    unless a single row has more."""
    step = max(1, most // max(n_queries, 1))
    first = ends[np.searchsorted(rows, np.arange(n_rows + 1))]  # meetings before each row
    a = 0
    while a < n_rows:
        b = int(np.searchsorted(first, first[a] + most, side="right")) - 1
        b = min(max(b, a + 1), a + step, n_rows)
        yield slice(a, b)
        a = b


def bm25_topk(
    corpus: DataFrame,
    queries: DataFrame,
    key: str,
    fields: list[str],
    query_id: str,
    text: str,
    k: int = K.LEXICAL_TOP_K,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(query, key, score, rk) by BM25 over all fields of the chunk.

    While the terms of all questions are small enough to share, every row is scored where it lies
    and a task returns k rows per question. Beyond that index rows and questions are joined by term,
    and so are rows whose key is not theirs alone: their counts are added up first.
    """
    terms = materialize(query_terms(queries, query_id, text), "asked-terms")
    lengths = phrase_lengths(terms)
    best = [F.desc("score"), F.asc(key)]
    size = terms.agg(F.coalesce(F.sum(F.length("term") + 40), F.lit(0))).first()[0]
    plain = all(df.schema[c].dataType.simpleString() in _ARROW for df, c in ((queries, query_id), (corpus, key)))
    if size > broadcast_bytes or not plain:
        index = query_index(corpus, key, fields, terms, lengths)
        stats = corpus_stats(index)
        return top_k(_joined_scores(index, terms.join(term_stats(index, stats), "term"), stats, query_id, key), query_id, best, k)

    vocabulary = [r[0] for r in terms.select("term").distinct().orderBy("term").collect()]
    counted = _counted(corpus, key, fields, vocabulary, lengths)
    shared = counted.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).select(F.col(key).alias("_k"))
    shared = materialize(shared, "shared-keys")
    same = F.col(key).eqNullSafe(F.col("_k"))
    alone, joint = counted, None
    if not shared.isEmpty():
        alone, several = counted.join(shared, same, "left_anti"), counted.join(shared, same, "left_semi")
        # an index row without a term stands for the length of the chunk
        found = several.select(key, "dl", F.explode(F.concat("found", F.array(F.struct(F.lit(-1).alias("term"), F.lit(1).cast("long").alias("tf"))))).alias("_f"))
        joint = materialize(found.groupBy(key, "dl", F.col("_f.term").alias("term")).agg(F.sum("_f.tf").alias("tf")), "joint-keys")

    numbers = terms.sparkSession.createDataFrame(list(zip(vocabulary, range(len(vocabulary)))), "term string, no int")
    rows = alone.select("dl")
    df = alone.select(F.explode("found.term").alias("term"))
    if joint is not None:
        rows = rows.unionByName(joint.where("term = -1").select("dl"))
        df = df.unionByName(joint.where("term >= 0").select("term"))
    stats = rows.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl")).first()
    idf = F.log((stats["n_docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = df.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = df.select(F.col("term").alias("no"), F.when(idf > 0, idf).otherwise(F.lit(K.BM25_IDF_FLOOR)).alias("idf"))
    weighted = terms.join(numbers, "term").join(df, "no").select(
        query_id, F.col("no").alias("term"), (F.col("weight") * F.col("idf")).alias("w")
    )
    weighted = materialize(weighted, "weighted")
    schema = T.StructType([queries.schema[query_id], corpus.schema[key], T.StructField("score", T.DoubleType())])
    avg_dl = stats["avg_dl"] or 1.0
    scored = _scan_topk(alone, weighted.toArrow(), avg_dl, len(vocabulary), key, query_id, k, schema)
    if joint is not None:
        weights = weighted.select(query_id, "term", F.col("w").alias("weight"), F.lit(1.0).alias("idf"))
        scored = scored.unionByName(_joined_scores(joint, weights, None, query_id, key, avg_dl))
    return top_k(scored, query_id, best, k)


def _joined_scores(index: DataFrame, weighted: DataFrame, stats: DataFrame | None, query_id: str, key: str, avg_dl: float | None = None) -> DataFrame:
    mean = F.lit(avg_dl) if stats is None else stats.select("avg_dl").scalar()
    tf = F.col("tf").cast("double")
    part = (
        F.col("weight")
        * F.col("idf")
        * tf
        * (K.BM25_K1 + 1)
        / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * F.col("dl") / mean))
    )
    return (
        index.join(weighted, "term")
        .groupBy(query_id, key)
        .agg(F.round(F.sum(part), 6).alias("score"))
    )


# --- vectors --------------------------------------------------------------------------


def _result_schema(chunks: DataFrame, queries: DataFrame, key: str, query_id: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(query_id, queries.schema[query_id].dataType),
            T.StructField(key, chunks.schema[key].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )


def _emit(best: TopK, query_ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    sizes = [len(s) for s in best.scores]
    columns = [
        np.repeat(query_ids, sizes).tolist(),
        np.concatenate(best.ids).tolist() if sizes else [],
        np.concatenate(best.scores).tolist() if sizes else [],
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in schema])


def _streamed_topk(chunks, queries, key, query_id, vector, k, schema):
    """Small query side: one pass over the chunks, no shuffle but the final k-row lists."""
    table = queries.select(query_id, vector).toArrow()
    side = (
        np.array(table[query_id].to_pylist(), dtype=object),
        matrix(table[vector].combine_chunks()),
    )
    shared = chunks.sparkSession.sparkContext.broadcast(side)
    out = _arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted = shared.value
        best = TopK(len(ids), k)
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column(1))
                keys = np.array(batch.column(0).to_pylist(), dtype=object)
                for tile in tiles(len(ids), len(keys)):
                    best.add(np.round(wanted @ rows[tile].T, 6), keys[tile])
        yield _emit(best, ids, out)

    return chunks.select(key, vector).mapInArrow(scan, schema)


def _blocked_topk(chunks, queries, key, query_id, vector, k, schema, block_rows, dim, n_queries):
    """Large query side: both sides cut into bounded blocks by key hash; a task holds one
    block of each and returns only its k best rows per query."""
    # k rows a query and block of chunks are shuffled, so these blocks are as large as memory allows
    wider = min(8, max(1, BROADCAST_BYTES // (8 * max(dim, 1) * VECTOR_BLOCK_ROWS)))
    n_chunks = max(1, -(-chunks.count() // (block_rows * wider)))
    enough = -(-2 * chunks.sparkSession.sparkContext.defaultParallelism // n_chunks)  # blocks for all cores
    n_blocks = max(1, -(-n_queries // block_rows), min(enough, -(-n_queries // 1000)))

    def block_of(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    left = queries.select(
        F.col(query_id),
        F.col(vector).alias("_qv"),
        block_of(query_id, n_blocks).alias("_qb"),
        F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("_cb"),
    )
    right = chunks.select(
        F.col(key),
        F.col(vector).alias("_cv"),
        block_of(key, n_chunks).alias("_cb"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_qb"),
    )
    out = _arrow_schema(schema)

    def score(query_block: pa.Table, chunk_block: pa.Table) -> pa.Table:
        if not query_block.num_rows or not chunk_block.num_rows:
            return out.empty_table()
        chunk_block = chunk_block.take(pc.sort_indices(chunk_block, sort_keys=[(key, "ascending")], null_placement="at_start"))
        wanted = matrix(query_block["_qv"].combine_chunks())
        rows = matrix(chunk_block["_cv"].combine_chunks())
        asked, row, similarity = nearest(wanted, rows, k)
        return pa.Table.from_arrays([query_block[query_id].take(asked), chunk_block[key].take(row), pa.array(similarity)], names=out.names).cast(out)

    return left.groupBy("_qb", "_cb").cogroup(right.groupBy("_qb", "_cb")).applyInArrow(score, schema)


def _dimension(queries: DataFrame, vector: str) -> int:
    return queries.agg(F.coalesce(F.mode(F.when(F.size(vector) > 0, F.size(vector)), True), F.lit(0))).first()[0]


def incomplete_vectors(rows: DataFrame, queries: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, size) of rows whose vector is missing, has nulls or another size than the questions'."""
    return rows.where(~complete(vector, _dimension(queries, vector))).select(key, F.size(vector).alias("size"))


def vector_topk(
    chunks: DataFrame,
    queries: DataFrame,
    key: str,
    query_id: str,
    vector: str = "embedding",
    k: int = K.VECTOR_TOP_K,
    min_similarity: float | None = K.MIN_SIMILARITY,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = VECTOR_BLOCK_ROWS,
) -> DataFrame:
    """(query, key, similarity, rk): exact cosine top-k, then the similarity gate.

    The query matrix is shared with every task only while its measured size is small, and so are
    the lists that every task keeps; beyond that both sides are joined block by block. Rows without a whole vector of the
    questions' size take no part; ``incomplete_vectors`` lists them.
    """
    schema = _result_schema(chunks, queries, key, query_id)
    dim = _dimension(queries, vector)
    chunks, queries = chunks.where(complete(vector, dim)), queries.where(complete(vector, dim))
    n_queries = queries.count()
    if n_queries * dim * 8 <= broadcast_bytes and n_queries <= SHARED_QUERIES:
        hits = _streamed_topk(chunks, queries, key, query_id, vector, k, schema)
    else:
        hits = _blocked_topk(chunks, queries, key, query_id, vector, k, schema, block_rows, dim, n_queries)
    ranked = top_k(hits, query_id, [F.desc("similarity"), F.asc(key)], k)
    return ranked if min_similarity is None else ranked.where(F.col("similarity") >= min_similarity)


# --- fusion ---------------------------------------------------------------------------


def fuse(lexical: DataFrame, dense: DataFrame, query_id: str, key: str, k: int = K.FUSED_TOP_K) -> DataFrame:
    """Reciprocal-rank fusion: (query, key, similarity, bm25, rrf, rk).

    A list that does not hold the chunk adds nothing; its score reads 0.
    """
    lex = lexical.select(query_id, key, F.col("score").alias("bm25"), F.col("rk").alias("_lex"))
    den = dense.select(query_id, key, "similarity", F.col("rk").alias("_den"))

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (F.lit(K.RRF_K) + F.col(rank)), F.lit(0.0))

    both = den.join(lex, [query_id, key], "full_outer").select(
        query_id,
        key,
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("bm25", F.lit(0.0)).alias("bm25"),
        F.round(share("_den") + share("_lex"), 10).alias("rrf"),
    )
    return top_k(both, query_id, [F.desc("rrf"), F.asc(key)], k)


def hybrid(
    corpus: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    key: str,
    fields: list[str],
    query_id: str,
    text: str,
    vector: str = "embedding",
    k: int = K.FUSED_TOP_K,
) -> DataFrame:
    """BM25 and cosine lists of every query, fused. Queries without a vector rank by text only."""
    lexical = bm25_topk(corpus, queries, key, fields, query_id, text)
    dense = vector_topk(vectors, queries.where(F.col(vector).isNotNull()), key, query_id, vector)
    return fuse(lexical, dense, query_id, key, k)
