import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import constants as K
from marginalia.functions.vectors import nearest
from marginalia.operators import evaluate, ranking, retrieval
from marginalia.plans.registry import Tables
from marginalia.session import deal


def bm25(spark, docs, question, k=10):
    corpus = spark.createDataFrame(docs, "id int, title string, text string")
    queries = spark.createDataFrame([(1, question)], "q int, question string")
    rows = retrieval.bm25_topk(corpus, queries, "id", ["title", "text"], "q", "question", k).orderBy("rk").collect()
    return [(r.id, r.score) for r in rows]


def test_bm25_formula(spark):
    docs = [(1, "a", "red fox red"), (2, "b", "blue fox"), (3, "c", "green"), (4, "d", "grey")]
    got = dict(bm25(spark, docs, "red"))
    idf = math.log((4 - 1 + 0.5) / (1 + 0.5))
    avg = (4 + 3 + 2 + 2) / 4
    want = idf * 2 * 2.2 / (2 + 1.2 * (1 - 0.75 + 0.75 * 4 / avg))
    assert got == {1: pytest.approx(want, abs=1e-6)}
    # a word asked twice counts twice; accents and case do not matter
    assert dict(bm25(spark, docs, "RÉD red"))[1] == pytest.approx(2 * want, abs=2e-6)


def test_common_words_keep_a_floor(spark):
    docs = [(i, "t", "same words") for i in range(3)]
    got = bm25(spark, docs, "same")
    assert [i for i, _ in got] == [0, 1, 2] and all(s >= 0 for _, s in got)


def test_phrases_need_neighbours_in_one_field(spark):
    docs = [(1, "x", "state of the-art work"), (2, "the", "art is long"), (3, "x", "art the")]
    assert [i for i, _ in bm25(spark, docs, "the/art")] == [1]


def test_empty_question_finds_nothing(spark):
    assert bm25(spark, [(1, "a", "b")], "\"' ()") == []


@pytest.mark.parametrize("ids", ["int", "string"])
def test_vector_plans_agree_with_brute_force(spark, ids):
    rng = random.Random(3)
    vec = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    name = (lambda i: f"c{i:03d}") if ids == "string" else (lambda i: i)
    chunks = [(name(i), vec()) for i in range(150)]
    queries = [(f"q{i}", vec()) for i in range(12)]
    cs = spark.createDataFrame(chunks, f"chunk {ids}, embedding array<float>").repartition(5)
    qs = spark.createDataFrame(queries, "q string, embedding array<float>")

    def cosine(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 6) if na and nb else 0.0

    want = set()
    for q, v in queries:
        best = sorted(((-cosine(v, e), c) for c, e in chunks))[:7]
        want |= {(q, c, -s, n + 1) for n, (s, c) in enumerate(best)}
    for options in ({}, {"broadcast_bytes": 0, "block_rows": 40}, {"broadcast_bytes": 0, "block_rows": 5}):
        rows = retrieval.vector_topk(cs, qs, "chunk", "q", k=7, min_similarity=None, **options).collect()
        assert {(r.q, r.chunk, r.similarity + 0.0, r.rk) for r in rows} == {(q, c, s + 0.0, k) for q, c, s, k in want}
    gated = retrieval.vector_topk(cs, qs, "chunk", "q", k=7, min_similarity=0.9).collect()
    assert {(r.q, r.chunk) for r in gated} == {(q, c) for q, c, s, _ in want if s >= 0.9}


def test_fusion_of_two_first_places(spark):
    lex = spark.createDataFrame([(1, "a", 3.0, 1), (1, "b", 2.0, 2)], "q int, c string, score double, rk int")
    den = spark.createDataFrame([(1, "a", 0.9, 1), (1, "z", 0.8, 2)], "q int, c string, similarity double, rk int")
    rows = {r.c: r for r in retrieval.fuse(lex, den, "q", "c").collect()}
    assert rows["a"].rrf == pytest.approx(2 / 61, abs=1e-9) and rows["a"].rk == 1
    assert rows["b"].similarity == 0.0 and rows["z"].bm25 == 0.0
    assert (rows["b"].rk, rows["z"].rk) == (2, 3)


def test_four_labels(spark):
    cands = spark.createDataFrame(
        [(1, 0.2, 9.0), (1, 0.9, 6.0), (2, 0.9, 2.0), (2, 0.1, 9.0), (3, 0.1, 4.9), (3, 0.7, 2.0)],
        "q int, similarity double, rerank_score double",
    )
    queries = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "q int")
    got = {r.q: r.label for r in ranking.labels(queries, cands, "q").collect()}
    assert got == {1: "PASS", 2: "HALLUCINATION_RISK", 3: "IRRELEVANT", 4: "NO_RESULTS"}


@pytest.mark.parametrize(
    "raw,want",
    [
        ("[8, 2.5]", [8.0, 2.5]),
        ("Scores: 7 and 3.5", [7.0, 3.5]),
        ("[1, 2, 3]", [1.0, 2.0]),
        ("[1]", [9.0, 1.0]),
        ("nothing", [9.0, 1.0]),
        ('["a", 4]', [9.0, 1.0]),
        ("", [9.0, 1.0]),
    ],
)
def test_score_replies(spark, raw, want):
    df = spark.createDataFrame([(raw, [0.9, 0.1])], "raw string, sims array<double>")
    assert df.select(ranking.parse_scores(F.col("raw"), F.lit(2), F.col("sims")).alias("s")).first().s == want


def test_link_expansion_order_and_cap(spark):
    ranked = spark.createDataFrame(
        [(1, 1, "n1.md", "One", "see [[Two]] and [[Three]] [[nowhere]]"), (1, 2, "n2.md", "Two", "[[four]] [[Three]] [[Five]] [[Six]]")],
        "q int, rk int, note_path string, note_title string, chunk_text string",
    )
    titles = ["One", "Two", "Three", "Four", "Five", "Six"]
    chunks = spark.createDataFrame(
        [(f"n{i + 1}.md", t, n, f"{t}-{n}") for i, t in enumerate(titles) for n in (1, 0)],
        "note_path string, note_title string, chunk_index int, chunk_text string",
    )
    rows = ranking.expand_links(ranked, chunks, "q").orderBy("linked_rank").collect()
    assert [(r.note_title, r.chunk_text, r.linked_from) for r in rows] == [
        ("Three", "Three-0", "One"), ("Four", "Four-0", "Two"), ("Five", "Five-0", "Two"),
    ]
    linked = ranking.expand_links(ranked, chunks, "q")
    full = ranked.withColumns({"note_folder": F.lit("f"), "note_date": F.lit("2024-01-01"), "heading_path": F.array(F.lit("H"), F.lit("I"))})
    text = ranking.context_text(full, linked, "q").first().context
    assert text.startswith("[1] [f] (2024-01-01) One > H > I\nsee ") and "\n\n---\n\n[2] [f]" in text
    assert "CONNECTED NOTES (linked from retrieved results):\n\n[C1] Three (linked from: One)\nThree-0\n\n[C2]" in text


def test_metrics(spark):
    queries = spark.createDataFrame([(i,) for i in (1, 2, 3)], "q int")
    expected = spark.createDataFrame([(1, "a"), (1, "a"), (1, "x"), (2, "b")], "q int, n string")
    retrieved = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (2, "c", 1), (3, "c", 1)], "q int, n string, rk int")
    got = {r.q: r for r in evaluate.per_query(queries, expected, retrieved, "q", "n").collect()}
    assert got[1].recall_at_5 == pytest.approx(2 / 3, abs=1e-6)
    assert (got[1].precision_at_5, got[1].mrr, got[1].passed) == (0.5, 0.5, False)
    assert (got[2].recall_at_5, got[2].mrr) == (0.0, 0.0)
    assert (got[3].recall_at_5, got[3].precision_at_5, got[3].passed) == (1.0, 0.0, True)


def test_passages_found_by_word_groups(spark):
    docs = [(1, "xx one two three four five six yy"), (2, "one two  three four five six"), (3, "zone two three four five sixty")]
    passages = spark.createDataFrame([(7, "one two three four five six")], "p int, passage string")
    got = evaluate.passage_matches(passages, spark.createDataFrame(docs, "d int, text string"), "p", "passage", "d", "text").collect()
    assert {(r.p, r.d) for r in got} == {(7, i) for i, text in docs if "one two three four five six" in text}


def test_notes_keep_the_place_of_their_first_chunk(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "a", 3), (1, "c", 4)], "q int, note string, rk int")
    rows = ranking.dedupe_to_notes(ranked, "q", "note").orderBy("rk").collect()
    assert [(r.note, r.rk) for r in rows] == [("a", 1), ("b", 2), ("c", 3)]


def test_limits_are_the_fixed_values():
    assert (K.LEXICAL_TOP_K, K.VECTOR_TOP_K, K.FUSED_TOP_K, K.RERANK_TOP_N, K.MAX_LINKED, K.RRF_K) == (50, 30, 10, 5, 3, 60)


def test_rows_scored_where_they_lie_equal_rows_joined_by_term(spark):
    rng = random.Random(5)
    words = "ash birch cedar elm fir oak pine yew".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 30))) for i in range(300)] + [(None, text(9)), (None, text(12)), (7, text(5)), (8, rows8 := text(6)), (8, rows8)]
    corpus = spark.createDataFrame(rows, "id long, body string")
    asked = spark.createDataFrame(
        [(1, "oak pine"), (2, "ash-birch elm elm"), (None, "yew"), (4, "nothing"), (5, "fir"), (5, "fir oak")], "q long, question string"
    )
    found = lambda size: sorted((tuple(r) for r in retrieval.bm25_topk(
        corpus, asked, "id", ["body"], "q", "question", 10, broadcast_bytes=size).select("q", "id", "score", "rk").collect()), key=repr)
    assert found(1 << 20) == found(0) and len(found(0)) == 40


def test_the_index_of_a_batch_has_one_row_a_chunk(spark):
    corpus = spark.createDataFrame([(i, "oak pine oak " * 50) for i in range(20)], "id long, body string")
    index = retrieval._counted(corpus, "id", ["body"], ["oak", "yew"], (1,))
    assert {(r.id, r.dl, tuple((f.term, f.tf) for f in r.found)) for r in index.collect()} == {(i, 150, ((0, 100),)) for i in range(20)}
    assert index.count() == 20


@pytest.mark.parametrize("k", [1, 7, 50])
def test_nearest_rows_by_tiles(k):
    rng = np.random.default_rng(5)
    rows = rng.integers(-1, 2, (300, 4)).astype(float)  # many equal similarities
    rows[11] = np.nan
    wanted = rng.integers(-1, 2, (40, 4)).astype(float)
    want = []
    for q, asked in enumerate(wanted):
        scores = sorted((-round(float(asked @ row), 6), r) for r, row in enumerate(rows) if r != 11)[:k]
        want += [(q, r, -s) for s, r in scores]
    for tile in ((512, 4096), (16, 64), (7, 5), (1, 1)):
        assert list(zip(*(c.tolist() for c in nearest(wanted, rows, k, *tile)))) == want
    assert [len(c) for c in nearest(wanted, rows[:0], k)] == [0, 0, 0]


def test_many_questions_have_no_list_in_every_task(spark, monkeypatch):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.random() - 0.5 for _ in range(3)]) for i in range(60)], "id long, embedding array<float>")
    few = retrieval.vector_topk(rows, rows.withColumnRenamed("id", "q"), "id", "q", k=5)
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(retrieval, "SHARED_QUERIES", 10)
    monkeypatch.setattr(retrieval, "_streamed_topk", None)
    many = retrieval.vector_topk(rows, rows.withColumnRenamed("id", "q"), "id", "q", k=5)
    assert sorted(map(tuple, many.collect())) == want


def test_few_rows_do_not_shuffle_all_texts(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(10**6)))))
        spark.range(300).select(
            F.col("id").alias("doc"), F.lit("a.md").alias("note_path"), F.lit("A").alias("note_title"), F.array(F.lit("H")).alias("heading_path"), text.alias("chunk_text")
        ).write.parquet(str(tmp_path / "chunks"))
        chunks = spark.read.parquet(str(tmp_path / "chunks"))
        many = spark.range(100_000).where("id < 3")  # looks large before it is counted
        ranked = many.select(F.lit(1).alias("q"), F.col("id").alias("doc"), F.lit(1).alias("rk"), F.lit(0.5).alias("similarity"), F.lit(0.5).alias("rerank_score"))
        asked = chunks.where("doc < 2").select("doc", F.array_join(F.slice(F.split("chunk_text", " "), 5, 12), " ").alias("passage"))
        asked = asked.join(many, asked.doc == many.id, "left").select(F.col("doc").alias("q"), "passage")
        cited = ranking.citations(ranked, chunks, "q", "doc")
        found = evaluate.passage_matches(asked, chunks, "q", "passage", "doc", "chunk_text")
        for rows in (cited, found):
            last = rows._jdf.queryExecution().sparkPlan().toString()
            assert "BroadcastHashJoin" in last and "SortMergeJoin" not in last
        assert sorted(r.doc for r in cited.collect()) == [0, 1, 2]
        assert {(0, 0), (1, 1)} <= set(map(tuple, found.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dealt_rows_are_not_sorted_and_need_no_key(spark):
    rows = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    dealt = deal(rows.coalesce(1), 8)
    assert dealt.columns == ["doc_id", "text"]
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert sum(sizes) == 400 and len(sizes) == 8 and max(sizes) <= 100


def test_few_splits_of_texts_are_dealt_without_sorting_them(spark, tmp_path):
    spark.range(400).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    dealt = Tables(spark, str(tmp_path)).spread("documents")
    assert "RoundRobin" not in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in dealt.collect()) == list(range(400))


def test_one_row_group_is_dealt_out_however_many_its_splits(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        tables = Tables(spark, str(tmp_path))
        assert tables.documents.rdd.getNumPartitions() > 8  # all but one are empty
        sizes = [len(p) for p in tables.spread("documents").rdd.glom().collect()]
        assert sum(sizes) == 4000 and max(sizes) <= 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
