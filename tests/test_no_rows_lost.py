"""Cases in which rows went missing: nulls, short passages, stored folders, empty streams."""

import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import evaluate, ranking, retrieval, routing
from marginalia.operators.skew import numbered_in_group
from marginalia.plans import catalog
from marginalia.sources import tables
from marginalia.streaming import jobs


def test_short_passages_are_matched(spark):
    passages = ["a b c d", "b c d", "c d", "d", "ell", "lo wor", "hello", "b  c", "b\nc d", "zz", "", "e y"]
    docs = ["x a b c d e y", "hello world", "a b\nc d", "b  c", "", "ell", None]
    got = evaluate.passage_matches(
        spark.createDataFrame(list(enumerate(passages)), "p int, passage string"),
        spark.createDataFrame(list(enumerate(docs)), "d int, text string"), "p", "passage", "d", "text",
    ).collect()
    want = {(i, j) for i, p in enumerate(passages) for j, d in enumerate(docs) if p and d and p in d}
    assert len(got) == len(want) and {(r.p, r.d) for r in got} == want


def test_random_passages_against_contains(spark):
    rng = random.Random(4)
    make = lambda n: " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(n))
    docs = [make(rng.randint(0, 30)) for _ in range(40)]
    passages = [make(rng.randint(1, 7)) for _ in range(40)]
    got = evaluate.passage_matches(
        spark.createDataFrame(list(enumerate(passages)), "p int, passage string"),
        spark.createDataFrame(list(enumerate(docs)), "d int, text string"), "p", "passage", "d", "text",
    ).collect()
    assert {(r.p, r.d) for r in got} == {(i, j) for i, p in enumerate(passages) for j, d in enumerate(docs) if p in d}


def test_null_keys_are_numbered(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    got = sorted((r.k or "", r.v, r.rn) for r in numbered_in_group(df, ["k"], ["v"]).collect())
    assert got == [("", 1, 1), ("", 2, 2), ("a", 3, 1)]


def test_page_refuses_more_than_its_limit(spark):
    table = spark.range(500)
    assert tables.page(table, "id", 10, 200).count() == 200
    for limit in (0, 201):
        with pytest.raises(ValueError):
            tables.page(table, "id", 0, limit)


def test_incomplete_vectors_are_reported(spark):
    rows = [(1, None), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, None]), (5, [1.0, 0.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "c int, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "q int, embedding array<double>")
    got = retrieval.vector_topk(chunks, asked, "c", "q", min_similarity=None).orderBy("rk").collect()
    assert [(r.q, r.c, r.similarity) for r in got] == [(9, 2, 1.0), (9, 3, 0.0)]
    assert sorted(r.c for r in retrieval.incomplete_vectors(chunks, asked, "c").collect()) == [1, 4, 5]


def test_item_held_by_one_of_several_notes(spark):
    notes = spark.createDataFrame([("d", "hello there"), ("d", "other")], "date string, content string")
    items = spark.createDataFrame([("d", "hello", 1), ("d", "new", 2), ("e", "hello", 3)], "date string, text string, o int")
    assert sorted((r.date, r.text) for r in routing.absent_items(items, notes, "o").collect()) == [("d", "new"), ("e", "hello")]


def test_unknown_chunks_get_no_citation(spark):
    ranked = spark.createDataFrame([(1, 5, 1, 0.5, 0.5), (1, 6, 2, 0.4, 0.5)], "q int, c int, rk int, similarity double, rerank_score double")
    chunks = spark.createDataFrame([(6, "a.md", "A", ["h"], "text")], "c int, note_path string, note_title string, heading_path array<string>, chunk_text string")
    assert [r.c for r in ranking.citations(ranked, chunks, "q", "c").collect()] == [6]


def test_stream_reads_a_table_stored_as_a_folder(spark, tmp_path):
    name = "stream_daily_cost"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(catalog.queries()[name](spark, str(tmp_path))) == key(catalog.queries()[name](spark, "/root/testdata/sf0.001"))


def test_streams_without_files_give_no_rows(spark, tmp_path):
    messages = jobs.source(spark, str(tmp_path), spark.createDataFrame([], "conversation_id long, turn long, role string, text string").schema)
    assert jobs.keep_last(messages, 2).count() == 0
    assert jobs.collect_appended(messages.select("role"), "none").count() == 0
    usage = jobs.source(spark, str(tmp_path), spark.createDataFrame([], "ts timestamp, provider string, cost double").schema)
    assert jobs.collect_updates(jobs.windowed_cost(usage, "1 day"), ["window_start", "provider"], "none").count() == 0


def test_tiles_keep_the_result(spark, monkeypatch):
    rng = random.Random(2)
    vec = lambda: [rng.random() for _ in range(4)]
    chunks = spark.createDataFrame([(i, vec()) for i in range(300)], "c int, embedding array<double>")
    asked = spark.createDataFrame([(i, vec()) for i in range(20)], "q int, embedding array<double>")
    run = lambda: sorted((r.q, r.c, r.rk) for r in retrieval.vector_topk(chunks, asked, "c", "q", k=5).collect())
    whole = run()
    from marginalia.functions import vectors

    monkeypatch.setattr(vectors.tiles, "__defaults__", (800,))
    assert run() == whole
    assert chunks.where(F.col("c") < 0).count() == 0


def test_numbered_titles_of_a_batch_do_not_clash(spark):
    new = spark.createDataFrame([(1, "f", "A"), (2, "f", "A"), (3, "f", "A 1"), (4, "f", "A 1"), (5, None, "A"), (6, None, "A")], "o int, folder string, title string")
    old = spark.createDataFrame([("f", "A"), (None, "A")], "folder string, title string")
    got = {r.o: (r.folder, r.file_title) for r in routing.file_names(new, old, "o").collect()}
    assert len(set(got.values())) == 6 and got[3] == ("f", "A 1") and got[1] == ("f", "A 2")
    assert {got[5][1], got[6][1]} == {"A 1", "A 2"}


def test_sessions_join_stretches_of_activity(spark):
    import datetime as dt

    from marginalia.operators import conversations

    start = dt.datetime(2024, 1, 1, 3)
    minutes = [0, 50, 109, 169, 200, 320, 379, 438, 498, 600]
    df = spark.createDataFrame([(1, start + dt.timedelta(minutes=m)) for m in minutes for _ in range(3)], "user_id int, ts timestamp")
    got = conversations.sessions(df, "60 minutes").orderBy("session_start").collect()
    raw = df.groupBy("user_id", F.session_window("ts", "60 minutes").alias("w")).count().orderBy("w").collect()
    assert [(r.session_start, r.session_end, r.n) for r in got] == [(r.w.start, r.w.end, r["count"]) for r in raw] and len(raw) > 2


def test_a_second_run_reads_only_new_files(spark, tmp_path):
    schema = "conversation_id long, turn long, role string, text string"
    folder, at = str(tmp_path / "in"), str(tmp_path / "job")
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: sorted((r.conversation_id, r.turn) for r in jobs.keep_last(jobs.source(spark, folder, spark.createDataFrame([], schema).schema), 2, at=at).collect())
    write([(1, 1, "user", "a"), (1, 2, "user", "b"), (2, 1, "user", "c")])
    assert run() == [(1, 1), (1, 2), (2, 1)]
    assert run() == [(1, 1), (1, 2), (2, 1)]  # nothing new
    write([(1, 3, "user", "d"), (3, 1, "user", "e")])
    assert run() == [(1, 2), (1, 3), (2, 1), (3, 1)]
