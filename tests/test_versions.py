"""Committed table versions and the index kept in them."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions import models
from marginalia.operators import indexing, retrieval, stored_index
from marginalia.sources.versions import Append, Replace, Store, Table

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def notes_frame(spark, texts, mtime=1):
    rows = [(p, f"# {p}\n{body}\n", m) for p, (body, m) in texts.items()]
    return spark.createDataFrame(rows, "note_path string, content string, mtime int")


def embed(text):
    return models.embed(text, lambda: lambda texts: [[len(t), 1] for t in texts])


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "index"), indexing.tables("int", buckets=4))


def body(rng, n=40):
    return " ".join(rng.choice(WORDS[: rng.randrange(3, len(WORDS))]) for _ in range(n))


def test_only_touched_buckets_are_written_and_half_a_run_is_not_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"t": Table("k long, v string", "k", 8), "log": Table("k long", "k", 2)})
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    store.commit({"t": Replace(None, frame([(i, "a") for i in range(50)]))})
    first = store.current()
    store.commit({"t": Replace(frame([(3, "")]), frame([(3, "b")])), "log": Append(frame([(3, "")]))})
    second = store.current()
    changed = [b for b in first.tables["t"] if first.tables["t"][b] != second.tables["t"][b]]
    assert changed == [str(b) for b in store.touched("t", frame([(3, "")]))]
    assert {r.k: r.v for r in store.read("t").collect()} == {i: "b" if i == 3 else "a" for i in range(50)}
    assert {r.v for r in store.read("t", version=first).collect()} == {"a"}

    class Killed(Exception):
        pass

    write = store._write

    def dies(name, rows, folder):
        if name == "log":
            raise Killed
        return write(name, rows, folder)

    store._write = dies
    with pytest.raises(Killed):
        store.commit({"t": Replace(frame([(i, "") for i in range(50)]), frame([(1, "c")])), "log": Append(frame([(1, "")]))})
    store._write = write
    assert store.read("t").count() == 50 and store.read("log").count() == 1
    with open(store._version_path(3), "w") as half:  # the version file itself may be cut short
        half.write(json.dumps({"number": 3})[:-4])
    assert store.current() == second
    store.commit({"t": Replace(frame([(i, "") for i in range(50)]), None)})
    assert store.current().number == 4 and store.read("t").count() == 0


def test_a_marked_batch_is_applied_once(spark, tmp_path):
    store = Store(spark, str(tmp_path), {"log": Table("k long", "k", 2)})
    rows = spark.range(5).withColumnRenamed("id", "k")
    for batch in (0, 0, 1, 0, 1):
        store.commit({"log": Append(rows)}, mark=("s", batch))
    assert store.read("log").count() == 10


def test_index_equals_a_rebuild_after_every_run(spark, store):
    rng = random.Random(3)
    texts = {f"n/{i:03d}.md": (body(rng), 1) for i in range(60)}
    questions = spark.createDataFrame(
        [(1, "alpha tau"), (2, "beta-gamma rho"), (3, "sigma sigma mu"), (4, "nothing here"), (5, "pi pi-pi kappa nu xi")], "q long, question string"
    )
    for run in range(3):
        if run:
            for p in rng.sample(sorted(texts), 12):
                texts.pop(p) if rng.random() < 0.4 else texts.update({p: (body(rng), run + 1)})
            texts |= {f"n/{run}-{i}.md": (body(rng, 25), run + 1) for i in range(5)}
        indexing.commit_run(store, notes_frame(spark, texts), f"run-{run}", embed)
        if run == 1:
            stored_index.compact(store)
        chunks = store.read("chunks").withColumn("heading", F.array_join("heading_path", " > "))
        want = retrieval.bm25_topk(chunks, questions, "chunk_id", list(stored_index.FIELDS), "q", "question", k=7)
        got = stored_index.topk(store, questions, "q", "question", k=7, first=1).hits
        rows = lambda df: sorted(tuple(r) for r in df.select("q", "rk", "chunk_id", "score").collect())
        assert rows(got) == rows(want) and rows(want)
        counts = store.read("chunks").groupBy("note_path").count()
        tracked = store.read("tracker").join(counts, "note_path", "left")
        assert tracked.where("chunk_count <> coalesce(count, 0)").count() == 0 and tracked.count() == len(texts)
        assert store.read("vectors").count() == store.read("chunks").count() == store.current().props["n_docs"]


def test_bounds_spare_most_postings(spark, store, monkeypatch):
    monkeypatch.setattr(stored_index, "BLOCK", 8)
    texts = {}
    for i in range(400):  # a topic in neighbouring notes, common words in all
        topic = WORDS[i // 40]
        texts[f"n/{i:04d}.md"] = (f"common words stand in every note and so do these {topic} " * 3 + f"{topic} " * (i % 7), 1)
    indexing.commit_run(store, notes_frame(spark, texts), "run-0")
    questions = spark.createDataFrame([(1, "alpha common words"), (2, "common gamma")], "q long, question string")
    ranked = stored_index.topk(store, questions, "q", "question", k=5)
    chunks = store.read("chunks").withColumn("heading", F.array_join("heading_path", " > "))
    want = retrieval.bm25_topk(chunks, questions, "chunk_id", list(stored_index.FIELDS), "q", "question", k=5)
    rows = lambda df: sorted(tuple(r) for r in df.select("q", "rk", "chunk_id", "score").collect())
    assert rows(ranked.hits) == rows(want)
    for r in ranked.reads.collect():
        assert 0 < r.scored < r.postings / 4


def test_a_question_reads_only_the_buckets_of_its_terms(spark, store):
    indexing.commit_run(store, notes_frame(spark, {f"n/{i}.md": (body(random.Random(i)), 1) for i in range(20)}), "run-0")
    asked = spark.createDataFrame([("alpha",)], "term string")
    files = {os.path.dirname(f) for f in store.lookup("postings", asked).inputFiles()}
    assert len({os.path.basename(f) for f in files}) == 1


def test_postings_are_made_in_the_row_of_their_chunk(spark):
    words = [[(0, "b"), (1, "a"), (2, "b")], [], [(0, "a")]]
    rows = [(f"c{i}", "n", 7, len(w), w) for i, w in enumerate(words)]
    chunks = spark.createDataFrame(rows, "chunk_id string, note_path string, block long, dl long, words array<struct<pos:int,term:string>>")
    made = stored_index._counted(chunks, 3)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.chunk_id, r.term, r.tf, tuple(r.positions), r.dl, r.block, r.version) for r in made.collect()}
    assert got == {
        ("c0", "a", 1, (1,), 3, 7, 3), ("c0", "b", 2, (0, 2), 3, 7, 3), ("c2", "a", 1, (0,), 1, 7, 3),
        *[(f"c{i}", stored_index._CHUNK, 0, (), len(w), 7, 3) for i, w in enumerate(words)],
    }


def test_a_posting_row_holds_a_block_and_groups_of_questions_give_the_same_rows(spark, store):
    rng = random.Random(5)
    texts = {f"n/{i:03d}.md": ("common " + body(rng), 1) for i in range(100)}
    indexing.commit_run(store, notes_frame(spark, texts), "run-0")
    rows = store.read("postings").where("term = 'common'").agg(F.sum("n"), F.count(F.lit(1)), F.count_distinct("block")).first()
    blocks = store.read("lengths").agg(F.count_distinct("block")).first()[0]
    assert tuple(rows) == (100, blocks, blocks) and blocks < 20
    assert store.read("lengths").where("slot IS NULL").count() == 0
    questions = spark.createDataFrame([(i, f"common {w} beta-gamma") for i, w in enumerate(WORDS)], "q long, question string")
    hits = lambda **kw: sorted(map(tuple, stored_index.topk(store, questions, "q", "question", k=4, **kw).hits.collect()))
    assert hits() == hits(shared_bytes=700) and len(hits()) == 4 * len(WORDS)


def test_words_of_equal_chunks_of_a_block_are_added_up(spark):
    words = [[(0, "b"), (1, "a")], [(0, "b"), (1, "a")], [(300, "a")]]
    rows = [("c", "n", 7, 2, words[0]), ("c", "n", 7, 2, words[1]), ("d", None, 8, 1, words[2])]
    chunks = spark.createDataFrame(rows, "chunk_id string, note_path string, block long, dl long, words array<struct<pos:int,term:string>>").coalesce(1)
    made = stored_index._packed(chunks).collect()
    got = {(r.term, r.block, r.n, r.max_tf, r.min_dl, bytes(r.slots), bytes(r.tf)) for r in made if r.term != stored_index._CHUNK}
    assert {g[:6] for g in got} == {("a", 7, 1, 2, 2, b"\0"), ("b", 7, 1, 2, 2, b"\0"), ("a", 8, 1, 1, 1, b"\0")}
    assert sorted((r.chunk_id, r.block, r.dl, -1 if r.slot is None else r.slot) for r in made if r.term == stored_index._CHUNK) == [
        ("c", 7, 2, -1), ("c", 7, 2, 0), ("d", 8, 1, 0)
    ]


def test_a_commit_leaves_nothing_but_the_store_behind(spark, store, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr("marginalia.session.shared_dir", lambda _, purpose: made.append(str(tmp_path / f"{purpose}-{len(made)}")) or made[-1])
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup)
    for run in range(2):
        indexing.commit_run(store, notes_frame(spark, {f"n/{i}.md": (body(random.Random(i + run)), run) for i in range(5)}), f"run-{run}", embed)
    assert store.read("chunks").count() == store.read("vectors").count() == 5
    assert len(made) >= 6 and not [p for p in made if os.path.exists(p)]
    assert spark.conf.get(cleanup) == before
