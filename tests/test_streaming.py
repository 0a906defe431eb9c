import datetime as dt

import pytest
from pyspark.sql import functions as F

from marginalia.operators import conversations, indexing, notes
from marginalia.sources.versions import Store
from marginalia.streaming import jobs


def write_files(spark, root, batches, schema):
    """One parquet file per batch, in arrival order."""
    import os
    import time

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(root))
        newest = max((os.path.join(root, f) for f in os.listdir(root) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(newest, (time.time() - 1000 + n * 10,) * 2)
    return spark.read.parquet(str(root)).schema


def ts(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_late_rows_inside_the_delay_count_and_later_ones_do_not(spark, tmp_path):
    root = tmp_path / "u"
    schema = write_files(
        spark,
        root,
        [
            [(ts(5, 1), "a", 1.0)],
            [(ts(5, 20), "a", 2.0), (ts(4, 23), "a", 4.0)],  # a few hours late: counts
            [(ts(9), "a", 3.0)],
            [(ts(9), "a", 5.0)],  # the watermark of a batch binds late rows from the one after next
            [(ts(5, 2), "a", 16.0), (ts(9, 1), "a", 32.0)],  # four days late: dropped
        ],
        "ts timestamp, provider string, cost double",
    )
    stream = jobs.source(spark, str(root), schema, files_per_batch=1)
    out = jobs.collect_updates(jobs.windowed_cost(stream, "1 day"), ["window_start", "provider"], "t")
    assert {r.window_start.day: r.cost for r in out.collect()} == {4: 4.0, 5: 3.0, 9: 40.0}


def test_alerts_keep_the_latest_total(spark, tmp_path):
    root = tmp_path / "u"
    schema = write_files(
        spark, root, [[(ts(5), "a", 0.6)], [(ts(5, 1), "b", 0.6)], [(ts(5, 2), "b", 0.3), (ts(6), "a", 0.1)]],
        "ts timestamp, provider string, cost double",
    )
    stream = jobs.source(spark, str(root), schema, files_per_batch=1)
    out = jobs.collect_updates(jobs.cost_alerts(stream), ["window_start"], "t").collect()
    assert [(r.window_start.day, r.cost) for r in out] == [(5, pytest.approx(1.5))]


def test_kept_messages_equal_batch_pruning(spark, tmp_path):
    root = tmp_path / "m"
    rows = [(f"c{i % 3}", i, "user", f"t{i}") for i in range(60)]
    schema = write_files(spark, root, [rows[:10], rows[30:], rows[10:30]], "conversation_id string, turn int, role string, text string")
    kept = jobs.keep_last(jobs.source(spark, str(root), schema, files_per_batch=1), 4)
    want = conversations.pruned(spark.read.parquet(str(root)), 4)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))


def test_ingest_over_batches(spark, tmp_path):
    root = tmp_path / "f"
    schema = write_files(
        spark,
        root,
        [
            [("new.md", 1, "n", 2, False), ("same.md", 1, "s", 9, False)],
            [("new.md", 2, "n2", 3, False), ("gone.md", 1, "g", 0, True)],
        ],
        "note_path string, mtime int, hash string, chunk_count long, deleted boolean",
    )
    tracker = spark.createDataFrame(
        [("same.md", 1, "s", "run-1", 1), ("gone.md", 1, "g", "run-1", 1), ("other.md", 1, "o", "run-1", 1)],
        "note_path string, mtime int, hash string, indexed_at string, chunk_count long",
    )
    got = jobs.ingest(jobs.source(spark, str(root), schema, files_per_batch=1), tracker).collect()
    assert {(r.note_path, r.indexed_at, r.chunk_count) for r in got} == {
        ("new.md", "batch-1", 3), ("same.md", "run-1", 1), ("other.md", "run-1", 1),
    }


def test_capture_copies_within_the_horizon(spark, tmp_path):
    root = tmp_path / "c"
    schema = write_files(
        spark, root, [[(ts(1), "a"), (ts(1, 1), " a\n")], [(ts(1, 2), "a"), (ts(1, 3), "b")]], "ts timestamp, text string"
    )
    out = jobs.collect_appended(jobs.deduplicated(jobs.source(spark, str(root), schema, files_per_batch=1), "text", "2 days"), "t")
    assert out.groupBy("content_hash").count().where("count = 1").count() == 2 == out.count()


def test_sessions_close_once_time_has_passed(spark, tmp_path):
    root = tmp_path / "s"
    schema = write_files(
        spark, root, [[(1, ts(1, 1)), (1, ts(1, 3))], [(1, ts(1, 4)), (2, ts(1, 5))], [(9, ts(20))], [(9, ts(20, 1))]], "user_id int, ts timestamp"
    )
    stream = jobs.source(spark, str(root), schema, files_per_batch=1).withWatermark("ts", "1 day")
    out = jobs.collect_appended(conversations.sessions(stream, "6 hours"), "t").where("user_id < 9")
    batch = conversations.sessions(spark.read.parquet(str(root)), "6 hours").where("user_id < 9")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
    assert out.count() == 2


def test_inbox_splits_and_archives(spark, tmp_path):
    root = tmp_path / "i"
    schema = write_files(spark, root, [[("a.md", '{"summary": "A"}'), ("b.md", "broken")], [("c.md", '{"summary": "C"}')]], "note_path string, raw string")
    stream = jobs.source(spark, str(root), schema, files_per_batch=1, archive=str(tmp_path / "done"))
    good, bad = jobs.inbox(stream)
    assert {(r.note_path, r.summary) for r in good.collect()} == {("a.md", "A"), ("c.md", "C")}
    assert [r.note_path for r in bad.select(F.col("note_path")).collect()] == ["b.md"]


def test_kept_messages_go_on_after_a_restart(spark, tmp_path):
    root, at = tmp_path / "m", str(tmp_path / "job")
    rows = [(f"c{i % 3}", i, "user", f"t{i}") for i in range(30)] + [(None, 1, "user", "no id"), ("c0", None, "user", "no turn")]
    columns = "conversation_id string, turn int, role string, text string"
    schema = write_files(spark, root, [rows[:8], rows[8:]], columns)
    first = jobs.keep_last(jobs.source(spark, str(root), schema), 4, at=at).collect()
    write_files(spark, root, [[("c1", 100, "user", "late"), ("new", 1, None, None)]], columns)
    kept = jobs.keep_last(jobs.source(spark, str(root), schema), 4, at=at)
    want = conversations.pruned(spark.read.parquet(str(root)), 4)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert len(first) == 13
    last = spark.read.parquet(f"{at}/output").groupBy("batch").agg(F.collect_set("conversation_id").alias("c")).orderBy("batch").collect()
    assert sorted(last[-1].c) == ["c1", "new"]  # a batch touches its own conversations only


def test_ingested_notes_equal_a_rebuild_and_a_repeat_changes_nothing(spark, tmp_path, monkeypatch):
    root = tmp_path / "f"
    text = lambda w: f"# T\n{(w + ' ') * 60}\n## Part\n{(w + 'x ') * 60}\n"
    batches = [
        [("a.md", text("a"), 1, False), ("b.md", text("b"), 1, False), ("b.md", text("old"), 0, False)],
        [("a.md", text("a2"), 2, False), ("c.md", text("c"), 1, False), ("b.md", text("b"), 2, False)],
        [("b.md", "", 3, True), ("d.md", "# short", 1, False)],
    ]
    schema = write_files(spark, root, batches, "note_path string, content string, mtime int, deleted boolean")
    store = Store(spark, str(tmp_path / "index"), indexing.tables("int", 4))
    run = jobs.run_batches

    def twice(stream, handle, checkpoint, mode="append"):
        def again(batch, number):
            handle(batch, number)
            before = store.current()
            handle(batch, number)
            assert store.current() == before

        run(stream, again, checkpoint, mode)

    monkeypatch.setattr(jobs, "run_batches", twice)
    now = jobs.ingest_notes(jobs.source(spark, str(root), schema, files_per_batch=1), store)
    assert now.number == 3 and now.marks == {"ingest": 2}
    left = spark.createDataFrame([("a.md", text("a2")), ("c.md", text("c")), ("d.md", "# short")], "note_path string, content string")
    want = notes.chunk(notes.parse(left)).select("note_path", "chunk_id", "chunk_index")
    got = store.read("chunks").select("note_path", "chunk_id", "chunk_index")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() >= 4
    tracked = {(r.note_path, r.indexed_at, r.mtime) for r in store.read("tracker").collect()}
    assert tracked == {("a.md", "batch-1", 2), ("b.md", "batch-0", 1), ("c.md", "batch-1", 1), ("d.md", "batch-2", 1)} - {("b.md", "batch-0", 1)}


def test_inbox_folder_is_worked_off(spark, tmp_path):
    box, done, failed = tmp_path / "in", tmp_path / "done", tmp_path / "failed"
    box.mkdir()
    for name, raw in {"a.json": b'{"summary": "A"}', "b.json": b"no object", "c.json": b"\xff\xfe", "d.json": b'```json\n{"summary": "D"}\n```', "x.txt": b"{}"}.items():
        (box / name).write_bytes(raw)
    at = str(tmp_path / "job")
    good, bad = jobs.inbox_files(spark, str(box), str(done), str(failed), files_per_batch=2, at=at)
    assert {(r.name, r.summary) for r in good.collect()} == {("a", "A"), ("d", "D")}
    assert {(r.name, r.reason) for r in bad.collect()} == {("b", "no JSON object"), ("c", "invalid UTF-8")}
    assert sorted(p.name for p in box.iterdir()) == ["x.txt"]
    assert sorted(p.name for p in done.iterdir() if p.suffix == ".json") == ["a.json", "d.json"]
    (box / "e.json").write_bytes(b'{"summary": "E"}')
    (done / "e.json").write_bytes(b"of another day")  # is not overwritten
    good, _ = jobs.inbox_files(spark, str(box), str(done), str(failed), files_per_batch=2, at=at)
    assert good.count() == 3 and len([p for p in done.iterdir() if p.suffix == ".json"]) == 4


def test_periods_from_panes(spark, tmp_path):
    root = tmp_path / "u"
    schema = write_files(spark, root, [[(ts(1, 1), "a", 1.0), (ts(2), "a", 2.0)], [(ts(2, 5), "a", 4.0), (ts(4), "b", 8.0)]], "ts timestamp, provider string, cost double")
    out = jobs.period_costs(jobs.source(spark, str(root), schema, files_per_batch=1), (1, 3)).where("window_start >= '2024-01-01'")
    got = {(r.days, r.window_start.day, r.provider): (r.cost, r.calls) for r in out.collect()}
    assert got == {
        (1, 1, "a"): (1.0, 1), (1, 2, "a"): (6.0, 2), (1, 4, "b"): (8.0, 1), (3, 1, "a"): (7.0, 3), (3, 2, "a"): (6.0, 2),
        (3, 2, "b"): (8.0, 1), (3, 3, "b"): (8.0, 1), (3, 4, "b"): (8.0, 1),
    }


def test_files_of_one_name_are_moved_together(spark, tmp_path):
    paths = []
    for i in range(40):
        (tmp_path / "in" / str(i)).mkdir(parents=True)
        paths.append(str(tmp_path / "in" / str(i) / f"part-{i % 3}.txt"))
        (tmp_path / "in" / str(i) / f"part-{i % 3}.txt").write_text(str(i))
    for _ in range(2):  # a repeated batch finds nothing left
        jobs._move(spark, paths, str(tmp_path / "done"))
    assert sorted(int(p.read_text()) for p in (tmp_path / "done").iterdir() if p.suffix == ".txt") == list(range(40))
    assert not list((tmp_path / "in").rglob("*.txt"))


def test_a_batch_of_notes_is_committed_in_the_session_of_the_store(spark, tmp_path, monkeypatch):
    """Settings that a commit makes hold there, not in the session of the stream."""
    folder = str(tmp_path / "notes")
    spark.createDataFrame([("a.md", "# A\n" + "word " * 30, 1, False)], "note_path string, content string, mtime int, deleted boolean").write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    sessions, commit = [], jobs.indexing.commit_run

    def seen(store, files, *args, **kw):
        sessions.extend([files.sparkSession, kw["touched"].sparkSession])
        return commit(store, files, *args, **kw)

    monkeypatch.setattr(jobs.indexing, "commit_run", seen)
    store = Store(spark, str(tmp_path / "index"), indexing.tables("int", buckets=2))
    jobs.ingest_notes(jobs.source(spark, folder, schema), store, at=str(tmp_path / "at"))
    assert store.read("chunks").count() == 1
    assert len(sessions) == 2 and all(s._jsparkSession.equals(spark._jsparkSession) for s in sessions)


def test_an_inbox_batch_reads_its_files_once_and_takes_few_jobs(spark, tmp_path):
    for i in range(9):
        place = tmp_path / "in" / str(i)
        place.mkdir(parents=True)
        (place / "same.json").write_text("no object" if i == 4 else f'{{"summary": "s{i}"}}')
    count = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = count()
    good, bad = jobs.inbox_files(spark, str(tmp_path / "in" / "*"), str(tmp_path / "done"), str(tmp_path / "failed"), files_per_batch=3, at=str(tmp_path / "at"))
    assert count() - before <= 3 * 4 + 1
    assert sorted(r.summary for r in good.collect()) == [f"s{i}" for i in range(9) if i != 4] and bad.count() == 1
    assert len(list((tmp_path / "done").glob("*same.json"))) == 8 and len(list((tmp_path / "failed").glob("*same.json"))) == 1
    assert not list((tmp_path / "in").glob("*/*.json"))


def test_a_local_file_is_moved_with_its_checksum_and_never_over_another(tmp_path):
    (tmp_path / "to").mkdir()
    for i in range(2):
        (tmp_path / f"in {i}").mkdir()
        (tmp_path / f"in {i}" / "a.json").write_text(str(i))
        (tmp_path / f"in {i}" / ".a.json.crc").write_text(f"sum {i}")
    paths = [f"file:{tmp_path}/in {i}/a.json" for i in range(2)]
    jobs._move_local(paths, str(tmp_path / "to"))
    jobs._move_local(paths, str(tmp_path / "to"))  # a batch that is repeated
    found = {p.name: p.read_text() for p in (tmp_path / "to").iterdir()}
    other = jobs._other_name(paths[1], "a.json")
    assert found == {"a.json": "0", ".a.json.crc": "sum 0", other: "1", f".{other}.crc": "sum 1"}
