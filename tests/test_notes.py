import random

from pyspark.sql import functions as F

from marginalia.functions import constants as K
from marginalia.functions import text as X
from marginalia.functions.splitting import pieces, windows
from marginalia.operators import changes, notes
from marginalia.plans.registry import Tables
from marginalia.sources import notes as files


def sections_of(spark, text):
    row = spark.createDataFrame([(text,)], "body string").select(notes.sections(F.col("body")).alias("s")).first()
    return [(list(s.heading_path), s.text) for s in row.s]


def test_sections_follow_the_heading_stack(spark):
    text = "intro\n# A\na\n### C\nc\n## B\nb\n#### D\nd\n# E\n#### F\nf\n####### not\n#not\nend"
    assert sections_of(spark, text) == [
        ([], "intro"),
        (["A"], "a"),
        (["A", "C"], "c"),
        (["A", "B"], "b"),
        (["A", "B", "D"], "d"),
        (["E", "F"], "f\n####### not\n#not\nend"),
    ]


def test_sections_without_headings_or_text(spark):
    assert sections_of(spark, "  just text \n") == [([], "just text")]
    assert sections_of(spark, " \n\n") == []
    assert sections_of(spark, "# Only a title") == []
    assert sections_of(spark, "##  Spaced out  \nx\n## Next\n\n\ny ") == [(["Spaced out"], "x"), (["Next"], "y")]


def test_bare_hash_line_is_text(spark):
    assert sections_of(spark, "#\nNext line") == [([], "#\nNext line")]


def parse(spark, path, content):
    return notes.parse(spark.createDataFrame([(path, content)], "note_path string, content string")).first()


def test_front_matter_and_titles(spark):
    row = parse(spark, "10_Notes/x.md", "---\ntitle: \"Quoted: one\"\ndate: 2024-05-06\ntags:\n  - a\ndate: '2024-05-07'\n---\n# H\nbody")
    assert (row.note_title, row.note_date, row.note_folder, row.body) == ("Quoted: one", "2024-05-07", "10_Notes", "# H\nbody")
    assert row.frontmatter["tags"] == ""
    # a plain date or number is no text: the name and the heading stand
    row = parse(spark, "a/2024-02-02.md", "---\ntitle: 2024\ndate: 2024-01-05\n---\n# H\nbody")
    assert (row.note_title, row.note_date, row.frontmatter["date"]) == ("H", "2024-02-02", "2024-01-05")
    assert parse(spark, "x.md", "---\ntitle: yes\n---\nb").note_title == "x"
    assert parse(spark, "x.md", "text\n  # Late title \nmore").note_title == "Late title"
    row = parse(spark, "00_Daily/2024-01-02.md", "## Not level one\r\nx")
    assert (row.note_title, row.note_date, row.body) == ("2024-01-02", "2024-01-02", "## Not level one\nx")
    assert parse(spark, "root.md", "---\nnot closed").note_folder == ""
    assert parse(spark, "a/2024-01-02 extra.md", "x").note_date == ""


def test_wiki_links(spark):
    text = "[[A]] [[B|b]] [[C#h]] [[D#h|d]] [[A]] `[[E]]` [[ F ]]\n```\n[[G]]\n```\n[[]] [[H]"
    row = spark.createDataFrame([(text,)], "t string").select(X.wiki_links(F.col("t")).alias("l")).first()
    assert row.l == ["A", "B", "C", "D", "F"]


def direct_pieces(text, level=0):
    """The splitting rule read aloud: one character budget, parts glued while they fit."""
    if len(text) <= K.TARGET_SIZE:
        return [text]
    if level == len(K.SEPARATORS):
        return windows(text)
    sep = K.SEPARATORS[level]
    if sep not in text:
        return direct_pieces(text, level + 1)
    out, held = [], ""
    for n, part in enumerate(text.split(sep)):
        part = part if n == 0 else sep.lstrip("\n") + part
        if len(held) + len(part) <= K.TARGET_SIZE:
            held += part
            continue
        out += [held] if held else []
        held = part if len(part) <= K.TARGET_SIZE else ""
        if not held:
            out += direct_pieces(part, level + 1)
    return out + ([held] if held else [])


def test_pieces_equal_the_rule_on_random_text():
    rng = random.Random(5)
    seps = K.SEPARATORS + [" ", "x" * 30, "word ", "\n\n\n", "y" * 800]
    for _ in range(400):
        text = "".join(rng.choice(seps + ["a" * rng.randint(1, 60)]) for _ in range(rng.randint(1, 120)))
        assert pieces(text) == direct_pieces(text)


def test_windows_move_on_and_cover():
    rng = random.Random(6)
    for size, overlap in [(50, 10), (100, 20), (700, 100)]:
        for _ in range(60):
            text = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 3000)))
            got = windows(text, size, overlap)
            assert all(len(p) <= size for p in got)
            assert len(got) <= len(text)
            assert set("".join(text.split())) <= set("".join(got))
    assert windows("a" * 120, 50, 10) == ["a" * 50, "a" * 50, "a" * 40]
    # a space right after the start must not hold the window back
    assert windows("ab " + "c" * 100, 50, 10)[1].startswith("c")


def test_chunks_are_numbered_and_identified(spark):
    body = "# T\n" + "long words here. " * 120 + "\n## Short\ntiny\n## Next\n" + "z" * 150
    df = notes.chunk(notes.parse(spark.createDataFrame([("n.md", body)], "note_path string, content string")))
    rows = df.orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert len({r.chunk_id for r in rows}) == len(rows)
    assert rows[-1].heading_path == ["T", "Next"] and rows[-1].chunk_text == "z" * 150
    assert all(len(r.chunk_text) >= K.MIN_CHUNK_SIZE for r in rows)
    again = notes.chunk(notes.parse(spark.createDataFrame([("n.md", body.replace("words here", "words   here"))], "note_path string, content string")))
    assert again.orderBy("chunk_index").first().chunk_id != "" and again.count() >= len(rows)


def test_excludes_cross_slashes(spark):
    paths = [".obsidian/a/b.md", "x/.obsidian/a.md", "a/b.excalidraw.md", "Inbox/_failed/c.md", "Tasks/All Tasks.md", "Tasks/Other.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    from marginalia.sources.notes import included

    kept = [r.p for r in df.where(included(F.col("p"))).collect()]
    assert kept == ["x/.obsidian/a.md", "Tasks/Other.md"]


def test_scan_folder(spark, tmp_path):
    from marginalia.sources import notes as files

    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "n+1.md").write_bytes("é\r\nx".encode())
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "skip.txt").write_text("x")
    (tmp_path / "Inbox").mkdir()
    (tmp_path / "Inbox" / "c.md").write_text("x")
    found = files.scan(spark, str(tmp_path))
    assert sorted(r.note_path for r in found.select("note_path").collect()) == ["a b/n+1.md", "bad.md"]
    assert [(r.note_path, r.content) for r in files.readable(found).collect()] == [("a b/n+1.md", "é\nx")]
    assert files.quarantined(found).first().n_bytes == 2
    import hashlib

    prints = {r.note_path: r.hash for r in files.fingerprint(found).collect()}
    assert prints["bad.md"] == hashlib.sha1(b"\xff\xfe").hexdigest()


def test_change_classes(spark):
    cur = [("same", 1, "a"), ("touched", 2, "a"), ("edited", 2, "b"), ("stale_time", 1, "b"), ("new", 1, "n")]
    old = [("same", 1, "a"), ("touched", 1, "a"), ("edited", 1, "a"), ("stale_time", 1, "a"), ("gone", 1, "g")]
    schema = "note_path string, mtime int, hash string"
    got = changes.classify(spark.createDataFrame(cur, schema), spark.createDataFrame(old, schema)).collect()
    assert {r.note_path: r.change for r in got} == {
        "same": "unchanged",
        "touched": "unchanged",
        "edited": "modified",
        "stale_time": "unchanged",
        "new": "new",
        "gone": "deleted",
    }


def test_upsert_is_stable(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = changes.upsert(base, new, "k")
    twice = changes.upsert(once, new, "k")
    want = [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_a_listing_is_not_a_task_per_folder(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"page={i}").mkdir()
        (tmp_path / f"page={i}" / "a.txt").write_text(str(i))
    sc = spark.sparkContext
    sc.setJobGroup("listing", "listing")
    found = files.scan(spark, str(tmp_path), "*.txt")
    status = sc.statusTracker()
    sizes = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("listing") for s in status.getJobInfo(j).stageIds]
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert sizes and max(sizes) <= 128
    assert found.select("note_path").distinct().count() == 200


def test_short_rows_are_dealt_out(spark, tmp_path):
    for i, n in enumerate([900] + [1] * 9):  # one split holds nearly all rows
        spark.range(i * 1000, i * 1000 + n).coalesce(1).write.mode("append").parquet(str(tmp_path / "orders.parquet"))
    sizes = [len(p) for p in Tables(spark, str(tmp_path)).spread("orders", 50).rdd.glom().collect()]
    assert sum(sizes) == 909 and max(sizes) <= 100


def test_one_row_files_lie_and_read_as_a_partitioned_write_puts_them(spark, tmp_path, monkeypatch):
    rows = [(1, "a/b=c d", "x\ny"), (1, "a/b=c d", "again"), (2, None, "z"), (2, "", None), (3, "é", "ü")]
    frame = spark.createDataFrame(rows, "k long, name string, value string").coalesce(1)
    frame.write.partitionBy("k", "name").text(str(tmp_path / "spark"))
    files.write_texts(frame, str(tmp_path / "own"), "k", "name")
    read = lambda root: sorted((str(p.parent.relative_to(root)), p.read_bytes()) for p in root.rglob("*.txt"))
    assert read(tmp_path / "own") == read(tmp_path / "spark") and len(read(tmp_path / "own")) == 3
    assert not list((tmp_path / "own").rglob(".part*"))  # no checksum file, nothing half written
    assert files.scan(spark, str(tmp_path / "own"), "*.txt").count() == 3


def test_a_folder_of_many_small_files_is_read_in_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SCAN_TASKS", 2)
    files.write_texts(spark.range(600).selectExpr("id AS k", "'x' AS value"), str(tmp_path / "f"), "k")
    found = files.scan(spark, str(tmp_path / "f"), "*.txt")
    assert found.rdd.getNumPartitions() <= 8 and found.agg(F.sum("length")).first()[0] == 1200
