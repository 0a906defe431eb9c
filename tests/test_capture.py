import json

import pytest
from pyspark.sql import functions as F

from marginalia.functions import dates as D
from marginalia.functions import models
from marginalia.functions import text as X
from marginalia.operators import conversations, insight, responses, routing, usage
from marginalia.operators.skew import numbered_in_group
from marginalia.sources import logs, tables


def test_numbers_inside_a_group_that_holds_most_rows(spark):
    rows = [("hot", i) for i in range(5000)] + [(f"k{i % 7}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int").repartition(13)
    ranged = df.repartitionByRange("k", "o")
    got = numbered_in_group(df, ["k"], ["o"]).collect()
    seen = {}
    for k, o in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        seen[(k, o)] = seen[k]
    assert len(got) == len(rows) and all(r.rn == seen[(r.k, r.o)] for r in got)
    assert ranged.rdd.getNumPartitions() >= 1


def test_file_names_fill_free_numbers(spark):
    existing = [("f", "T"), ("f", "T 1"), ("f", "T 4"), ("f", "Untitled 2"), ("g", "T")]
    new = [(i, "f", "T!") for i in range(5)] + [(9, "f", "***"), (10, "f", "***"), (11, "f", "***"), (12, "h", "T")]
    used = {}
    for folder, title in existing:
        used.setdefault(folder, set()).add(title)
    want = {}
    for i, folder, title in new:
        base = "".join(c for c in title if c.isalnum() or c in " -_").strip() or "Untitled"
        name, n = base, 0
        while name in used.setdefault(folder, set()):
            n += 1
            name = f"{base} {n}"
        used[folder].add(name)
        want[i] = name
    df = spark.createDataFrame(new, "i int, folder string, title string")
    ex = spark.createDataFrame(existing, "folder string, title string")
    assert {r.i: r.file_title for r in routing.file_names(df, ex, "i").collect()} == want


def test_captures_that_name_no_note_take_no_part_in_the_join(spark, monkeypatch):
    rows = spark.range(2000).select(
        F.col("id").alias("i"), F.lit("note").alias("note_type"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("N"), "id")).alias("existing_note"),
        F.lit(None).cast("string").alias("living_doc_name"), F.lit(0).alias("n_tasks"),
    )
    titles = spark.createDataFrame([("10_Notes", "N100")], "folder string, title string")
    joined = []
    join = type(rows).join
    monkeypatch.setattr(type(rows), "join", lambda self, *a, **k: joined.append(self.count()) or join(self, *a, **k))
    got = routing.route(rows, titles)
    monkeypatch.undo()
    assert joined == [20]
    assert {r.route: r["count"] for r in got.groupBy("route").count().collect()} == {"append": 1, "create": 1999}


def test_route_precedence(spark):
    schema = "i int, note_type string, existing_note string, living_doc_name string, n_tasks int"
    rows = [
        (1, "event", "Both", None, 1), (2, "event", "Gone", None, 1), (3, "living_document", None, "Recipe Ideas", 2),
        (4, "living_document", None, "Diary", 0), (5, "note", "Concept", None, 1), (6, "mystery", None, None, 0),
    ]
    titles = [("10_Notes", "Both"), ("30_Concepts", "Both"), ("30_Concepts", "Concept"), ("20_Projects", "Gone")]
    got = routing.route(spark.createDataFrame(rows, schema), spark.createDataFrame(titles, "folder string, title string"))
    assert {r.i: (r.route, r.folder, r.tasks_to_daily) for r in got.collect()} == {
        1: ("append", "10_Notes", False), 2: ("event", "00_Daily", False), 3: ("living_append", "10_Notes", False),
        4: ("create", "10_Notes", False), 5: ("append", "30_Concepts", True), 6: ("create", "10_Notes", False),
    }


def test_living_history_and_sections(spark):
    df = spark.createDataFrame([("d", "2024-01-0%d" % i, i, f"b{i}") for i in (3, 1, 2)], "doc string, day string, i int, body string")
    rows = routing.living_history(df, "doc", ["day", "i"]).orderBy("version").collect()
    assert [(r.version, r.body, r.valid_to, r.current) for r in rows] == [
        (1, "b1", "2024-01-02", False), (2, "b2", "2024-01-03", False), (3, "b3", None, True),
    ]


REPLIES = {
    "full": ('{"summary": "S", "key_phrases": ["a", "b"], "entities": [{"text": "X", "entity_type": "person", "confidence": "0.7"}, 3]}', True),
    "empty": ("{}", True),
    "list": ("[1]", False),
    "broken": ('{"summary": ', False),
    "fenced": ('```json\n{"summary": "F"}\n```', True),
    "null": ("null", False),
    "prose": ("Sure!", False),
}


def test_reply_typing(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in REPLIES.items()], "k string, raw string")
    got = {r.k: r for r in responses.typed(df).collect()}
    assert {k: r.ok for k, r in got.items()} == {k: v[1] for k, v in REPLIES.items()}
    full = got["full"]
    assert full.key_phrases == ["a", "b"] and [tuple(e) for e in full.entities] == [("X", "person", 0.7)]
    assert got["empty"].summary == "" and got["empty"].entities == [] and got["fenced"].summary == "F"


@pytest.mark.parametrize(
    "text,want",
    [("on 2024-3-5", "2024-03-05"), ("3/5/24!", "2024-03-05"), ("12/31/1999", "1999-12-31"), ("x 1/2/03 2020-01-01", "2003-01-02"), ("none", None), ("12024-01-01", None)],
)
def test_date_mentions(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(D.normalize_mention(F.col("t")).alias("d")).first().d == want


def test_small_text_rules(spark):
    df = spark.createDataFrame([("\n a \t",)], "t string")
    row = df.select(
        X.strip(F.col("t")).alias("s"),
        X.snippet(F.lit("x" * 201)).alias("long"),
        X.snippet(F.lit("x" * 200)).alias("fit"),
        X.task_key(F.lit("Call  Bob's, shop! (due: 2024-01-01)")).alias("key"),
        X.project_key(F.lit("Garden  Shed.md")).alias("project"),
        X.token_count_label(F.lit(1_250_000)).alias("m"),
        X.token_count_label(F.lit(999)).alias("n"),
        X.cost_label(F.lit(0.009)).alias("c"),
        X.content_words(F.lit("The new Garden is on 3 paths, an ox")).alias("w"),
    ).first()
    assert (row.s, row.long, row.fit) == ("a", "x" * 200 + "...", "x" * 200)
    assert (row.key, row.project, row.m, row.n, row.c) == ("call bobs shop", "gardenshed", "1.3M", "999", "$0.00")
    assert row.w == ["garden", "paths"]


def test_costs(spark):
    rows = [("anthropic", "claude-haiku-4-5", 1_000_000, 1_000_000), ("openai", "gpt-4o-mini", 1000, 1000), ("ollama", "any", 5, 5), ("openai", "new", 5, 5)]
    df = spark.createDataFrame(rows, "provider string, model string, input_tokens long, output_tokens long")
    got = {r.model: r.cost for r in usage.with_cost(df, tables.pricing(spark)).collect()}
    assert got == {"claude-haiku-4-5": 6.0, "gpt-4o-mini": pytest.approx(0.00075), "any": 0.0, "new": 0.0}


def test_run_status_cases(spark):
    rows = [("ok", "completed", "2024-01-02 00:00:00"), ("stale", "completed", "2024-01-01 00:00:00"), ("failed", "completed", "2024-01-02 00:00:00"), ("failed", "failed", "2024-01-02 01:00:00"), ("never", None, "2024-01-02 00:00:00"), ("only", "failed", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "job string, outcome string, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.job: r.status for r in usage.run_status(df, "2024-01-02 02:00:00").collect()}
    assert got == {"ok": "ok", "stale": "stale", "failed": "failed", "never": "unknown", "only": "failed"}


def test_time_bounds_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "u")
    df = spark.createDataFrame([(i, 1.0) for i in range(5)], "i int, cost double").withColumn("ts", F.timestamp_seconds(F.col("i") * 86400))
    df.write.parquet(path)
    bound = usage.between(spark.read.parquet(path), "1970-01-02", "1970-01-04")
    assert bound.count() == 2
    plan = bound._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_log_appends_and_skips_bad_lines(spark, tmp_path):
    path = str(tmp_path / "q")
    row = ("2024-01-01T00:00:00", "q", "c", "PASS", ["a"], 1, 12.3456)
    logs.append_queries(spark.createDataFrame([row], logs.QUERY_LOG), path)
    spark.createDataFrame([("{broken",), ("",)], "value string").write.mode("append").text(path)
    logs.append_queries(spark.createDataFrame([("2024-01-02T00:00:00", *row[1:])], logs.QUERY_LOG), path)
    got = logs.recent_queries(logs.read_queries(spark, path), 1).collect()
    assert [(r.timestamp, r.latency_ms) for r in got] == [("2024-01-02T00:00:00", 12.35)]


def test_related_notes_use_the_best_chunk(spark):
    chunks = spark.createDataFrame(
        [("a0", "a.md", [1.0, 0.0]), ("b0", "b.md", [0.0, 1.0]), ("b1", "b.md", [0.9, 0.1]), ("c0", "c.md", [0.5, 0.5])],
        "chunk_id string, note_path string, embedding array<float>",
    )
    meta_schema = "note_path string, key_phrases array<string>, entities array<struct<text:string,entity_type:string,confidence:double>>"
    meta = spark.createDataFrame(
        [("a.md", ["x"], [("Bob", "p", 0.9), ("c", "p", 0.4)]), ("b.md", [" Y ", "y", ""], [("BOB", "p", 0.9), ("bob", "p", 0.9), ("bOb", "p", 1.0)]), ("c.md", ["x", "z"], [])],
        meta_schema,
    )
    source = spark.createDataFrame([("a.md", [1.0, 0.0])], "note_path string, embedding array<float>")
    related = insight.related_notes(source, chunks, meta)
    got = [(r.target_path, r.similarity, r.shared) for r in related.orderBy("rk").collect()]
    assert got == [("b.md", 0.9939, ["BOB", "bob", "bOb"]), ("c.md", 0.7071, [])]
    links = [(r.target_path, r.anchor, r.confidence) for r in insight.link_suggestions(related, meta).orderBy("rk").collect()]
    assert links == [("b.md", "BOB", 0.9939), ("b.md", "bob", 0.9939), ("c.md", "c", 0.4)]
    tags = [(r.tag, r.confidence, r.sources) for r in insight.tag_suggestions(related, meta).orderBy("rk").collect()]
    assert tags == [("y", 0.994, ["b.md", "b.md"]), ("z", 0.354, ["c.md"])]


def test_model_boundaries(spark):
    df = spark.createDataFrame([("good",), ("bad",)], "t string")

    def make():
        def model(prompt):
            if prompt == "bad":
                raise RuntimeError("no")
            return json.dumps({"len": len(prompt)})

        return model

    got = {r.t: r.r for r in df.select("t", models.extract(F.col("t"), make).alias("r")).collect()}
    assert got["good"].ok and got["good"].value == '{"len": 4}' and got["bad"].error == "RuntimeError: no"
    vectors = models.hash_embed(spark.createDataFrame([("a b a",), ("A, b. a!",), ("c",)], "t string"), "t", 32).collect()
    assert vectors[0].embedding == vectors[1].embedding != vectors[2].embedding


def test_messages_and_previews(spark):
    rows = [("c", 0, "system", "s"), ("c", 1, "user", "hello"), ("c", 2, "user", "again"), ("d", 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conversation_id string, turn int, role string, text string")
    got = {r.conversation_id: (r.message_count, r.preview) for r in conversations.listing(df).collect()}
    assert got == {"c": (3, "hello"), "d": (1, "")}
    assert [(r.conversation_id, r.turn) for r in conversations.last_messages(df, 2).collect()] == [("c", 1), ("c", 2), ("d", 0)]


def test_settings_fall_back(spark, tmp_path):
    bad = tmp_path / "s.json"
    bad.write_text("not json\n")
    names = {r.category for r in tables.categories(spark, str(bad)).collect()}
    assert names == {"Work", "Personal"}
