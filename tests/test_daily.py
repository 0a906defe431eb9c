import datetime as dt

from pyspark.sql import functions as F

from marginalia.functions import dates as D
from marginalia.functions import text as X
from marginalia.operators import calendar, daily, reports, tasks, weekly

D1 = dt.date(2024, 3, 4)


def note(spark, text, path="00_Daily/2024-03-04.md"):
    return spark.createDataFrame([(path, text)], "note_path string, content string")


def test_task_lines_and_headings(spark):
    text = "\n".join(
        [
            "- [ ] before", "## Tasks", "-[ ] loose", "### Cat", "- [x] one (due: 2024-05-06)", "#### Sub", "  - [/] two  ",
            "- [X] (due: 2024-01-01)", "### Other", "- [ ] three (due: 2024-13-45)", "* [ ] no", "- [-] no", "## End", "- [ ] after",
            "## Tasks", "- [ ] second",
        ]
    )
    rows = daily.tasks(note(spark, text)).orderBy("line_number").collect()
    got = [(r.line_number, r.category, r.sub_project, r.status, r.text, r.due_date) for r in rows]
    assert got == [
        (2, "", "", "open", "loose", None),
        (4, "Cat", "", "done", "one", dt.date(2024, 5, 6)),
        (6, "Cat", "Sub", "in_progress", "two", None),
        (9, "Other", "", "open", "three", None),
    ]


def test_adjacent_task_sections_are_one(spark):
    text = "## Tasks\n### A\n- [ ] a\n## Tasks\n- [ ] b\n## X\n## Tasks\n- [ ] c"
    got = [(r.category, r.text) for r in daily.tasks(note(spark, text)).orderBy("line_number").collect()]
    assert [t for _, t in got] == ["a", "b"]


def test_file_names_that_are_not_dates(spark):
    df = note(spark, "## Tasks\n- [ ] a", "00_Daily/2024-99-01.md")
    assert daily.tasks(df).count() == 0 and daily.undated(df).count() == 1
    assert daily.tasks(note(spark, "## Tasks\n- [ ] a", "notes/x.md")).count() == 0
    assert daily.tasks(note(spark, "## Tasks\n- [ ] a", "x/2024-01-02 more.md")).first().source_date == dt.date(2024, 1, 2)


def test_events(spark):
    text = "## Events\n- 9:30 — A\n- 10:05 - B (through 2024-03-06)\n- C\n- \nnone\n### deeper\n- 7:00 – D\n## Next\n- E"
    rows = daily.events(note(spark, text)).orderBy("line_number").collect()
    assert [(r.time, r.title, r.end_date) for r in rows] == [
        ("9:30", "A", None), ("10:05", "B", dt.date(2024, 3, 6)), ("", "C", None), ("7:00", "D", None),
    ]


def test_context_sections_repeat(spark):
    text = "## Focus\n- a\n-  \n## Notes\n- b\n## Other\n- c\n## Focus\n- d"
    rows = daily.context(note(spark, text)).orderBy("line_number").collect()
    assert [(r.section, r.line_number, r.item) for r in rows] == [("focus", 1, "a"), ("notes", 4, "b"), ("focus", 8, "d")]


def test_lookback_skips_today(spark):
    items = spark.createDataFrame(
        [(dt.date(2024, 3, d), str(d)) for d in (1, 3, 8)], "date date, item string"
    )
    assert [r.item for r in daily.latest_context(items, "2024-03-08", 4).collect()] == ["3"]
    assert daily.latest_context(items, "2024-03-08", 0).count() == 0


def appearances(spark, rows):
    schema = "category string, sub_project string, text string, status string, source_date date, line_number int, due_date date"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("normalized", X.task_key(F.col("text"))).withColumn("note_path", F.lit(""))


def test_aggregation_takes_first_text_last_status_last_due(spark):
    day = [D1 + dt.timedelta(days=i) for i in range(4)]
    df = appearances(
        spark,
        [
            ("A", "", "Call Bob!", "open", day[0], 5, day[3]),
            ("A", "", "call  bob", "open", day[1], 9, None),
            ("A", "", "Call, Bob", "done", day[1], 2, None),
            ("B", "", "Call Bob", "in_progress", day[2], 1, None),
        ],
    )
    got = {r.category: r for r in tasks.aggregate(df, "2024-03-10").collect()}
    assert (got["A"].text, got["A"].status, got["A"].due_date, got["A"].appearance_count) == ("Call Bob!", "open", day[3], 3)
    assert got["A"].days_open == 6 and got["B"].days_open == 4


def test_due_labels(spark):
    cases = {-5: "5 days overdue", -1: "1 day overdue", 0: "Today", 1: "Tomorrow", 3: "in 3 days", 9: "in 9 days"}
    df = spark.createDataFrame([(D1 + dt.timedelta(days=n),) for n in cases], "d date")
    rows = df.select(D.due_label(F.col("d"), "2024-03-04", F.lit(False)).alias("l"), D.due_band(F.col("d"), "2024-03-04", F.lit(False)).alias("b")).collect()
    assert [r.l for r in rows] == list(cases.values())
    assert [r.b for r in rows] == ["urgent", "urgent", "urgent", "urgent", "soon", "later"]


def test_closed_interval_edges(spark):
    rows = [("ends", "2024-03-01", "2024-03-04"), ("starts", "2024-03-10", None), ("before", "2024-03-01", "2024-03-03"), ("after", "2024-03-11", None), ("around", "2024-01-01", "2024-12-31")]
    ev = spark.createDataFrame([(t, "", dt.date.fromisoformat(a), dt.date.fromisoformat(b) if b else None) for t, a, b in rows], "title string, time string, date date, end_date date")
    got = {r.title for r in calendar.overlapping(ev, "2024-03-04", "2024-03-10").collect()}
    assert got == {"ends", "starts", "around"}
    ranges = spark.createDataFrame([(D1, dt.date(2024, 3, 10))], "range_start date, range_end date")
    joined = [r.title for r in calendar.overlap_join(ev, ranges).collect()]
    assert sorted(joined) == sorted(got)


def test_events_meet_few_ranges_without_being_shuffled(spark):
    days = spark.range(400).select((F.lit(D1) + F.col("id").cast("int")).alias("date"), F.lit(None).cast("date").alias("end_date"))
    many = spark.range(4_000_000).select((F.lit(D1) + (F.col("id") % 400).cast("int")).alias("range_start"))  # of unknown size when grouped
    ranges = many.distinct().where(F.dayofmonth("range_start") == 1).withColumn("range_end", F.date_add("range_start", 9))
    joined = calendar.overlap_join(days, ranges)
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = days.crossJoin(ranges).where("date BETWEEN range_start AND range_end")
    assert joined.count() == want.count() > 0


def test_update_latest_only_and_clear_due(spark):
    df = appearances(spark, [("A", "", "t", "open", D1, 1, D1), ("A", "", "t", "open", D1 + dt.timedelta(1), 1, D1)])
    upd = spark.createDataFrame([("A", "", "t", "done", "")], "category string, sub_project string, normalized string, new_status string, new_due string")
    rows = tasks.update_latest(df, upd).orderBy("source_date").collect()
    assert [(r.status, r.due_date) for r in rows] == [("open", D1), ("done", None)]


def test_two_day_history_sync(spark):
    df = appearances(spark, [("A", "", "t one", "open", D1, 1, None), ("B", "x", "T one!", "open", D1, 2, D1)])
    lines = spark.createDataFrame(
        [
            (1, "| Status | Task | Added | Due | Timeline |"), (2, "|:---:|------|:---:|:---:|:---:|"),
            (3, "| In Progress | T one | [[2024-03-04]] | 2024-04-01 | in 28 days |"), (4, "- [x] Gone [[2024-03-01]] *(A)*"),
            (5, "| Done | cut |"),
        ],
        "line_no int, line string",
    )
    statuses = reports.read_statuses(lines)
    assert {(r.normalized, r.status) for r in statuses.collect()} == {("t one", "in_progress"), ("gone", "done"), ("cut", "done")}
    dues = reports.read_due_dates(lines)
    assert [(r.normalized, r.due_date) for r in dues.collect()] == [("t one", "2024-04-01")]
    desired = statuses.join(dues, "normalized", "left").withColumn("due_date", F.to_date("due_date"))
    synced = tasks.sync_state(df, desired)
    assert {(r.status, r.due_date, r.due_changed) for r in synced.collect()} == {("in_progress", dt.date(2024, 4, 1), True)}
    assert tasks.sync_summary(synced, "2024-03-05").first().asDict() == {"open_tasks": 2, "done_tasks": 0, "notes_updated": 1}


def test_report_lines_in_order_and_only_when_changed(spark, tmp_path):
    df = appearances(spark, [("B", "", "b", "open", D1, 1, None), ("A", "s", "late", "open", D1, 2, D1), ("A", "s", "none", "open", D1, 3, None), ("A", "", "x", "done", D1, 4, None)])
    lines = reports.open_report(tasks.aggregate(df, "2024-03-04"), "2024-03-04")
    out = str(tmp_path / "r")
    assert reports.write_if_changed(lines, out, None)
    text = [r.value for r in spark.read.text(out).collect()]
    assert sorted(text) == sorted(r.line for r in lines.collect())
    ordered = [r.line for r in lines.orderBy(*reports.ORDER).collect()]
    assert ordered[:2] == ["## A", "### s"] and ordered[4].startswith("| Open | late") and "Today" in ordered[4]
    assert not reports.write_if_changed(lines, str(tmp_path / "r2"), lines)


def test_replace_marked_section(spark):
    from marginalia.functions.constants import AUTO_END, AUTO_START

    old = f"# P\n## Open Tasks\n{AUTO_START}\nold $1 text\n{AUTO_END}\nkeep"
    df = spark.createDataFrame([(old,), ("# Q",)], "c string")
    rows = [r.n for r in df.select(reports.replace_section(F.col("c"), "## Open Tasks", F.lit("new \\1 $2")).alias("n")).collect()]
    block = f"## Open Tasks\n{AUTO_START}\nnew \\1 $2\n{AUTO_END}"
    assert rows == [f"# P\n{block}\nkeep", f"# Q\n\n{block}\n"]


def test_projects_by_mutual_containment(spark):
    names, subs = ["Garden Shed.md", "AI", "!!"], ["GardenShed v2 (main)", "Shed", "AI helper", "", "Orchard"]

    def key(name):
        return "".join(ch for ch in name.removesuffix(".md").lower() if ch.isalnum())

    want = {(p, s) for p in names for s in subs if key(p) and key(s) and (key(p) in key(s) or key(s) in key(p))}
    left = spark.createDataFrame([(n,) for n in names], "project string")
    right = spark.createDataFrame([(s,) for s in subs], "sub_project string")
    assert {(r.project, r.sub_project) for r in reports.match_projects(left, right).collect()} == want
    assert len(want) == 4


def test_focus_days_keep_repeats(spark):
    rows = [(D1, "n1", 1, "focus", "Ship"), (D1, "n1", 2, "focus", "Ship"), (dt.date(2024, 3, 6), "n2", 1, "focus", "Ship")]
    df = spark.createDataFrame(rows, "date date, note_path string, line_number int, section string, item string")
    assert weekly.focus_days(df).first().days == "Mon, Mon, Wed"
