"""Golden values of coursework: standing, drops, caps, deadlines, matching, conflicts, feeds, parsing, streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from studyplane.functions import state, text
from studyplane.operators import changes, grades, matching, outline, plan, problems, schedule, tree
from studyplane.plans import registry
from studyplane.sources import ics, raw
from studyplane.streaming import incremental

TORONTO = "America/Toronto"


def graded(spark, rows):
    """rows of (id, weight, percent, missed, dropped, kind)"""
    full = [("c", i, k, w, p, m, d, kind) for k, (i, w, p, m, d, kind) in enumerate(rows)]
    return spark.createDataFrame(full, "course_id string, id string, ord long, weight double, percent double, missed boolean, dropped boolean, kind string")


def test_standing(spark):
    rows = graded(spark, [("a", 20.0, 90.0, False, False, "quiz"), ("b", 20.0, 80.0, False, False, "quiz"), ("f", 60.0, None, False, False, "final")])
    s = grades.standing(rows).first()
    assert (s["calculated_percent"], s["completed_weight"], s["remaining_weight"]) == (85.0, 40.0, 60.0)
    need = grades.standing(rows).select(grades.required_average(80.0, F.col("calculated_percent"), F.col("completed_weight"), F.col("remaining_weight")).alias("x")).first()["x"]
    assert need == pytest.approx(76.67, abs=0.01)


def test_missed_keeps_its_weight_in_what_remains(spark):
    s = grades.standing(graded(spark, [("a", 50.0, 70.0, False, False, "quiz"), ("b", 50.0, None, True, False, "quiz")])).first()
    assert (s["calculated_percent"], s["remaining_weight"], s["missed_count"]) == (70.0, 50.0, 1)


def test_best_five_of_six(spark):
    rows = graded(spark, [(str(x), 1.0, float(x), False, False, "quiz") for x in (9, 8, 7, 6, 5, 4)])
    drops = {r["id"]: r["drop"] for r in grades.best_n(rows, 5, 6, ["course_id"]).collect()}
    assert [i for i, d in drops.items() if d == "official"] == ["4"]


def test_best_three_of_eleven_is_never_official(spark):
    rows = graded(spark, [(f"q{k}", 1.0, 90.0 - k if k < 6 else None, k == 10, False, "quiz") for k in range(11)])
    drops = [r["drop"] for r in grades.best_n(rows, 3, 11, ["course_id"]).collect()]
    assert "official" not in drops and drops.count("projection") == 3 and drops.count("pending") == 1


def test_combined_threshold(spark):
    rows = graded(spark, [("m", 25.0, 40.0, False, False, "midterm"), ("f", 35.0, 50.0, False, False, "final")])
    parts = spark.createDataFrame([("r", 0, "midterm", 25.0, 60.0, 30.0), ("r", 1, "final", 35.0, 60.0, 30.0)], "rule_id string, component int, kind string, component_weight double, available double, required double")
    r = grades.combined_threshold(rows, parts).first()
    assert (r["earned"], r["known_weight"], r["met"]) == (27.5, 60.0, False)
    got = spark.range(1).select(grades.capped(F.lit(70.0), F.lit(45.0)), grades.capped(F.lit(40.0), F.lit(45.0))).first()
    assert tuple(got) == (45.0, 40.0)


def test_percent(spark):
    rows = [(18.0, 20.0, None, False), (None, None, "90 %", False), (None, 10.0, "", True), (None, 10.0, "80%", True), (5.0, 0.0, "7.5%", False)]
    df = spark.createDataFrame(rows, "e double, p double, d string, m boolean")
    assert [r[0] for r in df.select(state.percent(F.col("e"), F.col("p"), F.col("d"), F.col("m"))).collect()] == [90.0, 90.0, None, None, 7.5]


def test_occurrences_skip_holidays_and_keep_wall_time(spark):
    p = spark.sql("SELECT 'lab' AS pattern_id, 3 AS day_of_week, '12:20' AS start_hm, DATE'2026-09-08' AS range_start, DATE'2026-12-01' AS range_end, array(DATE'2026-09-23') AS exdates")
    made = {str(r["day"]): r for r in schedule.occurrences(p, [("2026-10-13", "2026-10-16")], TORONTO).collect()}
    assert "2026-10-14" not in made and "2026-09-23" not in made
    assert made["2026-11-11"]["start"] == datetime(2026, 11, 11, 17, 20) and made["2026-09-09"]["start"] == datetime(2026, 9, 9, 16, 20)
    assert sorted(r["number"] for r in made.values()) == list(range(1, len(made) + 1))


def test_relative_deadline(spark):
    p = spark.sql("SELECT 'lab' AS pattern_id, 2 AS day_of_week, '10:00' AS start_hm, DATE'2026-09-15' AS range_start, DATE'2026-12-01' AS range_end, array() AS exdates").withColumn("exdates", F.col("exdates").cast("array<date>"))
    items = spark.createDataFrame([("lab3", "lab", 3)], "item_id string, pattern_id string, number int")
    assert schedule.due_after(items, schedule.occurrences(p, [], TORONTO), 8, "23:59", TORONTO).first()["due"] == datetime(2026, 10, 8, 3, 59)


@pytest.mark.parametrize("a,b", [("Assignment 1", "A1"), ("Assignment 1", "Assignment #1"), ("A1", "Assignment #1"), ("HW 2", "Homework 2")])
def test_titles_that_match(spark, a, b):
    rows = spark.createDataFrame([("x", "c", a, "assignment", None, 0), ("y", "c", b, "assignment", None, 1)], "id string, course_id string, title string, type string, due timestamp, ord int")
    assert matching.match_pairs(rows).first()["score"] >= 0.72


def test_matching_is_directed(spark):
    rows = lambda s, t: spark.createDataFrame([("x", "c", "Report draft one", s, None, 0), ("y", "c", "Report draft two", t, None, 1)], "id string, course_id string, title string, type string, due timestamp, ord int")
    assert matching.match_pairs(rows("lab", "assignment"), 0.41).count() == 1
    assert matching.match_pairs(rows("assignment", "lab"), 0.41).count() == 0


def test_three_sources_are_one_item(spark):
    day = datetime(2026, 10, 1)
    rows = [("d", "c", "Assignment 1", "assignment", day, None, 0), ("o", "c", "A1", "assignment", None, 10.0, 1), ("k", "c", "Assignment #1", "other", day, None, 2), ("z", "c", "Final Exam", "final", None, 40.0, 3)]
    df = spark.createDataFrame(rows, "id string, course_id string, title string, type string, due timestamp, weight double, ord int")
    got = {r["id"]: r for r in matching.reconcile(df).collect()}
    assert set(got) == {"d", "z"} and (got["d"]["weight"], got["d"]["members"], got["d"]["due"]) == (10.0, 3, day)


def test_conflict(spark):
    rows = spark.createDataFrame([("m", "2026-10-20", "course_outline"), ("m", "2026-10-22", "courselink_dropbox"), ("q", "2026-11-01", "ics")], "entity_id string, due string, source string")
    rank = F.when(F.col("source") == "courselink_dropbox", 90).when(F.col("source") == "course_outline", 60).otherwise(55)
    got = {r["entity_id"]: (r["resolved"], r["conflicting"]) for r in changes.resolve_conflict(rows, "due", rank).collect()}
    assert got == {"m": ("2026-10-22", True), "q": ("2026-11-01", False)}


def test_no_change_between_equal_snapshots(spark):
    rows = spark.createDataFrame([("a", "A", None, 1.0, None), ("outline:b", "B", datetime(2026, 1, 1), None, 2.0)], "id string, title string, due timestamp, weight double, earned double")
    assert changes.change_feed(rows, rows).count() == 0
    kinds = sorted(r["kind"] for r in changes.change_feed(rows, rows.limit(0)).collect())
    assert kinds == ["removed_assessment"]


def test_supersession_against_brute_force(spark):
    """The next arrival of no less authority, for more authorities than any table has; a null one is superseded by nothing."""
    rows = [(i, i % 3, "f", (i * 7919) % 1500 if i % 50 else None, i // 2, i) for i in range(3000)]
    df = spark.createDataFrame(rows[:60], "id long, entity_id long, field string, authority int, valid_from long, arrival long")
    got = {r["id"]: r["superseded_by"] for r in changes.superseded_in_order(df).collect()}
    for i, entity, _, authority, _, _ in rows[:60]:
        later = [j for j, e, _, a, _, _ in rows[:60] if e == entity and j > i and a is not None and authority is not None and a >= authority]
        assert got[i] == (min(later) if later else None)


def test_heavy_work_ranks_before_a_light_quiz(spark):
    df = spark.createDataFrame([("a", 12.5, 60.0, "assignment"), ("q", 1.0, 20.0, "quiz")], "id string, w double, h double, k string")
    no = F.lit(False)
    s = {r["id"]: r["s"] for r in df.select("id", state.priority(F.col("w"), F.col("h"), F.lit("not_submitted"), no, F.col("k"), no, F.lit(None).cast("string"), no).alias("s")).collect()}
    assert s["a"] > s["q"]


def test_weights_not_100(spark):
    df = spark.createDataFrame([("c", 30.0, False), ("c", 30.0, False), ("c", 40.0, True), ("d", None, None), ("e", 99.0, None), ("f", 10.0, False)], "course_id string, weight double, bonus boolean")
    categories = spark.createDataFrame([("f", 60.0), ("f", 40.0), ("e", None)], "course_id string, weight double")
    got = {r["course_id"]: (r["basis"], r["total"], r["problem"]) for r in problems.weight_summary(df, categories).collect()}
    assert got == {"c": ("assessments", 60.0, "weights_not_100"), "d": ("none", None, "no_weights"), "e": ("assessments", 99.0, None), "f": ("categories", 100.0, None)}


def test_promised_quizzes_are_padded(spark):
    found = spark.createDataFrame([("c", "Quiz", k) for k in range(1, 10)], "course_id string, name string, number int")
    promised = spark.createDataFrame([("c", "Quiz", 11)], "course_id string, name string, count int")
    assert sorted((r["number"], r["action"]) for r in problems.second_pass(promised, found).collect()) == [(10, "pad"), (11, "pad")]


def test_content_hash(spark):
    df = spark.createDataFrame([("abc",), ("",), (None,), ("😀",)], "t string")
    assert [r[0] for r in df.select(text.content_hash(F.col("t"))).collect()][:3] == ["fnv_1a47e90b_3", "fnv_811c9dc5_0", "fnv_811c9dc5_0"]
    h = 2166136261
    for u in (0xD83D, 0xDE00):
        h = (h ^ u) * 16777619 % 2**32
    assert df.select(text.content_hash(F.col("t"))).collect()[3][0] == f"fnv_{h:08x}_2"


def test_redaction(spark):
    df = spark.createDataFrame([("Mail ann.b@uni.ca, see ?token=abc&x=1; Lee, Ann (student number: 1234567) and ann lee, Lee and leeway, id u77",)], "t string")
    want = "Mail [email], see ?token=[redacted]&x=1; [user-name] (student number: [student-id]) and [user-name], [user-name] and leeway, id [student-id]"
    assert df.select(text.redacted(F.col("t"), "Ann Lee", ["u77"])).first()[0] == want


def test_search_needs_every_word(spark):
    df = spark.createDataFrame([("Lab report due",), ("report",), ("the lab",)], "t string")
    assert [r[0] for r in df.select(text.search_score("lab report", text.searchable(F.col("t")))).collect()] == [60, 0, 0]


def test_outline_lines(spark):
    body = "Assignments: 3 x 15%\nMidterm || 25 %\nFinal exam 30%\nBest 8 of 10 quizzes; drop lowest 2\nReport due ~8 days after lab introduced\n\nOffice 12"
    lines = outline.lines(spark.createDataFrame([(1, body), (2, None)], "doc_id int, text string"))
    got = {r["title"]: (r["count"], r["weight"], r["type"]) for r in outline.weight_rows(lines).collect()}
    assert got["Assignments"] == (3, 15.0, "assignment") and got["Final exam"] == (1, 30.0, "final")
    rules = sorted((r["kind"], r["n"], r["of"], r["anchor"]) for r in outline.rules(lines).collect())
    assert rules == [("BestN", 8, 10, None), ("DropLowest", 2, None, None), ("RelativeDeadline", 8, None, "lab")]


def test_all_facts_of_a_post(spark):
    posts = [
        "Quiz 1 moved to 2026-10-02; Quiz 2 due date postponed to Friday and Lab 3 is due 2026-10-09. A1 extended until Oct 5, 2026!",
        "Lecture on Monday and lab 2 on Tuesday\nare cancelled. See week 3.",
        "Midterm in MACN 105, final at Massey Hall 12.",
        "Your grades have been posted for Quiz 3",
        "In Assignment 4, count from zero.",
        "Nothing here", "", None,
    ]
    got = {}
    for r in outline.announcement_facts(spark.createDataFrame(list(enumerate(posts)), "post_id int, text string")).collect():
        got.setdefault(r["post_id"], []).append((r["kind"], r["hint"], r["value"], r["confidence"]))
    assert {k: sorted(map(str, v)) for k, v in got.items()} == {k: sorted(map(str, v)) for k, v in {
        0: [("due_changed", "quiz 1", "2026-10-02", 0.75), ("extension", "quiz 2", "Friday", 0.55), ("due_changed", "lab 3", "2026-10-09", 0.75), ("extension", "a 1", "2026-10-05", 0.75), ("schedule", None, None, 0.4)],
        1: [("cancelled", "lecture", None, 0.7), ("cancelled", "lab 2", None, 0.7)],
        2: [("location", "midterm", "MACN 105", 0.65), ("location", "final", "Massey Hall 12", 0.65), ("exam", "midterm", None, 0.45)],
        3: [("grade_release", "quiz 3", None, 0.6), ("resource", "quiz 3", None, 0.4)],
        4: [("clarification", "assignment 4", None, 0.35)],
    }.items()}


def test_calendar_file(spark):
    body = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long\r\n  title\\, part\r\nDTSTART:20261001T035900Z\r\nEXDATE:20261008T035900Z\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nDTSTART;VALUE=DATE:20261002\r\nEND:VEVENT\r\nEND:VCALENDAR"
    a, b = ics.events(spark.createDataFrame([(body,)], "text string")).orderBy("uid").collect()
    assert (a["title"], a["start"], a["all_day"], a["exdates"]) == ("Long title, part", datetime(2026, 10, 1, 3, 59), False, ["20261008"])
    assert (b["start"], b["all_day"]) == (datetime(2026, 10, 2), True)


def test_folding(spark):
    line = spark.range(1).select(ics.folded(F.lit("x" * 200))).first()[0]
    assert line.replace("\r\n ", "") == "x" * 200 and max(map(len, line.split("\r\n"))) == 75


def test_raw_records(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"Id": 7, "Name": "Lab 1", "DueDate": null, "IsHidden": false, "Availability": {"StartDate": null, "EndDate": "2026-10-01T03:59:00Z"}}, {"Id": 8, "Name": "Old", "IsHidden": true}]')
    (tmp_path / "q.json").write_text('[{"QuizId": 1, "Name": "Midterm", "EndDate": "2026-10-20T20:00:00Z", "IsActive": true}, {"QuizId": 2, "Name": "Quiz 2", "IsActive": false}]')
    course = F.lit("course:1")
    a = raw.assignments(raw.read(spark, "assignments", str(tmp_path / "f.json")).withColumn("course_id", course)).collect()
    q = raw.quizzes(raw.read(spark, "quizzes", str(tmp_path / "q.json")).withColumn("course_id", course)).collect()
    assert [(r["id"], r["type"], r["due"], r["certainty"]) for r in a] == [("dropbox:course:1:7", "lab", datetime(2026, 10, 1, 3, 59), "exact")]
    assert [(r["type"], r["confidence"]) for r in q] == [("midterm", 0.95)]
    assert raw.read(spark, "news", None).count() == 0


def test_preorder_prunes_hidden_branches(spark):
    nodes = spark.createDataFrame([("a", None, 2, False), ("b", None, 1, False), ("a1", "a", 1, False), ("a2", "a", 0, True), ("x", "a2", 0, False), ("o", "gone", 0, False)], "id string, parent_id string, ord int, hidden boolean")
    assert [r["id"] for r in tree.preorder(nodes).orderBy("path").collect()] == ["b", "a", "a1"]
    assert [r["id"] for r in tree.orphans(nodes).collect()] == ["o"]


def test_next_focus_is_the_best_other(spark):
    df = spark.createDataFrame([("a", 5.0, 0), ("b", 9.0, 1), ("c", 9.0, 2)], "id string, score double, ord int")
    assert {r["id"]: r["next_id"] for r in plan.next_focus(df).collect()} == {"a": "b", "b": "c", "c": "b"}


def test_snapshot_stream(spark, tmp_path):
    schema = "id string, title string, due timestamp, weight double, earned double, ord long"
    for k, rows in enumerate(([("a", "A", None, 1.0, None, 0), ("b", "B", None, 2.0, None, 1)], [("a", "A", None, 1.0, 9.0, 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        incremental.snapshots(stream, str(tmp_path / "state"), str(tmp_path / "changes"), str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted((r["batch"], r["id"], r["kind"]) for r in spark.read.parquet(str(tmp_path / "changes")).collect())
    assert got == [(0, "a", "new_assessment"), (0, "b", "new_assessment"), (1, "a", "grade_posted")]


def test_every_line_is_a_grade(spark, tmp_path):
    """Against brute force: line numbers past 2, items that share a tool id, a title without its tool id, a null title."""
    parts = [(1, "b", "lab"), (501, "b", "quiz"), (1001, "b", "quiz"), (2, "b", "exam"), (502, "c", "exam"), (3, "c", None), (4, "c", "lab")]
    lines = [(o, n, parts[(3 * o + n) % len(parts)][0], o % 7) for o in range(1, 9) for n in range(1, 8)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["grade_id"]: (r["item_id"], r["prio"]) for r in registry.queries()["gradebook_match_all"](spark, str(tmp_path)).collect()}
    assert got == brute_matches([(f"{o}-{n}-{s}-{p}", *next((b, k % 500, t) for k, b, t in parts if k == p)) for o, n, p, s in lines], parts)


def test_grades_that_differ_from_items(spark):
    parts = [(1, "b", "lab"), (501, "b", "quiz"), (1001, "b", "quiz"), (2, "b", "exam"), (3, "c", None)]
    grades_of = [(i, c, t, name) for i, (c, t, name) in enumerate((c, t, name) for c in ("b", "c", "d", None) for t in (1, 2, 3, None) for name in ("lab", "quiz", "exam", "other", None))]
    items = spark.createDataFrame([(k, b, k % 500, t, k) for k, b, t in parts], "item_id long, course_id string, tool_id long, title string, ord long")
    got = {r["grade_id"]: (r["item_id"], r["prio"]) for r in matching.gradebook_match(spark.createDataFrame(grades_of, "grade_id long, course_id string, tool_id long, title string"), items).collect()}
    assert got == brute_matches(grades_of, parts) and {p for _, p in got.values()} == {1, 2, 3, None}


def brute_matches(grades_of, parts):
    out = {}
    for g, course, tool, title in grades_of:
        mine = [(k, k % 500, t) for k, b, t in sorted(parts) if b == course]
        by_tool = [(k, t) for k, tool_id, t in mine if tool_id == tool]
        titled = lambda found: [k for k, t in found if t is not None and t == title]
        named = titled([(k, t) for k, _, t in mine])
        out[g] = (titled(by_tool)[0], 1) if titled(by_tool) else (by_tool[0][0], 2) if len(by_tool) == 1 else (named[0], 3) if named else (None, None)
    return out
