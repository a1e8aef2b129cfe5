"""Links by titles against brute force, on nulls, empty and repeated titles, ties, empty tables and further columns."""

import random

import pytest

from studyplane.operators import linking

WORDS = ["", None, "a", "ab", "quiz", "quiz 1", "quiz 10", "lab quiz 1", "midterm", "midterm exam", "ünïcode", "ü", "x" * 3000 + "quiz 1"]
ITEMS = "course_id int, key string, ord int, item_id int, key2 string"


@pytest.fixture(scope="module")
def drawn():
    r = random.Random(3)
    rows = [(r.choice([1, 2, None]), r.choice(WORDS)) for _ in range(120)]
    items = [(r.choice([1, 2, None]), r.choice(WORDS[2:] if r.random() < 0.9 else WORDS), r.randrange(20), i, "more") for i in range(60)]
    return rows, items


def test_contained_finds_every_pair_once(spark, drawn):
    rows, items = drawn
    got = [tuple(r) for r in linking.contained(spark.createDataFrame(rows, "course_id int, needle string"), spark.createDataFrame([(c, k) for c, k, *_ in items], "course_id int, hay string")).collect()]
    want = {(c, n, h) for c, n in rows for d, h, *_ in items if c is not None and c == d and n and h and n in h}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("exact_first", [True, False])
@pytest.mark.parametrize("empty", [True, False])
def test_by_title_equals_brute_force(spark, drawn, exact_first, empty):
    rows, items = drawn
    want = {}
    for c, k in set(rows):
        if c is None or k is None or (k == "" and not empty):
            continue
        met = [(-100 if exact_first and k == ik else -70, o, i, 100 if k == ik else 70) for d, ik, o, i, _ in items if d == c and ik is not None and (ik in k or k in ik)]
        if met:
            _, _, i, score = min(met)
            want[c, k] = (i, score)
    found = linking.by_title(spark.createDataFrame(rows, "course_id int, key string"), spark.createDataFrame(items, ITEMS), empty, exact_first)
    got = {(r.course_id, r.key): (r.item_id, r.score) for r in found.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    if exact_first:
        assert got == want


def test_empty_tables(spark):
    rows, items = spark.createDataFrame([], "course_id int, key string, post_id int"), spark.createDataFrame([], ITEMS)
    assert linking.by_title(rows, items).count() == linking.about(rows, items).count() == 0


def test_every_grade_stays(spark):
    grades = spark.createDataFrame([(1, None, None, None), (2, 1, 5, "quiz"), (2, 1, 5, "quiz"), (3, 1, None, "")], "grade_id int, course_id int, tool_id int, key string")
    items = spark.createDataFrame([(1, 5, "lab", 2, 8), (1, 5, "exam", 1, 9)], "course_id int, tool_id int, key string, ord int, item_id int")
    categories = spark.createDataFrame([(1, "quizzes of all kinds", 1, "q"), (1, "", 2, "any")], "course_id int, key string, ord int, category_id string")
    got = sorted(tuple(r) for r in linking.gradebook_map(grades, items, categories).fillna("-").fillna(-1).collect())
    assert got == [(1, -1, "-", True), (2, 9, "any", False), (2, 9, "any", False), (3, 9, "any", False)]


def test_activities_of_ranges_and_of_best_five(spark):
    rows = [(1, 1, "zyBooks Q2-Q4", False), (1, 2, "zybook q 3", True), (2, 1, "zyBooks: best 5/6", False), (3, 1, "Q1", False), (3, 2, None, True), (4, 1, "Q1 thru 30", True)]
    got = sorted(tuple(r) for r in linking.activities(spark.createDataFrame(rows, "course_id int, ord int, title string, is_item boolean")).collect())
    assert [r[:2] for r in got] == [(1, 2), (1, 3), (1, 4), *((2, n) for n in range(1, 7)), *((4, n) for n in range(1, 21))]
    assert got[:3] == [(1, 2, 2, 6, True), (1, 3, 2, 6, False), (1, 4, 2, 6, True)] and got[3][2:] == (5, 6, True)


@pytest.mark.parametrize("few", [0, 3, 256])
def test_contained_in_large_and_small_scopes(spark, drawn, monkeypatch, few):
    monkeypatch.setattr(linking, "FEW", few)
    test_contained_finds_every_pair_once(spark, drawn)


def test_nothing_is_gathered_to_be_broadcast(spark, drawn):
    """Exploded and joined rows are larger than the file that they come from."""
    rows, items = drawn
    grades = spark.createDataFrame([(i, c, i % 3, k) for i, (c, k) in enumerate(rows)], "grade_id int, course_id int, tool_id int, key string")
    work = spark.createDataFrame(items, ITEMS).selectExpr("*", "item_id % 3 AS tool_id", "key AS title")
    categories = work.selectExpr("course_id", "key", "ord", "key AS category_id")
    topics = grades.selectExpr("grade_id AS topic_id", "course_id", "key AS title")
    for found in (linking.gradebook_map(grades, work, categories), linking.content_items(topics, work), linking.by_title(grades, work, empty=False)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
