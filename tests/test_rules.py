"""Title patterns of rules, supersession of many facts, and rules over nulls, ties and empty tables."""

import time

import pytest
from pyspark.sql import functions as F

from studyplane.operators import changes, reasons, rules

ITEMS = "course_id long, id string, ord long, type string, title string, percent double, weight double"
RULES = "course_id long, rule_id string, ord int, kind string, types array<string>, threshold double, cap double, required double, available double, components array<struct<types:array<string>,title_pattern:string,weight:double>>"


def caps(spark, title, pattern, percent=10.0):
    items = spark.createDataFrame([(1, "a", 1, "exam", title, percent, 30.0)], ITEMS)
    rule = spark.createDataFrame([(1, "r", 1, "CombinedComponentThreshold", [], None, 45.0, 50.0, 30.0, [(["exam"], pattern, 30.0)])], RULES)
    return [(r["rule_id"], r["cap"]) for r in rules.last_caps(items, rule).collect()]


@pytest.mark.parametrize(
    ("title", "pattern", "hit"),
    [
        ("Exam A", r"Exam\S", False),
        ("ExamA", r"exam\S", True),
        ("Exam 1", r"^EXAM\s\D", False),
        ("exam x", r"^EXAM\s\D", True),
        ("Exam", r"\Bxam", True),
        ("xam", r"\Bxam", False),
        ("The exam (2)", "EXAM (", True),
        ("The exam 2", "EXAM (", False),
        (r"A \E (b", r"a \E (", True),
        ("ÉTUDE", "étude", True),
        ("Exam", None, True),
        (None, "exam", False),
    ],
)
def test_title_patterns_keep_their_escapes_and_invalid_ones_are_contained(spark, title, pattern, hit):
    assert caps(spark, title, pattern) == ([("r", 45.0)] if hit else [])


def test_reasons_take_the_same_patterns(spark):
    items = spark.createDataFrame([("a", 1, "exam", "Exam A"), ("b", 1, "exam", "ExamB"), ("c", 1, "exam", "Final (x"), ("d", 1, "exam", None), ("e", None, "exam", "ExamB")], "id string, course_id long, type string, title string")
    schema = "course_id long, ord int, kind string, components array<struct<types:array<string>,pattern:string>>, required double, available double, cap double, minimum double, category string, condition string"
    rule = lambda at, pattern: (1, at, "CombinedComponentThreshold", [([], pattern)], 30.0, 60.0, 45.0, None, None, None)
    found = reasons.rule_reasons(items, spark.createDataFrame([rule(1, r"exam\S"), rule(2, "final ("), (1, 3, "GradeCap", None, None, None, 60.0, None, None, "late")], schema)).collect()
    assert sorted((r["id"], r["ord"]) for r in found) == [("a", 3), ("b", 1), ("b", 3), ("c", 2), ("c", 3), ("d", 3)]
    assert reasons.rule_reasons(items.limit(0), spark.createDataFrame([], schema)).count() == 0


def test_first_graded_item_in_order_and_the_last_rule_count(spark):
    items = spark.createDataFrame([(1, "b", 2, "quiz", "Quiz 2", 20.0, 5.0), (1, "a", 1, "quiz", "Quiz 1", None, 5.0), (1, "c", 3, "quiz", "Quiz 3", 90.0, 5.0), (2, "d", 1, "quiz", None, None, None)], ITEMS)
    threshold = lambda course, name, at, cap: (course, name, at, "Threshold", ["quiz"], 50.0, cap, None, None, None)
    found = rules.last_caps(items, spark.createDataFrame([threshold(1, "x", 1, 70.0), threshold(1, "y", 2, 80.0), threshold(2, "z", 1, 60.0), threshold(None, "n", 1, 50.0)], RULES))
    assert [(r["course_id"], r["rule_id"], r["cap"], r["combined"]) for r in found.collect()] == [(1, "y", 80.0, False)]
    assert rules.last_caps(items.limit(0), spark.createDataFrame([], RULES)).count() == 0


def test_supersession_of_one_entity_with_many_facts_is_linear(spark):
    df = spark.range(100_000).select("id", F.lit(1).alias("entity_id"), F.lit("due").alias("field"), (F.col("id") * 7919 % 7).cast("int").alias("authority"), F.col("id").alias("valid_from"), F.col("id").alias("arrival"))
    changes.superseded_in_order(df.limit(10)).count()
    began = time.time()
    got = changes.superseded_in_order(df).agg(F.count("superseded_by").alias("n"), F.sum(F.col("superseded_by") - F.col("id")).alias("s")).first()
    assert time.time() - began < 15
    rows = [i * 7919 % 7 for i in range(100_000)]
    nearest, n, total = {}, 0, 0
    for i in reversed(range(100_000)):
        later = [nearest[a] for a in range(rows[i], 7) if a in nearest]
        if later:
            n, total = n + 1, total + min(later) - i
        nearest[rows[i]] = i
    assert (got["n"], got["s"]) == (n, total)
