"""Scores of extractions against the rule in plain Python, and its edges."""

import random

from studyplane.operators import extraction

OUTLINE = "course_id int, course_code string, instructors int, tables int, schedule int, policies int"
CATEGORY = "course_id int, ord int, name string, promised int, best_n int, weight double"
INSTANCE = "course_id int, category string, weight double"


def brute(outline, categories, instances):
    code, teachers, tables, schedule, policies = outline
    bad, n = [], len(instances)
    of_categories = sum(w or 0 for *_, w in categories)
    total = of_categories + sum(w or 0 for c, w in instances if not c) if of_categories > 0 else sum(w or 0 for _, w in instances)
    near = total > 0 and abs(total - 100) <= 5
    if not near and total > 0:
        bad.append(f"Weights sum to {total:g}, expected ~100")
    for _, name, promised, best, _ in categories:
        found = sum(c is not None and name is not None and c.lower() == name.lower() for c, _ in instances)
        if promised is not None and found != promised:
            bad.append(f'Category "{name or ""}" promised {promised} instance(s), found {found}')
        if best is not None and promised is not None and best > promised:
            bad.append(f"bestN {best} > promised {promised} for {name or ''}")
    missing = [k for k, gone in (("course_code", not code), ("instructor", not teachers), ("assessments", n < 2), ("evaluation_table", not tables and n < 3), ("schedule", not schedule)) if gone]
    score = 0.2
    for holds, points in ((code, 0.1), (teachers, 0.1), (n >= 2, 0.15), (n >= 4, 0.05), (near, 0.2), (not near and total > 40, 0.08), (tables, 0.1), (schedule, 0.05), (policies, 0.05)):
        score += points if holds else 0
    score -= 0.08 * min(3, len(bad))
    return ",".join(missing), sorted(bad), max(0, min(1, score)), "assessments" in missing or "evaluation_table" in missing or score < 0.45


def test_scores_and_contradictions(spark):
    rng = random.Random(5)
    some = lambda *xs: rng.choice(xs)
    outlines = {k: (some(None, "", "CIS*1"), some(None, 0, 2), some(None, 0, 1), some(0, 3), some(None, 1)) for k in range(80)}
    categories = {k: [(n, some(None, "Labs", "quizzes", "Exams"), some(None, 0, 1, 3), some(None, 2), some(None, 25.0, 50.0, 10.5)) for n in range(rng.randrange(4))] for k in outlines}
    instances = {k: [(some(None, "", "LABS", "Quizzes"), some(None, 5.0, 47.5)) for _ in range(rng.randrange(6))] for k in outlines}
    flat = lambda rows: [(k, *r) for k, rs in rows.items() for r in rs]
    o = spark.createDataFrame([(k, *r) for k, r in outlines.items()], OUTLINE)
    c = spark.createDataFrame(flat(categories) + [(999, 0, "Labs", 1, 1, 1.0)], CATEGORY)
    i = spark.createDataFrame(flat(instances) + [(999, "Labs", 1.0), (None, "Labs", 1.0)], INSTANCE)
    said = {}
    for r in extraction.checks(o, c, i).filter("contradiction IS NOT NULL").collect():
        assert not r["ok"]
        said.setdefault(r["course_id"], []).append(r["contradiction"])
    got = {r["course_id"]: (r["missing"], sorted(said.get(r["course_id"], [])), r["score"], r["incomplete"]) for r in extraction.scores(o, c, i).collect()}
    assert got == {k: brute(outlines[k], categories[k], instances[k]) for k in outlines}


def test_a_score_just_below_the_bound(spark):
    """Points are summed as doubles in their order, so that 0.2 + 0.15 + 0.05 + 0.05 stays below 0.45."""
    o = spark.createDataFrame([(1, None, 0, 0, 1, 1)], OUTLINE)
    i = spark.createDataFrame([(1, None, None)] * 3, INSTANCE)
    row = extraction.scores(o, spark.createDataFrame([], CATEGORY), i).first()
    assert (row["missing"], row["incomplete"], row["score"]) == ("course_code,instructor", True, 0.2 + 0.15 + 0.05 + 0.05)


def test_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in (OUTLINE, CATEGORY, INSTANCE)]
    assert extraction.scores(*empty).isEmpty() and extraction.checks(*empty).isEmpty()
