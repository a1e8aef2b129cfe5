"""Materials and schedule links against brute force."""

import random
import re

import pytest

from studyplane.operators import materials

SCHEMAS = {
    "items": "item_id string, course_id int, title string, ord int",
    "library": "course_id int, item_id string, document_class string, filename string, ord int",
    "content": "content_id string, course_id int, item_id string, document_class string, title string, ord int",
    "links": "from_id string, to_id string, kind string, label string, ord int",
    "outline": "course_id int, title string, snippet string, ord int",
}


def brute(items, library, content, links, outline):
    out = {}
    say = lambda c, n: f"{c.replace('_', ' ')}: {n}"
    for item, course, title, _ in items:
        key = None if title is None else re.sub(r"\s+", " ", title.lower())
        found = []
        for c, own, kind, name, _ in library:
            if None not in (kind, name) and (own == item or key is not None and c == course is not None and kind in materials.NAMING and key[:12].replace(" ", "") in name.lower()):
                found.append(say(kind, name))
        for _, c, own, kind, name, _ in content:
            if c != course or c is None or None in (kind, name):
                continue
            if own == item or key is not None and kind in (*materials.NAMING, *materials.EXAMS) and all(len(w) < 2 or w in name.lower() for w in key.split()):
                found.append(say(kind, name))
        for a, b, kind, label, _ in links:
            if kind in materials.LINK_KINDS and item in (a, b):
                found.append(f"{kind.replace('_', ' ').lower()}: {label or (b if a == item else a)}")
        line = next((s for c, t, s, _ in outline if key is not None and c == course is not None and t and t.lower() in key), None)
        if line:
            found.append(f"outline: {line[:80]}")
        out.update({(item, n): t for n, t in enumerate(list(dict.fromkeys(found))[:3], 1)})
    return out


@pytest.mark.parametrize("seed", range(2))
def test_linked_materials(spark, seed):
    r = random.Random(seed)
    words = ["Lab", "Quiz", "1", "2", "Report", "Midterm", "exam", "A"]
    name = lambda: r.choice([None, "", " ", *(r.choice(["", " "]).join(r.choices(words, k=r.randint(1, 3))) for _ in range(20))])
    courses, kinds = [1, 2, None], [*materials.NAMING, *materials.EXAMS, "lecture_notes", None]
    items = [(f"i{k}", r.choice(courses), name(), k) for k in range(25)]
    own = lambda: r.choice([None, None, None, *(i[0] for i in items)])
    rows = {
        "items": items,
        "library": [(r.choice(courses), own(), r.choice(kinds), name(), k) for k in range(30)],
        "content": [(f"c{k}", r.choice(courses), own(), r.choice(kinds), name(), k) for k in range(30)],
        "links": [(own(), own(), r.choice([*materials.LINK_KINDS, "ABOUT"]), r.choice([None, "the label"]), k) for k in range(20)],
        "outline": [(r.choice(courses), name(), r.choice([None, "", "snippet " * 15]), k) for k in range(20)],
    }
    rows["links"] = [x for x in rows["links"] if x[0] and x[1]]
    found = materials.linked(*(spark.createDataFrame(rows[n], s) for n, s in SCHEMAS.items()))
    assert {(x["item_id"], x["place"]): x["text"] for x in found.collect()} == brute(*rows.values())


def test_no_materials_and_no_items(spark):
    empty = [spark.createDataFrame([], s) for s in SCHEMAS.values()]
    assert materials.linked(*empty).count() == 0


def brute_schedule(entities, midterms, items):
    out = set()
    for course in {e[0] for e in entities} | {m[0] for m in midterms}:
        mine = [e for e in entities if e[0] == course]
        c = "x" if course is None else course
        weeks = [e for e in mine if e[1] == "week" or e[3] is not None]
        lectures, labs = ([e for e in mine if e[1] == k] for k in ("lecture", "lab"))
        same = lambda a, b: a is None or b is None or a == b
        for _, _, label, n in weeks:
            week = f"schedule:week:{c}:{label if n is None else n}"
            for kind, rows in (("lecture", lectures), ("lab", labs)):
                out |= {(week, f"schedule:{kind}:{c}:{x[2]}", "CONTAINS", 0.7) for x in rows if same(n, x[3])}
            out |= {(f"schedule:lecture:{c}:{x[2]}", f"schedule:lab:{c}:{y[2]}", "ASSOCIATED_WITH", 0.55) for y in labs if same(n, y[3]) for x in lectures if n is not None and x[3] == n}
        by_title = {}
        for k, title, _, item in items:
            if k == course and course is not None:
                by_title[title.lower()] = item
        spoken = next((i for t, i in by_title.items() if "midterm" in t), None)
        for title in [e[2] for e in mine if e[1] == "midterm"] + [m[1] for m in midterms if m[0] == course]:
            mid = by_title.get(title.lower()) or spoken or f"schedule:midterm:{c}:{title}"
            out |= {(f"schedule:lecture:{c}:{x[2]}", mid, "INTRODUCED_DURING", 0.5) for x in lectures} | {(f"schedule:lab:{c}:{x[2]}", mid, "PREPARES_FOR", 0.55) for x in labs}
    return out


@pytest.mark.parametrize("seed", range(2))
def test_schedule_links(spark, seed):
    r = random.Random(seed)
    courses = [1, 2, 3, None]
    entities = [(r.choice(courses), r.choice(["week", "lecture", "lab", "midterm", "other"]), f"L{r.randint(1, 6)}", r.choice([None, 1, 2, 3])) for _ in range(60)]
    midterms = [(c, t) for c in (1, 2, None) for t in ("Midterm", "The Midterm 2")]
    items = [(1, "MIDTERM", 0, "i1"), (1, "midterm", 1, "i2"), (2, "Quiz", 0, "i3"), (2, "A midterm", 1, "i4"), (2, "b MIDTERM", 2, "i5")]
    found = materials.schedule_links(spark.createDataFrame(entities, "course_id int, kind string, label string, week int"), spark.createDataFrame(midterms, "course_id int, title string"), spark.createDataFrame(items, "course_id int, title string, ord int, item_id string"))
    rows = [tuple(x) for x in found.select("from_id", "to_id", "kind", "confidence").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_schedule(entities, midterms, items)


def test_a_course_with_many_numbered_weeks_meets_by_number(spark):
    """Of 3000 lectures and labs in 3000 weeks each pair that meets is a link; what the join makes grows with them, not with their square."""
    e = spark.range(3000).selectExpr("1 AS course_id", "inline(array(struct('lecture' AS kind, concat('l', id) AS label, cast(id AS int) AS week), struct('lab' AS kind, concat('b', id) AS label, cast(id AS int) AS week)))")
    none = spark.createDataFrame([], "course_id int, title string, ord int, item_id string")
    found = materials.schedule_links(e, none.select("course_id", "title"), none)
    assert {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()} == {"CONTAINS": 6000, "ASSOCIATED_WITH": 3000}


def test_schedules_are_not_broadcast(spark):
    entities = spark.createDataFrame([(1, "week", "L1", 1), (1, "lecture", "L2", 1), (1, "lab", "L3", None)], "course_id int, kind string, label string, week int")
    mids = spark.createDataFrame([(1, "Midterm")], "course_id int, title string")
    found = materials.schedule_links(entities, mids, spark.createDataFrame([(1, "MIDTERM", 0, "i")], "course_id int, title string, ord int, item_id string"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
