"""What the findings of round 4 found: pages that were dealt and made several times over, and pairs across made-up borders of a course."""

import random
import re
from collections import Counter
from datetime import datetime

import pytest

import __spark_entry__
from studyplane.operators import layout, matching, tables

SF = "/root/testdata/sf0.001"
SPANS = "doc_id int, page int, ord int, x double, y double, w double, h double, font double, bold boolean, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, dealt", [("layout_tables", 2), ("layout_kept", 1)])
def test_pages_are_made_once_and_not_joined(spark, name, dealt):
    """rows are dealt once, their pages at most once more, by document; nothing is written between, joined or read again."""
    made = plan(__spark_entry__.queries()[name](spark, SF))
    assert made.count("Exchange hashpartitioning") + made.count("ExistingRDD") == dealt and made.count("FileScan") == 1 and "Join" not in made


def test_lines_of_odd_pages_do_not_depend_on_the_batch(spark, monkeypatch):
    """close heights, equal places, endless ones and pages without spans, folded all at once and some spans at a time."""
    r = random.Random(4)
    ys = [r.choice([r.randrange(0, 90) / 4, 700.0, float("inf"), -0.0]) for _ in range(600)]
    spans = [(r.randrange(9), r.choice([1, 2, None]), i, r.choice([None, float(r.randrange(0, 300, 9))]), y, r.choice([None, 30.0]), 10.0, r.choice([None, 9.0, 15.0]), r.choice([None, False, True]), r.choice(["a b", "20 %", " ", "é|ü", "x\ty"])) for i, y in enumerate(ys)]
    df = spark.createDataFrame(spans, SPANS)
    whole = sorted(map(str, layout.lines(df).collect()))
    monkeypatch.setattr(layout, "SPANS", 7)
    assert sorted(map(str, layout.lines(df).collect())) == whole != []
    want = Counter()
    for doc in range(9):
        for page in (1, 2):
            starts = []
            for y in sorted({s[4] for s in spans if s[:2] == (doc, page) and s[9].strip()}, reverse=True):
                if not starts or not (starts[-1] == y or starts[-1] - y <= layout.LINE_HEIGHT):
                    starts.append(y)
            want[doc, page] = len(starts)
    assert Counter((x["doc_id"], x["page"]) for x in layout.lines(df).collect()) == +want
    empty = layout.pages(df).selectExpr("doc_id", "page", "filter(spans, s -> false) AS spans")
    assert layout.page_lines(empty).count() == 0 and {len(x["lines"]) for x in layout.pages_in_order(empty).collect()} == {0}


def test_pages_in_order_are_lines_in_reading_order(spark):
    """pages that were never rows of lines have the same lines in the same order, also in two columns, and the same tables."""
    r = random.Random(1)
    words = ["Assessment", "Weight", "Due", "Quiz 1", "5%", "Total 20%", "Late Policies", "a|b", "Week 2"]
    spans = [(d, p, i, 50.0 + 70 * (i % 8) + (60 if i % 8 > 3 else 0), 700.0 - i // 8 * 12 - i % 3, r.choice([5.0, 50.0]), 10.0, r.choice([11.0, 15.0]), False, r.choice(words)) for d in range(5) for p in range(3) for i in range(r.choice([5, 40, 90]))]
    df = spark.createDataFrame(spans, SPANS)
    of_lines = layout.reading_order(layout.lines(df))
    rows = {}
    for x in of_lines.orderBy("doc_id", "page", "reading_order").collect():
        rows.setdefault((x["doc_id"], x["page"]), []).append((x["text"], x["bold"], x["cells"]))
    in_order = layout.pages_in_order(layout.pages(df))
    assert {(x["doc_id"], x["page"]): [(y["text"], y["bold"], y["cells"]) for y in x["lines"]] for x in in_order.collect()} == rows
    assert of_lines.filter("column_index = 1").count() > 0
    assert sorted(map(str, tables.page_tables(in_order).collect())) == sorted(map(str, tables.tables(of_lines).collect())) != []


def test_repeats_equal_a_count_by_hand(spark):
    """heads and feet are counted where the lines of a document are, once; null documents and pages keep what they kept."""
    r = random.Random(2)
    texts = ["Course outline", "course outline ", "Page of many", "Quiz 1 is due", "short", None, "x" * 95, "body one of them", "body two of them"]
    rows = [(r.choice([1, 2, 3, 4, None]), r.choice([0, 1, 2, None]), n, r.choice(texts[: r.choice([2, 9])]), r.choice([None, float(r.randrange(9))])) for n in range(160)]
    kept = layout.without_repeats(spark.createDataFrame(rows, "doc_id int, page int, number int, text string, y double"))
    assert kept.columns == ["doc_id", "page", "number", "text", "y"]
    heads, feet, pages, of_page = Counter(), Counter(), {}, {}
    for x in rows:
        of_page.setdefault(x[:2], []).append(x)
    for (d, p), xs in of_page.items():
        pages.setdefault(d, set()).update({p} - {None})
        xs.sort(key=lambda x: (x[4] is None, -(x[4] or 0), x[2]))
        for ends, count in ((xs[:2], heads), (xs[-2:], feet)):
            count.update((d, x[3].strip(" ").lower()) for x in ends if x[3] is not None)
    sizes = Counter(x[0] for x in rows)

    def stays(x):
        if x[0] is None or x[3] is None or sizes[x[0]] < 12 or len(pages[x[0]]) < 2 or re.search(r"(?i)quiz|due\b", x[3]):
            return True
        key = x[3].strip(" ").lower()
        return not 9 <= len(key) <= 89 or max(heads[x[0], key], feet[x[0], key]) < max(2, -(-len(pages[x[0]]) * 6 // 10))

    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(str(x) for x in rows if stays(x))
    assert kept.count() < len(rows)


def brute(left, threshold=matching.THRESHOLD):
    """The fold, row by row, over all rows of a course."""
    out, left = [], [dict(x, members=1, features=matching._features(x["title"])) for x in sorted(left, key=lambda x: x["ord"])]
    while left:
        mine, rest = left[0], []
        for other in left[1:]:
            if matching._score(mine, other) >= threshold:
                mine = matching._merged(mine, other)
            else:
                rest.append(other)
        out.append((mine["course_id"], mine["id"], mine["title"], mine["type"], mine["due"], mine["weight"], mine["members"]))
        left = rest
    return out


PARTS = "id long, course_id string, title string, type string, due timestamp, weight double, ord long"


def test_kinds_of_rows_fold_as_rows_do(spark):
    """rows of one kind are taken at once, and blocks are found without pairs; the items are those of a fold row by row of whole courses."""
    r = random.Random(3)
    titles = ["Quiz 1", "Q1", "quiz #1 on trees", "Quiz 2", "Quiz on trees", "Midterm", "Mid-term exam", "Lab 1: old ring", "Lab old ring", "Final Exam old ring", "HW 3", "Assignment 3", "A3 hot bolt", "", "trees", None]
    rows = [(i, r.choice(["a", "b", None]), r.choice(titles), r.choice(["quiz", "other", "lab", "assignment", "project"]), r.choice([None, *(datetime(2026, 9, d) for d in (1, 3, 9, 28))]), r.choice([None, 5.0, 10.0]), 1000 - i) for i in range(400)]
    names = [c.split()[0] for c in PARTS.split(", ")]
    df = spark.createDataFrame(rows, PARTS)
    got = sorted(tuple(x) for x in matching.reconcile(df).collect() if x["course_id"] and x["title"] is not None)
    every = [dict(zip(names, x, strict=True)) for x in rows]
    want = [y for c in ("a", "b") for y in brute([x for x in every if x["course_id"] == c and x["title"] is not None])]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) < 200
    assert matching.reconcile(df.filter("course_id IS NULL")).count() == sum(x["course_id"] is None for x in every)
    classes = matching.match_classes(df.filter("course_id IS NOT NULL"))
    blocks = lambda links: sorted(map(str, matching.components(links).collect()))
    assert blocks(matching.block_links(classes)) == blocks(matching.candidates(classes))


def test_a_brand_is_reconciled_whole(spark, tmp_path):
    """parts of one brand whose titles name the same item are one item, however far their keys lie from each other."""
    spark.createDataFrame([(k, "Brand#1", "old ring", 5) for k in (5, 45, 3005, 90045, 8)], "p_partkey long, p_brand string, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = __spark_entry__.queries()["reconcile_parts"](spark, str(tmp_path)).collect()
    assert sorted((x["course_id"], x["title"], x["members"]) for x in got) == [("Brand#1", "Assignment #3", 1), ("Brand#1", "Mid-term exam", 4)]
