"""Layout against brute force: the folds of heights and gaps, repeated lines, and cleaned text."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from studyplane.operators import layout

SPANS = "doc_id int, page int, ord int, x double, y double, w double, h double, font double, bold boolean, text string, extra string"


def brute_lines(spans):
    rows = []
    for s in sorted((s for s in spans if s[9] and s[9].strip()), key=lambda s: (-s[4], s[3], s[2])):
        row = next((r for r in rows if abs(r[0][4] - s[4]) <= 3.5), None)
        row.append(s) if row else rows.append([s])
    out = []
    for row in rows:
        row.sort(key=lambda s: (s[3], -s[4], s[2]))
        text = row[0][9]
        for a, b in zip(row, row[1:]):
            text += (" " if b[3] - (a[3] + a[5]) > 1.2 else "") + b[9]
        out.append((len(out), re.sub(r" ([0-9]+\s*%)", r"  \1", re.sub(r"[ \t]+", " ", text)).strip(" ")))
    return out


def test_lines_equal_a_fold_of_spans(spark):
    r = random.Random(5)
    spans = [(r.choice([1, 2]), r.choice([1, 2]), i, float(r.randrange(0, 500, 7)), r.randrange(0, 160) / 2, float(r.randrange(5, 30)), 10.0, 11.0, False, r.choice(["a", "Weight", "20 %", " ", "", None, "é"]), "e") for i in range(400)]
    got = layout.lines(spark.createDataFrame(spans, SPANS)).collect()
    for doc in (1, 2):
        for page in (1, 2):
            want = brute_lines([s for s in spans if s[:2] == (doc, page)])
            assert sorted((x.number, x.text) for x in got if (x.doc_id, x.page) == (doc, page)) == want


def test_no_spans_no_lines(spark):
    empty = layout.lines(spark.createDataFrame([], SPANS))
    assert layout.reading_order(empty).count() == layout.headings(empty).count() == layout.without_repeats(empty).count() == 0


def test_two_columns_are_read_one_after_the_other(spark):
    line = lambda n, x, gaps: (1, 1, n, f"line {n}", float(x), 700.0 - 12 * n, 200.0, 10.0, 11.0, False, gaps)
    rows = [line(0, 50, [300.0]), line(1, 350, [302.0]), line(2, 50, [324.9]), line(3, 350, []), line(4, 50, [90.0]), line(5, 350, [])]
    df = spark.createDataFrame(rows, "doc_id int, page int, number int, text string, x double, y double, w double, h double, font double, bold boolean, gaps array<double>")
    assert [r.split for r in layout.columns(df).collect()] == [(300.0 + 302.0 + 324.9) / 3]
    assert [r.number for r in layout.reading_order(df).orderBy("reading_order").collect()] == [0, 2, 4, 1, 3, 5]
    assert layout.columns(df.filter("number < 5")).count() == 0


def test_repeated_heads_go_and_coursework_stays(spark):
    rows = [(d, p, n, "Course outline" if n == 0 else "Quiz 1 is due soon" if n == 5 else f"text {d} {p} {n}", 100.0 - n) for d in (1, 2) for p in range(2 if d == 1 else 1) for n in range(12)]
    kept = layout.without_repeats(spark.createDataFrame(rows, "doc_id int, page int, number int, text string, y double")).collect()
    assert len(kept) == len(rows) - 2 and not [r for r in kept if r.doc_id == 1 and r.number == 0]


def test_outline_text(spark):
    texts = ["ﬁnal–exam’s​  20•", "ClS*1500 lnstructor FaII", None, "", "We¡ght ½\r\n\0x", "Ａ" * 5000]
    got = {r.i: r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", layout.outline_text(F.col("t")).alias("t")).collect()}
    assert got == {0: "final-exam's  20-", 1: "CIS*1500 Instructor Fall", 2: None, 3: "", 4: f"Weight {unicodedata.normalize('NFKC', '½')}\nx", 5: "A" * 5000}


def test_spans_are_dealt_once(spark):
    """Lines, columns and reading order of a page take one exchange of its spans, and one of its heights."""
    rows = [(1, 1, i, 50.0 + i, 700.0 - i % 3 * 12, 10.0, 10.0, 11.0, False, f"w{i}") for i in range(9)] + [(1, 1, 9, 1.0, None, 1.0, 1.0, 1.0, False, "nowhere"), (1, None, 10, 1.0, 1.0, 1.0, 1.0, 1.0, False, "no page")]
    spans = spark.createDataFrame(rows, "doc_id int, page int, ord int, x double, y double, w double, h double, font double, bold boolean, text string")
    found = layout.reading_order(layout.lines(spans))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert [(r.number, r.reading_order, r.column_index) for r in found.orderBy("number").collect()] == [(0, 0, 0), (1, 1, 0), (2, 2, 0)]
