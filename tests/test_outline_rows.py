"""Passes over outlines against folds line by line, and cases as outlines have them."""

import random
import re
from datetime import date

import pytest

from studyplane.operators import outline_rows as rows

WORK = re.compile(rows.WORK[4:], re.I)
MESSY = """Methods of Evaluation
Assessment          Weight     Due Date
Assignment 1          10%      Week 3
Assignment 2          10%      October 9, 2026
covering lists and trees
Quizzes (best 5 of 7) 15%
Labs\t10%\tweekly
Midterm | 20% | October 20, 2026
Final Exam            35%      Exam period
Total                100%
Late Policy
Late work 5% a day"""


def frame(spark, texts):
    return rows.lines(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, place int"))


def split(line):
    for gap in ("\t+", r"\|"):
        if re.search(gap, line):
            return [c.strip() for c in re.split(gap, line) if c.strip()]
    parts = [c.strip() for c in re.split(r"\s{2,}", line) if c.strip()]
    if len(parts) > 1:
        return parts
    m = re.match(r"^(.+?)\s+(\d{1,3}(?:\.\d+)?\s*%|due\b.*)$", line, re.I)
    return [m[1].strip(), m[2].strip()] if m else [line]


def lines_of(text):
    return [x.strip() for x in text.split("\n") if x.strip() and x.strip() != "--- page break ---"]


def fold_table(lines):
    item, weight, due = (re.compile(p[4:], re.I) for p in (rows.HEAD_ITEM, rows.HEAD_WEIGHT, rows.HEAD_DUE))
    head = next((i for i, x in enumerate(lines) if item.search(x) and (weight.search(x) or due.search(x))), None)
    if head is None:
        return []
    out = []
    for i in range(head + 1, min(len(lines), head + 40)):
        x = lines[i]
        if re.match(r"total\b", x, re.I) and re.search(r"\d\s*%", x):
            out.append([split(x), x])
            break
        if out and re.fullmatch("[A-Z][A-Za-z ]{4,40}", x) and not WORK.search(x):
            break
        c = split(x)
        if len(c) > 1 or WORK.search(x) and re.search(r"\d", x):
            out.append([c, x])
        elif out and len(x) < 60:
            out[-1][0][0] += " " + c[0]
            out[-1][1] += " " + x
    return out if len(out) > 1 else []


def fold_unwrapped(lines):
    out, i = [], 0
    while i < len(lines):
        x = lines[i]
        if i + 1 < len(lines) and WORK.search(x) and not re.search(r"\d\s*%", x) and (re.match(r"\d{1,3}(\.\d+)?\s*%", lines[i + 1]) or re.search(r"\b(week\s*\d+|due\b)", lines[i + 1], re.I)):
            out.append((i, f"{x}  {lines[i + 1]}"))
            i += 1
        else:
            out.append((i, x))
        i += 1
    return out


def test_an_outline_with_a_table(spark):
    df = frame(spark, [MESSY, None, "", "no table\nat all"])
    items = rows.table_items(rows.table_rows(df), 2026).orderBy("place").collect()
    assert [(r["title"], r["type"], r["weight"], r["due_label"], r["due"], r["certainty"], r["confidence"]) for r in items] == [
        ("Assignment 1", "assignment", 10.0, "Week 3", None, "approximate", 0.85),
        ("Assignment 2 covering lists and trees", "assignment", 10.0, "October 9, 2026", date(2026, 10, 9), "exact", 0.85),
        ("Quizzes (best 5 of 7)", "other", 15.0, None, None, "unknown", 0.8),
        ("Labs", "other", 10.0, "weekly", None, "unknown", 0.85),
        ("Midterm", "midterm", 20.0, "October 20, 2026", date(2026, 10, 20), "exact", 0.85),
        ("Final Exam", "final", 35.0, "Exam period", None, "approximate", 0.85),
    ]


def sample(seed):
    r = random.Random(seed)
    kinds = ["Assessment   Weight   Due", "Component | Weight", "Quiz 1   5%", "Quiz 2 5% due Oct 3", "Labs", "10%", "Week 3", "due Oct 1", "Essay", "Midterm Exam", "Late Policy", "Total   100%", "Total", "more of the title", "x" * 70, "a\tb", "--- page break ---", "", "Project 20%", "Participation"]
    return ["\n".join(r.choices(kinds, k=r.choice([0, 1, 5, 12, 60]))) for _ in range(120)]


@pytest.mark.parametrize("seed", range(2))
def test_tables_and_wrapped_lines_against_folds(spark, seed):
    texts = sample(seed)
    df = frame(spark, texts)
    got = {}
    for r in rows.table_rows(df).orderBy("doc_id", "row_number").collect():
        got.setdefault(r["doc_id"], []).append([r["cells"], r["raw"]])
    assert got == {i: fold_table(lines_of(t)) for i, t in enumerate(texts) if fold_table(lines_of(t))}
    joined = {}
    for r in rows.unwrapped(df).orderBy("doc_id", "place").collect():
        joined.setdefault(r["doc_id"], []).append((r["place"], r["line"]))
    assert joined == {i: fold_unwrapped(lines_of(t)) for i, t in enumerate(texts) if lines_of(t)}


def test_weights_line_by_line(spark):
    text = "1. Assignment 1\n15%\nQuiz total   10%  Oct 2\nMidterm - 20%\nFinal exam 40.5% December 9\nTotal   100%\nParticipation 120%\nLab report\ndue Friday\nEssay: 5% due Nov 3, 2026"
    got = rows.weight_lines(frame(spark, [text, None]), 2026).orderBy("place").collect()
    assert [(r["title"], r["weight"], r["due_label"], r["due"]) for r in got] == [
        ("Assignment 1", 15.0, None, None),
        ("Quiz total", 10.0, "Oct 2", date(2026, 10, 2)),
        ("Midterm", 20.0, None, None),
        ("Final exam", 40.5, "December 9", date(2026, 12, 9)),
        ("Essay", 5.0, "due Nov 3, 2026", date(2026, 11, 3)),
    ]


def test_sections(spark):
    text = "Instructor: Dr. A\nroom 5\nOffice hours\nMonday 2pm\nTuesday\nLab Work\nLate Policy\nnone\n2) Instructor: B"
    got = {(r["doc_id"], r["section"]): r["body"] for r in rows.section_bodies(frame(spark, [text, "nothing", None]), {"who": ("Instructor", "Professor"), "when": ("Office hours",), "late": ("Late",)}).collect()}
    assert got == {(0, "who"): "Dr. A\nroom 5", (0, "when"): "Monday 2pm", (0, "late"): "Policy\nnone\n2) Instructor: B"}
