"""Tables of pages against a fold line by line, with wrapped cells and tables over page breaks."""

import random
import re

import pytest

from studyplane.operators import layout, tables

SPANS = "doc_id int, page int, ord int, x double, y double, w double, h double, font double, bold boolean, text string"
LINES = "doc_id int, page int, reading_order int, text string, bold boolean, cells array<string>"


def is_items(cells):
    low = " ".join(cells).lower()
    item, weight, due = (re.search(p, low) for p in (r"\b(assessment|component|item|activity|deliverable|evaluation|description)\b", r"\b(weight|marks?|percent|%|value)\b", r"\b(due|date|deadline|when)\b"))
    return bool(item and weight or item and due or weight and due)


def is_schedule(cells):
    low = " ".join(cells).lower()
    return bool(re.search(r"\b(week|lecture|lab|topic|reading|zybook)\b", low) and (re.search(r"\b(week|date|topic|chapter)\b", low) or len(cells) >= 3))


def fold(pages):
    """pages: lists of (text, bold, cells). One document, from its first line to its last."""
    done, open_table = [], None
    for page, lines in pages:
        i = 0
        while i < len(lines):
            text, _, cells = lines[i]
            head = is_items(cells) or is_schedule(cells)
            if not head and not (open_table and len(cells) > 1 and re.search(r"\d", text)):
                i += 1
                continue
            begin = i + 1 if head else i
            rows, j = [], begin
            while j < min(len(lines), begin + 50):
                t, bold, c = lines[j]
                if re.match(r"total\b", t, re.I) and re.search(r"\d\s*%", t):
                    rows.append(list(c))
                    break
                if rows and bold and re.fullmatch("[A-Z][A-Za-z ]{4,40}", t):
                    break
                if len(c) > 1 or re.search(r"\d\s*%", t):
                    rows.append(list(c))
                elif rows and len(t) < 70:
                    rows[-1][0] = f"{rows[-1][0]} {c[0]}".strip()
                elif len(rows) > 1:
                    break
                j += 1
            if not head:
                open_table["rows"] += rows
                open_table["end"] = page
                if j >= len(lines) - 1 or not rows:
                    done.append(open_table)
                    open_table = None
            else:
                made = {"page": page, "end": page, "kind": "schedule" if is_schedule(cells) else "assessment", "headers": cells, "rows": rows}
                if made["kind"] == "assessment" and not any(r[0].lower() == "total" for r in rows) and j >= len(lines) - 1:
                    open_table = made
                else:
                    if rows:
                        done.append(made)
                    open_table = None
            i = max(j, i + 1)
    if open_table and open_table["rows"]:
        done.append(open_table)
    return done


def expected(docs):
    out = []
    for d, pages in docs.items():
        for n, t in enumerate(fold(pages)):
            out += [(d, n, t["page"], t["kind"], t["headers"], r, cells) for r, cells in enumerate(t["rows"])]
    return sorted(out)


def frame(spark, docs):
    rows = [(d, p, i * 2, *line) for d, pages in docs.items() for p, lines in pages for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, LINES)


def found(df):
    return sorted((r["doc_id"], r["table_number"], r["page"], r["kind"], r["headers"], r["row_number"], r["cells"]) for r in tables.tables(df).collect())


def line(*cells, bold=False):
    return "  ".join(cells), bold, list(cells)


HEAD = line("Assessment", "Weight", "Due")


def test_heads_rows_wrapped_cells_and_page_breaks(spark):
    long = line("A line of text that goes on and on over the whole width of the page, and says nothing")
    docs = {
        1: [(1, [line("Course outline", bold=True), HEAD, line("Quiz 1", "5%", "Week 2"), line("on the first chapters"), line("Quiz 2", "5%", "Week 3"), line("Total", "100%"), line("after it")])],
        2: [(1, [HEAD, line("Lab 1", "10%", "Week 1"), line("Lab 2", "10%", "Week 2")]), (2, [line("Lab 3", "10%", "Week 3"), line("with report"), line("Lab 4", "10%", "Week 4")]), (3, [line("Lab 5", "10%", "Week 5")])],
        3: [(1, [HEAD, line("Lost", "10%", "Week 1")]), (2, [HEAD, line("Kept", "20%", "Week 2")])],
        4: [(4, [line("Week", "Topic", "Reading"), line("1", "Sets", "Ch 1"), line("2", "Maps", "Ch 2"), long, line("3", "Late", "Ch 3")])],
        5: [(1, [HEAD, line("Essay", "50%"), line("Late Policies", bold=True), line("Exam", "50%")])],
        6: [(1, [HEAD]), (2, [line("Only here 40%"), line("Final", "60%")])],
        7: [(1, [line("no table"), line("a", "b")]), (2, [long])],
    }
    assert found(frame(spark, docs)) == expected(docs)
    assert {r[0] for r in expected(docs)} == {1, 2, 3, 4, 5, 6}


@pytest.mark.parametrize("seed", range(4))
def test_pages_of_all_kinds_of_lines(spark, seed):
    r = random.Random(seed)
    kinds = [HEAD, line("Week", "Topic"), line("Quiz 1", "5%"), line("Quiz 2", "b"), line("Essay", "c"), line("short"), line("Midterm 20%"), line("Total", "100%"), line("Total", "100"), line("Total"), line("Late Policies", bold=True), line("Late Policies"), line("x" * 80), line("4 marks")]
    weights = [r.random() for _ in kinds]
    docs = {d: [(p, r.choices(kinds, weights, k=r.choice([0, 1, 2, 8, 70]))) for p in range(r.randint(1, 7))] for d in range(60)}
    docs = {d: [(p, x) for p, x in pages if x] for d, pages in docs.items()}
    assert found(frame(spark, docs)) == expected(docs)


def test_from_spans(spark):
    rows = [["Assessment", "Weight", "Due"], ["Quiz 1", "5%", "Week 2"], ["Quiz 2", "5%", "Week 3"], ["Midterm", "40%", "Oct 1, 2026"], ["Final Exam", "50%", "Exam period"]]
    spans = [(1, 1, i * 3 + k, x, 700.0 - 16 * i, 50.0, 12.0, 11.0, i == 0, c) for i, cells in enumerate(rows) for k, (x, c) in enumerate(zip((40.0, 200.0, 320.0), cells, strict=True))]
    spans += [(2, 1, 0, 40.0, 700.0, 200.0, 12.0, 11.0, False, "Component | Weight"), (2, 1, 1, 40.0, 680.0, 60.0, 12.0, 11.0, False, "Labs 20%"), (2, 1, 2, 40.0, 660.0, 60.0, 12.0, 11.0, False, None)]
    lines = layout.reading_order(layout.lines(spark.createDataFrame(spans, SPANS)))
    got = sorted((r["doc_id"], r["row_number"], r["headers"], r["cells"]) for r in tables.tables(lines).collect())
    assert [(d, n, c) for d, n, _, c in got] == [(1, i, c) for i, c in enumerate(rows[1:])] + [(2, 0, ["Labs", "20%"])]
    assert got[0][2] == rows[0] and got[-1][2] == ["Component", "Weight"]
    assert tables.tables(lines.limit(0)).count() == 0
