"""Tables of laid-out pages: header lines, rows, cells that are wrapped, and tables that go on over page breaks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from ..functions.state import let
from ..functions.text import bounded
from .layout import PAGE

#: Words of table heads (fixed values): of items, weights and dates, of schedules, and of a schedule's second column.
ITEM, WEIGHT, DUE = r"\b(assessment|component|item|activity|deliverable|evaluation|description)\b", r"\b(weight|marks?|percent|%|value)\b", r"\b(due|date|deadline|when)\b"
SCHEDULE, SCHEDULE_TOO = r"\b(week|lecture|lab|topic|reading|zybook)\b", r"\b(week|date|topic|chapter)\b"

#: Lines after its head that a table may take up on a page, and characters of a line that can be a wrapped cell (fixed values).
LONGEST, WRAPPED = 50, 70

#: What a line is, as bits.
ITEMS_HEAD, SCHEDULE_HEAD, CELLS, DIGIT, PERCENT, TOTAL, SECTION, SHORT, BARE_TOTAL = (1 << k for k in range(9))

#: What becomes of a stretch of rows: a table of its own, one that may go on, more rows of the open one, its last rows, or nothing.
CLOSED, OPENED, MORE, LAST, NOTHING = range(5)


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(bounded(pattern))


def line_kind(text: Column, cells: Column, bold: Column) -> Column:
    """The bits of a line."""
    return let(F.lower(F.array_join(cells, " ")), lambda head: let(text.rlike(r"[0-9]\s*%"), lambda percent: _kind(text, cells, bold, head, percent)))


def _kind(text: Column, cells: Column, bold: Column, head: Column, percent: Column) -> Column:
    item, weight, due = (_has(head, p) for p in (ITEM, WEIGHT, DUE))
    bit = lambda which, value: F.when(F.coalesce(which, F.lit(False)), value).otherwise(0)
    return (
        bit(F.when(item, weight | due).otherwise(weight & due), ITEMS_HEAD)
        + bit(_has(head, SCHEDULE) & (_has(head, SCHEDULE_TOO) | (F.size(cells) >= 3)), SCHEDULE_HEAD)
        + bit(F.size(cells) >= 2, CELLS)
        + bit(text.rlike("[0-9]"), DIGIT)
        + bit(percent, PERCENT)
        + bit(percent & _has(text, r"(?i)^total\b"), TOTAL)
        + bit(text.rlike("^[A-Z][A-Za-z ]{4,40}$") & bold, SECTION)
        + bit(F.length(text) < WRAPPED, SHORT)
        + bit(F.lower(F.get(cells, F.lit(0))) == "total", BARE_TOTAL)
    )


def stretches(lines: list[int], pending: bool) -> tuple[list[tuple[int, int, int, int]], bool]:
    """The stretches of rows of one page, (head or -1, first row line, line after the last, what becomes of it), and whether a table is open
    after it; pending: whether one is before it.

    A head begins a stretch; while a table is open so does a line of cells with a digit. It ends behind a total, before a section's title in
    bold or a long line after two rows, after LONGEST lines, or with the page. The line that ends it is looked at again."""
    out, i, n = [], 0, len(lines)
    while i < n:
        head = bool(lines[i] & (ITEMS_HEAD | SCHEDULE_HEAD))
        if not head and not (pending and lines[i] & CELLS and lines[i] & DIGIT):
            i += 1
            continue
        first = i + 1 if head else i
        rows, bare, j, stop = 0, False, first, None
        while j < min(n, first + LONGEST):
            line = lines[j]
            if line & TOTAL:
                rows, bare, stop = rows + 1, bare or bool(line & BARE_TOTAL), j + 1
                break
            if rows and line & SECTION and not line & DIGIT:
                break
            if line & (CELLS | PERCENT):
                rows += 1
                bare = bare or bool(line & BARE_TOTAL) and not _wrapped(lines, j)
            elif not (rows and line & SHORT) and rows >= 2:
                break
            j += 1
        stop = j if stop is None else stop
        if not head:
            done = j >= n - 1 or not rows
            out.append((-1, first, stop, LAST if done else MORE))
            pending = not done
        else:
            goes_on = not lines[i] & SCHEDULE_HEAD and not bare and j >= n - 1
            out.append((i, first, stop, OPENED if goes_on else CLOSED if rows else NOTHING))
            pending = goes_on
        i = max(j, i + 1)
    return out, pending


def _wrapped(lines: list[int], j: int) -> bool:
    """Whether the next line is the rest of line j's first cell."""
    if j + 1 >= len(lines):
        return False
    after = lines[j + 1]
    return not after & (TOTAL | CELLS | PERCENT) and not (after & SECTION and not after & DIGIT) and bool(after & SHORT)


_STRETCH = ArrayType(StructType([StructField(n, IntegerType()) for n in ("head", "first", "stop", "what")]))
_BOTH = StructType([StructField("closed", _STRETCH), StructField("closed_after", BooleanType()), StructField("open", _STRETCH), StructField("open_after", BooleanType())])


@F.pandas_udf(_BOTH)
def _both_ways(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Each page's stretches where no table is open before it, and where one is."""
    fields = ("head", "first", "stop", "what")
    for kinds in pages:
        known: dict = {}  # pages of the same kinds of lines are looked at once
        shapes = [tuple(k) for k in kinds]
        named = lambda s: [dict(zip(fields, x, strict=True)) for x in s]
        for k in set(shapes):
            known[k] = [(named(out), after) for out, after in (stretches(list(k), p) for p in (False, True))]
        made = [known[k] for k in shapes]
        yield pd.DataFrame({"closed": [a[0] for a, _ in made], "closed_after": [a[1] for a, _ in made], "open": [b[0] for _, b in made], "open_after": [b[1] for _, b in made]})


#: As if it were not deterministic, so that what looks at its columns doesn't call it anew.
_once = _both_ways.asNondeterministic()


def tables(of_lines: DataFrame) -> DataFrame:
    """The rows of all tables: doc_id, table_number (from 0), page, end_page, kind (assessment, schedule), headers, row_number (from 0), cells.

    of_lines: lines in reading order (doc_id, page, reading_order, text, bold, cells). Null texts and pages without lines have no tables."""
    line = F.struct("reading_order", "text", "bold", "cells")
    return page_tables(of_lines.filter("text IS NOT NULL").groupBy(*PAGE).agg(F.sort_array(F.collect_list(line)).alias("lines")))


def _rows(body: Column) -> Column:
    """The rows of a stretch of lines (cells, kind): a line of cells, a percentage or a total, with the first cells of the short lines behind it."""
    cell = lambda s: F.get(s["cells"], F.lit(0))
    is_row = lambda s: s["kind"].bitwiseAND(CELLS | PERCENT | TOTAL) > 0
    begins = F.filter(F.transform(body, lambda s, i: F.when(is_row(s), i)), lambda i: i.isNotNull())

    def row(at: Column, b: Column, n: Column) -> Column:
        more = F.filter(F.slice(body, b + 2, F.coalesce(F.get(at, n + 1), F.size(body)) - b - 1), lambda s: s["kind"].bitwiseAND(SHORT) > 0)
        own = F.get(body, b)
        first = F.trim(F.array_join(F.concat(F.array(cell(own)), F.array_compact(F.transform(more, cell))), " "))
        return F.concat(F.array(first), F.slice(own["cells"], 2, 1 << 30))

    return let(begins, lambda at: F.transform(at, lambda b, n: row(at, b, n)))


def page_tables(pages: DataFrame) -> DataFrame:
    """The same rows from pages: doc_id, page and lines, an array of structs with text (not null), bold and cells in reading order.

    Lines of a page become bits, which are looked at page by page, for both cases: a table is open before the page, or none. Which case holds
    is carried over a document's pages by a window: a page either settles whether a table is open after it, keeps that or turns it round, so it
    is what the last page settled that did, turned round as often as since then. A head while a table is open gives up that table, as it was
    never ended. A line of one short cell after a row is the rest of its first cell. Rows of a stretch are cut out of their page before
    documents are looked at, and documents are dealt once, so that no line is written twice or joined."""
    kinds = F.transform("lines", lambda s: line_kind(s["text"], s["cells"], F.coalesce(s["bold"], F.lit(False))))
    pages = pages.select(*PAGE, F.transform("lines", lambda s: s["cells"]).alias("cells"), kinds.alias("kinds"))
    pages = pages.select(*PAGE, F.arrays_zip("cells", F.col("kinds").alias("kind")).alias("lines"), _once("kinds").alias("b")).select(*PAGE, "lines", "b.*")
    pages = pages.filter((F.size("closed") > 0) | (F.size("open") > 0))
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    settles, turns = F.col("closed_after") == F.col("open_after"), F.col("closed_after") & ~F.col("open_after")
    upto = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    pages = pages.withColumn("turns", F.sum(turns.cast("int")).over(upto))
    last = lambda c: F.last(F.when(settles, c), ignorenulls=True).over(before)
    turned = F.coalesce(F.max("turns").over(before), F.lit(0)) - F.coalesce(last(F.col("turns")), F.lit(0))
    is_open = (F.coalesce(last(F.col("closed_after").cast("int")), F.lit(0)) + turned) % 2 == 1

    def stretch(s: Column) -> Column:
        body = F.slice("lines", F.least(s["first"], s["stop"]) + 1, F.greatest(s["stop"] - s["first"], F.lit(0)))
        head = F.get(F.col("lines"), s["head"])
        kind = F.when(head["kind"].bitwiseAND(SCHEDULE_HEAD) > 0, "schedule").otherwise("assessment")
        return F.struct(s["what"].alias("what"), F.struct(head["cells"].alias("headers"), kind.alias("kind")).alias("head"), let(body, _rows).alias("rows"))

    pages = pages.withColumn("is_open", is_open).select(*PAGE, "lines", F.when(F.col("is_open"), F.col("open")).otherwise(F.col("closed")).alias("found"))
    found = pages.select(*PAGE, F.posexplode(F.transform("found", stretch)).alias("at", "s")).select(*PAGE, "at", "s.*").withColumn("n", F.size("rows"))
    whole, group = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "group")
    begins = F.col("what").isin(CLOSED, OPENED, NOTHING).cast("int")
    found = found.withColumn("group", F.sum(begins).over(whole.orderBy("page", "at").rowsBetween(Window.unboundedPreceding, 0)))
    kept = F.max((F.col("what") == CLOSED) | (F.col("what") == LAST)).over(group) | (F.max(F.col("what") == OPENED).over(group) & (F.col("group") == F.col("_last")))
    of_group = group.orderBy("page", "at")
    found = found.withColumn("_last", F.max("group").over(whole)).withColumns({
        "kept": kept,
        "upto": F.sum("n").over(of_group.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"),
        "head": F.first("head").over(of_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "first_page": F.min("page").over(group),
        "end_page": F.max(F.when(F.col("n") > 0, F.col("page"))).over(group),
    })
    found = found.filter(F.col("kept") & F.col("end_page").isNotNull()).withColumn("table_number", F.dense_rank().over(whole.orderBy("group")) - 1)
    rows = found.select("doc_id", "table_number", F.col("first_page").alias("page"), "end_page", "head.kind", "head.headers", "upto", F.posexplode("rows").alias("at", "cells"))
    return rows.select("doc_id", "table_number", "page", "end_page", "kind", "headers", (F.col("upto") + F.col("at")).cast("int").alias("row_number"), "cells")
