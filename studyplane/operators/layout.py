"""Lines, columns, reading order, headings and repeated headers of pages, from the spans that a document's pages were landed as.

A span has doc_id, page, ord (as landed), x, y (growing upwards), w, h, font (its size), bold and text."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Distances in page units (fixed values): of a line's spans in height, of words, of columns, of the centres of one column gap.
LINE_HEIGHT, WORD_GAP, COLUMN_GAP, GAP_CENTRES = 3.5, 1.2, 40.0, 25.0

#: Distance of two cells of a table.
CELL_GAP = 10.0

#: What a page needs for columns, and where they may part, as shares of its width (fixed values).
COLUMN_LINES, COLUMN_GAPS, LEFTMOST, RIGHTMOST = 6, 3, 0.25, 0.75

#: Repeated lines of page heads and feet go where this share of pages has them, but not these (fixed values).
REPEATED, KEPT = 0.6, r"(?i)[0-9]\s*%|assignment|quiz|midterm|final|due\b"

PAGE = ["doc_id", "page"]

#: The columns of lines after doc_id, page and number.
LINE = ("text", "x", "y", "w", "h", "font", "bold", "gaps", "cells")

#: Spans that are folded at once, about.
SPANS = 500_000


def _starts(sorted_values: Column, same) -> Column:
    """The first value of each run: a value begins a run if same(first of the last run, value) does not hold."""
    kind = F.array().cast("array<double>")
    return F.aggregate(sorted_values, kind, lambda runs, v: F.when((F.size(runs) > 0) & same(F.try_element_at(runs, F.lit(-1)), v), runs).otherwise(F.array_append(runs, v)))


def pages(spans: DataFrame) -> DataFrame:
    """Spans as pages: doc_id, page and spans, an array of structs. Blank and null spans, and those of no page, count for nothing."""
    usable = spans.filter((F.length(F.trim("text")) > 0) & F.col("y").isNotNull() & F.col("doc_id").isNotNull() & F.col("page").isNotNull())
    return usable.groupBy(*PAGE).agg(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), "x", "ord", "w", "h", "font", "bold", "text")).alias("spans"))


def _tidy(texts: pa.Array) -> pa.Array:
    blanks = pc.replace_substring_regex(texts, r"[ \t]+", " ")
    return pc.utf8_trim(pc.replace_substring_regex(blanks, r" ([0-9]+[\s\x0B]*%)", r"  \1"), " ")


def _begins(page: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which spans begin a line, of spans sorted by page and from high to low: the first more than LINE_HEIGHT below the last that did.

    A wider step between two neighbours always begins one; only what is left of stretches higher than a line takes further rounds, for all pages
    at once."""
    begins = np.ones(len(y), dtype=bool)
    begins[1:] = (page[1:] != page[:-1]) | ~((y[1:] == y[:-1]) | (y[:-1] - y[1:] <= LINE_HEIGHT) | (np.isnan(y[1:]) & np.isnan(y[:-1])))
    place = np.arange(len(y))
    while True:
        first = y[np.maximum.accumulate(np.where(begins, place, 0))]
        far = np.flatnonzero(first - y > LINE_HEIGHT)
        if not len(far):
            return begins
        line = np.cumsum(begins)[far]
        begins[far[np.r_[True, line[1:] != line[:-1]]]] = True


def _lists(starts: np.ndarray, total: int, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, total), pa.int32()), values)


def _numbers(values: pa.Array) -> np.ndarray:
    """As doubles, null as NaN."""
    return values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


#: What lines have, as Spark's and Arrow's types.
MADE = {"text": ("string", pa.string()), **{c: ("double", pa.float64()) for c in ("x", "y", "w", "h", "font")}, "bold": ("boolean", pa.bool_()), "gaps": ("array<double>", pa.list_(pa.float64())), "apart": ("array<string>", pa.list_(pa.string()))}


def _folded(spans: pa.ListArray, wanted: tuple[str, ...]) -> pa.ListArray:
    """The lines of each page of a batch, downwards, with what is wanted of MADE; apart: texts between gaps as wide as between cells."""
    flat = spans.flatten()
    sizes = spans.value_lengths().fill_null(0).to_numpy()
    page, n = np.repeat(np.arange(len(sizes)), sizes), len(flat)
    kind = pa.struct([(c, MADE[c][1]) for c in wanted])
    if not n:
        return _lists(np.zeros(len(sizes), dtype=np.int64), 0, pa.array([], kind))
    col = {c: _numbers(flat.field(c)) for c in ("x", "y", "w")}
    down = np.where(np.isnan(col["y"]), -np.inf, -col["y"])
    by = np.lexsort((down, page))
    begins = _begins(page[by], col["y"][by])
    line = np.empty(n, dtype=np.int64)
    line[by] = np.cumsum(begins) - 1
    left = np.where(np.isnan(col["x"]), -np.inf, col["x"])
    at = np.lexsort((_numbers(flat.field("ord")), down, left, line))
    line = line[at]
    x, y, w = (col[c][at] for c in ("x", "y", "w"))
    new = np.r_[True, line[1:] != line[:-1]]
    first = np.flatnonzero(new)
    end = np.where(new, np.nan, np.roll(x + w, 1))
    gap = x - end
    least, most = (lambda v: np.fmin.reduceat(v, first)), (lambda v: np.fmax.reduceat(v, first))
    known = lambda v: pa.array(v, mask=np.isnan(v))
    made = {"x": lambda: known(least(x)), "y": lambda: known(least(y)), "w": lambda: known(most(x + w) - least(x))}
    made["h"] = lambda: known(most(y + _numbers(flat.field("h"))[at]) - least(y))
    font = most(_numbers(flat.field("font"))[at])
    made["font"] = lambda: known(font)

    def bold() -> pa.Array:
        said = _numbers(flat.field("bold").cast(pa.int8()))[at]
        some = most(said)
        return pa.array((some == 1) | (font >= 14), mask=~(font >= 14) & (np.isnan(some) | (np.isnan(font) & (some != 1))))

    def gaps() -> pa.Array:
        wide = gap >= COLUMN_GAP
        return _lists(np.r_[0, np.cumsum(wide)][first], int(wide.sum()), pa.array((end + gap / 2)[wide]))

    pieces = pc.binary_join_element_wise(pa.array(np.where(gap > WORD_GAP, " ", "")), flat.field("text").take(pa.array(at)), "")

    def apart() -> pa.Array:
        cut = new | (gap > CELL_GAP)
        cells = pc.binary_join(_lists(np.flatnonzero(cut), n, pieces), "")
        return _lists(np.r_[0, np.cumsum(cut)][first], len(cells), _tidy(cells))

    made |= {"bold": bold, "gaps": gaps, "apart": apart, "text": lambda: _tidy(pc.binary_join(_lists(first, n, pieces), ""))}
    rows = pa.StructArray.from_arrays([made[c]().cast(MADE[c][1]) for c in wanted], fields=list(kind))
    per = np.bincount(page[at][first], minlength=len(sizes))
    return _lists(np.r_[0, np.cumsum(per)[:-1]], len(first), rows)


def folded(spans: Column, *wanted: str) -> Column:
    """The lines of one page, downwards: an array of structs of what is wanted of MADE. A line has the spans within LINE_HEIGHT of its highest one,
    which depends on their order, so pages are folded in Arrow batches, where they are."""

    def lines_of_pages(spans: pa.Array) -> pa.Array:
        # a batch has very many spans where pages are long, so they are taken a part at a time
        sizes = np.cumsum(spans.value_lengths().fill_null(0).to_numpy())
        cuts = np.r_[0, np.flatnonzero(np.diff(sizes // SPANS)) + 1, len(sizes)]
        return pa.concat_arrays([_folded(spans.slice(a, b - a), wanted) for a, b in zip(cuts, cuts[1:])])

    return F.arrow_udf(lines_of_pages, f"array<struct<{','.join(f'{c}:{MADE[c][0]}' for c in wanted)}>>")(spans)


def lines(spans: DataFrame) -> DataFrame:
    """Spans within LINE_HEIGHT of a line's highest span, from left to right, as lines: doc_id, page, number (from 0, downwards), text, x, y, w,
    h, font (the largest), bold (any, or a font of 14), gaps (centres of those as wide as between columns) and cells (texts that CELL_GAP parts,
    else bars or wide blanks in the text). Blank and null spans count for nothing. A page's spans come together in one row."""
    return page_lines(pages(spans))


def page_lines(of_pages: DataFrame, *wanted: str) -> DataFrame:
    """The same lines, or what is wanted of them, of pages (doc_id, page, spans, none of them blank): nothing is dealt or sorted by Spark."""
    wanted = wanted or LINE
    taken = [c for c in MADE if c in wanted or ("cells" in wanted and c in ("text", "apart"))]
    out = of_pages.select(*PAGE, folded(F.col("spans"), *taken).alias("_lines")).select(*PAGE, F.posexplode("_lines").alias("number", "_line")).select(*PAGE, "number", "_line.*")
    return out.select(*PAGE, "number", *(line_cells(F.col("text"), F.col("apart")).alias(c) if c == "cells" else F.col(c) for c in wanted))


def line_cells(text: Column, apart: Column) -> Column:
    return F.when(F.size(apart) > 1, apart).otherwise(text_cells(text))


def text_cells(text: Column) -> Column:
    """The cells of a line without geometry: between bars, else between two or more blanks."""
    parts = lambda pattern: F.filter(F.transform(F.split(text, pattern), lambda c: F.trim(c)), lambda c: c != "")
    return F.when(text.contains("|"), parts(r"\|")).when(F.size(parts(r"\s{2,}")) > 1, parts(r"\s{2,}")).otherwise(F.array(text))


def _parted(pages: DataFrame, page_width: float) -> DataFrame:
    """Pages with split, from n (lines) and gaps (sorted centres of all): null where there is one column."""
    starts = pages.withColumn("starts", F.when((F.col("n") >= COLUMN_LINES) & (F.size("gaps") >= COLUMN_GAPS), _starts(F.col("gaps"), lambda first, g: g - first < GAP_CENTRES)))
    of = lambda s: F.filter("gaps", lambda g: F.element_at(F.filter("starts", lambda t: t <= g), -1) == s)
    mean = lambda g: F.aggregate(g, F.lit(0.0), lambda a, v: a + v) / F.size(g)
    large = F.filter(F.transform("starts", of), lambda g: F.size(g) >= F.greatest(F.lit(2), F.floor(F.size("gaps") * 0.25)))
    split = starts.withColumn("split", F.array_min(F.transform(large, mean)))
    return split.withColumn("split", F.when(F.col("split").between(page_width * LEFTMOST, page_width * RIGHTMOST), F.col("split"))).drop("starts")


def columns(of_lines: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Where a page's two columns part: doc_id, page and split, for pages that have two. Centres of gaps within GAP_CENTRES of a cluster's first
    belong to it; the leftmost cluster with a quarter of the gaps counts, if it is not at the page's side."""
    pages = of_lines.groupBy(*PAGE).agg(F.count("*").alias("n"), F.sort_array(F.flatten(F.collect_list("gaps"))).alias("gaps"))
    return _parted(pages, page_width).select(*PAGE, "split").filter("split IS NOT NULL")


def reading_order(of_lines: DataFrame, page_width: float = 612.0) -> DataFrame:
    """The lines with column_index, by their centres, and reading_order: column by column, downwards. A page's first line carries its gaps, so
    that lines needn't be made a second time to meet their columns."""
    page = Window.partitionBy(*PAGE)
    whole = of_lines.withColumns({"n": F.count("*").over(page), "_every": F.collect_list("gaps").over(page), "_least": F.min("number").over(page)})
    first = F.when(F.col("number") == F.col("_least"), F.sort_array(F.flatten("_every")))
    met = _parted(whole.withColumns({"_own": F.col("gaps"), "gaps": first}).drop("_every", "_least"), page_width)
    met = met.withColumn("split", F.max("split").over(page)).withColumn("gaps", F.col("_own")).drop("_own", "n")
    column = F.when(F.col("x") + F.col("w") / 2 >= F.col("split"), 1).otherwise(0)
    w = Window.partitionBy(*PAGE).orderBy("column_index", F.desc("y"), "number")
    return met.withColumn("column_index", column).withColumn("reading_order", F.row_number().over(w) - 1).drop("split")


def pages_in_order(of_pages: DataFrame, page_width: float = 612.0) -> DataFrame:
    """Pages (doc_id, page, spans) with lines, an array of their lines' text, bold and cells in reading order: what reading_order(lines()) gives,
    page by page, without a row for each line."""
    whole = of_pages.select(*PAGE, folded(F.col("spans"), "text", "bold", "apart", "x", "y", "w", "gaps").alias("lines"))
    whole = whole.select(*PAGE, "lines", F.size("lines").alias("n"), F.sort_array(F.flatten("lines.gaps")).alias("gaps"))
    second = lambda s: F.coalesce(s["x"] + s["w"] / 2 >= F.col("split"), F.lit(False))
    down = lambda s: F.when(F.isnan(s["y"]), float("-inf")).otherwise(-s["y"])
    placed = F.sort_array(F.transform("lines", lambda s, n: F.struct(second(s).alias("second"), down(s).alias("down"), n.alias("number"), s.alias("line"))))
    cells = lambda s: line_cells(s["text"], s["apart"])
    return _parted(whole, page_width).select(*PAGE, F.transform(placed["line"], lambda s: F.struct(s["text"].alias("text"), s["bold"].alias("bold"), cells(s).alias("cells"))).alias("lines"))


def headings(of_lines: DataFrame) -> DataFrame:
    """Short lines in bold or a font over the page's median (the upper one) that begin like a title: doc_id, page, number, text, level."""
    page = Window.partitionBy(*PAGE)
    sized = F.count_if(F.col("font") > 0).over(page)
    place = F.row_number().over(page.orderBy(F.col("font") <= 0, "font", "number"))
    middle = F.max(F.when((F.col("_place") == F.floor(F.col("_sized") / 2) + 1) & (F.col("font") > 0), F.col("font"))).over(page)
    rows = of_lines.withColumns({"_sized": sized, "_place": place}).withColumn("_median", F.coalesce(middle, F.lit(11.0)))
    big = (F.col("font") >= F.col("_median") + 2) | F.col("bold")
    title = F.col("text").rlike("^[A-Z0-9]") & ~F.col("text").rlike(r"[0-9]\s*%") & ~F.col("text").rlike("(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)")
    level = F.when(F.col("font") >= F.col("_median") + 5, 1).otherwise(2)
    return rows.filter((F.length("text") < 90) & big & title).select(*PAGE, "number", "text", level.alias("level"))


def without_repeats(of_lines: DataFrame) -> DataFrame:
    """The lines without those that stand among the two highest, or lowest, of REPEATED of the pages; documents of under two pages or twelve
    lines keep all, and so do lines that speak of coursework."""
    of_page, of_doc = Window.partitionBy(*PAGE), Window.partitionBy("doc_id")
    down = of_page.orderBy(F.desc("y"), "number")
    # lines are dealt by document once: pages, documents and keys stay where they are, and nothing is made twice or joined
    rows = of_lines.repartition("doc_id").withColumns({"_at": F.row_number().over(down), "_n": F.count("*").over(of_page)})
    first = F.when(F.col("page").isNotNull() & (F.col("_at") == 1), 1).otherwise(0)
    rows = rows.withColumns({"_key": F.lower(F.trim("text")), "_lines": F.count("*").over(of_doc), "_pages": F.sum(first).over(of_doc)})
    of_key = Window.partitionBy("doc_id", "_key")
    rows = rows.withColumns({"_heads": F.count_if(F.col("_at") <= 2).over(of_key), "_feet": F.count_if(F.col("_n") - F.col("_at") < 2).over(of_key)})
    long = (F.col("_lines") >= 12) & (F.col("_pages") >= 2) & F.length("_key").between(9, 89) & F.col("doc_id").isNotNull()
    often = F.greatest("_heads", "_feet") >= F.greatest(F.lit(2), F.ceil(F.col("_pages") * REPEATED))
    goes = F.when(long & often, ~F.col("text").rlike(KEPT)).otherwise(False)
    return rows.filter(~goes).select(*of_lines.columns)


#: Characters and misread words of outlines and what they stand for (fixed values).
CHARACTERS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", "•": "-", "‣": "-", "◦": "-", "⁃": "-", "¡": "i", "​": "", "‌": "", "‍": "", "﻿": "", "\0": ""}
MISREAD = ((r"ClS\*", "CIS*"), (r"\bFaII\b", "Fall"), (r"(?i)\blnstructor\b", "Instructor"), (r"(?i)\bEvaIuation\b", "Evaluation"), (r"(?i)\bEmaiI\b", "Email"))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def outline_text(text: Column) -> Column:
    """The text in compatibility form (which only Python has), with plain quotes, dashes and bullets, and without common misreadings."""
    out = F.replace(_nfkc(text), F.lit("\r\n"), F.lit("\n"))
    out = F.translate(out, "".join(k for k, v in CHARACTERS.items() if v) + "".join(k for k, v in CHARACTERS.items() if not v), "".join(CHARACTERS.values()))
    for pattern, by in MISREAD:
        out = F.regexp_replace(out, pattern, by)
    return out
