"""Outline texts to rows, pass by pass: the lines, an evaluation table and its items, weights line by line, bodies of sections.

Each pass is an operator over documents as lists of their lines, whose places tell where a row came from. What a line means may depend on
the lines before it, which stand beside it in the list; so nothing is sorted or shuffled behind the texts. Rows of single lines, as `lines`
gives them, are brought together by document first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.state import let
from ..functions.text import bounded, outline_type
from .deadlines import date_label

#: Words of coursework, of a table's head by what its column holds, and of heads that are no item (fixed values).
WORK = r"(?i)\b(assignment|assign\.?|homework|hw|quiz|quizzes|lab|labs|project|mid[- ]?term|final|exam|test|tests|participation|attendance|presentation|discussion|essay|report|portfolio|workshop|practicum|tutorial)\b"
HEAD_ITEM, HEAD_WEIGHT, HEAD_DUE = r"(?i)\b(assessment|component|item|activity|deliverable|evaluation)\b", r"(?i)\b(weight|marks?|percent|%|value)\b", r"(?i)\b(due|date|deadline|when)\b"
TITLE_KEYS, WEIGHT_KEYS, DUE_KEYS = ("assessment", "component", "item", "activity", "deliverable", "evaluation", "description"), ("weight", "mark", "percent", "%", "value"), ("due", "date", "deadline", "when")
NO_ITEM, NO_WEIGHT_ITEM = r"(?i)^(assessment|component|weight|due|date|total)$", r"(?i)^(weight|component|assessment|evaluation|marks?|total)$"

#: Lines behind a head that a table may take up, and characters of the rest of a title and of a section's heading (fixed values).
TABLE_LINES, WRAPPED, HEADING = 40, 60, 120

#: A title and its weight on a line, then what follows, in the order in which they are tried; and days in words (fixed values).
WEIGHT_LINES = (r"^(.{3,80}?)\s{2,}(\d{1,3}(?:\.\d+)?)\s*%(?:\s+(.*))?$", r"^(.{3,80}?)\s*[-|:]\s*(\d{1,3}(?:\.\d+)?)\s*%(?:\s+(.*))?$", r"^(.{3,80}?)\s+(\d{1,3}(?:\.\d+)?)\s*%(?:\s+[-–]?\s*(.*))?$")
DAYS = r"(?i)\b(week\s*\d+|jan\w*\s+\d{1,2}|feb\w*\s+\d{1,2}|mar\w*\s+\d{1,2}|apr\w*\s+\d{1,2}|may\s+\d{1,2}|jun\w*\s+\d{1,2}|jul\w*\s+\d{1,2}|aug\w*\s+\d{1,2}|sep\w*\s+\d{1,2}|oct\w*\s+\d{1,2}|nov\w*\s+\d{1,2}|dec\w*\s+\d{1,2}(?:\s*,?\s*\d{4})?)"

#: A day with what stands up to the next comma, and its year, as lines of weights have it (fixed value).
DAYS_OF_LINES = r"(?i)\b(week\s*\d+|jan\w*\s+\d{1,2}[^,]*(?:,\s*\d{4})?|feb\w*\s+\d{1,2}[^,]*(?:,\s*\d{4})?|mar\w*\s+\d{1,2}|apr\w*\s+\d{1,2}|may\s+\d{1,2}|jun\w*\s+\d{1,2}|jul\w*\s+\d{1,2}|aug\w*\s+\d{1,2}|sep\w*\s+\d{1,2}|oct\w*\s+\d{1,2}|nov\w*\s+\d{1,2}|dec\w*\s+\d{1,2})"
DUE_WORDS = r"(?i)\bdue\b[:\s-]*(.+)$"
_PERCENT = r"\d\s*%"

#: White space at the ends of lines, with the separators of lines and paragraphs (fixed value).
BLANK = " \t\n\x0b\f\r\u2028\u2029"


def _is(text: Column, pattern: str) -> Column:
    return text.rlike(bounded(pattern))


def _got(text: Column, pattern: str, k: int = 1) -> Column:
    """The k-th group where the pattern is found and the group isn't empty."""
    return let(F.regexp_extract(text, bounded(pattern), k), lambda got: F.when(got != "", got))


def listed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and lines: a document's lines trimmed, their inner blanks kept, without empty ones and page breaks. Null texts have null."""
    trimmed = F.transform(F.split(F.col(text_col), "\n"), lambda line: F.btrim(line, F.lit(BLANK)))
    return docs.select(F.col(id_col).alias("doc_id"), F.filter(trimmed, lambda line: (line != "") & (line != "--- page break ---")).alias("lines"))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place (from 0, among lines that count) and line, of the lines that `listed` gives."""
    return listed(docs, id_col, text_col).select("doc_id", F.posexplode("lines").alias("place", "line"))


def _listed(of_lines: DataFrame) -> DataFrame:
    """Documents with their lines, of either form."""
    if "lines" in of_lines.columns:
        return of_lines
    by_place = F.array_sort(F.collect_list(F.struct("place", "line")))
    return of_lines.groupBy("doc_id").agg(F.transform(by_place, lambda s: s["line"]).alias("lines"))


def _first(flags: Column) -> Column:
    """The place (from 0) of the first true one; null if there is none."""
    return let(F.array_position(flags, True), lambda at: F.when(at > 0, (at - 1).cast("int")))


def _behind(many: Column, at: Column, upto: Column) -> Column:
    """What stands behind a place and before another one."""
    return F.slice(many, at + 2, F.greatest(upto - at - 1, F.lit(0)))


def cells(line: Column) -> Column:
    """A line's cells: between tabs, else bars, else wide blanks, else a title and the weight or due date at its end."""
    parts = lambda pattern: F.filter(F.transform(F.split(line, pattern), lambda c: F.trim(c)), lambda c: c != "")
    ending = bounded(r"(?i)^(.+?)\s+(\d{1,3}(?:\.\d+)?\s*%|due\b.*)$")
    two = F.array(F.trim(F.regexp_extract(line, ending, 1)), F.trim(F.regexp_extract(line, ending, 2)))
    wide = let(parts(r"\s{2,}"), lambda c: F.when(F.size(c) > 1, c).when(line.rlike(ending), two).otherwise(F.array(line)))
    return F.when(line.contains("\t"), parts(r"\t+")).when(line.contains("|"), parts(r"\|")).otherwise(wide)


def table_rows(of_lines: DataFrame) -> DataFrame:
    """The rows of each document's evaluation table: doc_id, header, place (of the row's first line), row_number (from 0), cells and raw.

    The first line that names items with weights or dates is the head. Rows have two cells, or a word of coursework and a number; a short line
    of one cell is the rest of the title above it. The table ends with a total, before a line like a heading, or after TABLE_LINES; a table
    of one row is none."""

    def told(line: Column, k: Column) -> Column:
        """What a line behind the head is."""
        total = _is(line, r"(?i)^total\b") & line.rlike(_PERCENT)
        heading = line.rlike("^[A-Z][A-Za-z ]{4,40}$") & ~_is(line, WORK)
        made = lambda total, own: F.struct(k.alias("k"), line.alias("line"), own.alias("cells"), total.alias("total"), (total | (F.size(own) > 1) | (_is(line, WORK) & line.rlike("[0-9]"))).alias("is_row"), heading.alias("heading"))
        return let(total, lambda total: let(cells(line), lambda own: made(total, own)))

    def ended(of: Column) -> Column:
        """The lines before the table's end."""
        stop = lambda first: _first(F.transform(of, lambda s: F.coalesce((s["heading"] & ~s["total"] & (s["k"] > first)) | (s["total"]), F.lit(False))))
        cut = lambda at: F.when(at.isNull(), of).otherwise(F.slice(of, 1, at + F.get(of, at)["total"].cast("int")))
        return let(_first(F.transform(of, lambda s: s["is_row"])), lambda first: let(stop(first), cut))

    def row(of: Column, own: Column, upto: Column) -> Column:
        rest = F.filter(_behind(of, own["k"], upto), lambda s: F.length(s["line"]) < WRAPPED)
        title = lambda rest: F.trim(F.array_join(F.concat(F.array(own["cells"][0]), F.transform(rest, lambda s: s["cells"][0])), " "))
        raw = lambda rest: F.array_join(F.concat(F.array(own["line"]), F.transform(rest, lambda s: s["line"])), " ")
        return let(rest, lambda rest: F.struct(own["k"].alias("k"), F.concat(F.array(title(rest)), F.slice(own["cells"], 2, 1 << 30)).alias("cells"), raw(rest).alias("raw")))

    def rows(of: Column) -> Column:
        each = lambda begun: F.when(F.size(begun) > 1, F.transform(begun, lambda own, n: row(of, own, F.coalesce(F.get(begun, n + 1)["k"], F.size(of)))))
        return let(F.filter(of, lambda s: s["is_row"]), each)

    head = lambda line: _is(line, HEAD_ITEM) & (_is(line, HEAD_WEIGHT) | _is(line, HEAD_DUE))
    found = lambda at: F.struct(at.alias("head"), F.get("lines", at).alias("line"), let(F.transform(F.slice("lines", at + 2, TABLE_LINES - 1), told), lambda of: let(ended(of), rows)).alias("rows"))
    tables = _listed(of_lines).select("doc_id", let(_first(F.transform("lines", head)), lambda at: F.when(at.isNotNull(), found(at))).alias("t"))
    tables = tables.select("doc_id", cells(F.col("t.line")).alias("header"), F.col("t.head").alias("head"), F.posexplode("t.rows").alias("row_number", "r"))
    return tables.select("doc_id", "header", (F.col("head") + 1 + F.col("r.k")).alias("place"), F.col("row_number").cast("long").alias("row_number"), "r.cells", "r.raw")


def _column(keys: tuple[str, ...]) -> Column:
    """The place (from 1) of the first head that holds a key, or 0."""
    return F.array_position(F.transform("header", lambda h: F.exists(F.array(*map(F.lit, keys)), lambda k: F.contains(F.lower(h), k))), True).cast("int")


def _named(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"^[-*0-9.)\s]+", ""))


def _dated(label: Column, year: int) -> Column:
    return F.when(label.isNotNull(), date_label(label, year))


def table_items(rows: DataFrame, year: int) -> DataFrame:
    """Items of table rows: doc_id, place, title, type, weight, due_label, due, certainty, confidence, snippet. The head tells which column is
    which; a weight and a date that no column has are looked for in the row. Totals, heads and rows that speak of no work and have no
    weight are left out."""
    title_at, weight_at, due_at = F.greatest(_column(TITLE_KEYS), F.lit(1)), _column(WEIGHT_KEYS), _column(DUE_KEYS)
    weight_at = let(weight_at, lambda at: F.when(at > 0, at).when(F.size("header") > 1, F.size("header")).otherwise(0))
    cell = lambda at: let(at, lambda at: F.when(at > 0, F.try_element_at("cells", F.greatest(at, F.lit(1)))))
    title = _named(F.coalesce(cell(title_at), F.col("cells")[0]))
    number = let(_got(cell(weight_at), r"(\d{1,3}(?:\.\d+)?)").cast("double"), lambda n: F.when(n <= 100, n))
    weight = F.coalesce(number, _got(F.col("raw"), r"(\d{1,3}(?:\.\d+)?)\s*%").cast("double"))
    label = F.coalesce(let(cell(due_at), lambda due: F.when(due != "", due)), _got(F.col("raw"), DUE_WORDS), _got(F.col("raw"), DAYS))
    made = rows.select("doc_id", "place", "raw", F.inline(F.array(F.struct(title.alias("_title"), weight.alias("_weight"), label.alias("_label")))))
    made = made.filter((F.col("_title") != "") & ~_is(F.col("_title"), NO_ITEM) & (F.col("_weight").isNotNull() | _is(F.col("_title"), WORK)))
    return _items(made, F.col("raw"), year, F.when(F.col("_weight").isNull(), 0.55).when(F.col("_label").isNotNull(), 0.85).otherwise(0.8))


def _items(made: DataFrame, line: Column, year: int, sure: Column) -> DataFrame:
    """Items as table_items gives them, of _title, _weight and _label."""
    dated = made.withColumn("_due", _dated(F.col("_label"), year))
    label = [F.left("_label", F.lit(80)).alias("due_label"), F.col("_due.day").alias("due"), F.coalesce("_due.certainty", F.lit("unknown")).alias("certainty")]
    return dated.select("doc_id", "place", F.left("_title", F.lit(120)).alias("title"), outline_type(F.col("_title")).alias("type"), F.col("_weight").alias("weight"), *label, sure.alias("confidence"), F.left(line, F.lit(200)).alias("snippet"))


def unwrapped(of_lines: DataFrame) -> DataFrame:
    """Lines, a title joined with the weight or date that stands alone on the next line. A line that was taken in takes in none: of a run of
    lines that each could, every second one does."""
    stands = lambda after: F.coalesce(after.rlike(r"^\d{1,3}(?:\.\d+)?\s*%") | after.rlike(bounded(r"(?i)\b(week\s*\d+|due\b)")), F.lit(False))
    could = lambda line, k: ~line.rlike(_PERCENT) & let(F.get("lines", k + 1), stands) & _is(line, WORK)
    # a letter for each line: of a run of 1, each second one joins (J) what it takes in (T)
    marks = F.split(F.regexp_replace(F.array_join(F.transform("lines", lambda line, k: F.when(could(line, k), "1").otherwise("0")), ""), "1.", "JT"), "")
    joined = lambda line, k, mark: F.struct(k.alias("place"), F.when(mark == "J", F.concat(line, F.lit("  "), F.get("lines", k + 1))).otherwise(line).alias("line"), (mark != "T").alias("stays"))
    each = let(marks, lambda marks: F.transform("lines", lambda line, k: joined(line, k, F.get(marks, k))))
    return _listed(of_lines).select("doc_id", F.inline(F.filter(each, lambda s: s["stays"]))).drop("stays")


def weight_lines(of_lines: DataFrame, year: int) -> DataFrame:
    """Items of lines with a title and a weight, as table_items gives them; the first of WEIGHT_LINES that a line matches counts."""
    line = F.col("line")
    parts = F.coalesce(*(F.when(line.rlike(p), F.struct(*(F.regexp_extract(line, p, k).alias(str(k)) for k in (1, 2, 3)))) for p in WEIGHT_LINES))
    made = let(parts, lambda of: F.struct(_named(of["1"]).alias("_title"), of["2"].cast("double").alias("_weight"), let(F.trim(of["3"]), lambda rest: F.when(rest != "", rest)).alias("_rest")))
    made = unwrapped(of_lines).select("doc_id", "place", "line", F.inline(F.array(made)))
    made = made.filter((F.col("_title") != "") & (F.col("_weight") <= 100) & ~_is(F.col("_title"), NO_WEIGHT_ITEM))
    made = made.withColumn("_label", F.coalesce("_rest", _got(line, DUE_WORDS), _got(line, DAYS_OF_LINES, 0)))
    return _items(made, line, year, F.when(F.col("_label").isNotNull(), 0.75).otherwise(0.85))


def section_bodies(of_lines: DataFrame, headings: dict[str, tuple[str, ...]]) -> DataFrame:
    """doc_id, section and body of the first section of each name: what stands behind its heading, then its lines up to one that is like a
    heading, speaks of no work and has no weight. headings: for each section the words that its heading begins with.

    A pattern takes a section whole out of the lines put together again, where its words occur at all; so no line is looked at by itself."""
    ends = rf"(?=[A-Z][A-Za-z ]{{2,48}}\n)(?![^\n]*?(?i:{bounded(WORK.removeprefix('(?i)'))}))"

    def section(words: tuple[str, ...]) -> Column:
        heading = r"(?i:(?:\d+[.)][\s&&[^\n]]*)?(?:" + "|".join(r"\Q" + w + r"\E" for w in words) + "))" + bounded(r"\b")
        # the rest of the heading and the next line as they are, then lines up to an end; possessive, so that a long section needs no stack
        pattern = rf"\n(?={heading})(?=[^\n]{{0,{HEADING - 1}}}\n){heading}[:\-\s&&[^\n]]*+([^\n]*+\n(?:[^\n]++\n)?+(?:(?!{ends})[^\n]++\n)*+)"
        occurs = [F.contains(F.lower("text"), F.lit(w.lower())) if w.isascii() else F.lit(True) for w in words]
        return F.when(reduce(Column.__or__, occurs), F.regexp_extract("text", pattern, 1))

    text = F.concat(F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("text")
    found = _listed(of_lines).select("doc_id", text).select("doc_id", *(section(words).alias(f"_{n}") for n, words in enumerate(headings.values())))
    made = (F.when(F.col(f"_{n}") != "", F.struct(F.lit(name).alias("section"), F.btrim(F.col(f"_{n}"), F.lit(" \n")).alias("body"))) for n, name in enumerate(headings))
    return found.select("doc_id", F.inline(F.array_compact(F.array(*made))))
