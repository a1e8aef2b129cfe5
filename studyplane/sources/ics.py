"""Calendar files: parsing into rows, and writing items as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def events(files: DataFrame, text_col: str = "text") -> DataFrame:
    """uid, title, start, all_day, location and excepted days of every VEVENT in texts, with the file's other columns.

    Folded lines are joined; instants are UTC where they end in Z, else as they stand; recurrence rules are not expanded; an event without
    a start has a null one. Everything is split and extracted by built-in functions."""
    flat = F.regexp_replace(F.col(text_col), r"\r?\n[ \t]", "")
    others = [c for c in files.columns if c != text_col]
    each = files.select(*others, F.explode(F.regexp_extract_all(flat, F.lit(r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"), F.lit(1))).alias("_e"))
    prop = lambda name: F.nullif(F.regexp_extract("_e", rf"(?m)^{name}(?:;[^:\n]*)?:([^\r\n]*)", 1), F.lit(""))
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\n", " "), r"\\([,;])", "$1"), r"\\\\", r"\\")
    raw = prop("DTSTART")
    start = F.coalesce(F.try_to_timestamp(F.rtrim(raw, F.lit("Z")), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(raw, F.lit("yyyyMMdd")))
    exdates = F.transform(F.regexp_extract_all("_e", F.lit(r"(?m)^EXDATE[^:\n]*:([^\r\n]*)"), F.lit(1)), lambda d: F.left(d, F.lit(8)))
    return each.select(*others, prop("UID").alias("uid"), plain(prop("SUMMARY")).alias("title"), start.alias("start"), (F.length(raw) == 8).alias("all_day"), plain(prop("LOCATION")).alias("location"), exdates.alias("exdates"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"([,;])", r"\\$1"), "\n", r"\\n")


def folded(line: Column, width: int = 75) -> Column:
    """A line broken after `width` characters, its rest in lines that begin with a blank."""
    rest = F.regexp_replace(F.substring(line, width + 1, 1 << 30), f"(.{{{width - 1}}})(?=.)", "$1\r\n ")
    return F.when(F.length(line) <= width, line).otherwise(F.concat(F.left(line, F.lit(width)), F.lit("\r\n "), rest))


def event_text(uid: Column, title: Column, due: Column, stamp: Column) -> Column:
    """One VEVENT; the caller leaves out items without a sure date."""
    utc = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    lines = [F.lit("BEGIN:VEVENT"), folded(F.concat(F.lit("UID:"), uid)), F.concat(F.lit("DTSTAMP:"), utc(stamp)), F.concat(F.lit("DTSTART:"), utc(due)), folded(F.concat(F.lit("SUMMARY:"), escaped(title))), F.lit("END:VEVENT")]
    return F.concat_ws("\r\n", *lines)
