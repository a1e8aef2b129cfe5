"""Content that is read again and again: what a budget lets through, and the versions that its texts went through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_diff

#: Files that are never read, classes read before others, how many files of a course are read at a time, and what a change shows (fixed values).
MEDIA = r"(?i)\.(mp4|mov|avi|mkv|mp3|wav|png|jpe?g|gif|webp)$"
FIRST = (
    "course_outline",
    "assignment_specification",
    "lab_instructions",
    "grading_rubric",
    "grading_scheme",
    "exam_information",
    "policy",
    "lecture_notes",
    "lecture_slides",
    "tutorial",
)
MOST, COMPARED, ID_HEAD = 40, 3000, 12


def readable(title: Column, external: Column) -> Column:
    """Whether an item is a file that may be read at all; nulls: no media, and not external."""
    return ~F.coalesce(title.rlike(MEDIA), F.lit(False)) & ~F.coalesce(external, F.lit(False))


def within_budget(items: DataFrame, most: int = MOST) -> DataFrame:
    """course_id, item_id and place (from 1) of the items that a course's budget lets through, in their order.

    items: course_id, item_id, ord, title, external, document_class, failed (a file that can't be had, which costs nothing). While at most half
    the budget is spent every item takes its place; then only the classes of FIRST do. Rows of one item and ord count once, among FIRST if one of them is; ties
    of ord go by item_id, and items of no course are a course of their own.

    A course sends its first items and its first ones of FIRST and no more, so that one large course stays small."""
    ahead = F.coalesce(F.col("document_class").isin(*FIRST), F.lit(False))
    ok = items.filter(readable(F.col("title"), F.col("external")) & ~F.coalesce("failed", F.lit(False))).groupBy("course_id", "ord", "item_id").agg(F.max(ahead).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("course_id").orderBy("ord", "item_id"))
    early = ok.withColumn("place", place).filter(F.col("place") <= min(most, most // 2 + 1))
    ones = ok.filter("ahead").withColumn("place", place).filter(F.col("place") <= most)
    both = early.unionByName(ones).select("course_id", "ord", "item_id").distinct()
    return both.withColumn("place", place).filter(F.col("place") <= most).select("course_id", "item_id", "place")


def versions(snapshots: DataFrame) -> DataFrame:
    """The versions of each item: item_id, version (from 1), id, content_hash, valid_from, valid_to (null: still valid), previous_hash and detail
    (the lines that changed in the first COMPARED characters; null for a first version).

    snapshots: item_id, at, ord, content_hash, text. A snapshot with the hash of the one before it confirms that version, and one without a
    hash wasn't read and says nothing. Of several at one time the last (ord) counts. The id names item and hash, so that a text that comes
    back has its old id; items without an id are left out, and a null text counts as empty."""
    read = snapshots.filter("item_id IS NOT NULL AND at IS NOT NULL AND content_hash IS NOT NULL")
    last = read.groupBy("item_id", "at").agg(F.max_by(F.struct("content_hash", F.coalesce("text", F.lit("")).alias("text")), F.struct("ord", "content_hash")).alias("s"))
    w = Window.partitionBy("item_id").orderBy("at")
    hashed = F.col("s.content_hash")
    new = last.withColumn("same", F.lag(hashed).over(w).eqNullSafe(hashed)).filter(~F.col("same"))
    out = new.withColumns(
        {
            "version": F.row_number().over(w),
            "valid_to": F.lead("at").over(w),
            "previous_hash": F.lag(hashed).over(w),
            "before": F.lag(F.left(F.col("s.text"), F.lit(COMPARED))).over(w),
        }
    )
    named = F.concat(F.lit("lib:"), F.col("item_id").cast("string"), F.lit(":"), F.left(hashed, F.lit(ID_HEAD)))
    detail = F.when(F.col("before").isNotNull(), line_diff(F.col("before"), F.left(F.col("s.text"), F.lit(COMPARED))))
    return out.select("item_id", "version", named.alias("id"), hashed.alias("content_hash"), F.col("at").alias("valid_from"), "valid_to", "previous_hash", detail.alias("detail"))
