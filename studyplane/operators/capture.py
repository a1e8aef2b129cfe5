"""What a student adds or changes: captured tasks, corrections, sections, confirmations; and lists that are merged or cut for showing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bounded

#: Words for days, in the order in which they are looked for, with their weekday (0: Sunday) or days ahead (fixed values).
AHEAD = {"today": 0, "tomorrow": 1}
WEEKDAYS = {"mon": 1, "monday": 1, "tue": 2, "tuesday": 2, "wed": 3, "wednesday": 3, "thu": 4, "thursday": 4, "fri": 5, "friday": 5, "sat": 6, "saturday": 6, "sun": 0, "sunday": 0}

#: How many notes go out at once, and how many are remembered (fixed values).
AT_ONCE, REMEMBERED = 5, 100


def due_in_words(text: Column, today: Column) -> Column:
    """The day that a text names: today, tomorrow, a weekday (the next one, never today), or yyyy-mm-dd."""
    low = F.lower(text)
    out = F.try_to_date(F.nullif(F.regexp_extract(low, bounded(r"\b(20\d{2}-\d{2}-\d{2})\b"), 1), F.lit("")), "yyyy-MM-dd")
    for word, day in reversed([*AHEAD.items(), *WEEKDAYS.items()]):
        ahead = F.lit(day) if word in AHEAD else F.pmod(F.lit(day) - (F.dayofweek(today) - 1) - 1, F.lit(7)) + 1
        out = F.when(low.rlike(bounded(rf"\b{word}\b")), F.date_add(today, ahead.cast("int"))).otherwise(out)
    return out


def task_title(text: Column) -> Column:
    """The text without its days; the text itself where nothing else is left."""
    words = "|".join([*AHEAD, *(w for w in WEEKDAYS)])
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "(?i)" + bounded(rf"\b({words})\b"), ""), bounded(r"\b20\d{2}-\d{2}-\d{2}\b"), ""), r"\s+", " "))
    return F.when(bare == "", F.trim(text)).otherwise(bare)


def with_course(tasks: DataFrame, courses: DataFrame) -> DataFrame:
    """tasks (task_id, student_id, text) with course_id: the student's first course (student_id, course_id, code, ord) whose four digits or code the text has."""
    bare = F.regexp_replace(F.lower("t.text"), r"\s", "")
    code = F.regexp_replace(F.lower("c.code"), r"[\s*]", "")
    digits = F.nullif(F.regexp_extract(code, r"\d{4}", 0), F.lit(""))
    hit = tasks.alias("t").join(courses.alias("c"), (F.col("t.student_id") == F.col("c.student_id")) & (F.coalesce(bare.contains(digits), F.lit(False)) | bare.contains(code)))
    first = hit.groupBy("t.task_id").agg(F.min_by("c.course_id", "c.ord").alias("course_id"))
    return tasks.join(first, "task_id", "left")


def overridden(items: DataFrame, overrides: DataFrame) -> DataFrame:
    """items (id, title, type, weight, due) with the user's own values: overrides has id, and a struct (value) for each field that is set, even to null."""
    out = items.join(overrides.select("id", *(F.col(c).alias(f"_{c}") for c in ("title", "type", "weight", "due"))), "id", "left")
    pick = lambda c: F.when(F.col(f"_{c}").isNotNull() & (F.col(f"_{c}.value").isNotNull() if c == "title" else F.lit(True)), F.col(f"_{c}.value")).otherwise(F.col(c))
    return out.select("id", *(pick(c).alias(c) for c in ("title", "type", "weight", "due")))


def with_sections(courses: DataFrame, configs: DataFrame) -> DataFrame:
    """courses (course_id, section, lab_section, lecture_section) with the sections that the user chose; a null choice keeps the course's own."""
    names = ("section", "lab_section", "lecture_section")
    out = courses.join(configs.select("course_id", *(F.col(c).alias(f"_{c}") for c in names)), "course_id", "left")
    return out.select("course_id", *(F.coalesce(f"_{c}", c).alias(c) for c in names))


def merged_rules(others: DataFrame, blueprint: DataFrame, hints: DataFrame) -> DataFrame:
    """Rules of other sources, then those of the blueprint, then hints whose rule_id neither has."""
    known = others.unionByName(blueprint)
    return known.unionByName(hints.join(known.select("rule_id"), "rule_id", "left_anti"))


def inbox(changed: DataFrame, earlier: DataFrame, most: int = 300) -> DataFrame:
    """A student's changes (student_id, change_id, ord, read): the new ones in their order, then earlier ones that were read, `most` in all. Earlier unread ones
    are left out, as a new snapshot finds what still holds."""
    both = changed.withColumn("_late", F.lit(0)).unionByName(earlier.filter("read").withColumn("_late", F.lit(1)))
    w = Window.partitionBy("student_id").orderBy("_late", "ord", "change_id")
    return both.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).drop("_late")


def to_send(candidates: DataFrame, shown: DataFrame) -> DataFrame:
    """The notes of a student's first AT_ONCE candidates (student_id, note_id, ord) that are not among the last REMEMBERED that were shown (student_id,
    note_id, ord)."""
    first = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("student_id").orderBy("ord", "note_id"))).filter(F.col("_n") <= AT_ONCE).drop("_n")
    last = shown.withColumn("_n", F.row_number().over(Window.partitionBy("student_id").orderBy(F.desc("ord"), "note_id"))).filter(F.col("_n") <= REMEMBERED)
    return first.join(last.select("student_id", "note_id"), ["student_id", "note_id"], "left_anti")


def deduped(items: DataFrame) -> DataFrame:
    """Parsed items (doc_id, ord, title, type, weight, due_label, due, snippet, confidence) of a document as one a title: its first row, with the first known weight,
    date (label and day together) and snippet, the first type but other, and the most confidence."""
    key = F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " "))
    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col("ord")))
    dated = F.min_by(F.struct("due_label", "due"), F.when(F.length("due_label") > 0, F.col("ord"))).alias("_d")
    out = items.groupBy("doc_id", key.alias("key")).agg(F.min("ord").alias("ord"), F.min_by("title", "ord").alias("title"), F.coalesce(F.min_by("type", F.when(F.col("type") != "other", F.col("ord"))), F.lit("other")).alias("type"), known("weight").alias("weight"), dated, known("snippet").alias("snippet"), F.max("confidence").alias("confidence"))
    return out.select("doc_id", "ord", "title", "type", "weight", F.col("_d.due_label").alias("due_label"), F.col("_d.due").alias("due"), "snippet", "confidence")


def day_load(items: DataFrame, occurrences: DataFrame, tasks: DataFrame, zone: str) -> DataFrame:
    """Per course-holder and local day: n, and score: 2 for a midterm, final or project and 1 for all else, and a twentieth of the weights.

    items: student_id, at, kind, weight. occurrences and tasks: student_id, at."""
    plain = lambda df: df.select("student_id", "at", F.lit("other").alias("kind"), F.lit(None).cast("double").alias("weight"))
    every = items.select("student_id", "at", "kind", "weight").unionByName(plain(occurrences)).unionByName(plain(tasks)).filter("at IS NOT NULL")
    hard = F.col("kind").isin("midterm", "final", "project")
    return every.groupBy("student_id", F.to_date(F.from_utc_timestamp("at", zone)).alias("day")).agg(F.count("*").alias("n"), F.sum(F.when(hard, 2.0).otherwise(1.0) + F.coalesce("weight", F.lit(0.0)) / 20).alias("score"))
