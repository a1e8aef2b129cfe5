"""A student's day as one list: meetings, items, changes, announcements, tasks and calendar entries, each in its section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.state import filled, local_day

#: Sections in their order, each with its most items (fixed values).
SECTIONS = {"right_now": 12, "next": 12, "tonight": 12, "coming_up": 16, "since_last_checked": 20, "needs_answer": 12, "history": 12}

#: How many changes and announcements are looked at, newest first, and from when on if nobody has checked yet (fixed values).
CHANGES, ANNOUNCEMENTS, UNCHECKED_DAYS = 40, 20, 4

COLUMNS = ["student", "id", "section", "kind", "status", "actionable", "sort_at"]


def _at(now: Column, zone: str, hour: int) -> Column:
    """The instant of that hour of now's local day."""
    start = F.date_trunc("day", F.from_utc_timestamp(now, zone)) + F.make_dt_interval(hours=F.lit(hour))
    return F.to_utc_timestamp(start, zone)


def _day_end(now: Column, zone: str) -> Column:
    return _at(now, zone, 24) - F.make_dt_interval(secs=F.lit(0.001))


def _hours(n: float) -> Column:
    return F.make_dt_interval(secs=F.lit(float(n * 3600)))


def _clock(at: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "h:mm a")


def _when(at: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "EEE MMM d · h:mm a")


def meetings(rows: DataFrame, now: Column, zone: str) -> DataFrame:
    """Meetings of today and the next seven days. rows: student, id, kind, start, end, cancelled; without a start or an end there is none."""
    start, end, kind = F.col("start"), F.col("end"), F.col("kind")
    ahead = F.date_diff(local_day(start, zone), local_day(now, zone))
    over = (F.unix_micros(now) - F.unix_micros(end)) / 6e7
    state = F.when(ahead > 0, "later").when((start <= now) & (now <= end), "on").when((now < start) & (start - _hours(3) <= now), "soon").when((now > end) & (over <= 45), "over").when(start >= _at(now, zone, 17), "evening").when(start > now, "today").otherwise("past")
    section = F.when(F.col("_s") == "on", "right_now").when(F.col("_s").isin("soon", "today"), "next").when(F.col("_s") == "over", "needs_answer").when(F.col("_s") == "evening", "tonight").when(F.col("_s") == "past", "history").otherwise("coming_up")
    status = F.when(F.col("_s") == "on", "In progress").when(F.col("_s") == "soon", F.concat(F.lit("Starts "), _clock(start, zone))).when(F.col("_s") == "over", F.concat(F.lit("Finished "), F.floor(over + 0.5).cast("string"), F.lit(" min ago"))).otherwise(kind)
    kept = rows.filter(~F.col("cancelled") & end.isNotNull() & ahead.between(0, 7)).withColumn("_s", state)
    return kept.select("student", F.concat(F.lit("occ:"), "id").alias("id"), section.alias("section"), F.when(kind.isin("lab", "tutorial"), kind).otherwise("class").alias("kind"), status.alias("status"), (F.col("_s") == "over").alias("actionable"), start.alias("sort_at"))


def assessments(rows: DataFrame, now: Column, zone: str) -> DataFrame:
    """Items that are to be done, asked for, or settled lately; what is due in over three weeks is left out.

    rows: student, id, type, due, end, weight, submission, submitted_at, done, missed, dropped, confirmed (its being past due),
    needs_confirmation."""
    due, type_ = F.col("due"), F.col("type")
    late = F.coalesce(due < now, F.lit(False))
    ask = F.col("needs_confirmation") | (late & (F.col("submission") != "submitted") & ~F.col("confirmed") & ((F.col("submission") == "unknown") | type_.isin("lab", "quiz")))
    closed = F.col("dropped") | (F.coalesce("end", "due").isNotNull() & F.col("confirmed"))
    important = (F.coalesce("weight", F.lit(0.0)) >= 10) | type_.isin("midterm", "final")
    within = lambda hours: due <= now + _hours(hours)
    tonight = due.between(_at(now, zone, 17), _day_end(now, zone))
    branch = (
        F.when(F.col("done"), F.when(F.col("submitted_at") > now - _hours(48), "done"))
        .when(ask & ~F.col("missed"), "ask")
        .when(F.col("missed"), "missed")
        .when(closed, None)
        .when(due.isNull(), F.when(important, "unk"))
        .when(late, "late")
        .when(within(3), "soon")
        .when(tonight, "tonight")
        .when(due <= _day_end(now, zone), "today")
        .when(within(21 * 24), "later")
    )
    b = F.col("_b")
    section = F.when(b.isin("done", "missed"), "history").when(b.isin("ask", "late"), "needs_answer").when(b == "soon", "right_now").when(b == "tonight", "tonight").when(b == "today", "next").otherwise("coming_up")
    status = (
        F.when(b == "done", "Submitted")
        .when(b == "ask", "Needs your answer")
        .when(b == "missed", "Missed")
        .when(b == "unk", "Date unknown")
        .when(b == "late", "Past due — confirm")
        .when(b == "soon", "Due soon")
        .when(b == "tonight", F.concat(F.lit("Due "), _clock(due, zone)))
        .when(b == "today", F.concat(F.lit("Due today "), _clock(due, zone)))
        .otherwise(_when(due, zone))
    )
    marked = b.isin("done", "ask", "missed", "unk")
    epoch = F.timestamp_seconds(F.lit(0))
    sort_at = F.when(b == "unk", now + _hours(720)).when(b == "ask", F.coalesce(due, now)).otherwise(F.coalesce(due, epoch))
    out = rows.withColumn("_b", branch).filter("_b IS NOT NULL")
    id_ = F.concat_ws(":", F.lit("a"), F.col("id").cast("string"), F.when(marked, b))
    return out.select("student", id_.alias("id"), section.alias("section"), F.when((type_ == "lab") & ~marked, "lab").otherwise("assessment").alias("kind"), status.alias("status"), b.isin("ask", "late", "soon", "tonight").alias("actionable"), sort_at.alias("sort_at"))


def _newest(rows: DataFrame, at: str, most: int) -> DataFrame:
    w = Window.partitionBy("student").orderBy(F.desc(at), "id")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def changes(rows: DataFrame, since: Column) -> DataFrame:
    """The CHANGES newest of a student's changes that are unread or no older than since. rows: student, id, kind, created_at, read."""
    kept = _newest(rows.filter((F.col("created_at") >= since) | ~F.col("read")), "created_at", CHANGES)
    return kept.select("student", F.concat(F.lit("ch:"), "id").alias("id"), F.lit("since_last_checked").alias("section"), F.lit("change").alias("kind"), F.replace("kind", F.lit("_"), F.lit(" ")).alias("status"), (~F.col("read")).alias("actionable"), F.col("created_at").alias("sort_at"))


def announcements(rows: DataFrame, since: Column) -> DataFrame:
    """The ANNOUNCEMENTS newest no older than since. rows: student, id, published_at."""
    kept = _newest(rows.filter(F.col("published_at") >= since), "published_at", ANNOUNCEMENTS)
    return kept.select("student", F.concat(F.lit("ann:"), "id").alias("id"), F.lit("since_last_checked").alias("section"), F.lit("announcement").alias("kind"), F.lit("Posted").alias("status"), F.lit(True).alias("actionable"), F.col("published_at").alias("sort_at"))


def tasks(rows: DataFrame, now: Column, zone: str) -> DataFrame:
    """Tasks that aren't done. rows: student, id, due, done."""
    due = F.col("due")
    section = F.when(due < now, "needs_answer").when(due.between(_at(now, zone, 17), _day_end(now, zone)), "tonight").when(due <= _day_end(now, zone), "next").otherwise("coming_up")
    return rows.filter(~F.col("done")).select("student", F.concat(F.lit("task:"), "id").alias("id"), section.alias("section"), F.lit("task").alias("kind"), F.lit("Task").alias("status"), F.lit(True).alias("actionable"), F.coalesce(due, now + _hours(14 * 24)).alias("sort_at"))


def calendar(rows: DataFrame, now: Column, zone: str) -> DataFrame:
    """Calendar entries from this day's start to seven days from now. rows: student, id, category, start."""
    start, c = F.col("start"), F.col("category")
    section = F.when(start.between(now - _hours(0.5), now + _hours(1)), "right_now").when(start.between(_at(now, zone, 17), _day_end(now, zone)), "tonight").when(start <= _day_end(now, zone), "next").otherwise("coming_up")
    kept = rows.filter(start.between(_at(now, zone, 0), now + _hours(168)))
    return kept.select("student", F.concat(F.lit("cal:"), "id").alias("id"), section.alias("section"), F.when(c == "BUS", "commute").when(c == "STUDY", "study").otherwise("personal").alias("kind"), c.alias("status"), F.lit(False).alias("actionable"), start.alias("sort_at"))


def day_list(*sources: DataFrame) -> DataFrame:
    """The sources' rows by student and section with their place in it, the first SECTIONS[section] of each; of rows of one id the first source's
    counts, then the earliest."""
    rows = sources[0].select(*COLUMNS, F.lit(0).alias("_source"))
    for n, s in enumerate(sources[1:], 1):
        rows = rows.unionByName(s.select(*COLUMNS, F.lit(n).alias("_source")))
    first = rows.groupBy("student", "id").agg(F.min(F.struct("_source", "sort_at", "section", "kind", "status", "actionable")).alias("r")).select("student", "id", "r.*")
    limit = F.create_map(*(x for k, v in SECTIONS.items() for x in (F.lit(k), F.lit(v))))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("student", "section").orderBy("sort_at", "id"))).filter(F.col("place") <= max(SECTIONS.values()))
    return placed.filter(F.col("place") <= limit[F.col("section")]).drop("_source")


def standing_lines(standings: DataFrame, most: int = 6) -> DataFrame:
    """A line on each of the first courses of a student. standings: student, course_id, ord, code, calculated, completed, graded."""
    w = Window.partitionBy("student").orderBy("ord", "course_id")
    known = F.concat(F.format_string("%s: %.1f%% on %.0f%% graded", "code", "calculated", "completed"))
    line = F.when(F.col("calculated").isNotNull(), known).otherwise(F.concat("code", F.lit(": standing unknown ("), F.col("graded").cast("string"), F.lit(" graded)")))
    return standings.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("student", "course_id", "place", line.alias("line"))


def status_groups(items: DataFrame, status: Column) -> DataFrame:
    """Items by status, first those due first, items without a due last: status, place and id."""
    w = Window.partitionBy("course_id", "status").orderBy(F.asc_nulls_last("due"), "id")
    return items.withColumn("status", status).select("course_id", "status", F.row_number().over(w).alias("place"), "id")


def tonight_labs(meetings_: DataFrame, now: Column, zone: str) -> DataFrame:
    """course_id and id of the earliest lab of each course today, at whatever hour. meetings_: course_id, id, kind, start, cancelled."""
    today = local_day(F.col("start"), zone) == local_day(now, zone)
    return meetings_.filter((F.col("kind") == "lab") & ~F.col("cancelled") & today).groupBy("course_id").agg(F.min_by("id", F.struct("start", "id")).alias("id"))


def content_dues(topics: DataFrame) -> DataFrame:
    """Content with a due and a title of coursework as items: id, course_id, type, due. topics: id, course_id, title, due."""
    title = F.lower("title")
    work = title.rlike(r"\b(assignment|quiz|lab|project|mid[- ]?term|final|exam|homework|hw|test)\b")
    kind = F.when(title.contains("final"), "final").when(title.rlike("mid[- ]?term"), "midterm").when(title.rlike("quiz|test"), "quiz").when(title.contains("lab"), "lab").otherwise("assignment")
    return topics.filter(F.col("due").isNotNull() & work).select("id", "course_id", kind.alias("type"), "due")


def patterns(meetings_: DataFrame) -> DataFrame:
    """Older meeting rows with a weekday and both times as patterns: id, course_id, kind, day_of_week, start_time, end_time."""
    whole = F.col("day_of_week").isNotNull() & filled(F.col("start_time")) & filled(F.col("end_time"))
    return meetings_.filter(F.coalesce(whole, F.lit(False))).select(F.concat(F.lit("pattern:"), "id").alias("id"), "course_id", "kind", "day_of_week", "start_time", "end_time")
