"""Deadlines that rules derive from meetings, deadlines that facts change, and what is near in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.state import let
from ..functions.text import bounded

#: Sources whose exact dates no rule changes (fixed values), and how sure a fact must be to change a date, and to leave no open conflict.
PROTECTED = ("courselink_dropbox", "courselink_quiz", "manual")
CHANGES_FROM, SETTLED_FROM = 0.7, 0.85


def number_in(title: Column) -> Column:
    """The number of a lab, assignment or quiz in its title."""
    return F.nullif(F.regexp_extract(F.lower(title), bounded(r"\b(?:lab|assignment|quiz|a)\s*#?\s*(\d+)\b"), 1), F.lit("")).cast("int")


def derived(items: DataFrame, rules: DataFrame, occurrences: DataFrame, zone: str) -> DataFrame:
    """item_id, due, rule_id and occurrence_id of the items whose deadline a rule derives; the first rule in order that finds a meeting.

    items: item_id, course_id, title, type, certainty, due, source, overridden. rules: course_id, rule_id, ord, types (empty: all), word (of the title,
    null: all), meeting_kind, day_of_week (0: Sunday; null: any), number (of the meeting; null: that in the title, else 1), offset_days, at (wall time;
    null: 23:59), at_end (of the meeting, where offset_days is 0). occurrences: course_id, occurrence_id, kind, day, number, end_at, cancelled.
    A meeting is found by its own number, then by its place among those of the rule, by day. Exact dates of PROTECTED sources and the user's stay."""
    free = items.filter(~F.coalesce("overridden", F.lit(False)) & ~F.coalesce((F.col("certainty") == "exact") & F.col("due").isNotNull() & F.col("source").isin(*PROTECTED), F.lit(False)))
    o, r = occurrences.filter(~F.coalesce("cancelled", F.lit(False))).alias("o"), rules.alias("r")
    met = o.join(r, (F.col("o.course_id") == F.col("r.course_id")) & (F.col("o.kind") == F.col("r.meeting_kind")) & (F.col("r.day_of_week").isNull() | (F.dayofweek("o.day") - 1 == F.col("r.day_of_week"))))
    met = met.select("r.rule_id", "r.course_id", "o.occurrence_id", "o.day", "o.end_at", "o.number").withColumn("place", F.row_number().over(Window.partitionBy("course_id", "rule_id").orderBy("day", "occurrence_id")))
    keys = ["course_id", "rule_id", "wanted"]
    found = lambda by, name: met.withColumnRenamed(by, "wanted").groupBy(*keys).agg(F.min_by(F.struct("occurrence_id", "day", "end_at"), F.struct("day", "occurrence_id")).alias(name))
    i = free.alias("i")
    fits = ((F.coalesce(F.size("r.types"), F.lit(0)) <= 0) | F.array_contains("r.types", F.col("i.type"))) & (F.col("r.word").isNull() | F.lower("i.title").contains(F.lower("r.word")))
    asked = i.join(r, (F.col("i.course_id") == F.col("r.course_id")) & fits).select("i.item_id", "r.course_id", "r.rule_id", "r.ord", "r.offset_days", "r.at", "r.at_end", F.coalesce("r.number", number_in(F.col("i.title")), F.lit(1)).alias("wanted"))
    hit = asked.join(found("number", "own"), keys, "left").join(found("place", "placed"), keys, "left").withColumn("m", F.coalesce("own", "placed")).filter("m IS NOT NULL")
    wall = F.concat_ws(" ", F.date_add("m.day", F.col("offset_days")).cast("string"), F.coalesce("at", F.lit("23:59"))).cast("timestamp")
    due = F.when(F.coalesce("at_end", F.lit(False)) & (F.col("offset_days") == 0), F.col("m.end_at")).otherwise(F.to_utc_timestamp(wall, zone))
    return hit.groupBy("item_id").agg(F.min_by(F.struct(due.alias("due"), "rule_id", F.col("m.occurrence_id").alias("occurrence_id")), "ord").alias("d")).select("item_id", "d.*")


def clarified(items: DataFrame, facts: DataFrame) -> DataFrame:
    """items (item_id, due) with the due date after all facts (item_id, ord, due, label, confidence), in order, and lists of changes and reviews.

    A fact of another day than the date as it then is changes it from CHANGES_FROM on (changed: ord of each; unsettled: how many of them
    are below SETTLED_FROM), and calls for a review below that; one without a date changes nothing that is known. A missing date takes the
    first fact's, and a label alone leaves it missing. One item's facts are folded together: those are a few posts, not a corpus."""
    listed = facts.filter("item_id IS NOT NULL AND (due IS NOT NULL OR label IS NOT NULL)").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("ord", "due", "label", "confidence"))).alias("_f"))
    out = items.join(listed, "item_id", "left")
    none = F.array().cast("array<long>")
    begin = F.struct(F.col("due").alias("due"), none.alias("changed"), none.alias("reviews"), F.lit(0).cast("long").alias("unsettled"))

    def step(s: Column, f: Column) -> Column:
        other = F.coalesce(F.to_date(s["due"]) != F.to_date(f["due"]), F.lit(False))
        sure = F.coalesce(f["confidence"] >= CHANGES_FROM, F.lit(False))
        now = F.when(s["due"].isNull(), f["due"]).when(other & sure, f["due"]).otherwise(s["due"])
        add = lambda c, when: F.when(when, F.concat(c, F.array(f["ord"].cast("long")))).otherwise(c)
        return F.struct(now.alias("due"), add(s["changed"], other & sure).alias("changed"), add(s["reviews"], other & ~sure).alias("reviews"), (s["unsettled"] + (other & sure & (f["confidence"] < SETTLED_FROM)).cast("long")).alias("unsettled"))

    return out.withColumn("_s", F.aggregate(F.coalesce("_f", F.array().cast(dict(out.dtypes)["_f"])), begin, step)).select("item_id", "_s.*")


def soon_meetings(meetings: DataFrame, now: Column, zone: str, before: float = 1, after: float = 36) -> DataFrame:
    """Per course the meeting that begins within `before` hours past to `after` hours ahead: one of today first, then the earliest.

    meetings: course_id, meeting_id, kind, start. Ties go to the smaller id."""
    hours = (F.unix_micros("start") - F.unix_micros(now)) / 3.6e9
    today = F.to_date(F.from_utc_timestamp("start", zone)) == F.to_date(F.from_utc_timestamp(now, zone))
    near = meetings.filter((hours >= -before) & (hours <= after))
    return near.groupBy("course_id").agg(F.min_by(F.struct("meeting_id", "kind", "start"), F.struct((~today).alias("later"), "start", "meeting_id")).alias("m")).select("course_id", "m.*")


def next_of(rows: DataFrame, key: str, at: str, now: Column, columns: list[str]) -> DataFrame:
    """Per key the columns of the first row at `now` or later; ties by the columns."""
    return rows.filter(F.col(at) >= now).groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(at, *columns)).alias("n")).select(key, "n.*")


def date_label(label: Column, year: int) -> Column:
    """What a date in words says, as a struct of day and certainty: Week n and to-be-announced forms are approximate; month and day in either order
    (with their own year or the given one) and yyyy-mm-dd are exact; all else is unknown. Days past a month's end run on into the next."""
    month = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
    forms = ((bounded(rf"\b{month}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s*(\d{{4}}))?"), 1, 2), (bounded(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{month}\.?(?:,?\s*(\d{{4}}))?"), 2, 1))
    number = F.create_map(*(F.lit(x) for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1) for x in (m, k)))

    def named(low: Column, pattern: str, m: int, d: int) -> Column:
        g = lambda k: F.regexp_extract(low, pattern, k)
        own = let(g(3), lambda y: F.when(y != "", y).cast("int"))
        first = F.make_date(F.coalesce(own, F.lit(year)), F.try_element_at(number, F.left(g(m), F.lit(3))), F.lit(1))
        return let(let(g(d), lambda x: F.when(x != "", x).cast("int")), lambda day: F.when((day >= 1) & (day <= 31), F.date_add(first, day - 1)))

    def told(low: Column) -> Column:
        iso = let(F.regexp_extract(low, bounded(r"\b\d{4}-\d{2}-\d{2}\b"), 0), lambda x: F.try_to_date(F.when(x != "", x), "yyyy-MM-dd"))
        vague = low.rlike(bounded(r"\bweek\s*\d+\b")) | low.rlike(bounded(r"\b(exam\s*period|tbd|tba|see\s+(course\s+)?link|announced\s+later)\b"))
        known = lambda v: F.when(~v, F.coalesce(*(named(low, *form) for form in forms), iso))
        said = lambda v, day: F.struct(day.alias("day"), F.when(v, "approximate").when(day.isNotNull(), "exact").otherwise("unknown").alias("certainty"))
        return let(vague, lambda v: let(known(v), lambda day: said(v, day)))

    return let(F.lower(F.trim(label)), told)
