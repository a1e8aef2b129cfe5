"""What differs between snapshots and between sources: change feed, supersession, field resolution, conflicts, dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much a fact's source counts (fixed values), and how near a runner-up must be to make a conflict.
AUTHORITY_MARGIN = 15
AUTHORITY = {
    "REGISTRAR_OFFICIAL": 100,
    "COURSELINK_TOOL_EXACT": 90,
    "USER_MANUAL": 85,
    "INSTRUCTOR_ANNOUNCEMENT": 75,
    "STAFF_DISCUSSION": 70,
    "COURSE_OUTLINE": 60,
    "COURSELINK_CONTENT": 50,
    "DERIVED_RULE": 40,
    "STUDENT_DISCUSSION": 20,
    "EXTERNAL_UNVERIFIED": 10,
}

#: Source, what it counts for a due date, and for a weight (fixed values).
SOURCES = """
manual 100 100
courselink_dropbox 90 50
courselink_quiz 90 50
courselink_calendar 80 40
courselink_news 75 40
courselink_grade 50 80
course_outline 60 85
courselink_content 55 45
courselink_course 40 20
uofg_academic_date 45 10
uofg_catalogue 30 10
ics 55 55
user_task 90 90
rule_engine 50 50
external_activity 40 40
courselink_discussion 45 45
courselink_checklist 50 50
courselink_feedback 70 70
library_resource 45 45
"""


def rank_of(source: Column, field: str) -> Column:
    """What a source (or authority class) counts for `due`, `weight` or as `authority`; 0 if unknown."""
    at = {"due": 1, "weight": 2}
    known = AUTHORITY if field == "authority" else {w[0]: int(w[at[field]]) for w in map(str.split, SOURCES.strip().splitlines())}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), source), F.lit(0))


def change_feed(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, kind, before_value and after_value of each change between two snapshots of (id, title, due, weight, earned).

    New and removed rows (not ids of outlines, which come and go), due, weight (null-safe) and grades that are posted."""
    b, a = before.alias("b"), after.alias("a")
    both = b.join(a, F.col("a.id") == F.col("b.id"), "full_outer")
    text = lambda c: F.col(c).cast("string")

    def event(kind: str, condition: Column, old: Column, new: Column) -> Column:
        return F.when(condition, F.struct(F.lit(kind).alias("kind"), old.alias("before_value"), new.alias("after_value")))

    there = F.col("a.id").isNotNull() & F.col("b.id").isNotNull()
    nothing = F.lit(None).cast("string")
    events = F.array(
        event("new_assessment", F.col("b.id").isNull(), nothing, F.col("a.title")),
        event("deadline_changed", there & ~F.col("a.due").eqNullSafe(F.col("b.due")), text("b.due"), text("a.due")),
        event("weight_changed", there & ~F.col("a.weight").eqNullSafe(F.col("b.weight")), text("b.weight"), text("a.weight")),
        event("grade_posted", there & F.col("b.earned").isNull() & F.col("a.earned").isNotNull(), nothing, text("a.earned")),
        event("removed_assessment", F.col("a.id").isNull() & ~F.startswith(F.col("b.id").cast("string"), F.lit("outline:")), F.col("b.title"), nothing),
    )
    return both.select(F.coalesce("a.id", "b.id").alias("id"), F.explode(F.array_compact(events)).alias("e")).select("id", "e.*")


def superseded_in_order(facts: DataFrame) -> DataFrame:
    """facts (id, entity_id, field, authority, valid_from, arrival) with superseded_by: the next arrival of the same field and entity of no
    less authority, where facts arrive in the order of valid_from; null if none, and for a null authority.

    Authorities are the ranks of a fixed table, so the fact's own are kept as steps: for each step the next arrival of at least that
    authority is looked up by a window, over rows sorted once and not compared with each other. All steps that occur are taken."""
    ranks = sorted(r["authority"] for r in facts.select("authority").filter("authority IS NOT NULL").distinct().collect())
    after = Window.partitionBy("entity_id", "field").orderBy(F.desc("arrival")).rowsBetween(Window.unboundedPreceding, -1)  # a frame that only grows is read once
    found = None
    for r in ranks:
        next_one = F.last(F.when(F.col("authority") >= r, F.col("id")), ignorenulls=True).over(after)
        found = F.when(F.col("authority") == r, next_one) if found is None else found.when(F.col("authority") == r, next_one)
    return facts.withColumn("superseded_by", found if found is not None else F.lit(None).cast(dict(facts.dtypes)["id"]))


def field_resolution(facts: DataFrame, margin: int = AUTHORITY_MARGIN) -> DataFrame:
    """Per entity and field the fact of most authority, confidence and recency, and whether the next one contradicts it from near enough."""
    w = Window.partitionBy("entity_id", "field").orderBy(F.desc("authority"), F.desc("confidence"), F.desc("valid_from"), "id")
    top = facts.withColumn("_rank", F.row_number().over(w)).filter("_rank <= 2")
    pick = lambda n, c: F.max(F.when(F.col("_rank") == n, F.col(c)))
    out = top.groupBy("entity_id", "field").agg(*(pick(1, c).alias(c) for c in ("id", "value", "authority", "confidence")), pick(2, "value").alias("_v"), pick(2, "authority").alias("_a"))
    conflicted = F.coalesce((F.col("_v") != F.col("value")) & (F.col("_a") >= F.col("authority") - margin), F.lit(False))
    return out.select("entity_id", "field", F.col("id").alias("winner"), "value", "authority", "confidence", conflicted.alias("conflicted"))


def resolve_conflict(candidates: DataFrame, value: str, priority: Column, entity: str = "entity_id") -> DataFrame:
    """Per entity the value of the source of highest priority (then the smaller value), how many distinct values there are, and whether they conflict."""
    each = candidates.withColumn("_p", priority).groupBy(entity, value).agg(F.max("_p").alias("_p"))
    best = F.min_by(value, F.struct((-F.col("_p")).alias("p"), F.col(value).alias("v")))
    return each.groupBy(entity).agg(best.alias("resolved"), F.count("*").alias("n_values")).withColumn("conflicting", F.col("n_values") > 1)


def first_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key, the first in order; partial sums keep a hot key small."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*others), order).alias("_r")).select(*key, "_r.*")


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the last one's values, in the place (first_order) of the first."""
    others = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("_r"), F.min(order).alias("first_order")).select(*key, "_r.*", "first_order")
