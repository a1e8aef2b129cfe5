"""Planning operators over many assessments: workload, rankings, sections, insights, gates, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.state import hours_between, local_day

#: A busy week: this many items, this many times the average, or this much weight. A crowded day: this many items (fixed values).
BUSY_COUNT, BUSY_TIMES, BUSY_WEIGHT, CROWDED = 3, 1.5, 25.0, 3


def workload_weeks(items: DataFrame, zone: str) -> DataFrame:
    """Per Monday week of due: count, weight_sum and busy, against the average count of all weeks."""
    weeks = items.filter("due IS NOT NULL AND certainty <> 'unknown'").groupBy(F.date_trunc("week", local_day(F.col("due"), zone)).cast("date").alias("week_start")).agg(F.count("*").alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight_sum"))
    average = weeks.agg(F.avg("n").alias("average"))
    threshold = F.greatest(F.lit(BUSY_COUNT), F.ceil(F.col("average") * BUSY_TIMES))
    # one row, the weeks' average, beside each week
    return weeks.join(F.broadcast(average)).select("week_start", "n", "weight_sum", ((F.col("n") >= threshold) | (F.col("weight_sum") >= BUSY_WEIGHT)).alias("busy"))


def crowded_days(items: DataFrame, zone: str) -> DataFrame:
    """Days on which CROWDED items or more are due."""
    return items.filter("due IS NOT NULL AND certainty <> 'unknown'").groupBy(local_day(F.col("due"), zone).alias("day")).agg(F.count("*").alias("n")).filter(F.col("n") >= CROWDED)


def next_focus(scored: DataFrame) -> DataFrame:
    """For each item (id, score, ord) the best other one, first in order on ties: only the two best of all are ever an answer."""
    best = scored.orderBy(F.desc("score"), "ord").limit(2).select("id", F.monotonically_increasing_id().alias("_i"))
    two = [r["id"] for r in best.orderBy("_i").collect()] + [None, None]
    kind = dict(scored.dtypes)["id"]
    first, second = (F.lit(x).cast(kind) for x in two[:2])
    return scored.select("id", F.when(F.col("id") == first, second).otherwise(first).alias("next_id"))


def top_per(rows: DataFrame, group: str, limits: dict[str, int], order: list[Column]) -> DataFrame:
    """The first rows of each named group, as many as its limit, with their place; groups without a limit keep all rows, and so do null ones.

    The largest limit stops the named groups early, before they come together."""
    limit = F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v))))
    placed = lambda df: df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    named = F.coalesce(F.col(group).isin(*limits), F.lit(False))
    top = placed(rows.filter(named)).filter(F.col("place") <= max(limits.values())).filter(F.col("place") <= limit[F.col(group)])
    return top.unionByName(placed(rows.filter(~named)))


def insights(items: DataFrame) -> DataFrame:
    """The one risk of each item, by the first branch that holds, with its score.

    items: id, open, missed, needs_confirmation, absorbed, weight, hours, score."""
    heavy = F.coalesce(F.col("weight") >= 8, F.lit(False))
    late, soon = F.col("hours") < 0, F.col("hours") <= 36
    kind = F.when(F.col("open") & late & heavy, "overdue").when(F.col("open") & soon & heavy, "due").when(F.col("missed"), "missed").when(F.col("needs_confirmation"), "confirm")
    score = F.when(F.col("kind") == "overdue", F.col("score") + 20).when((F.col("kind") == "missed") & F.col("absorbed"), F.col("score") * 0.5).when(F.col("kind") == "confirm", F.col("score") + 5).otherwise(F.col("score"))
    return items.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("score", score)


#: Scores of risks that grade rules make, and how many insights a student sees (fixed values).
PROVISIONAL_DROP, RULE_PRESSURE, INSIGHTS = 25.0, 30.0, 8

#: Buckets in their order, and what each adds to an item's score (fixed values).
BUCKETS = {"NOW": 4.0, "NEEDS_ACTION": 6.0, "CONFIRMATION": 8.0, "CHANGES": 0.0, "NEXT": 2.0, "WATCH": 0.0, "DONE": 0.0}
CHANGE_SCORE = 60.0


def greatest(risks: DataFrame, student: str, most: int = INSIGHTS) -> DataFrame:
    """The risks (risk, score, ...) of highest score of each student, with rank; ties by name. The window stops early, so no student comes together."""
    w = Window.partitionBy(student).orderBy(F.desc("score"), "risk")
    return risks.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def command_centre(scored: DataFrame, unread: DataFrame) -> DataFrame:
    """item, bucket, place (of the bucket, from 1) and score of every item and every unread change.

    scored: id, open, missed, needs_confirmation, hours, score. unread: id. What is closed, not missed and not to be confirmed is done and scores 0."""
    h = F.col("hours")
    done = ~F.col("open") & ~F.col("needs_confirmation") & ~F.col("missed")
    bucket = F.when(done, "DONE").when(F.col("needs_confirmation"), "CONFIRMATION").when(h < 0, "NEEDS_ACTION").when(h <= 24, "NOW").when(h <= 72, "NEXT").otherwise("WATCH")
    more = F.create_map(*(F.lit(x) for kv in BUCKETS.items() for x in kv))
    rows = scored.withColumn("bucket", bucket).select(F.concat(F.lit("pri:"), "id").alias("item"), "bucket", F.when(F.col("bucket") == "DONE", 0.0).otherwise(F.col("score") + more[F.col("bucket")]).alias("score"))
    changed = unread.select(F.concat(F.lit("pri:ch:"), "id").alias("item"), F.lit("CHANGES").alias("bucket"), F.lit(CHANGE_SCORE).alias("score"))
    place = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket"))
    return rows.unionByName(changed).withColumn("place", place)


def gate(problems: DataFrame) -> DataFrame:
    """Per course whether planning must wait: any block, or three structural warnings. problems: course_id, severity, structural."""
    out = problems.groupBy("course_id").agg(F.count_if(F.col("severity") == "block").alias("blocks"), F.count_if((F.col("severity") == "warn") & F.col("structural")).alias("warnings"))
    return out.withColumn("recheck", (F.col("blocks") > 0) | (F.col("warnings") >= 3))


def notifications(items: DataFrame, now: Column, zone: str) -> DataFrame:
    """note_id and kind: due tomorrow (12 to 36 hours), quizzes closing (to 6), exams (to 48). items: id, open, submission, kind, due."""
    hours = hours_between(now, F.col("due"))
    day = F.date_format(local_day(F.col("due"), zone), "yyyy-MM-dd")
    note = lambda condition, kind, key: F.when(condition, F.struct(key.alias("note_id"), F.lit(kind).alias("note")))
    notes = F.array(
        note((hours > 12) & (hours <= 36) & (F.col("submission") != "submitted"), "due_tomorrow", F.concat_ws(":", F.lit("n:due"), "id", day)),
        note((F.col("kind") == "quiz") & (hours > 0) & (hours <= 6), "quiz_closing", F.concat_ws(":", F.lit("n:quiz"), "id")),
        note(F.col("kind").isin("midterm", "final") & (hours > 0) & (hours <= 48), "exam_room", F.concat_ws(":", F.lit("n:exam"), "id")),
    )
    return items.filter("open AND due IS NOT NULL").select("id", F.explode(F.array_compact(notes)).alias("n")).select("id", "n.*")
