"""Data quality of courses: weight sums, health checks, coverage of capabilities, gaps against what was promised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How far a course's weights may be from 100 (fixed values): in diagnostics, and in health checks.
TOLERANCE, HEALTH_TOLERANCE = 2.0, 5.0


def weight_summary(items: DataFrame, categories: DataFrame) -> DataFrame:
    """Per course of items: sums of item and of category weights (one decimal, null without any), which of them is the basis, the total, how many
    items lack a weight, and the problem: no_weights, weights_not_100 or null.

    items: course_id, weight, bonus (left out). categories: course_id, weight. Categories are the basis where they have a positive sum."""
    rounded = lambda c: F.floor(c * 10 + 0.5) / 10
    own = items.filter(~F.coalesce("bonus", F.lit(False))).groupBy("course_id").agg(rounded(F.sum("weight")).alias("assessment_sum"), F.count_if(F.col("weight").isNull()).alias("missing"))
    of_categories = categories.groupBy("course_id").agg(rounded(F.sum("weight")).alias("category_sum"))
    out = items.select("course_id").distinct().join(own, "course_id", "left").join(of_categories, "course_id", "left")
    basis = F.when(F.col("category_sum") > 0, "categories").when(F.col("assessment_sum").isNotNull(), "assessments").otherwise("none")
    total = F.when(F.col("basis") == "categories", F.col("category_sum")).when(F.col("basis") == "assessments", F.col("assessment_sum"))
    problem = F.when(F.col("basis") == "none", "no_weights").when(F.abs(F.col("total") - 100) > TOLERANCE, "weights_not_100")
    return out.withColumn("missing", F.coalesce("missing", F.lit(0))).withColumn("basis", basis).withColumn("total", total).withColumn("problem", problem)


#: The checks of a course's health besides its connection, which always holds (fixed values).
CHECKS = ("outline", "assessments", "weights", "missing_weights", "dates", "final", "conflicts", "instructor", "schedule")


def health(courses: DataFrame, items: DataFrame) -> DataFrame:
    """Per course the nine checks (boolean), score (of 100), warnings and status: complete, good, needs_attention or missing_information.

    courses: course_id, outline, instructor, schedule (booleans). items: course_id, weight, due, certainty, kind, conflict (has an unresolved one).
    Weights hold within HEALTH_TOLERANCE of 100; a course without a final, or with one of unknown date, fails that check."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    c = F.col
    undated = c("due").isNull() | (c("certainty") == "unknown")
    facts = items.groupBy("course_id").agg(
        F.count("*").alias("_n"),
        F.count("weight").alias("_weighed"),
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_sum"),
        F.count_if(undated).alias("_undated"),
        F.count_if(c("kind") == "final").alias("_finals"),
        F.count_if((c("kind") == "final") & (c("certainty") == "unknown")).alias("_unknown_finals"),
        F.count_if(yes(c("conflict"))).alias("_conflicts"),
    )
    have = courses.join(facts, "course_id", "left").fillna(0, ["_n", "_weighed", "_undated", "_finals", "_unknown_finals", "_conflicts"]).fillna(0.0, ["_sum"])
    near = F.abs(c("_sum") - 100) <= HEALTH_TOLERANCE
    missing = c("_n") - c("_weighed")
    made = {
        "outline": yes(c("outline")),
        "assessments": c("_n") > 0,
        "weights": (c("_weighed") > 0) & near,
        "missing_weights": missing == 0,
        "dates": c("_undated") == 0,
        "final": (c("_finals") > 0) & (c("_unknown_finals") == 0),
        "conflicts": c("_conflicts") == 0,
        "instructor": yes(c("instructor")),
        "schedule": yes(c("schedule")),
    }
    out = have.withColumns(made)
    total = lambda cs: sum((x.cast("int") for x in cs[1:]), cs[0].cast("int"))
    # of the weights a warning is raised for what lacks or is off, not where there are none at all
    warned = [(missing > 0) | ((c("_weighed") > 0) & ~near) if n == "weights" else ~c(n) for n in CHECKS]
    out = out.withColumns({"score": F.floor(total([c(n) for n in CHECKS]) * 100 / len(CHECKS) + 0.5).cast("int"), "warnings": total(warned)})
    worse = (c("_conflicts") > 0) | (c("_undated") > c("_n") / 2)
    status = F.when((c("warnings") == 0) & (c("score") >= 90), "complete").when(c("score") >= 70, "good").when(worse, "needs_attention").otherwise("missing_information")
    return out.withColumn("status", status).select("course_id", *CHECKS, "score", "warnings", "status")


#: Capabilities of a course's sources and where they are read (fixed values).
CAPABILITIES = {
    "dropbox": "/dropbox/folders/",
    "quizzes": "/quizzes/",
    "quiz_attempts": "/quizzes/{id}/attempts/",
    "grades": "/grades/",
    "grade_categories": "/grades/categories/",
    "news": "/news/",
    "calendar": "/calendar/events/",
    "content": "/content/toc",
    "discussions": "/discussions/forums/.../posts/",
    "feedback": "/dropbox/folders/{id}/feedback/...",
    "checklists": "/checklists/",
    "groups": "/groupcategories/",
}


def coverage(counts: DataFrame) -> DataFrame:
    """capability, endpoint, discovered, ingested and status of each course and capability.

    counts: course_id, capability, discovered, ingested, forbidden, error; a capability without a row counts as nothing found. forbidden and
    error come first; partial where less is ingested than discovered, unavailable where there is nothing, else available."""
    known = F.inline(F.array(*(F.struct(F.lit(k).alias("capability"), F.lit(v).alias("endpoint")) for k, v in CAPABILITIES.items())))
    every = counts.select("course_id").distinct().select("course_id", known)
    out = every.join(counts, ["course_id", "capability"], "left").fillna(0, ["discovered", "ingested"])
    status = (
        F.when(F.coalesce("forbidden", F.lit(False)), "forbidden")
        .when(F.col("error").isNotNull(), "error")
        .when(F.col("ingested") < F.col("discovered"), "partial")
        .when((F.col("discovered") == 0) & (F.col("ingested") == 0), "unavailable")
        .otherwise("available")
    )
    return out.select("course_id", "capability", "endpoint", "discovered", "ingested", status.alias("status"))


def stale_gaps(expected: DataFrame, live: DataFrame) -> DataFrame:
    """Against expected (course_id, kind, promised): missing (none is live) or shortfall, and how many are short. live: course_id, kind."""
    have = live.groupBy("course_id", "kind").agg(F.count("*").alias("found"))
    out = expected.join(have, ["course_id", "kind"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return out.filter("found < promised").select("course_id", "kind", (F.col("promised") - F.col("found")).alias("short"), F.when(F.col("found") == 0, "missing").otherwise("shortfall").alias("gap"))


def expanded(categories: DataFrame) -> DataFrame:
    """A category row (course_id, name, count, weight) as its instances: number, title and weight of each, to three decimals."""
    each = F.floor(F.col("weight") / F.col("count") * 1000 + 0.5) / 1000
    rows = categories.filter("count > 0").withColumn("number", F.explode(F.sequence(F.lit(1), F.col("count"))))
    return rows.select("course_id", "name", "number", F.concat_ws(" ", "name", F.col("number").cast("string")).alias("title"), each.alias("weight"))


def second_pass(promised: DataFrame, found: DataFrame) -> DataFrame:
    """Instances that a promise (course_id, name, count) lacks among the found (course_id, name, number), and found ones beyond it."""
    want = promised.filter("count > 0").select("course_id", "name", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("number"))
    key = ["course_id", "name", "number"]
    padded = want.join(found, key, "left_anti").withColumn("action", F.lit("pad"))
    trimmed = found.join(promised.select("course_id", "name", "count"), ["course_id", "name"]).filter(F.col("number") > F.col("count")).select(*key).distinct().withColumn("action", F.lit("trim"))
    return padded.unionByName(trimmed)


def _found(rows: list[tuple[str, str, object]]):
    """Those of (severity, code, condition) that hold, as rows."""
    return F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"))) for s, k, c in rows))))


def course_problems(facts: DataFrame) -> DataFrame:
    """course_id, severity and code of each problem of a course.

    facts, one row a course: outline_status, has_document, parse_failed, parsed, parsed_items, confidence, incomplete, text_length, n_items, n_undated,
    n_approximate, basis and total (of weight_summary), n_duplicates (titles that occur twice), n_conflicts, n_meetings, n_blocked and
    n_failed (requests), n_bad_sources. What is null counts as unknown and makes no problem."""
    c = F.col
    status = c("outline_status")
    missing, blocked = status.isin("none_accessible", "not_checked"), status == "blocked"
    read = c("has_document") & c("parsed")
    undated = c("n_undated") > 0
    most = c("n_undated") > c("n_items") / 2
    found = [
        ("error", "outline_not_found", missing),
        ("error", "outline_blocked", blocked),
        ("error", "outline_parse_failed", ~F.coalesce(missing | blocked, F.lit(False)) & ((status == "parse_failed") | c("parse_failed"))),
        ("error", "outline_no_assessments", read & (c("parsed_items") == 0)),
        ("warn", "outline_low_confidence", read & (c("confidence") < 0.45)),
        ("warn", "outline_extraction_incomplete", read & c("incomplete")),
        ("warn", "outline_text_short", read & (c("text_length") < 400)),
        ("warn", "outline_doc_missing", status.isin("parsed", "found") & ~c("has_document")),
        ("error", "no_assessments", c("n_items") == 0),
        ("error", "assessments_without_dates", undated & most),
        ("warn", "assessments_without_dates", undated & ~most),
        ("info", "assessments_approximate_dates", c("n_approximate") > 0),
        ("warn", "no_weights", (c("basis") == "none") & (c("n_items") > 0)),
        ("warn", "weights_not_100", (c("basis") != "none") & (F.abs(c("total") - 100) > TOLERANCE)),
        ("warn", "duplicate_assessments", c("n_duplicates") > 0),
        ("warn", "unresolved_conflicts", c("n_conflicts") > 0),
        ("warn", "no_class_times", c("n_meetings") == 0),
        ("warn", "blocked_endpoints", c("n_blocked") > 0),
        ("warn", "failed_endpoints", c("n_failed") > 0),
        ("info", "coverage_gaps", c("n_bad_sources") > 0),
    ]
    return facts.select("course_id", _found(found).alias("p")).select("course_id", "p.*")


def sync_problems(syncs: DataFrame, now) -> DataFrame:
    """student_id, severity and code of each problem of a student's data as a whole.

    syncs: student_id, last_synced_at, status, n_courses, n_selected, n_requests, n_failures (of requests that belong to no course)."""
    c = F.col
    synced = c("last_synced_at").isNotNull()
    found = [
        ("error", "never_synced", ~synced),
        ("error", "signed_out", c("status") == "signed_out"),
        ("error", "sync_error", c("status") == "error"),
        ("warn", "sync_stale", F.unix_micros(now) - F.unix_micros("last_synced_at") > 3 * 86400 * 1000000),
        ("info", "no_sync_trace", (c("n_courses") > 0) & (c("n_requests") == 0)),
        ("error", "no_courses_selected", (c("n_courses") > 0) & (c("n_selected") == 0)),
        ("error", "no_courses", synced & (c("n_courses") == 0)),
        ("warn", "global_endpoint_failures", c("n_failures") > 0),
    ]
    return syncs.select("student_id", _found(found).alias("p")).select("student_id", "p.*")
