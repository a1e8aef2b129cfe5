"""Where a course's live items fall short of what its outline says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import by_title, contained, shuffled

#: Kinds that a category's name stands for (fixed values), in order, by the words in it.
GUESSES = (("quiz", "quiz"), ("lab", "lab"), ("assign|project", "assignment"))

#: An outline scored under this is incomplete; weights from which a missing item, date or material matters (fixed values).
LEAST_QUALITY, HEAVY, DATED, WITH_MATERIAL = 0.55, 5.0, 8.0, 5.0


def plain(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), r"\s+", " "))


def _guess(name: Column) -> Column:
    out = F.when(F.lit(False), "")
    for pattern, kind in GUESSES:
        out = out.when(F.lower(name).rlike(pattern), kind)
    return out


def course_gaps(courses: DataFrame) -> DataFrame:
    """Gaps of whole courses. courses: course_id, outlined (a blueprint is there), status, score, incomplete, section_needed, section_known."""
    c = F.col
    gap = lambda condition, kind, severity: F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(kind).alias("kind"), severity.alias("severity")))
    warn = F.lit("warn")
    found = [
        gap(~c("outlined") & c("status").isin("parsed", "found"), "incomplete_blueprint", warn),
        gap(c("outlined") & (c("incomplete") | F.coalesce(c("score") < LEAST_QUALITY, F.lit(False))), "quality_incomplete", F.when(c("incomplete"), "block").otherwise("warn")),
        gap(c("outlined") & c("section_needed") & ~c("section_known"), "section_unresolved", warn),
    ]
    return courses.select("course_id", F.explode(F.array_compact(F.array(*found))).alias("g")).select("course_id", "g.kind", F.lit(None).cast("string").alias("subject"), "g.severity")


def count_gaps(categories: DataFrame, instances: DataFrame, items: DataFrame) -> DataFrame:
    """Categories of which far fewer items are live than promised. categories: course_id, name, promised; instances: course_id, category, type;
    items: course_id, type, key (plain title). A name that stands for no kind is looked for by its first word."""
    kinds = [k for _, k in GUESSES]
    live = items.groupBy("course_id").agg(*(F.count_if((F.col("type") == k) | F.col("key").contains(k)).alias(f"live_{k}") for k in kinds))
    promised = categories.filter("promised > 0").withColumns({"guess": _guess(F.col("name")), "word": F.split_part(plain(F.col("name")), F.lit(" "), F.lit(1))})
    keys = items.groupBy("course_id", F.col("key").alias("hay")).agg(F.count("*").alias("n"))
    worded = contained(promised.filter("guess IS NULL").select("course_id", F.col("word").alias("needle")), keys).join(shuffled(keys), ["course_id", "hay"]).groupBy("course_id", F.col("needle").alias("word")).agg(F.sum("n").alias("live_word"))
    of_type = instances.groupBy("course_id", F.col("type").alias("guess")).agg(F.count("*").alias("typed"))
    of_name = instances.groupBy("course_id", plain(F.col("category")).alias("plain_name")).agg(F.count("*").alias("named"))
    both = instances.groupBy("course_id", plain(F.col("category")).alias("plain_name"), F.col("type").alias("guess")).agg(F.count("*").alias("both"))
    met = promised.withColumn("plain_name", plain(F.col("name"))).join(shuffled(live), "course_id", "left").join(shuffled(worded), ["course_id", "word"], "left")
    met = met.join(shuffled(of_type), ["course_id", "guess"], "left").join(shuffled(of_name), ["course_id", "plain_name"], "left").join(shuffled(both), ["course_id", "plain_name", "guess"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    have = F.coalesce(*(F.when(F.col("guess") == k, zero(F.col(f"live_{k}"))) for k in kinds), F.col("live_word"), F.lit(0))
    made = zero(F.col("typed")) + zero(F.col("named")) - zero(F.col("both"))
    met = met.withColumns({"have": have, "expected": F.greatest("promised", made)})
    short = met.filter((F.col("expected") >= 2) & (F.col("have") < F.least(F.col("expected"), F.greatest(F.lit(1), F.col("expected") - 1))))
    return short.select("course_id", F.lit("promised_count_shortfall").alias("kind"), F.col("name").alias("subject"), F.when(F.col("have") == 0, "block").otherwise("warn").alias("severity"))


def instance_gaps(instances: DataFrame, items: DataFrame) -> DataFrame:
    """Instances without an item, or whose item lacks a weight, a date or material. instances: course_id, title, weight, type, dated; items: item_id,
    course_id, ord, key, weight, type, dated, open, materials (whether there are any)."""
    wanted = instances.filter(F.length("title") > 0).withColumn("key", plain(F.col("title")))
    hits = by_title(wanted, items, exact_first=False).select("course_id", "key", "item_id")
    live = items.select("course_id", "item_id", F.col("weight").alias("live_weight"), F.col("type").alias("live_type"), F.col("dated").alias("live_dated"), "open", "materials")
    met = wanted.join(shuffled(hits), ["course_id", "key"], "left").join(shuffled(live), ["course_id", "item_id"], "left")
    c = F.col
    exam = lambda t: c(t).isin("midterm", "final")
    here = c("item_id").isNotNull()
    gap = lambda condition, kind, subject, severity: F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), severity.alias("severity")))
    warn, heavy = F.lit("warn"), (F.coalesce("weight", F.lit(0.0)) >= HEAVY) | exam("type")
    found = [
        gap(~here, "missing_assessment", F.left("key", F.lit(40)), F.when(heavy, "block").otherwise("warn")),
        gap(here & c("live_weight").isNull() & c("weight").isNull(), "missing_weight", c("item_id"), warn),
        gap(here & ~c("live_dated") & ~c("dated") & (exam("live_type") | (F.coalesce("weight", "live_weight", F.lit(0.0)) >= DATED)), "missing_date", c("item_id"), warn),
        gap(here & c("open") & c("live_type").isin("lab", "assignment", "project") & (F.coalesce("live_weight", "weight", F.lit(0.0)) >= WITH_MATERIAL) & ~c("materials"), "missing_material", c("item_id"), warn),
    ]
    return met.select("course_id", F.explode(F.array_compact(F.array(*found))).alias("g")).select("course_id", "g.*")
