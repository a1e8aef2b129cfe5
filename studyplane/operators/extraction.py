"""How complete what was read from an outline is: checks, contradictions, what is missing, and a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights may sum to this much beside 100; a score below which an extraction is incomplete (fixed values of the feature).
NEAR, ENOUGH = 5, 0.45
WEIGHT = "decimal(18,6)"


def _sum(weight: Column) -> Column:
    """Weights sum to six decimals, so that their order doesn't count."""
    return F.coalesce(F.sum(weight.cast(WEIGHT)), F.lit(0)).cast("double")


def _number(x: Column) -> Column:
    """A number of at most six decimals in its shortest form."""
    return F.regexp_replace(F.regexp_replace(x.cast(WEIGHT).cast("string"), "0+$", ""), r"\.$", "")


def category_checks(categories: DataFrame, instances: DataFrame) -> DataFrame:
    """course_id, ord, name, id, ok, detail and contradiction (null if none) of each check of a category.

    categories: course_id, ord, name, promised, best_n; instances: course_id, category. A category that promises a number is checked against
    the instances of its name (any case); a best-of against the promise, where there is one. An instance belongs to each category of its
    name, a nameless one to none; categories without a name are found by no instance."""
    found = instances.filter("category IS NOT NULL").groupBy("course_id", F.lower("category").alias("low")).agg(F.count("*").alias("found"))
    of = categories.withColumn("low", F.lower("name")).join(found, ["course_id", "low"], "left").withColumn("found", F.coalesce("found", F.lit(0)))
    name = F.coalesce("name", F.lit(""))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    kept = F.col("found") == F.col("promised")
    over = F.coalesce(F.col("best_n") > F.col("promised"), F.lit(False))
    promised, best, n = F.col("promised"), F.col("best_n"), F.col("found")
    check = lambda number, id, ok, detail, says: F.struct(F.lit(number).alias("number"), id.alias("id"), ok.alias("ok"), detail.alias("detail"), F.when(~ok, says).alias("contradiction"))
    promise = F.when(promised.isNotNull(), check(0, text("promised_", name), kept, text("promised ", promised, ", found ", n), text('Category "', name, '" promised ', promised, " instance(s), found ", n)))
    limit = F.when(best.isNotNull(), check(1, text("bestn_", name), ~over, F.when(over, "bestN exceeds count").otherwise(text("best ", best)), text("bestN ", best, " > promised ", promised, " for ", name)))
    return of.select("course_id", "ord", name.alias("name"), F.explode(F.array_compact(F.array(promise, limit))).alias("c")).select("course_id", (F.col("ord") * 2 + F.col("c.number")).alias("ord"), "name", "c.id", "c.ok", "c.detail", "c.contradiction")


def scores(outlines: DataFrame, categories: DataFrame, instances: DataFrame) -> DataFrame:
    """One row per outline: course_id, n_instances, total_weight, weights_ok, contradictions, missing, score and incomplete.

    outlines: course_id, course_code, instructors, tables, schedule, policies (numbers, null counts as 0); categories and instances as in
    `category_checks`, with weight. Where categories have weights they count, with the instances of none; otherwise instances do. missing
    joins by commas what isn't there: course_code, instructor, assessments, evaluation_table, schedule. A course without instances or
    categories has none; repeated instances count as often as they come, and rows of courses without an outline nowhere."""
    weighed = categories.groupBy("course_id").agg(_sum(F.col("weight")).alias("of_categories"))
    loose = F.coalesce(F.col("category"), F.lit("")) == ""
    counted = instances.groupBy("course_id").agg(F.count("*").alias("n_instances"), _sum(F.col("weight")).alias("of_instances"), _sum(F.when(loose, F.col("weight"))).alias("of_loose"))
    against = category_checks(categories, instances).groupBy("course_id").agg(F.count("contradiction").alias("broken"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    of = outlines.join(weighed, "course_id", "left").join(counted, "course_id", "left").join(against, "course_id", "left")
    total = F.when(zero("of_categories") > 0, zero("of_categories") + zero("of_loose")).otherwise(zero("of_instances"))
    of = of.withColumns({"n_instances": zero("n_instances").cast("long"), "total_weight": total.cast("double")})
    n, weight = F.col("n_instances"), F.col("total_weight")
    of = of.withColumn("weights_ok", (weight > 0) & (F.abs(weight - 100) <= NEAR))
    code, teachers, tables, schedule, policies = F.coalesce("course_code", F.lit("")) != "", zero("instructors") > 0, zero("tables"), zero("schedule") > 0, zero("policies") > 0
    contradictions = zero("broken") + F.when(~F.col("weights_ok") & (weight > 0), 1).otherwise(0)
    untabled = (tables == 0) & (n < 3)
    gaps = F.array_compact(F.array(*(F.when(c, F.lit(k)) for c, k in ((~code, "course_code"), (~teachers, "instructor"), (n < 2, "assessments"), (untabled, "evaluation_table"), (~schedule, "schedule")))))
    score = F.lit(0.2)
    for holds, points in ((code, 0.1), (teachers, 0.1), (n >= 2, 0.15), (n >= 4, 0.05)):
        score = score + F.when(holds, points).otherwise(0.0)
    score = score + F.when(F.col("weights_ok"), 0.2).when(weight > 40, 0.08).otherwise(0.0)
    for holds, points in ((tables > 0, 0.1), (schedule, 0.05), (policies, 0.05)):
        score = score + F.when(holds, points).otherwise(0.0)
    score = score - F.lit(0.08) * F.least(F.lit(3), contradictions)
    out = of.withColumns({"contradictions": contradictions.cast("long"), "missing": F.array_join(gaps, ","), "raw": score})
    incomplete = (n < 2) | untabled | (F.col("raw") < ENOUGH)
    return out.select("course_id", "n_instances", "total_weight", "weights_ok", "contradictions", "missing", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw"))).alias("score"), incomplete.alias("incomplete"))


def checks(outlines: DataFrame, categories: DataFrame, instances: DataFrame) -> DataFrame:
    """course_id, place (from 0, as checks come), id, ok, detail and contradiction of every check of an outline: its weights, its categories, and
    whether it has assessments and an instructor. A place is its own only within a course whose categories have different ord."""
    of = scores(outlines, categories, instances).join(outlines.select("course_id", F.coalesce("instructors", F.lit(0)).alias("instructors")), "course_id")
    weight = F.col("total_weight")
    row = lambda place, id, ok, detail, says=None: of.select("course_id", F.lit(place).cast("long").alias("place"), F.lit(id).alias("id"), ok.alias("ok"), detail.alias("detail"), (F.lit(None) if says is None else says).cast("string").alias("contradiction"))
    sums = row(0, "weights_near_100", F.col("weights_ok"), F.concat(F.lit("weightSum="), _number(F.floor(weight * 100 + 0.5) / 100)), F.when(~F.col("weights_ok") & (weight > 0), F.concat(F.lit("Weights sum to "), _number(weight), F.lit(", expected ~100"))))
    named = category_checks(categories, instances).join(outlines.select("course_id"), "course_id", "left_semi").select("course_id", (F.col("ord") + 1).cast("long").alias("place"), "id", "ok", "detail", "contradiction")
    last = 2**40
    some = row(last, "has_assessments", F.col("n_instances") >= 2, F.concat(F.col("n_instances").cast("string"), F.lit(" instance(s)")))
    taught = row(last + 1, "has_instructor", F.col("instructors") > 0, F.concat(F.col("instructors").cast("string"), F.lit(" instructor(s)")))
    return sums.unionByName(named).unionByName(some).unionByName(taught)
