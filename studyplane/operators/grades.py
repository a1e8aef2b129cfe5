"""Grade operators over assessments: weighted standing, best-N and drop-lowest rules, caps, what-if, required averages.

An assessment row has course_id, id, ord (input order within the course), weight, percent (null: not graded), missed and dropped.
Everything is keyed by course, or by course and rule pool, and aggregates with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def standing(rows: DataFrame, group: str = "course_id", dropped: str = "dropped") -> DataFrame:
    """Per course: calculated_percent, completed_weight, remaining_weight, graded, ungraded and missed counts.

    Provisional drops must not be in `dropped`. A missed row keeps its weight in what remains."""
    counted = F.col("percent").isNotNull() & ~F.col(dropped) & ~F.col("missed") & F.col("weight").isNotNull()
    total = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))
    out = rows.groupBy(group).agg(
        total(counted, F.col("percent") * F.col("weight")).alias("_sum"),
        total(counted, F.col("weight")).alias("completed_weight"),
        total(~F.col(dropped), F.col("weight")).alias("_known"),
        F.count_if(F.col("percent").isNotNull()).alias("graded_count"),
        F.count_if(F.col("percent").isNull() & ~F.col("missed")).alias("ungraded_count"),
        F.count_if("missed").alias("missed_count"),
    )
    return out.select(
        group,
        F.try_divide("_sum", F.nullif("completed_weight", F.lit(0.0))).alias("calculated_percent"),
        "completed_weight",
        F.greatest(F.lit(0.0), F.col("_known") - F.col("completed_weight")).alias("remaining_weight"),
        "graded_count",
        "ungraded_count",
        "missed_count",
    )


def required_average(target: float, calculated: Column, completed: Column, remaining: Column) -> Column:
    """The average on what remains that gives the target; null if nothing remains."""
    return F.when(remaining > 0, (F.lit(target) * (completed + remaining) - F.coalesce(calculated, F.lit(0.0)) * completed) / remaining)


def required_final(target: float, final_weight: Column, calculated: Column, completed: Column) -> Column:
    """The final exam's percentage that gives the target."""
    return F.when(final_weight > 0, (F.lit(target) * (completed + final_weight) - F.coalesce(calculated, F.lit(0.0)) * completed) / final_weight)


def maximum_possible(calculated: Column, completed: Column, remaining: Column) -> Column:
    """The standing with full marks on all that remains."""
    return F.try_divide(F.coalesce(calculated, F.lit(0.0)) * completed + 100 * remaining, F.nullif(completed + remaining, F.lit(0.0)))


def best_n(rows: DataFrame, n: int | Column, expected: int | Column, pool: list[str]) -> DataFrame:
    """rows with drop: official, provisional or projection for what best-N leaves out, pending for a miss without a grade, else none.

    Ties keep the earlier row. A pool without any score has no effect. It is incomplete while fewer than expected rows are graded or
    missed, or any row is neither. Pools are windows: a pool's rows are those of one course's rule, not of a corpus."""
    n, expected = (F.lit(x) if isinstance(x, int) else x for x in (n, expected))
    w = Window.partitionBy(*pool)
    scored = F.col("percent").isNotNull()
    ranked = rows.withColumns(
        {
            "_rank": F.row_number().over(w.orderBy(F.desc_nulls_last("percent"), "ord")),
            "_scored": F.count_if(scored).over(w),
            "_open": F.count_if(~scored & ~F.col("missed")).over(w),
            "_missed": F.count_if(~scored & F.col("missed")).over(w),
        }
    )
    incomplete = (F.col("_scored") + F.col("_missed") < expected) | (F.col("_open") > 0)
    left_out = F.when(~incomplete, "official").when(F.col("_open") > 0, "projection").otherwise("provisional")
    drop = F.when(F.col("_scored") == 0, "none").when(scored & (F.col("_rank") > n), left_out).when(~scored & F.col("missed"), "pending").otherwise("none")
    return ranked.withColumn("drop", drop).drop("_rank", "_scored", "_open", "_missed")


def drop_lowest(rows: DataFrame, n: int | Column, pool: list[str]) -> DataFrame:
    """rows with drop: official for the n lowest scores of a pool, provisional while a row is neither graded nor missed."""
    n = F.lit(n) if isinstance(n, int) else n
    w = Window.partitionBy(*pool)
    scored = F.col("percent").isNotNull()
    rank = F.row_number().over(w.orderBy(F.asc_nulls_last("percent"), "ord"))
    still_open = F.count_if(~scored & ~F.col("missed")).over(w) > 0
    return rows.withColumns({"_rank": rank, "_open": still_open}).withColumn("drop", F.when(scored & (F.col("_rank") <= n), F.when(F.col("_open"), "provisional").otherwise("official")).otherwise("none")).drop("_rank", "_open")


def combined_threshold(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Per course and rule: earned, known_weight and met (null while a component has no score).

    components: a short list of rule texts, read to the driver: rule_id, component, kind, component_weight, available, required. A component's score is that of the first row of its
    kind, also where that row isn't graded."""
    first = rows.groupBy("course_id", "kind").agg(F.min_by("percent", "ord").alias("percent"))
    courses = rows.select("course_id").distinct()
    listed = components.agg(F.collect_list(F.struct("rule_id", "component", "kind", "component_weight", "available", "required")).alias("_c")).first()["_c"]
    each = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in c.asDict().items())) for c in listed))
    hit = courses.select("course_id", F.inline(each)).join(first, ["course_id", "kind"], "left")
    known = F.when(F.col("percent").isNotNull(), F.col("component_weight"))
    out = hit.groupBy("course_id", "rule_id").agg(F.sum(F.col("percent") / 100 * F.col("component_weight")).alias("earned"), F.coalesce(F.sum(known), F.lit(0.0)).alias("known_weight"), F.first("available").alias("available"), F.first("required").alias("required"))
    return out.withColumn("met", F.when(F.col("known_weight") >= F.col("available"), F.col("earned") >= F.col("required")))


def last_cap(effects: DataFrame) -> DataFrame:
    """Per course the cap of the last rule that sets one: effects has course_id, rule_ord and cap (null: sets none)."""
    return effects.filter("cap IS NOT NULL").groupBy("course_id").agg(F.max_by("cap", "rule_ord").alias("cap"), F.max("rule_ord").alias("cap_rule"))


def capped(calculated: Column, cap: Column) -> Column:
    return F.when(calculated > cap, cap).otherwise(calculated)


def what_if(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """rows with the percent, missed and dropped of the first override of their id; a null there keeps the row's own."""
    first = overrides.groupBy("id").agg(F.min_by(F.struct("percent", "missed", "dropped"), "ord").alias("_o"))
    out = rows.join(first, "id", "left")
    return out.withColumns({c: F.coalesce(f"_o.{c}", c) for c in ("percent", "missed", "dropped")}).drop("_o")
