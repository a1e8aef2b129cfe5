"""Grade rules: which items they drop and which cap they set, and a course's standing under them.

items: course_id, id, ord (input order in the course), title, type, category_id, weight, percent (null: no grade), missed, dropped, bonus.
categories: course_id, category_id, ord, name, drop_lowest, best_n. rules: course_id, rule_id, ord, kind, n, of, types (empty: all), category (a
word of the title, null: all), threshold, cap, components (array of types, title_pattern, weight), required, available.

Rules carry their course. Kinds that change a grade are BestN, DropLowest, ExternalActivity (its n as best of), Threshold, CombinedComponentThreshold
and GradeCap; all others are kept for other purposes and change nothing here. Every step is keyed by course."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_pattern

#: All kinds of rules (fixed values).
KINDS = (
    "BestN DropLowest EqualWeightCategory ExplicitWeight CategoryWeight Threshold CombinedComponentThreshold GradeCap MinimumComponentPass RelativeDeadline OccurrenceRelativeDeadline SectionOccurrence "
    "Attempt HigherAttempt ConditionalReplacement WeightTransfer RegistrarScheduled LiveAssessment ExternalActivity ManualOverride"
).split()


def matches(types: Column, category: Column, type_of: Column, title: Column) -> Column:
    """Whether a rule is for an item: an empty list of types is for all, and so is no category, which is looked for in the title."""
    return ((F.coalesce(F.size(types), F.lit(0)) <= 0) | F.array_contains(types, type_of)) & (category.isNull() | F.lower(title).contains(F.lower(category)))


def pools(items: DataFrame, categories: DataFrame, rules: DataFrame) -> DataFrame:
    """The items of each pool: items' columns, pool, pool_ord (categories first, each with drop-lowest before best-of, then rules in order), mode
    (best or lowest), n and expected (null: the pool's size)."""
    i, g, r = items.alias("i"), categories.alias("g"), rules.filter(F.col("kind").isin("BestN", "DropLowest") | ((F.col("kind") == "ExternalActivity") & F.col("n").isNotNull())).alias("r")
    member = (F.col("i.course_id") == F.col("g.course_id")) & (F.col("i.category_id").eqNullSafe(F.col("g.category_id")) | ((F.col("g.name") != "") & F.lower("i.title").contains(F.lower(F.col("g.name")))))
    step = lambda first, at, then: F.struct(F.lit(first).alias("a"), F.col(at).cast("long").alias("b"), F.lit(then).alias("c"))
    of_category = i.join(g, member)
    none = F.lit(None).cast("long")
    lowest = of_category.filter("g.drop_lowest > 0").select("i.*", F.concat(F.lit("cat:"), "g.category_id").alias("pool"), step(0, "g.ord", 0).alias("pool_ord"), F.lit("lowest").alias("mode"), F.col("g.drop_lowest").cast("long").alias("n"), none.alias("expected"))
    best = of_category.filter("g.best_n > 0").select("i.*", F.concat(F.lit("cat:"), "g.category_id", F.lit(":bestn")).alias("pool"), step(0, "g.ord", 1).alias("pool_ord"), F.lit("best").alias("mode"), F.col("g.best_n").cast("long").alias("n"), none.alias("expected"))
    category = F.when(F.col("r.kind") != "ExternalActivity", F.col("r.category"))
    of_rule = i.join(r, (F.col("i.course_id") == F.col("r.course_id")) & matches(F.col("r.types"), category, F.col("i.type"), F.col("i.title")))
    ruled = of_rule.select("i.*", F.col("r.rule_id").alias("pool"), step(1, "r.ord", 0).alias("pool_ord"), F.when(F.col("r.kind") == "DropLowest", "lowest").otherwise("best").alias("mode"), F.col("r.n").cast("long").alias("n"), F.coalesce("r.of", "r.n").cast("long").alias("expected"))
    return lowest.unionByName(best).unionByName(ruled)


def _pooled(items: DataFrame, categories: DataFrame, rules: DataFrame) -> DataFrame:
    """What `drops` says, of the items that stand in a pool; one row for each course_id and id, certainty null where nothing drops it."""
    scored = F.col("percent").isNotNull()
    w = Window.partitionBy("course_id", "pool", "mode")
    open_ = F.count_if(~scored & ~F.col("missed")).over(w)
    ranked = pools(items, categories, rules).withColumns(
        {
            "_high": F.row_number().over(w.orderBy(F.desc_nulls_last("percent"), "ord")),
            "_low": F.row_number().over(w.orderBy(F.asc_nulls_last("percent"), "ord")),
            "_open": open_,
            "_scored": F.count_if(scored).over(w),
            "_lost": F.count_if(~scored & F.col("missed")).over(w),
            "_size": F.count("*").over(w),
        }
    )
    incomplete = (F.col("_scored") + F.col("_lost") < F.coalesce("expected", "_size")) | (F.col("_open") > 0)
    best = F.when(scored & (F.col("_high") > F.col("n")), F.when(~incomplete, "official").when(F.col("_open") > 0, "projection").otherwise("provisional"))
    lowest = F.when(scored & (F.col("_low") <= F.col("n")), F.when(F.col("_open") > 0, "provisional").otherwise("official"))
    outcome = F.when(F.col("mode") == "best", best).otherwise(lowest)
    pending = (F.col("mode") == "best") & (F.col("_scored") > 0) & ~scored & F.col("missed")
    return ranked.select("course_id", "id", "pool_ord", outcome.alias("_o"), pending.alias("_p")).groupBy("course_id", "id").agg(
        F.coalesce(F.bool_or(F.col("_o") == "official"), F.lit(False)).alias("official"),
        F.coalesce(F.bool_or(F.col("_o") != "official"), F.lit(False)).alias("provisional"),
        F.max_by("_o", F.when(F.col("_o").isNotNull(), F.col("pool_ord"))).alias("certainty"),
        F.bool_or("_p").alias("pending"),
    )


def drops(items: DataFrame, categories: DataFrame, rules: DataFrame) -> DataFrame:
    """Per item of items: official (some pool drops it for good), provisional (some pool would, but isn't complete), certainty of the last pool in
    order that drops it (official, provisional, projection or none), pending (missed without a grade in a best-of pool).

    Best-of keeps the n highest, ties by input order; it is complete once as many as expected are graded or missed and none is open, and does nothing
    while no item is graded. Drop-lowest drops the n lowest, provisionally while one is open."""
    each = _pooled(items, categories, rules)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return items.select("course_id", "id").join(each, ["course_id", "id"], "left").select("course_id", "id", no("official"), no("provisional"), F.coalesce("certainty", F.lit("none")).alias("certainty"), no("pending"))


def last_caps(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Per course the last rule in order that sets a cap: rule_id, cap, and combined (the cap is then the standing, where that is lower).

    A threshold looks at its first graded item. A combined threshold adds up the first item of each component, graded or not, and counts once
    the weights of graded ones reach what is available; a title pattern is a regular expression in any case, and one that isn't valid a part of
    the title."""
    i = items.alias("i")
    one = rules.filter("kind = 'Threshold' AND cap IS NOT NULL").alias("r")
    hit = one.join(i, (F.col("i.course_id") == F.col("r.course_id")) & F.col("i.percent").isNotNull() & matches(F.col("r.types"), F.lit(None).cast("string"), F.col("i.type"), F.col("i.title")))
    first = hit.groupBy("r.course_id", "r.rule_id", "r.ord", "r.cap", "r.threshold").agg(F.min_by("i.percent", "i.ord").alias("p")).filter("p < threshold")
    set_ = first.select("course_id", "rule_id", "ord", "cap", F.lit(False).alias("combined"))
    always = rules.filter("kind = 'GradeCap'").select("course_id", "rule_id", "ord", "cap", F.lit(False).alias("combined"))
    part = rules.filter("kind = 'CombinedComponentThreshold'").select("course_id", "rule_id", "ord", "cap", "required", "available", F.posexplode("components").alias("k", "c")).withColumn("pattern", title_pattern(F.col("c.title_pattern"))).alias("r")
    titled = F.col("r.pattern").isNull() | F.coalesce(F.regexp_like("i.title", F.col("r.pattern")), F.lit(False))
    found = part.join(i, (F.col("i.course_id") == F.col("r.course_id")) & matches(F.col("r.c.types"), F.lit(None).cast("string"), F.col("i.type"), F.col("i.title")) & titled, "left")
    each = found.groupBy("r.course_id", "r.rule_id", "r.ord", "r.cap", "r.required", "r.available", "r.k", F.col("r.c.weight").alias("w")).agg(F.min_by(F.struct("i.percent"), "i.ord")["percent"].alias("p"))
    known = F.col("p").isNotNull()
    total = each.groupBy("course_id", "rule_id", "ord", "cap", "required", "available").agg(F.sum(F.when(known, F.col("p") / 100 * F.col("w"))).alias("earned"), F.coalesce(F.sum(F.when(known, F.col("w"))), F.lit(0.0)).alias("known"))
    failed = total.filter("known >= available AND coalesce(earned, 0) < required").select("course_id", "rule_id", "ord", "cap", F.lit(True).alias("combined"))
    last = set_.unionByName(always).unionByName(failed).groupBy("course_id").agg(F.max_by(F.struct("rule_id", "cap", "combined"), "ord").alias("l"))
    return last.select("course_id", "l.*")


def summary(items: DataFrame, categories: DataFrame, rules: DataFrame) -> DataFrame:
    """Per course: calculated_percent, completed_weight, remaining_weight, graded, ungraded and missed counts, cap and cap_rule.

    Bonus items are left out. Caps are found for the standing before drops, and again for the one that they lower; provisional drops change nothing."""
    mine = items.filter(~F.coalesce("bonus", F.lit(False)))
    official = _pooled(mine, categories, rules).filter("official").select("course_id", "id", "official")
    rows = mine.join(official, ["course_id", "id"], "left")
    gone = F.coalesce("official", F.lit(False)) | F.coalesce("dropped", F.lit(False))
    counted = F.col("percent").isNotNull() & ~F.col("missed")
    add = lambda condition, value: F.sum(F.when(condition, value))
    raw_on, on = counted & ~F.coalesce("dropped", F.lit(False)), counted & ~gone
    s = rows.groupBy("course_id").agg(
        F.try_divide(add(raw_on, F.col("percent") * F.col("weight")), F.nullif(add(raw_on, F.col("weight")), F.lit(0.0))).alias("_raw"),
        add(on, F.col("percent") * F.col("weight")).alias("_sum"),
        F.coalesce(add(on, F.col("weight")), F.lit(0.0)).alias("completed_weight"),
        F.coalesce(add(~gone, F.col("weight")), F.lit(0.0)).alias("_known"),
        F.count("percent").alias("graded_count"),
        F.count_if(F.col("percent").isNull() & ~F.col("missed")).alias("ungraded_count"),
        F.count_if("missed").alias("missed_count"),
    )
    out = s.join(last_caps(mine, rules).withColumnRenamed("cap", "_cap"), "course_id", "left")
    under = lambda standing: F.when(F.col("combined") & standing.isNotNull(), F.least(standing, F.col("_cap"))).otherwise(F.col("_cap"))
    lower = lambda standing, cap: F.when(standing > cap, cap).otherwise(standing)
    out = out.withColumn("_first", F.try_divide("_sum", F.nullif("completed_weight", F.lit(0.0)))).withColumn("_cap1", under(F.col("_raw"))).withColumn("_second", lower(F.col("_first"), F.col("_cap1")))
    out = out.withColumn("cap", F.when(F.col("_second").isNull(), F.col("_cap1")).otherwise(under(F.col("_second"))))
    return out.select("course_id", lower(F.col("_second"), F.col("cap")).alias("calculated_percent"), "completed_weight", F.greatest(F.lit(0.0), F.col("_known") - F.col("completed_weight")).alias("remaining_weight"), "graded_count", "ungraded_count", "missed_count", "cap", F.col("rule_id").alias("cap_rule"))


def merged_categories(live: DataFrame, outline: DataFrame) -> DataFrame:
    """Live categories with what outline ones of the same course and name add, then outline ones without a live one.

    Columns of both: course_id, category_id, name, weight, drop_lowest, best_n, cap, threshold. Names are told apart without case. Of several outline rows
    of one name the first by id adds; a null or 0 drop_lowest takes the outline's."""
    key = lambda df: df.withColumn("_k", F.lower("name"))
    more = ("weight", "drop_lowest", "best_n", "cap", "threshold")
    one = key(outline).groupBy("course_id", "_k").agg(F.min_by(F.struct(*more), "category_id").alias("_o"))
    l = key(live).join(one, ["course_id", "_k"], "left")  # noqa: E741
    filled = l.withColumns({c: F.coalesce(F.nullif(c, F.lit(0)), F.col(f"_o.{c}"), F.col(c)) if c == "drop_lowest" else F.coalesce(c, f"_o.{c}") for c in more}).select("course_id", "category_id", "name", *more)
    alone = key(outline).join(key(live).select("course_id", "_k").distinct(), ["course_id", "_k"], "left_anti").select("course_id", "category_id", "name", *more)
    return filled.unionByName(alone)


def typed(legacy: DataFrame) -> DataFrame:
    """Rules of the older form (rule_id, course_id, ord, kind, params as a JSON object) in the columns of rules; numbers that aren't such count as absent.

    A best-of without its count takes 1, a drop-lowest 1; kinds without a typed form become ManualOverride."""
    known = F.col("kind").isin("BestN", "DropLowest", "Threshold", "CombinedComponentThreshold", "GradeCap", "RelativeDeadline", "OccurrenceRelativeDeadline", "ExternalActivity")
    p = lambda name, kind: F.try_variant_get(F.col("_v"), f"$.{name}", kind)
    kind = F.when(known, F.col("kind")).otherwise("ManualOverride")
    counted = F.when(kind.isin("BestN", "DropLowest"), F.coalesce(p("n", "double"), F.lit(1.0))).otherwise(p("n", "double"))
    return legacy.withColumn("_v", F.try_parse_json("params")).select(
        "course_id", "rule_id", "ord", kind.alias("kind"), counted.cast("long").alias("n"), p("of", "double").cast("long").alias("of"),
        F.coalesce(p("applyToTypes", "array<string>"), F.array().cast("array<string>")).alias("types"), p("category", "string").alias("category"), p("thresholdPercent", "double").alias("threshold"), F.coalesce(p("capPercent", "double"), p("capAt", "double")).alias("cap"),
        p("requiredCoursePoints", "double").alias("required"), p("availableCoursePoints", "double").alias("available"), p("offsetDays", "double").cast("long").alias("offset_days"),
    )
