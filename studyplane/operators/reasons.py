"""Why an item matters: the rules that take up a miss, and reasons in a fixed order, each with its code and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_pattern


def absorbers(items: DataFrame, rules: DataFrame, categories: DataFrame) -> DataFrame:
    """id and absorber (kind, n, of, category) of items whose miss a rule takes up: the first rule of its course for its type and words, else
    the first category, its own if it has one, that counts the best n or drops the lowest.

    items: id, course_id, type, title, category_id. rules: course_id, ord, kind, n, of, types (empty: all), category (null: all).
    categories: course_id, category_id, ord, name, best_n, drop_lowest. A course has few rules; items meet those of their course only."""
    named = categories.select("course_id", "category_id", F.col("name").alias("_name"))
    blob = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("_name", F.lit(""))))
    kept = rules.filter("kind IN ('BestN', 'DropLowest')").select("course_id", "ord", "kind", "n", "of", "types", "category")
    spoken = items.select("id", "course_id", "type", "title", "category_id").join(named, ["course_id", "category_id"], "left")
    fits = ((F.size("types") == 0) | F.array_contains("types", F.col("type"))) & (F.col("category").isNull() | blob.contains(F.lower("category")) | F.coalesce(F.col("_name") == F.col("category"), F.lit(False)))
    by_rule = spoken.join(kept, "course_id").filter(fits).groupBy("id").agg(F.min_by(F.struct("kind", "n", "of", "category"), "ord").alias("by_rule"))
    counts = categories.filter("best_n IS NOT NULL OR drop_lowest > 0").withColumn("made", F.struct(F.when(F.col("best_n").isNotNull(), "BestN").otherwise("DropLowest").alias("kind"), F.coalesce("best_n", "drop_lowest").alias("n"), F.lit(None).cast("int").alias("of"), F.col("name").alias("category")))
    own = counts.groupBy("course_id", "category_id").agg(F.min_by("made", "ord").alias("own"))
    any_ = counts.groupBy("course_id").agg(F.min_by("made", "ord").alias("any"))
    met = items.select("id", "course_id", "category_id").join(own, ["course_id", "category_id"], "left").join(any_, "course_id", "left").join(by_rule, "id", "left")
    found = F.coalesce("by_rule", F.when(F.col("category_id").isNull(), F.col("any")).otherwise(F.col("own")))
    return met.select("id", found.alias("absorber")).filter("absorber IS NOT NULL")


def absorber_text(a: Column) -> Column:
    of = F.coalesce(F.concat(F.lit(" of "), a["of"].cast("string")), F.lit(""))
    where = F.coalesce(F.concat(F.lit(" ("), a["category"], F.lit(")")), F.lit(""))
    head = F.when(a["kind"] == "BestN", F.concat(F.lit("Best "), a["n"].cast("string"), of)).otherwise(F.concat(F.lit("Drop lowest "), a["n"].cast("string")))
    return F.concat(head, where, F.lit(" may absorb a miss"))


def number(value: Column) -> Column:
    """A number as it is read: without a fraction if it has none."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def reasons(items: DataFrame) -> DataFrame:
    """id, branch, ord, code and text of what an item itself gives as reasons, by branch.

    items: id, type, title, weight, blueprint_weight, submission, hours (to its due), safety, source, due_label, open, missed,
    needs_confirmation, absorber (as of absorbers), lab (text on its course's lab tonight). Nulls give no reason, but a weight's."""
    c = F.col
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    one = lambda h: F.format_string("%.1f", h)
    hours = c("hours")
    reason = lambda condition, branch, code, said: F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(branch).alias("branch"), code.alias("code"), said.alias("text")))
    lit = F.lit
    rule = c("absorber").isNotNull() & (c("missed") | ((hours < 0) & c("open")) | (c("type") == "quiz"))
    due = F.when(hours < 0, F.when(hours > -24, text("Overdue by ", F.format_string("%.0f", -hours), "h")).otherwise(text("Overdue by ", one(-hours / 24), "d"))).when(hours < 1, text("Due in ", F.floor(hours * 60 + 0.5).cast("string"), " min")).when(hours <= 24, text("Due in ", one(hours), "h")).otherwise(text("Due in ", one(hours / 24), "d"))
    weight = F.when(c("weight").isNotNull(), text(number(c("weight")), "% of course")).when(c("blueprint_weight").isNotNull(), text(number(c("blueprint_weight")), "% (from outline blueprint)")).otherwise("Weight unknown")
    found = [
        reason(lit(True), 1, F.when(c("weight").isNull() & c("blueprint_weight").isNotNull(), "blueprint").otherwise("weight"), weight),
        reason(c("submission").isin("not_submitted", "submitted", "unknown"), 2, F.when(c("submission") == "unknown", "needs_confirmation").otherwise(c("submission")), F.when(c("submission") == "submitted", "Submitted").when(c("submission") == "unknown", "Submission unknown").otherwise("Not submitted")),
        reason(hours <= 72, 3, F.when(hours < 0, "overdue").otherwise("due_soon"), due),
        reason((c("safety") == "DERIVED") | F.coalesce(c("source") == "rule_engine", lit(False)), 4, lit("relative_deadline"), text("Derived due: ", F.coalesce("due_label", lit("relative deadline from meeting occurrence")))),
        reason(rule, 5, F.when(c("absorber")["kind"] == "BestN", "best_n").otherwise("drop_lowest"), absorber_text(c("absorber"))),
        reason(c("needs_confirmation"), 6, lit("needs_confirmation"), lit("Needs your confirmation")),
        reason(c("lab").isNotNull() & ((c("type") == "lab") | F.lower("title").contains("lab")), 7, lit("lab_tonight"), c("lab")),
    ]
    rows = items.select("id", F.explode(F.array_compact(F.array(*found))).alias("r"))
    return rows.select("id", "r.branch", F.lit(0).cast("long").alias("ord"), "r.code", "r.text")


#: The branches of reasons that other tables give, after an item's own.
MATERIAL, GRADE_RULE, DEPENDENCY = 8, 9, 10


def rule_reasons(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Reasons from thresholds, minimums and caps of an item's course, in the order of the rules.

    items: id, course_id, type, title. rules: course_id, ord, kind, components (types, pattern), required, available, cap, minimum, category,
    condition. Patterns are regular expressions in any case; an invalid one is a part of the title."""
    c = F.col
    title = F.coalesce("title", F.lit(""))
    hit = F.exists(F.arrays_zip("components", "patterns"), lambda z: ((F.size(z["components"]["types"]) == 0) | F.array_contains(z["components"]["types"], c("type"))) & (z["patterns"].isNull() | F.coalesce(F.rlike(title, z["patterns"]), F.lit(False))))
    said = (
        F.when((c("kind") == "CombinedComponentThreshold") & hit, F.concat(F.lit("Combined threshold: need "), number(c("required")), F.lit("/"), number(c("available")), F.lit(" pts (cap "), number(c("cap")), F.lit("%)")))
        .when((c("kind") == "MinimumComponentPass") & (c("type") != "quiz"), F.concat(F.lit("Minimum "), number(c("minimum")), F.lit("% in "), c("category")))
        .when(c("kind") == "GradeCap", F.concat(F.lit("Grade cap "), number(c("cap")), F.lit("% — "), c("condition")))
    )
    each = rules.select("course_id", "ord", F.posexplode("components").alias("k", "c")).select("course_id", "ord", "k", title_pattern(c("c.pattern")).alias("p"))
    patterns = each.groupBy("course_id", "ord").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("patterns"))
    rules = rules.join(patterns, ["course_id", "ord"], "left").withColumn("patterns", F.transform("patterns", lambda x: x["p"]))
    met = items.select("id", "course_id", "type", "title").join(rules, "course_id").select("id", F.lit(GRADE_RULE).alias("branch"), c("ord").cast("long").alias("ord"), F.lit("grade_rule").alias("code"), said.alias("text"))
    return met.filter("text IS NOT NULL")


def link_reasons(links: DataFrame) -> DataFrame:
    """Reasons from changes and clarifications that are linked to an item: the label of what is linked, 120 characters in all.

    links: id (of the item), ord, kind, label (null: the kind in words)."""
    kinds = links.filter(F.col("kind").isin("CHANGES_DEADLINE_OF", "EXTENDS_DEADLINE_OF", "CLARIFIES", "ABOUT"))
    head = F.when(F.col("kind") == "CLARIFIES", "Staff clarification: ").otherwise("Linked change: ")
    label = F.coalesce("label", F.lower(F.replace("kind", F.lit("_"), F.lit(" "))))
    return kinds.select("id", F.lit(DEPENDENCY).alias("branch"), F.col("ord").cast("long").alias("ord"), F.lit("dependency").alias("code"), F.left(F.concat(head, label), F.lit(120)).alias("text"))


def in_order(*parts: DataFrame) -> DataFrame:
    """All reasons of each item with their place: id, place, code, text."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.select("id", F.row_number().over(Window.partitionBy("id").orderBy("branch", "ord", "text")).alias("place"), "code", "text")
