"""Grade queries over lineitem: an order is a course, a line an assessment, quantity its weight, discount what it lost.

Lines of status O aren't graded, flag R is dropped, flag N with an odd line number is missed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.state import percent
from ..operators import grades, rules
from .registry import query, table

ASSESSMENTS = """
a AS (
  SELECT l_orderkey AS course_id, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
         l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS ord, l_quantity AS weight, l_tax,
         CASE WHEN l_linestatus = 'F' AND NOT (l_returnflag = 'N' AND l_linenumber % 2 = 1)
              THEN l_extendedprice * (1 - l_discount) / l_extendedprice * 100 END AS percent,
         l_returnflag = 'N' AND l_linenumber % 2 = 1 AS missed, l_returnflag = 'R' AS dropped,
         CASE l_linenumber % 4 WHEN 0 THEN 'midterm' WHEN 1 THEN 'quiz' WHEN 2 THEN 'assignment' ELSE 'final' END AS kind
  FROM lineitem)"""


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    missed = (F.col("l_returnflag") == "N") & (F.col("l_linenumber") % 2 == 1)
    earned = F.when((F.col("l_linestatus") == "F") & ~missed, F.col("l_extendedprice") * (1 - F.col("l_discount")))
    part = F.col("l_linenumber") % 4
    return li.select(
        F.col("l_orderkey").alias("course_id"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        (F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ord"),
        F.col("l_quantity").alias("weight"),
        "l_tax",
        percent(earned, F.col("l_extendedprice"), F.lit(None).cast("string"), missed).alias("percent"),
        missed.alias("missed"),
        (F.col("l_returnflag") == "R").alias("dropped"),
        F.when(part == 0, "midterm").when(part == 1, "quiz").when(part == 2, "assignment").otherwise("final").alias("kind"),
    )


STANDING = """
s AS (
  SELECT course_id,
         sum(percent * weight) FILTER (WHERE percent IS NOT NULL AND NOT dropped AND NOT missed) AS num,
         coalesce(sum(weight) FILTER (WHERE percent IS NOT NULL AND NOT dropped AND NOT missed), 0) AS completed_weight,
         coalesce(sum(weight) FILTER (WHERE NOT dropped), 0) AS known,
         count(percent) AS graded_count, count(*) FILTER (WHERE percent IS NULL AND NOT missed) AS ungraded_count,
         count(*) FILTER (WHERE missed) AS missed_count
  FROM {source} GROUP BY course_id),
t AS (
  SELECT *, CASE WHEN completed_weight > 0 THEN num / completed_weight END AS calculated,
         greatest(0, known - completed_weight) AS remaining_weight FROM s)"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"""WITH {ASSESSMENTS}, {STANDING.format(source="a")}
SELECT course_id, round(calculated, 6) AS calculated_percent, round(completed_weight, 6) AS completed_weight,
       round(remaining_weight, 6) AS remaining_weight, graded_count, ungraded_count, missed_count FROM t""")
def weighted_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grades.standing(assessments(spark, sf_dir)), "calculated_percent", "completed_weight", "remaining_weight")


@query(f"""WITH {ASSESSMENTS}, {STANDING.format(source="a")}
SELECT course_id,
       round(CASE WHEN remaining_weight > 0 THEN (80 * (completed_weight + remaining_weight) - coalesce(calculated, 0) * completed_weight) / remaining_weight END, 5) + 0.0 AS required_average,
       round((80 * (completed_weight + 40.0) - coalesce(calculated, 0) * completed_weight) / 40.0, 5) AS required_final,
       round(CASE WHEN completed_weight + remaining_weight > 0 THEN (coalesce(calculated, 0) * completed_weight + 100 * remaining_weight) / (completed_weight + remaining_weight) END, 5) AS maximum_possible
FROM t""")
def required_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = grades.standing(assessments(spark, sf_dir))
    c = [F.col(x) for x in ("calculated_percent", "completed_weight", "remaining_weight")]
    return s.select(
        "course_id",
        F.round(grades.required_average(80.0, *c), 5).alias("required_average"),
        F.round(grades.required_final(80.0, F.lit(40.0), c[0], c[1]), 5).alias("required_final"),
        F.round(grades.maximum_possible(*c), 5).alias("maximum_possible"),
    )


@query(f"""WITH {ASSESSMENTS},
r AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY percent DESC NULLS LAST, ord) AS rank,
        count(percent) OVER (PARTITION BY course_id) AS scored,
        count(*) FILTER (WHERE percent IS NULL AND NOT missed) OVER (PARTITION BY course_id) AS still_open,
        count(*) FILTER (WHERE percent IS NULL AND missed) OVER (PARTITION BY course_id) AS lost FROM a)
SELECT course_id, id,
  CASE WHEN scored = 0 THEN 'none'
       WHEN percent IS NOT NULL AND rank > 3 THEN CASE WHEN still_open > 0 THEN 'projection' WHEN scored + lost < 5 THEN 'provisional' ELSE 'official' END
       WHEN percent IS NULL AND missed THEN 'pending' ELSE 'none' END AS drop_state FROM r""")
def best_n_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grades.best_n(assessments(spark, sf_dir), 3, 5, ["course_id"]).select("course_id", "id", F.col("drop").alias("drop_state"))


@query(f"""WITH {ASSESSMENTS},
r AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY percent ASC NULLS LAST, ord) AS rank,
        count(*) FILTER (WHERE percent IS NULL AND NOT missed) OVER (PARTITION BY course_id) AS still_open FROM a)
SELECT course_id, id, CASE WHEN percent IS NOT NULL AND rank <= 1 THEN CASE WHEN still_open > 0 THEN 'provisional' ELSE 'official' END ELSE 'none' END AS drop_state FROM r""")
def drop_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grades.drop_lowest(assessments(spark, sf_dir), 1, ["course_id"]).select("course_id", "id", F.col("drop").alias("drop_state"))


@query(f"""WITH {ASSESSMENTS}, {STANDING.format(source="a")},
f AS (SELECT course_id, kind, first(percent ORDER BY ord) AS percent FROM a GROUP BY course_id, kind),
g AS (SELECT t.course_id, t.calculated, m.percent AS mid, e.percent AS fin,
             first.percent AS quiz FROM t
      LEFT JOIN f m ON m.course_id = t.course_id AND m.kind = 'midterm' LEFT JOIN f e ON e.course_id = t.course_id AND e.kind = 'final'
      LEFT JOIN (SELECT course_id, first(percent ORDER BY ord) AS percent FROM a WHERE kind = 'quiz' AND percent IS NOT NULL GROUP BY course_id) first ON first.course_id = t.course_id),
h AS (SELECT *, CASE WHEN quiz < 95 THEN 88.0 END AS cap1,
        CASE WHEN mid IS NOT NULL AND fin IS NOT NULL AND mid / 100 * 25 + fin / 100 * 35 < 57 THEN CASE WHEN calculated > 45 THEN 45.0 ELSE coalesce(calculated, 45.0) END END AS cap2 FROM g)
SELECT course_id, CASE WHEN cap2 IS NOT NULL THEN 2 WHEN cap1 IS NOT NULL THEN 1 END AS cap_rule, round(coalesce(cap2, cap1), 6) AS cap,
       round(CASE WHEN calculated > coalesce(cap2, cap1) THEN coalesce(cap2, cap1) ELSE calculated END, 6) AS final_percent FROM h""")
def grade_caps_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quiz threshold, then a combined threshold of midterm and final; the last cap set holds."""
    rows = assessments(spark, sf_dir)
    s = grades.standing(rows).select("course_id", "calculated_percent")
    quiz = rows.filter("kind = 'quiz' AND percent IS NOT NULL").groupBy("course_id").agg(F.min_by("percent", "ord").alias("p"))
    one = quiz.select("course_id", F.lit(1).alias("rule_ord"), F.when(F.col("p") < 95, 88.0).alias("cap"))
    parts = spark.createDataFrame([("both", 0, "midterm", 25.0, 60.0, 57.0), ("both", 1, "final", 35.0, 60.0, 57.0)], "rule_id string, component int, kind string, component_weight double, available double, required double")
    failed = grades.combined_threshold(rows, parts).filter("NOT met").join(s, "course_id")
    two = failed.select("course_id", F.lit(2).alias("rule_ord"), F.coalesce(grades.capped(F.col("calculated_percent"), F.lit(45.0)), F.lit(45.0)).alias("cap"))
    out = s.join(grades.last_cap(one.unionByName(two)), "course_id", "left")
    return out.select("course_id", "cap_rule", F.round("cap", 6).alias("cap"), F.round(grades.capped(F.col("calculated_percent"), F.col("cap")), 6).alias("final_percent"))


@query(f"""WITH {ASSESSMENTS.replace("a AS (", "a0 AS (", 1)},
a AS (SELECT course_id, weight, CASE WHEN l_tax >= 0.06 THEN 100.0 ELSE percent END AS percent, missed AND l_tax < 0.06 AS missed, dropped FROM a0), {STANDING.format(source="a")}
SELECT course_id, round(calculated, 6) AS calculated_percent, round(completed_weight, 6) AS completed_weight, round(remaining_weight, 6) AS remaining_weight,
       graded_count, ungraded_count, missed_count FROM t""")
def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing if every line of the two highest tax rates had full marks."""
    rows = assessments(spark, sf_dir)
    wish = rows.filter("l_tax >= 0.06").select("id", F.lit(0).alias("ord"), F.lit(100.0).alias("percent"), F.lit(False).alias("missed"), F.lit(None).cast("boolean").alias("dropped"))
    return _rounded(grades.standing(grades.what_if(rows, wish)), "calculated_percent", "completed_weight", "remaining_weight")


RULES = f"""{ASSESSMENTS},
i AS (SELECT *, kind || ' ' || (ord // 10000000000) AS title, l_tax >= 0.08 AS bonus FROM a),
cat AS (SELECT DISTINCT course_id, 'quiz' AS name, 1 AS drop_lowest, NULL AS best_n, 0 AS ord FROM i WHERE course_id % 4 = 0 UNION ALL SELECT DISTINCT course_id, 'Assignment', 0, 1, 1 FROM i WHERE course_id % 4 <> 2),
member AS (SELECT i.*, 'cat:' || cat.name AS pool, 0 AS first, cat.ord AS o2, 0 AS o3, 'lowest' AS mode, drop_lowest AS n, NULL AS expected FROM i JOIN cat ON cat.course_id = i.course_id AND contains(lower(title), lower(cat.name)) WHERE drop_lowest > 0
  UNION ALL SELECT i.*, 'cat:' || cat.name, 0, cat.ord, 1, 'best', best_n, NULL FROM i JOIN cat ON cat.course_id = i.course_id AND contains(lower(title), lower(cat.name)) WHERE best_n > 0
  UNION ALL SELECT *, 'best', 1, 1, 0, 'best', 2, 3 FROM i WHERE course_id % 2 = 0 UNION ALL SELECT *, 'low', 1, 2, 0, 'lowest', 1, NULL FROM i WHERE course_id % 3 = 0 AND kind = 'final'
  UNION ALL SELECT *, 'tool', 1, 6, 0, 'best', 1, 1 FROM i WHERE course_id % 13 = 0 AND kind IN ('quiz', 'midterm')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY course_id, pool, mode ORDER BY percent DESC NULLS LAST, ord) AS high, row_number() OVER (PARTITION BY course_id, pool, mode ORDER BY percent ASC NULLS LAST, ord) AS low,
  count(*) FILTER (WHERE percent IS NULL AND NOT missed) OVER (PARTITION BY course_id, pool, mode) AS still_open, count(percent) OVER (PARTITION BY course_id, pool, mode) AS scored,
  count(*) FILTER (WHERE percent IS NULL AND missed) OVER (PARTITION BY course_id, pool, mode) AS lost, count(*) OVER (PARTITION BY course_id, pool, mode) AS size FROM member {{only}}),
outcome AS (SELECT *, CASE WHEN percent IS NULL THEN NULL WHEN mode = 'best' AND high > n THEN CASE WHEN still_open > 0 THEN 'projection' WHEN scored + lost < coalesce(expected, size) THEN 'provisional' ELSE 'official' END
  WHEN mode = 'lowest' AND low <= n THEN CASE WHEN still_open > 0 THEN 'provisional' ELSE 'official' END END AS o FROM ranked),
d AS (SELECT course_id, id, bool_or(coalesce(o = 'official', false)) AS official, bool_or(coalesce(o <> 'official', false)) AS provisional, arg_max(o, (first, o2, o3)) FILTER (WHERE o IS NOT NULL) AS certainty,
  bool_or(mode = 'best' AND scored > 0 AND percent IS NULL AND missed) AS pending FROM outcome GROUP BY 1, 2)"""


def ruled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, categories and rules of the courses: which rules a course has goes by its key."""
    none = F.lit(None).cast("string")
    items = assessments(spark, sf_dir).withColumnRenamed("kind", "type")
    items = items.withColumns({"title": F.concat_ws(" ", "type", F.floor(F.col("ord") / 10000000000).cast("string")), "category_id": none, "bonus": F.col("l_tax") >= 0.08})
    courses = items.select("course_id").distinct()
    k = F.col("course_id")
    category = lambda when, name, drop, best, at: F.when(when, F.struct(F.lit(name).alias("category_id"), F.lit(at).alias("ord"), F.lit(name).alias("name"), F.lit(drop).cast("int").alias("drop_lowest"), F.lit(best).cast("int").alias("best_n")))
    categories = courses.select("course_id", F.inline(F.array_compact(F.array(category(k % 4 == 0, "quiz", 1, None, 0), category(k % 4 != 2, "Assignment", 0, 1, 1)))))
    part = "array<struct<types:array<string>,title_pattern:string,weight:double>>"

    def rule(when, at, name, kind, n=None, of=None, types=(), threshold=None, cap=None, components=None, required=None, available=None):
        values = {"rule_id": (name, "string"), "ord": (at, "int"), "kind": (kind, "string"), "n": (n, "int"), "of": (of, "int")}
        fields = [F.lit(v).cast(t).alias(c) for c, (v, t) in values.items()] + [F.array(*map(F.lit, types)).cast("array<string>").alias("types"), none.alias("category")]
        fields += [F.lit(v).cast("double").alias(c) for c, v in (("threshold", threshold), ("cap", cap), ("required", required), ("available", available))]
        made = F.lit(None).cast(part) if components is None else F.array(*(F.struct(F.array(F.lit(t)).alias("types"), F.lit(p).cast("string").alias("title_pattern"), F.lit(w).alias("weight")) for t, p, w in components))
        return F.when(when, F.struct(*fields, made.alias("components")))

    listed = [
        rule(k % 2 == 0, 1, "best", "BestN", 2, 3),
        rule(k % 3 == 0, 2, "low", "DropLowest", 1, types=("final",)),
        rule(k % 5 == 0, 3, "quiz", "Threshold", types=("quiz",), threshold=95, cap=88),
        rule(k % 7 == 0, 4, "both", "CombinedComponentThreshold", cap=45, components=[("midterm", None, 25.0), ("final", r"FINAL\s\S", 35.0)], required=57, available=60),
        rule(k % 11 == 0, 5, "cap", "GradeCap", cap=90),
        rule(k % 13 == 0, 6, "tool", "ExternalActivity", 1, 1, types=("quiz", "midterm")),
        rule(k % 2 == 1, 7, "pass", "MinimumComponentPass", threshold=99, cap=1),
    ]
    return items, categories, courses.select("course_id", F.inline(F.array_compact(F.array(*listed))))


@query(f"""WITH {RULES.format(only="")} SELECT i.course_id, i.id, coalesce(official, false) AS official, coalesce(provisional, false) AS provisional, coalesce(certainty, 'none') AS certainty, coalesce(pending, false) AS pending FROM i LEFT JOIN d USING (course_id, id)""")
def grade_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What categories and rules, in their order, drop from each course."""
    return rules.drops(*ruled(spark, sf_dir))


@query(f"""WITH {RULES.format(only="WHERE NOT bonus")}, m AS (SELECT * FROM i WHERE NOT bonus),
r AS (SELECT m.*, coalesce(official, false) OR dropped AS gone FROM m LEFT JOIN d USING (course_id, id)),
s AS (SELECT course_id, sum(percent * weight) FILTER (WHERE percent IS NOT NULL AND NOT missed AND NOT dropped) / nullif(sum(weight) FILTER (WHERE percent IS NOT NULL AND NOT missed AND NOT dropped), 0) AS raw,
  sum(percent * weight) FILTER (WHERE percent IS NOT NULL AND NOT missed AND NOT gone) AS num, coalesce(sum(weight) FILTER (WHERE percent IS NOT NULL AND NOT missed AND NOT gone), 0) AS completed_weight,
  coalesce(sum(weight) FILTER (WHERE NOT gone), 0) AS known, count(percent) AS graded_count, count(*) FILTER (WHERE percent IS NULL AND NOT missed) AS ungraded_count, count(*) FILTER (WHERE missed) AS missed_count FROM r GROUP BY 1),
p AS (SELECT course_id, kind, first(percent ORDER BY ord) AS p, first(percent ORDER BY ord) FILTER (WHERE percent IS NOT NULL) AS graded FROM m GROUP BY 1, 2),
c AS (SELECT course_id, 3 AS o, 'quiz' AS cap_rule, 88.0 AS c, false AS combined FROM p WHERE course_id % 5 = 0 AND kind = 'quiz' AND graded < 95
  UNION ALL SELECT x.course_id, 4, 'both', 45.0, true FROM p x JOIN p y ON x.course_id = y.course_id AND x.kind = 'midterm' AND y.kind = 'final' WHERE x.course_id % 7 = 0 AND x.p / 100 * 25 + y.p / 100 * 35 < 57
  UNION ALL SELECT course_id, 5, 'cap', 90.0, false FROM s WHERE course_id % 11 = 0),
l AS (SELECT course_id, arg_max(cap_rule, o) AS cap_rule, arg_max(c, o) AS c, arg_max(combined, o) AS combined FROM c GROUP BY 1),
t AS (SELECT s.*, cap_rule, c, combined, num / nullif(completed_weight, 0) AS one, CASE WHEN combined AND raw IS NOT NULL THEN least(raw, c) ELSE c END AS cap1 FROM s LEFT JOIN l USING (course_id)),
u AS (SELECT *, CASE WHEN one > cap1 THEN cap1 ELSE one END AS two FROM t),
v AS (SELECT *, CASE WHEN two IS NULL THEN cap1 WHEN combined THEN least(two, c) ELSE c END AS cap FROM u)
SELECT course_id, round(CASE WHEN two > cap THEN cap ELSE two END, 6) AS calculated_percent, round(completed_weight, 6) AS completed_weight, round(greatest(0, known - completed_weight), 6) AS remaining_weight, graded_count, ungraded_count, missed_count, round(cap, 6) AS cap, cap_rule FROM v""")
def course_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each course's standing under its categories and rules, with the second pass of caps."""
    return _rounded(rules.summary(*ruled(spark, sf_dir)), "calculated_percent", "completed_weight", "remaining_weight", "cap")
