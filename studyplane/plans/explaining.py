"""Queries on why an item matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gaps
from ..operators import reasons as why
from .planning import ITEMS, items
from .registry import query, table

#: Rules and categories of customers as courses, and the items with titles and categories.
COURSES = """t AS (SELECT *, kind || ' ' || (id % 10) AS title, CASE WHEN id % 4 <> 0 THEN id % 3 END AS category_id FROM h),
r AS (SELECT c_custkey AS course_id, 1 AS ord, 'BestN' AS kind, 4 AS n, 6 AS "of", ['quiz'] AS types, NULL AS category FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 2, 'DropLowest', 1, NULL, [], 'Lab' FROM customer WHERE c_custkey % 3 <> 1),
g AS (SELECT c_custkey AS course_id, k AS category_id, k AS ord, 'Group ' || k AS name, CASE WHEN k = 1 THEN 5 END AS best_n, CASE WHEN k = 2 THEN 2 ELSE 0 END AS drop_lowest FROM customer, range(3) x(k) WHERE c_custkey % 4 = 0),
a AS (SELECT t.id, arg_min({'kind': r.kind, 'n': r.n, 'of': r."of", 'category': r.category}, r.ord) FILTER (WHERE (len(types) = 0 OR list_contains(types, t.kind)) AND (r.category IS NULL OR contains(lower(t.title || ' ' || coalesce(g.name, '')), lower(r.category)))) AS by_rule FROM t LEFT JOIN g USING (course_id, category_id) JOIN r ON r.course_id = t.course_id GROUP BY 1),
b AS (SELECT t.id, arg_min({'kind': CASE WHEN best_n IS NOT NULL THEN 'BestN' ELSE 'DropLowest' END, 'n': coalesce(best_n, drop_lowest)::INT, 'of': NULL::INT, 'category': name}, ord) AS by_group FROM t JOIN g ON g.course_id = t.course_id AND (t.category_id IS NULL OR t.category_id = g.category_id) WHERE best_n IS NOT NULL OR drop_lowest > 0 GROUP BY 1),
s AS (SELECT t.id, coalesce(by_rule.kind, by_group.kind) AS akind, CASE WHEN by_rule IS NOT NULL THEN by_rule.n ELSE by_group.n END AS n, CASE WHEN by_rule IS NOT NULL THEN by_rule."of" END AS n_of, CASE WHEN by_rule IS NOT NULL THEN by_rule.category ELSE by_group.category END AS category FROM t LEFT JOIN a USING (id) LEFT JOIN b USING (id))"""


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    return items(spark, sf_dir).withColumns({"title": F.concat_ws(" ", "kind", (k % 10).cast("string")), "type": F.col("kind"), "category_id": F.when(k % 4 != 0, k % 3)})


def _absorbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("course_id"))
    none = F.lit(None)
    rule = lambda ord_, kind, n, of, types, category: [F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), F.lit(n).alias("n"), F.lit(of).cast("int").alias("of"), types.cast("array<string>").alias("types"), F.lit(category).cast("string").alias("category")]
    rules = c.filter("course_id % 3 = 0").select("course_id", *rule(1, "BestN", 4, 6, F.array(F.lit("quiz")), None)).unionByName(c.filter("course_id % 3 <> 1").select("course_id", *rule(2, "DropLowest", 1, None, F.array(), "Lab")))
    groups = c.filter("course_id % 4 = 0").select("course_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    groups = groups.select("course_id", F.col("k").cast("long").alias("category_id"), F.col("k").alias("ord"), F.concat_ws(" ", F.lit("Group"), F.col("k").cast("string")).alias("name"), F.when(F.col("k") == 1, 5).otherwise(none).alias("best_n"), F.when(F.col("k") == 2, 2).otherwise(0).alias("drop_lowest"))
    return why.absorbers(_titled(spark, sf_dir), rules, groups)


@query(f"""WITH {ITEMS}, {COURSES} SELECT id, akind AS kind, n, n_of AS "of", category FROM s WHERE akind IS NOT NULL""")
def absorbing_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that takes up a miss of each item, if there is one."""
    return _absorbers(spark, sf_dir).select("id", "absorber.*")


@query(f"""WITH {ITEMS}, {COURSES}, x AS (SELECT t.*, s.* EXCLUDE (id) FROM t JOIN s USING (id)),
u AS (SELECT id, 1 AS branch, CASE WHEN weight IS NULL AND id % 2 = 0 THEN 'blueprint' ELSE 'weight' END AS code, CASE WHEN weight IS NOT NULL THEN weight::BIGINT || '% of course' WHEN id % 2 = 0 THEN '7.5% (from outline blueprint)' ELSE 'Weight unknown' END AS text FROM x
 UNION ALL SELECT id, 2, CASE submission WHEN 'unknown' THEN 'needs_confirmation' ELSE submission END, CASE submission WHEN 'unknown' THEN 'Submission unknown' WHEN 'submitted' THEN 'Submitted' ELSE 'Not submitted' END FROM x
 UNION ALL SELECT id, 3, CASE WHEN hours < 0 THEN 'overdue' ELSE 'due_soon' END, CASE WHEN hours < 0 AND hours > -24 THEN printf('Overdue by %.0fh', -hours) WHEN hours < 0 THEN printf('Overdue by %.1fd', floor(-hours / 24 * 10 + 0.5) / 10) WHEN hours < 1 THEN 'Due in ' || floor(hours * 60 + 0.5)::INT || ' min'
   WHEN hours <= 24 THEN printf('Due in %.1fh', hours) ELSE printf('Due in %.1fd', floor(hours / 24 * 10 + 0.5) / 10) END FROM x WHERE hours <= 72
 UNION ALL SELECT id, 4, 'relative_deadline', 'Derived due: relative deadline from meeting occurrence' FROM x WHERE id % 20 = 1
 UNION ALL SELECT id, 5, CASE akind WHEN 'BestN' THEN 'best_n' ELSE 'drop_lowest' END, CASE akind WHEN 'BestN' THEN 'Best ' || n || coalesce(' of ' || n_of, '') ELSE 'Drop lowest ' || n END || coalesce(' (' || category || ')', '') || ' may absorb a miss' FROM x WHERE akind IS NOT NULL AND (missed OR (hours < 0 AND is_open) OR kind = 'quiz')
 UNION ALL SELECT id, 6, 'needs_confirmation', 'Needs your confirmation' FROM x WHERE needs_confirmation
 UNION ALL SELECT id, 7, 'lab_tonight', 'Lab meeting tonight' FROM x WHERE kind = 'lab' AND course_id % 7 = 0
 UNION ALL SELECT id, 9, 'grade_rule', CASE course_id % 5 WHEN 0 THEN 'Combined threshold: need 30/60 pts (cap 49.5%)' WHEN 1 THEN 'Minimum 50% in Labs' ELSE 'Grade cap 60% — late' END FROM x WHERE (course_id % 5 = 0 AND (kind IN ('midterm', 'final') OR contains(title, '7'))) OR (course_id % 5 = 1 AND kind <> 'quiz') OR course_id % 5 = 2
 UNION ALL SELECT id, 10, 'dependency', CASE id % 9 WHEN 0 THEN 'Staff clarification: ' || o_orderpriority ELSE 'Linked change: changes deadline of' END FROM x WHERE id % 9 IN (0, 1))
SELECT id, row_number() OVER (PARTITION BY id ORDER BY branch) AS place, code, text FROM u""")
def item_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons of every item in their order."""
    k, course = F.col("id"), F.col("course_id")
    none = F.lit(None)
    rows = _titled(spark, sf_dir).join(_absorbers(spark, sf_dir), "id", "left")
    rows = rows.withColumns({"blueprint_weight": F.when(k % 2 == 0, 7.5), "safety": F.lit("UNKNOWN"), "source": F.when(k % 20 == 1, "rule_engine"), "due_label": none.cast("string"), "lab": F.when(course % 7 == 0, "Lab meeting tonight")})
    part = lambda types, pattern: F.struct(F.array(*map(F.lit, types)).cast("array<string>").alias("types"), F.lit(pattern).cast("string").alias("pattern"))
    kind = F.when(course % 5 == 0, "CombinedComponentThreshold").when(course % 5 == 1, "MinimumComponentPass").when(course % 5 == 2, "GradeCap")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("course_id"))
    rules = c.select("course_id", F.lit(1).alias("ord"), kind.alias("kind"), F.array(part(["midterm", "final"], None), part([], "7")).alias("components"), F.lit(30.0).alias("required"), F.lit(60.0).alias("available"), F.when(course % 5 == 0, 49.5).otherwise(60.0).alias("cap"), F.lit(50.0).alias("minimum"), F.lit("Labs").alias("category"), F.lit("late").alias("condition"))
    links = rows.filter("id % 9 < 3").select("id", F.lit(0).alias("ord"), F.when(k % 9 == 0, "CLARIFIES").when(k % 9 == 1, "CHANGES_DEADLINE_OF").otherwise("CONTAINS").alias("kind"), F.when(k % 9 == 0, F.col("o_orderpriority")).alias("label"))
    return why.in_order(why.reasons(rows), why.rule_reasons(rows, rules), why.link_reasons(links))


GAPS = r"""c AS (SELECT c_custkey AS course_id, c_custkey % 4 <> 0 AS outlined, c_custkey % 7 / 7.0 AS score, c_custkey % 11 = 1 AS incomplete FROM customer),
i AS (SELECT id AS item_id, course_id, kind AS type, kind || ' ' || (id % 4) AS key, weight, certainty <> 'unknown' AS dated, is_open, id % 3 = 0 AS materials FROM h),
n AS (SELECT course_id, k, CASE k WHEN 0 THEN 'Quiz 1' WHEN 1 THEN 'LAB  2' WHEN 2 THEN 'Midterm' WHEN 3 THEN 'Essay ' || (course_id % 3) ELSE 'assignment 3' END AS title, CASE WHEN k <> 1 THEN 4.0 * k END AS weight, CASE k WHEN 0 THEN 'quiz' WHEN 1 THEN 'lab' WHEN 2 THEN 'midterm' WHEN 3 THEN 'other' ELSE 'assignment' END AS type, k = 0 AS dated,
   CASE WHEN k IN (0, 1) THEN 'Labs' ELSE 'Other work' END AS category, regexp_replace(lower(CASE k WHEN 0 THEN 'Quiz 1' WHEN 1 THEN 'LAB  2' WHEN 2 THEN 'Midterm' WHEN 3 THEN 'Essay ' || (course_id % 3) ELSE 'assignment 3' END), '\s+', ' ', 'g') AS key FROM c, range(5) r(k) WHERE outlined),
p AS (SELECT course_id, v.* FROM c, (VALUES ('Labs', 3, 'lab'), ('Quizzes', 6, 'quiz'), ('Discussion board', 2, 'discussion'), ('Other  work', 1, 'other')) v(name, promised, word) WHERE outlined),
q AS (SELECT p.*, (SELECT count(*) FROM i WHERE i.course_id = p.course_id AND (CASE WHEN word IN ('lab', 'quiz') THEN i.type = word ELSE false END OR contains(i.key, word))) AS have,
   greatest(promised, (SELECT count(*) FROM n WHERE n.course_id = p.course_id AND (lower(n.category) = regexp_replace(lower(p.name), '\s+', ' ', 'g') OR (word IN ('lab', 'quiz') AND n.type = word)))) AS expected FROM p),
m AS (SELECT n.course_id, n.k, min(i.item_id) AS item_id FROM n JOIN i ON i.course_id = n.course_id AND (contains(i.key, n.key) OR contains(n.key, i.key)) GROUP BY ALL),
z AS (SELECT n.*, i.item_id, i.weight AS lw, i.type AS lt, i.dated AS ld, i.is_open, i.materials FROM n LEFT JOIN m ON m.course_id = n.course_id AND m.k = n.k LEFT JOIN i ON i.item_id = m.item_id)"""


@query(f"""WITH {ITEMS}, {GAPS} SELECT course_id, 'incomplete_blueprint' AS kind, NULL AS subject, 'warn' AS severity FROM c WHERE NOT outlined AND course_id % 3 <> 0
UNION ALL SELECT course_id, 'quality_incomplete', NULL, CASE WHEN incomplete THEN 'block' ELSE 'warn' END FROM c WHERE outlined AND (incomplete OR score < 0.55)
UNION ALL SELECT course_id, 'section_unresolved', NULL, 'warn' FROM c WHERE outlined AND course_id % 5 = 1 AND course_id % 2 = 0
UNION ALL SELECT course_id, 'promised_count_shortfall', name, CASE WHEN have = 0 THEN 'block' ELSE 'warn' END FROM q WHERE expected >= 2 AND have < least(expected, greatest(1, expected - 1))
UNION ALL SELECT course_id, 'missing_assessment', left(key, 40), CASE WHEN coalesce(weight, 0) >= 5 OR type IN ('midterm', 'final') THEN 'block' ELSE 'warn' END FROM z WHERE item_id IS NULL
UNION ALL SELECT course_id, 'missing_weight', item_id::VARCHAR, 'warn' FROM z WHERE item_id IS NOT NULL AND lw IS NULL AND weight IS NULL
UNION ALL SELECT course_id, 'missing_date', item_id::VARCHAR, 'warn' FROM z WHERE item_id IS NOT NULL AND NOT ld AND NOT dated AND (lt IN ('midterm', 'final') OR coalesce(weight, lw, 0) >= 8)
UNION ALL SELECT course_id, 'missing_material', item_id::VARCHAR, 'warn' FROM z WHERE item_id IS NOT NULL AND is_open AND lt IN ('lab', 'assignment', 'project') AND coalesce(lw, weight, 0) >= 5 AND NOT materials""")
def model_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of customers as courses, of which three in four have an outline of five items in four categories."""
    k = F.col("course_id")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("course_id"))
    courses = c.select("course_id", (k % 4 != 0).alias("outlined"), F.when(k % 3 == 0, "missing").otherwise("parsed").alias("status"), (k % 7 / 7.0).alias("score"), (k % 11 == 1).alias("incomplete"), (k % 5 == 1).alias("section_needed"), (k % 2 != 0).alias("section_known"))
    outlined = courses.filter("outlined").select("course_id")
    essay = F.concat(F.lit("Essay "), (k % 3).cast("string"))
    told = [(F.lit("Quiz 1"), 0.0, "quiz", "Labs"), (F.lit("LAB  2"), None, "lab", "Labs"), (F.lit("Midterm"), 8.0, "midterm", "Other work"), (essay, 12.0, "other", "Other work"), (F.lit("assignment 3"), 16.0, "assignment", "Other work")]
    one = lambda t, w, kind, name: F.struct(t.alias("title"), F.lit(w).cast("double").alias("weight"), F.lit(kind).alias("type"), F.lit(w == 0.0).alias("dated"), F.lit(name).alias("category"))
    instances = outlined.select("course_id", F.inline(F.array(*(one(*x) for x in told))))
    categories = outlined.select("course_id", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(m).alias("promised")) for n, m in (("Labs", 3), ("Quizzes", 6), ("Discussion board", 2), ("Other  work", 1))))))
    i = items(spark, sf_dir)
    live = i.select(F.col("id").alias("item_id"), "course_id", F.col("id").alias("ord"), F.col("kind").alias("type"), F.concat_ws(" ", "kind", (F.col("id") % 4).cast("string")).alias("key"), "weight", (F.col("certainty") != "unknown").alias("dated"), "open", (F.col("id") % 3 == 0).alias("materials"))
    return gaps.course_gaps(courses).unionByName(gaps.count_gaps(categories, instances, live)).unionByName(gaps.instance_gaps(instances, live))
