"""Queries on what was read from outlines: customers as outlines, their orders as instances, three categories each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction
from .registry import query, table

#: The tables in plain terms, and each category's check.
GIVEN = """o AS (SELECT c_custkey AS course_id, CASE WHEN c_custkey % 7 > 0 THEN c_name END AS code, c_custkey % 3 AS teachers, c_custkey % 4 // 2 AS tables, c_custkey % 5 AS schedule, c_custkey % 2 AS policies FROM customer),
k AS (SELECT c_custkey AS course_id, n AS ord, CASE n WHEN 0 THEN 'Quizzes' WHEN 1 THEN 'Labs' ELSE 'Exams' END AS name, CASE WHEN (c_custkey + n) % 4 > 0 THEN (c_custkey + n) % 6 END AS promised, CASE WHEN c_custkey % 3 = n THEN c_custkey % 5 + 1 END AS best_n, CASE WHEN c_custkey % 3 > 0 THEN 20.5 + 10 * n END AS weight FROM customer, range(3) r(n)),
i AS (SELECT o_custkey AS course_id, CASE o_orderkey % 5 WHEN 0 THEN 'QUIZZES' WHEN 1 THEN 'labs' WHEN 2 THEN 'Exams' WHEN 3 THEN '' END AS category, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 40 / 4 END AS weight FROM orders),
f AS (SELECT k.*, (SELECT count(*) FROM i WHERE i.course_id = k.course_id AND lower(i.category) = lower(k.name)) AS found FROM k),
c AS (SELECT course_id, 2 * ord AS ord, 'promised_' || name AS id, found = promised AS ok, 'promised ' || promised || ', found ' || found AS detail, CASE WHEN found <> promised THEN 'Category "' || name || '" promised ' || promised || ' instance(s), found ' || found END AS contradiction FROM f WHERE promised IS NOT NULL
  UNION ALL SELECT course_id, 2 * ord + 1, 'bestn_' || name, coalesce(best_n <= promised, TRUE), CASE WHEN best_n > promised THEN 'bestN exceeds count' ELSE 'best ' || best_n END, CASE WHEN best_n > promised THEN 'bestN ' || best_n || ' > promised ' || promised || ' for ' || name END FROM f WHERE best_n IS NOT NULL),
t AS (SELECT o.*, coalesce((SELECT sum(weight) FROM k WHERE k.course_id = o.course_id), 0)::DOUBLE AS cats, n.* EXCLUDE course_id, coalesce(n.num, 0) AS n_instances,
  coalesce((SELECT count(contradiction) FROM c WHERE c.course_id = o.course_id), 0) AS broken
  FROM o LEFT JOIN (SELECT course_id, count(*) AS num, coalesce(sum(weight), 0)::DOUBLE AS own, coalesce(sum(weight) FILTER (WHERE coalesce(category, '') = ''), 0)::DOUBLE AS loose FROM i GROUP BY 1) n ON n.course_id = o.course_id),
w AS (SELECT *, CASE WHEN cats > 0 THEN cats + coalesce(loose, 0) ELSE coalesce(own, 0) END::DOUBLE AS total_weight FROM t),
g AS (SELECT *, total_weight BETWEEN 95 AND 105 AS weights_ok, broken + CASE WHEN total_weight > 0 AND NOT total_weight BETWEEN 95 AND 105 THEN 1 ELSE 0 END AS contradictions, tables = 0 AND n_instances < 3 AS untabled FROM w),
p AS (SELECT *, 0.2e0 + CASE WHEN code IS NULL THEN 0e0 ELSE 0.1e0 END + CASE WHEN teachers > 0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN n_instances >= 2 THEN 0.15e0 ELSE 0e0 END + CASE WHEN n_instances >= 4 THEN 0.05e0 ELSE 0e0 END
  + CASE WHEN weights_ok THEN 0.2e0 WHEN total_weight > 40 THEN 0.08e0 ELSE 0e0 END + CASE WHEN tables > 0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN schedule > 0 THEN 0.05e0 ELSE 0e0 END + CASE WHEN policies > 0 THEN 0.05e0 ELSE 0e0 END - 0.08e0 * least(3, contradictions) AS raw FROM g)"""


def _outlines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    customers = table(spark, sf_dir, "customer")
    outlines = customers.select(c.alias("course_id"), F.when(c % 7 > 0, F.col("c_name")).alias("course_code"), (c % 3).alias("instructors"), F.floor(c % 4 / 2).alias("tables"), (c % 5).alias("schedule"), (c % 2).alias("policies"))
    n = F.col("ord")
    each = customers.select(c, F.explode(F.array(*map(F.lit, range(3)))).alias("ord"))
    name = F.when(n == 0, "Quizzes").when(n == 1, "Labs").otherwise("Exams")
    categories = each.select(c.alias("course_id"), "ord", name.alias("name"), F.when((c + n) % 4 > 0, (c + n) % 6).alias("promised"), F.when(c % 3 == n, c % 5 + 1).alias("best_n"), F.when(c % 3 > 0, 20.5 + 10 * n).alias("weight"))
    category = F.when(k % 5 == 0, "QUIZZES").when(k % 5 == 1, "labs").when(k % 5 == 2, "Exams").when(k % 5 == 3, "")
    instances = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("course_id"), category.alias("category"), F.when(k % 3 > 0, k % 40 / 4).alias("weight"))
    return outlines, categories, instances


@query(f"""WITH {GIVEN} SELECT course_id, n_instances, total_weight, weights_ok, contradictions, greatest(0e0, least(1e0, raw)) AS score, n_instances < 2 OR untabled OR raw < 0.45e0 AS incomplete,
concat_ws(',', CASE WHEN code IS NULL THEN 'course_code' END, CASE WHEN teachers = 0 THEN 'instructor' END, CASE WHEN n_instances < 2 THEN 'assessments' END, CASE WHEN untabled THEN 'evaluation_table' END, CASE WHEN schedule = 0 THEN 'schedule' END) AS missing FROM p""")
def extraction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.scores(*_outlines(spark, sf_dir))


_SHORT = "regexp_replace(regexp_replace(({})::DECIMAL(18, 6)::VARCHAR, '0+$', ''), '\\.$', '')"


@query(f"""WITH {GIVEN} SELECT course_id, 0 AS place, 'weights_near_100' AS id, weights_ok AS ok, 'weightSum=' || {_SHORT.format('floor(total_weight * 100 + 0.5) / 100')} AS detail, CASE WHEN NOT weights_ok AND total_weight > 0 THEN 'Weights sum to ' || {_SHORT.format('total_weight')} || ', expected ~100' END AS contradiction FROM p
UNION ALL SELECT course_id, ord + 1, id, ok, detail, contradiction FROM c
UNION ALL SELECT course_id, 1099511627776, 'has_assessments', n_instances >= 2, n_instances || ' instance(s)', NULL FROM p
UNION ALL SELECT course_id, 1099511627777, 'has_instructor', teachers > 0, teachers || ' instructor(s)', NULL FROM p""")
def extraction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.checks(*_outlines(spark, sf_dir))
