"""Queries on materials: parts as items, a thousand keys of a brand as a course, rows of lineitem as files and content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linking, materials
from .registry import query, table

#: The tables in plain terms.
GIVEN = """it AS (SELECT p_partkey AS item_id, p_brand || '-' || p_partkey // 1000 AS course_id, p_name AS key, p_size FROM part),
li AS (SELECT course_id, l_partkey, key, l_orderkey AS ord, l_quantity, l_tax, l_returnflag, l_linestatus || ' ' || key || ' ' || l_linenumber AS title,
  CASE l_suppkey % 4 WHEN 0 THEN 'grading_rubric' WHEN 1 THEN 'exam_information' WHEN 2 THEN 'lab_notes' ELSE 'lab_handout' END AS kind FROM lineitem JOIN it ON l_partkey = item_id),
lib AS (SELECT course_id, CASE WHEN l_tax > 0.07 THEN l_partkey END AS item_id, kind, replace(key, ' ', '') || '.pdf' AS name, ord FROM li WHERE l_returnflag = 'R'),
con AS (SELECT course_id, CASE WHEN l_quantity < 3 THEN l_partkey END AS item_id, kind, title AS name, ord FROM li),
named AS (SELECT course_id, kind, name, min(ord) AS ord FROM lib WHERE kind IN ('grading_rubric', 'lab_handout') GROUP BY ALL),
told AS (SELECT course_id, kind, name, min(ord) AS ord FROM con WHERE kind <> 'lab_notes' GROUP BY ALL),
lin AS (SELECT course_id, lower(split_part(key, ' ', 1)) AS word, min(item_id) AS ord, arg_min('see ' || key, item_id) AS snippet FROM it WHERE p_size = 1 GROUP BY ALL)"""


@query(f"""WITH {GIVEN}, e AS (
  SELECT item_id, 0 AS s, ord, replace(kind, '_', ' ') || ': ' || name AS text FROM lib WHERE item_id IS NOT NULL
  UNION ALL SELECT it.item_id, 0, n.ord, replace(kind, '_', ' ') || ': ' || name FROM it JOIN named n ON n.course_id = it.course_id AND contains(n.name, replace(left(it.key, 12), ' ', ''))
  UNION ALL SELECT item_id, 1, ord, replace(kind, '_', ' ') || ': ' || name FROM con WHERE item_id IS NOT NULL
  UNION ALL SELECT it.item_id, 1, t.ord, replace(kind, '_', ' ') || ': ' || name FROM it JOIN told t ON t.course_id = it.course_id AND contains(lower(t.name), split_part(it.key, ' ', 1)) AND contains(lower(t.name), split_part(it.key, ' ', 2))
  UNION ALL SELECT item_id, 2, item_id, 'has spec: ' || CASE WHEN p_size % 2 = 0 THEN 'spec ' || p_size ELSE 'doc' || p_size END FROM it WHERE p_size % 5 = 0
  UNION ALL SELECT it.item_id, 3, f.ord, 'outline: ' || f.snippet FROM it JOIN (SELECT it.item_id, min(lin.ord) AS ord, arg_min(snippet, lin.ord) AS snippet FROM it JOIN lin ON lin.course_id = it.course_id AND contains(it.key, lin.word) GROUP BY 1) f ON f.item_id = it.item_id),
d AS (SELECT item_id, text, min((s, ord)) AS first FROM e GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY first, text) AS place FROM d)
SELECT item_id, place, text FROM r WHERE place <= 3""")
def linked_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three materials of every part."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    items = p.select(k.alias("item_id"), F.concat_ws("-", "p_brand", F.floor(k / 1000).cast("string")).alias("course_id"), F.col("p_name").alias("title"), "p_size")
    s = F.col("l_suppkey") % 4
    kind = F.when(s == 0, "grading_rubric").when(s == 1, "exam_information").when(s == 2, "lab_notes").otherwise("lab_handout")
    li = table(spark, sf_dir, "lineitem").join(linking.shuffled(items.withColumnRenamed("item_id", "l_partkey")), "l_partkey").withColumns({"document_class": kind, "ord": F.col("l_orderkey")})
    library = li.filter("l_returnflag = 'R'").select("course_id", F.when(F.col("l_tax") > 0.07, F.col("l_partkey")).alias("item_id"), "document_class", F.concat(F.replace("title", F.lit(" "), F.lit("")), F.lit(".pdf")).alias("filename"), "ord")
    content = li.select(F.col("l_orderkey").alias("content_id"), "course_id", F.when(F.col("l_quantity") < 3, F.col("l_partkey")).alias("item_id"), "document_class", F.concat_ws(" ", "l_linestatus", "title", F.col("l_linenumber").cast("string")).alias("title"), "ord")
    size = F.col("p_size").cast("string")
    links = items.filter("p_size % 5 = 0").select(F.concat(F.lit("doc"), size).alias("to_id"), F.col("item_id").cast("string").alias("from_id"), F.lit("HAS_SPEC").alias("kind"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("spec "), size)).alias("label"), F.col("item_id").alias("ord"))
    outline = items.filter("p_size = 1").select("course_id", F.split_part("title", F.lit(" "), F.lit(1)).alias("title"), F.concat(F.lit("see "), "title").alias("snippet"), F.col("item_id").alias("ord"))
    return materials.linked(items, library, content, links, outline)


@query("""WITH e AS (SELECT DISTINCT o_custkey AS course_id, CASE o_orderkey % 3 WHEN 0 THEN 'lecture' WHEN 1 THEN 'lab' ELSE 'week' END AS kind, o_orderkey % 7 AS label, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 + 1 END AS week FROM orders),
w AS (SELECT DISTINCT course_id, week, 'schedule:week:' || course_id || ':' || coalesce(week::VARCHAR, 'L' || label) AS id FROM e WHERE kind = 'week' OR week IS NOT NULL),
x AS (SELECT *, 'schedule:' || kind || ':' || course_id || ':L' || label AS id FROM e WHERE kind <> 'week'),
m AS (SELECT c_custkey AS course_id, CASE WHEN c_custkey % 2 = 0 THEN 'item ' || c_custkey ELSE 'schedule:midterm:' || c_custkey || ':Midterm' END AS id FROM customer)
SELECT w.id AS from_id, x.id AS to_id, 'CONTAINS' AS kind, 0.7::DOUBLE AS confidence FROM w JOIN x ON w.course_id = x.course_id AND (w.week IS NULL OR x.week IS NULL OR w.week = x.week)
UNION SELECT a.id, b.id, 'ASSOCIATED_WITH', 0.55::DOUBLE FROM x a JOIN x b ON a.course_id = b.course_id AND a.kind = 'lecture' AND b.kind = 'lab' AND a.week IS NOT NULL AND (b.week IS NULL OR a.week = b.week)
UNION SELECT x.id, m.id, CASE kind WHEN 'lab' THEN 'PREPARES_FOR' ELSE 'INTRODUCED_DURING' END, CASE kind WHEN 'lab' THEN 0.55::DOUBLE ELSE 0.5::DOUBLE END FROM x JOIN m ON x.course_id = m.course_id""")
def schedule_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as weeks, lectures and labs of a customer's schedule, every other customer with an item that is a midterm."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    kind = F.when(k % 3 == 0, "lecture").when(k % 3 == 1, "lab").otherwise("week")
    entities = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("course_id"), kind.alias("kind"), F.concat(F.lit("L"), (k % 7).cast("string")).alias("label"), F.when(k % 5 > 0, k % 4 + 1).alias("week"))
    customers = table(spark, sf_dir, "customer")
    mids = customers.select(c.alias("course_id"), F.lit("Midterm").alias("title"))
    items = customers.filter(c % 2 == 0).select(c.alias("course_id"), F.when(c % 4 == 0, "MIDTERM").otherwise("Second midterm exam").alias("title"), F.lit(0).alias("ord"), F.concat(F.lit("item "), c.cast("string")).alias("item_id"))
    return materials.schedule_links(entities, mids, items)
