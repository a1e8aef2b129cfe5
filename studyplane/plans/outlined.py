"""Queries on outline texts: an order as an outline, a row of lineitem as a row of its evaluation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outline_rows
from .registry import query, table

#: The rows of lineitem in their order's outline, in plain terms: a returned one is wrapped over two lines.
LISTED = """o AS (SELECT l_orderkey AS doc_id, row_number() OVER w - 1 AS k, 'Quiz ' || l_partkey AS title, l_quantity::INT AS weight, l_suppkey % 28 + 1 AS day, l_returnflag = 'R' AS wrapped, l_linestatus AS status FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
r AS (SELECT *, k + coalesce(sum(wrapped::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM o)"""


def outlines(spark: SparkSession, sf_dir: str, row: Column, before: str, after: str) -> DataFrame:
    """doc_id and text: a row's lines, between what stands before and after them. Rows are dealt by their order first: those of one order lie
    far apart, so that gathering them before would sort all of them and gather none."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    dealt = table(spark, sf_dir, "lineitem").repartition("l_orderkey").select(F.col("l_orderkey").alias("doc_id"), F.struct(*order, row.alias("row")).alias("row"))
    listed = dealt.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("row"))["row"], "\n").alias("rows"))
    return listed.select("doc_id", F.concat(F.lit(before), "rows", F.lit(after)).alias("text"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def with_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines whose evaluation table has three columns; the rest of a returned one's title stands below it."""
    row = _text("Quiz ", F.col("l_partkey"), "   ", F.col("l_quantity").cast("int"), "%   Oct ", F.col("l_suppkey") % 28 + 1, F.when(F.col("l_returnflag") == "R", F.concat(F.lit("\nby "), "l_linestatus")).otherwise(""))
    return outlines(spark, sf_dir, row, "Some course\nMethods of Evaluation\nAssessment   Weight   Due\n", "\nTotal   100%\nLate Policy\nnone")


@query(f"""WITH {LISTED} SELECT doc_id, 3 + pos AS place, title || CASE WHEN wrapped THEN ' by ' || status ELSE '' END AS title, 'quiz' AS type, weight::DOUBLE AS weight, 'Oct ' || day AS due_label, make_date(2026, 10, day::INT) AS due, 'exact' AS certainty, 0.85::DOUBLE AS confidence,
title || '   ' || weight || '%   Oct ' || day || CASE WHEN wrapped THEN ' by ' || status ELSE '' END AS snippet FROM r""")
def outline_table_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each outline's evaluation table."""
    return outline_rows.table_items(outline_rows.table_rows(outline_rows.listed(with_table(spark, sf_dir))), 2026)


@query(f"""WITH {LISTED} SELECT doc_id, 1 + pos AS place, title, 'quiz' AS type, weight::DOUBLE AS weight, 'Oct ' || day AS due_label, make_date(2026, 10, day::INT) AS due, 'exact' AS certainty, 0.75::DOUBLE AS confidence,
title || CASE WHEN wrapped THEN '  ' ELSE ': ' END || weight || '% Oct ' || day AS snippet FROM r""")
def outline_weight_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items line by line, where a returned one's weight stands on the line below its title."""
    row = _text("Quiz ", F.col("l_partkey"), F.when(F.col("l_returnflag") == "R", "\n").otherwise(": "), F.col("l_quantity").cast("int"), "% Oct ", F.col("l_suppkey") % 28 + 1)
    return outline_rows.weight_lines(outline_rows.listed(outlines(spark, sf_dir, row, "Grading\n", "\nTotal: 100%")), 2026)


@query(f"""WITH {LISTED}, t AS (SELECT doc_id, string_agg(title || '   ' || weight || '%   Oct ' || day || CASE WHEN wrapped THEN chr(10) || 'by ' || status ELSE '' END, chr(10) ORDER BY k) AS listed FROM r GROUP BY doc_id)
SELECT doc_id, 'evaluation' AS section, md5('Assessment   Weight   Due' || chr(10) || listed || chr(10) || 'Total   100%') AS body_md5 FROM t UNION ALL SELECT doc_id, 'late', md5('Policy' || chr(10) || 'none') FROM t""")
def outline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sections of each outline: one up to the next heading, one whose heading goes on behind its first word."""
    found = outline_rows.section_bodies(outline_rows.listed(with_table(spark, sf_dir)), {"evaluation": ("Methods of Evaluation", "Evaluation"), "late": ("Late",), "none here": ("Textbook",)})
    return found.select("doc_id", "section", F.md5("body").alias("body_md5"))
