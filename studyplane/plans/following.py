"""Queries on progress: submissions, attempts, revisions and triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import progress
from .planning import ITEMS, items
from .registry import query, table


@query("""WITH r AS (SELECT l_orderkey AS item_id, max(CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS last FROM lineitem WHERE l_orderkey % 6 <> 0 GROUP BY 1)
SELECT o_orderkey AS item_id, CASE WHEN r.item_id IS NULL THEN o_orderstatus WHEN last IS NOT NULL THEN 'submitted' ELSE 'not_submitted' END AS submission,
  strftime(CASE WHEN r.item_id IS NULL THEN o_orderdate ELSE last END, '%Y-%m-%d') AS submitted_at FROM orders LEFT JOIN r ON r.item_id = o_orderkey""")
def submission_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items, their returned lines as submissions; the list of every sixth order wasn't read."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderstatus").alias("submission"), F.col("o_orderdate").cast("timestamp").alias("submitted_at"))
    li = table(spark, sf_dir, "lineitem").filter("l_orderkey % 6 <> 0")
    read = li.select(F.col("l_orderkey").alias("item_id"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate").cast("timestamp")).alias("date"))
    return progress.with_submissions(o, read).withColumn("submitted_at", F.date_format("submitted_at", "yyyy-MM-dd"))


@query("""SELECT user_id AS quiz_id, arg_max(event_id % 5, event_id) AS attempt, strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS submitted_at FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1""")
def quiz_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("event_type").isin("purchase", "click")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("quiz_id"), (F.col("event_id") % 5).alias("number"), F.when(done, F.col("ts").cast("timestamp")).alias("completed_at"), F.col("event_id").alias("ord"))
    return progress.last_attempts(e).withColumn("submitted_at", F.date_format("submitted_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {ITEMS} SELECT course_id, kind AS type, count(*) FILTER (WHERE submission = 'submitted' OR graded OR missed) AS done, count(*) AS total FROM h WHERE kind <> 'discussion' GROUP BY 1, 2""")
def course_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.progress(items(spark, sf_dir), (F.col("submission") == "submitted") | F.col("graded") | F.col("missed"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS content, md5(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS meaning FROM d),
p AS (SELECT doc_id, md5(text) AS content, md5(text) AS meaning FROM d WHERE doc_id % 7 <> 0),
k AS (SELECT c.doc_id AS document_id, CASE WHEN p.doc_id IS NULL THEN 'initial' WHEN c.meaning <> p.meaning THEN 'semantic' WHEN c.content = p.content THEN 'reparse' ELSE 'metadata_only' END AS change_kind FROM c LEFT JOIN p USING (doc_id))
SELECT *, change_kind IN ('initial', 'semantic') AS rebuild FROM k""")
def document_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against their previous revision, in which some had other content and some another meaning."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = lambda n, mark: F.md5(F.when(F.col("document_id") % n == 0, F.concat("text", F.lit(mark))).otherwise(F.col("text")))
    now = d.select("document_id", marked(3, "!").alias("content_hash"), marked(5, ".").alias("semantic_hash"))
    before = d.filter("document_id % 7 <> 0").select("document_id", F.md5("text").alias("content_hash"), F.md5("text").alias("semantic_hash"))
    return progress.revisions(now, before)


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'deadline_changed' WHEN 'purchase' THEN 'grade_posted' ELSE 'note' END AS kind FROM events
WHERE event_type IN ('error', 'purchase') AND (event_id % 3 = 0 OR ts >= TIMESTAMP '2024-01-20')""")
def replan_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "deadline_changed").when(F.col("event_type") == "purchase", "grade_posted").otherwise("note")
    e = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), (F.col("event_id") % 3 != 0).alias("read"), F.col("ts").cast("timestamp").alias("created_at"))
    return progress.replan_triggers(e, F.lit("2024-01-20").cast("timestamp")).select("event_id", "kind")
