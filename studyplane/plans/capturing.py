"""Queries on problem codes, captured tasks, corrections and merged lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import capture, problems, rules
from .planning import ITEMS, LOCAL, ZONE, items
from .registry import query, table


@query("""WITH f AS (SELECT o_orderkey AS k, ['none_accessible', 'blocked', 'parse_failed', 'parsed', 'found', 'not_checked'][o_orderkey % 6 + 1] AS s, o_orderkey % 4 <> 0 AS doc, o_orderkey % 3 <> 0 AS parsed, o_orderkey % 5 AS p, o_totalprice % 100 AS t FROM orders)
SELECT k AS course_id, unnest(list_filter([
  CASE WHEN s IN ('none_accessible', 'not_checked') THEN 'error outline_not_found' END, CASE WHEN s = 'blocked' THEN 'error outline_blocked' END, CASE WHEN s = 'parse_failed' OR (s IN ('parsed', 'found') AND k % 17 = 0) THEN 'error outline_parse_failed' END,
  CASE WHEN doc AND parsed AND p = 0 THEN 'error outline_no_assessments' END, CASE WHEN doc AND parsed AND p < 2 THEN 'warn outline_low_confidence' END, CASE WHEN doc AND parsed AND k % 7 = 0 THEN 'warn outline_extraction_incomplete' END,
  CASE WHEN doc AND parsed AND k % 1000 < 400 THEN 'warn outline_text_short' END, CASE WHEN s IN ('parsed', 'found') AND NOT doc THEN 'warn outline_doc_missing' END, CASE WHEN p = 0 THEN 'error no_assessments' END,
  CASE WHEN k % 4 > 0 THEN CASE WHEN k % 4 > p / 2 THEN 'error' ELSE 'warn' END || ' assessments_without_dates' END, CASE WHEN k % 6 = 1 THEN 'info assessments_approximate_dates' END, CASE WHEN k % 9 = 0 AND p > 0 THEN 'warn no_weights' END,
  CASE WHEN k % 9 <> 0 AND t > 2 THEN 'warn weights_not_100' END, CASE WHEN k % 8 = 0 THEN 'warn duplicate_assessments' END, CASE WHEN k % 13 = 0 THEN 'warn unresolved_conflicts' END, CASE WHEN k % 2 = 0 THEN 'warn no_class_times' END,
  CASE WHEN k % 19 = 0 THEN 'warn blocked_endpoints' END, CASE WHEN k % 23 = 0 THEN 'warn failed_endpoints' END, CASE WHEN k % 10 = 9 THEN 'info coverage_gaps' END], lambda x: x IS NOT NULL)) AS problem FROM f""")
def course_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("none_accessible", "blocked", "parse_failed", "parsed", "found", "not_checked"))), (k % 6 + 1).cast("int"))
    one = lambda c: c.cast("int")
    facts = table(spark, sf_dir, "orders").select(
        k.alias("course_id"), status.alias("outline_status"), (k % 4 != 0).alias("has_document"), (k % 17 == 0).alias("parse_failed"), (k % 3 != 0).alias("parsed"), (k % 5).alias("parsed_items"), F.when(k % 5 < 2, 0.4).otherwise(0.9).alias("confidence"),
        (k % 7 == 0).alias("incomplete"), (k % 1000).alias("text_length"), (k % 5).alias("n_items"), (k % 4).alias("n_undated"), one(k % 6 == 1).alias("n_approximate"), F.when(k % 9 == 0, "none").otherwise("assessments").alias("basis"),
        F.when(k % 9 != 0, 100 + F.col("o_totalprice") % 100).alias("total"), one(k % 8 == 0).alias("n_duplicates"), one(k % 13 == 0).alias("n_conflicts"), one(k % 2 != 0).alias("n_meetings"), one(k % 19 == 0).alias("n_blocked"), one(k % 23 == 0).alias("n_failed"), one(k % 10 == 9).alias("n_bad_sources"),
    )
    return problems.course_problems(facts).select("course_id", F.concat_ws(" ", "severity", "code").alias("problem"))


@query("""WITH f AS (SELECT user_id AS student_id, max(ts) FILTER (WHERE event_type <> 'view') AS t, arg_max(event_type, event_id) AS last, count(*) FILTER (WHERE event_type = 'purchase') AS n, count(*) FILTER (WHERE event_type = 'signup') AS s, count(*) FILTER (WHERE event_type = 'click') AS r, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1)
SELECT student_id, unnest(list_filter([CASE WHEN t IS NULL THEN 'never_synced' END, CASE WHEN last = 'signup' THEN 'signed_out' END, CASE WHEN last = 'error' THEN 'sync_error' END, CASE WHEN t < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3 DAY THEN 'sync_stale' END, CASE WHEN n > 0 AND r = 0 THEN 'no_sync_trace' END,
  CASE WHEN n > 0 AND s = 0 THEN 'no_courses_selected' END, CASE WHEN t IS NOT NULL AND n = 0 THEN 'no_courses' END, CASE WHEN e > 0 THEN 'global_endpoint_failures' END], lambda x: x IS NOT NULL)) AS code FROM f""")
def sync_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    n = lambda k: F.count_if(kind == k)
    last = F.max_by("event_type", "event_id")
    f = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("student_id")).agg(
        F.max(F.when(kind != "view", F.col("ts").cast("timestamp"))).alias("last_synced_at"), F.when(last == "signup", "signed_out").when(last == "error", "error").otherwise("idle").alias("status"), n("purchase").alias("n_courses"), n("signup").alias("n_selected"), n("click").alias("n_requests"), n("error").alias("n_failures")
    )
    return problems.sync_problems(f, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("student_id", "code")


@query("""WITH t AS (SELECT p_partkey AS id, p_partkey % 6 AS k, p_name FROM part) SELECT id, CASE k WHEN 0 THEN '2026-10-07' WHEN 1 THEN '2026-10-08' WHEN 2 THEN '2026-10-14' WHEN 3 THEN '2026-10-11' WHEN 4 THEN '2026-11-30' END AS due, CASE k WHEN 4 THEN p_name || ' by' ELSE p_name END AS title FROM t""")
def captured_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of a Wednesday with a day in words."""
    k = F.col("p_partkey") % 6
    day = F.when(k == 0, "today").when(k == 1, " Tomorrow").when(k == 2, "wed").when(k == 3, "Sunday").when(k == 4, " by 2026-11-30").otherwise("")
    said = F.concat_ws(" ", "p_name", day)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.date_format(capture.due_in_words(said, F.lit("2026-10-07").cast("date")), "yyyy-MM-dd").alias("due"), capture.task_title(said).alias("title"))


@query("""WITH c AS (SELECT n_nationkey AS student_id, n_nationkey * 100 + i AS course_id, 'CIS*' || (1000 + n_nationkey * 7 + i) AS code, i AS ord FROM nation, range(0, 5) r(i)),
t AS (SELECT c_custkey AS task_id, c_nationkey AS student_id, 'read cis ' || (1000 + c_nationkey * 7 + c_custkey % 8) || ' notes' AS text, 1000 + c_nationkey * 7 + c_custkey % 8 AS d FROM customer)
SELECT task_id, min(course_id) AS course_id FROM t LEFT JOIN c ON c.student_id = t.student_id AND contains(code, d::VARCHAR) GROUP BY 1""")
def task_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    courses = table(spark, sf_dir, "nation").withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(n.alias("student_id"), (n * 100 + F.col("ord")).alias("course_id"), F.concat(F.lit("CIS*"), (1000 + n * 7 + F.col("ord")).cast("string")).alias("code"), "ord")
    c = F.col("c_nationkey")
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), c.alias("student_id"), F.concat(F.lit("read cis "), (1000 + c * 7 + F.col("c_custkey") % 8).cast("string"), F.lit(" notes")).alias("text"))
    return capture.with_course(tasks, courses).select("task_id", "course_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 9 <> 0 THEN 'mine' ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 5.0 END ELSE p_retailprice END AS weight FROM part""")
def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own titles, but not null ones, and own weights, null ones too, for every third part."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    rows = p.select(k.alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("type"), F.col("p_retailprice").alias("weight"), F.lit(None).cast("timestamp").alias("due"))
    value = lambda c, t: F.struct(c.cast(t).alias("value"))
    own = p.filter("p_partkey % 3 = 0").select(k.alias("id"), value(F.when(k % 9 != 0, "mine"), "string").alias("title"), F.lit(None).cast("struct<value:string>").alias("type"), value(F.when(k % 2 != 0, 5.0), "double").alias("weight"), F.lit(None).cast("struct<value:timestamp>").alias("due"))
    return capture.overridden(rows, own).select("id", "title", "weight")


@query("""SELECT n_nationkey AS course_id, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 4 <> 0 THEN 'B' ELSE 'A' END AS section, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS lab_section, 'L' AS lecture_section FROM nation""")
def course_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("course_id", F.col("n_nationkey"))
    none = F.lit(None).cast("string")
    courses = n.select("course_id", F.lit("A").alias("section"), none.alias("lab_section"), F.lit("L").alias("lecture_section"))
    return capture.with_sections(courses, n.filter("course_id % 2 = 0").select("course_id", F.when(F.col("course_id") % 4 != 0, "B").alias("section"), F.col("n_name").alias("lab_section"), none.alias("lecture_section")))


@query("""SELECT p_partkey AS rule_id, CASE WHEN p_size < 20 THEN 'other' WHEN p_size < 30 THEN 'blueprint' ELSE 'hint' END AS source FROM part""")
def merged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a rule; those of sizes from 25 on are hints as well."""
    size = F.col("p_size")
    part = lambda which, name: table(spark, sf_dir, "part").filter(which).select(F.col("p_partkey").alias("rule_id"), F.lit(name).alias("source"))
    return capture.merged_rules(part(size < 20, "other"), part((size >= 20) & (size < 30), "blueprint"), part(size >= 25, "hint"))


@query("""WITH u AS (SELECT user_id AS student_id, event_id AS change_id, 0 AS late, event_id FROM events WHERE event_type = 'error' UNION ALL SELECT user_id, event_id, 1, event_id FROM events WHERE event_type = 'view' AND event_id % 2 = 0)
SELECT student_id, change_id, place FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY late, event_id) AS place FROM u) WHERE place <= 300""")
def change_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("student_id"), F.col("event_id").alias("change_id"), F.col("event_id").alias("ord"), (F.col("event_id") % 2 == 0).alias("read"), "event_type")
    return capture.inbox(e.filter("event_type = 'error'").drop("event_type"), e.filter("event_type = 'view'").drop("event_type")).select("student_id", "change_id", "place")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type = 'click'), s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'view')
SELECT user_id AS student_id, event_id % 50 AS note_id FROM c WHERE n <= 5 AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = c.user_id AND s.n <= 100 AND s.event_id % 50 = c.event_id % 50)""")
def notes_to_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five candidates of each student, without what was shown among the last hundred."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("student_id"), (F.col("event_id") % 50).alias("note_id"), F.col("event_id").alias("ord"), "event_type")
    return capture.to_send(e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'view'").drop("event_type")).select("student_id", "note_id")


@query("""WITH i AS (SELECT p_brand AS doc_id, p_partkey AS ord, 'Item ' || (p_partkey % 40) AS title, p_partkey % 40 AS k, CASE WHEN p_size % 3 = 0 THEN 'other' ELSE p_type END AS type, CASE WHEN p_size % 4 > 0 THEN p_retailprice END AS weight, CASE WHEN p_size % 5 = 0 THEN 'Week ' || p_size END AS due_label, p_size / 50 AS confidence FROM part)
SELECT doc_id, min(ord) AS ord, coalesce(arg_min(type, ord) FILTER (WHERE type <> 'other'), 'other') AS type, arg_min(weight, ord) FILTER (WHERE weight IS NOT NULL) AS weight, arg_min(due_label, ord) FILTER (WHERE due_label IS NOT NULL) AS due_label, round(max(confidence), 6) AS confidence FROM i GROUP BY doc_id, k""")
def parsed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed rows that name the same item as one, with what each of them knows."""
    k, s = F.col("p_partkey"), F.col("p_size")
    title = F.concat(F.when(s % 2 == 0, "Item  ").otherwise("ITEM #"), (k % 40).cast("string"))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc_id"), k.alias("ord"), title.alias("title"), F.when(s % 3 == 0, "other").otherwise(F.col("p_type")).alias("type"), F.when(s % 4 > 0, F.col("p_retailprice")).alias("weight"),
        F.when(s % 5 == 0, F.concat(F.lit("Week "), s.cast("string"))).otherwise("").alias("due_label"), F.lit(None).cast("date").alias("due"), F.lit(None).cast("string").alias("snippet"), (s / 50).alias("confidence"),
    )
    return capture.deduped(rows).select("doc_id", "ord", "type", "weight", "due_label", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {ITEMS}, u AS (SELECT course_id % 50 AS student_id, due, CASE WHEN kind IN ('midterm', 'final', 'project') THEN 2 ELSE 1 END + coalesce(weight, 0) / 20 AS s FROM h UNION ALL SELECT user_id % 50, ts, 1 FROM events WHERE event_type IN ('click', 'purchase'))
SELECT student_id, {LOCAL} AS day, count(*) AS n, round(sum(s), 6) AS score FROM u GROUP BY 1, 2""")
def day_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("student_id"), F.col("ts").cast("timestamp").alias("at"), "event_type")
    mine = items(spark, sf_dir).select((F.col("course_id") % 50).alias("student_id"), F.col("due").alias("at"), "kind", "weight")
    return capture.day_load(mine, e.filter("event_type = 'click'"), e.filter("event_type = 'purchase'"), ZONE).withColumn("score", F.round("score", 6))


@query("""SELECT p_partkey AS course_id, 'l' AS category_id, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE 7.5 END AS weight, CASE WHEN p_size % 3 > 0 THEN p_size % 3 ELSE 2 END AS drop_lowest FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, 'o', 7.5, 2 FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT p_partkey, 'p', 1.0, 0 FROM part""")
def merged_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live categories of even parts with what the outline adds, and categories of the outline alone."""
    p = table(spark, sf_dir, "part")
    none = F.lit(None).cast("double")
    made = lambda df, key, name, weight, drop: df.select(F.col("p_partkey").alias("course_id"), F.lit(key).alias("category_id"), F.lit(name).alias("name"), weight.cast("double").alias("weight"), drop.cast("int").alias("drop_lowest"), F.lit(None).cast("int").alias("best_n"), none.alias("cap"), none.alias("threshold"))
    live = made(p.filter("p_partkey % 2 = 0"), "l", "Quizzes", F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice")), F.col("p_size") % 3)
    outline = made(p, "o", "QUIZZES", F.lit(7.5), F.lit(2)).unionByName(made(p, "p", "Labs", F.lit(1.0), F.lit(0)))
    return rules.merged_categories(live, outline).select("course_id", "category_id", "weight", "drop_lowest")


@query("""SELECT p_partkey AS rule_id, CASE p_partkey % 4 WHEN 0 THEN 'BestN' WHEN 1 THEN 'DropLowest' WHEN 2 THEN 'GradeCap' ELSE 'ManualOverride' END AS kind, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN 1 END AS n, CASE p_partkey % 4 WHEN 2 THEN p_size::DOUBLE END AS cap FROM part""")
def typed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the older form in the columns of the typed one."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    kind = F.when(k % 4 == 0, "BestN").when(k % 4 == 1, "DropLowest").when(k % 4 == 2, "GradeCap").otherwise("Whatever")
    params = F.when(k % 4 == 0, F.concat(F.lit('{"n": '), s, F.lit(', "applyToTypes": ["quiz"]}'))).when(k % 4 == 1, '{"n": "many"}').when(k % 4 == 2, F.concat(F.lit('{"capPercent": '), s, F.lit("}")))
    legacy = table(spark, sf_dir, "part").select(k.alias("rule_id"), k.alias("course_id"), k.alias("ord"), kind.alias("kind"), params.alias("params"))
    return rules.typed(legacy).select("rule_id", "kind", "n", "cap")
