"""Calendar, outline, tree, data-quality and incremental queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outline, problems, schedule, tree
from ..sources import ics
from ..streaming import incremental
from .registry import query, table

ZONE = "America/Toronto"
HOLIDAYS = [("2024-02-17", "2024-02-25")]

_LOCAL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto')"
CLUSTERS = f"""
e AS (SELECT user_id AS course_id, event_type AS kind, dayofweek({_LOCAL}) AS day_of_week, strftime(date_trunc('hour', {_LOCAL}), '%H:%M') AS start_hm, {_LOCAL}::DATE AS day,
   CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'R' || (event_id % 40) END AS location, event_id AS ord FROM events),
c AS (SELECT course_id, kind, day_of_week, start_hm, count(*) AS n, arg_min(location, ord) FILTER (WHERE location IS NOT NULL) AS location, min(day) AS first_day, max(day) AS last_day FROM e GROUP BY 1, 2, 3, 4)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    place = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("R"), F.col("event_id") % 40))
    return e.select(F.col("user_id").alias("course_id"), F.col("event_type").alias("kind"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start"), place.alias("location"), F.col("event_id").alias("ord"))


@query(f"WITH {CLUSTERS} SELECT * FROM c")
def calendar_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.clusters(calendar(spark, sf_dir), ZONE)


OCCURRENCES = f"""
{CLUSTERS}, p AS (SELECT concat_ws('-', course_id, kind, day_of_week, start_hm) AS pattern_id, day_of_week, start_hm, last_day FROM c),
d AS (SELECT p.*, unnest(generate_series(DATE '2024-02-01', DATE '2024-04-10', INTERVAL 1 DAY))::DATE AS day FROM p),
o AS (SELECT pattern_id, day, row_number() OVER (PARTITION BY pattern_id ORDER BY day) AS number, (((day || ' ' || start_hm)::TIMESTAMP AT TIME ZONE 'America/Toronto') AT TIME ZONE 'UTC') AS start FROM d
      WHERE dayofweek(day) = day_of_week AND NOT (day >= DATE '2024-02-17' AND day <= DATE '2024-02-25') AND day <> DATE '2024-03-04')"""


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = schedule.clusters(calendar(spark, sf_dir), ZONE)
    day = lambda d: F.lit(d).cast("date")
    return c.select(F.concat_ws("-", F.col("course_id").cast("string"), "kind", F.col("day_of_week").cast("string"), "start_hm").alias("pattern_id"), "day_of_week", "start_hm", day("2024-02-01").alias("range_start"), day("2024-04-10").alias("range_end"), F.array(day("2024-03-04")).alias("exdates"))


@query(f"WITH {OCCURRENCES} SELECT pattern_id, 'occ:' || pattern_id || ':' || day AS occurrence_id, day, number, strftime(start, '%Y-%m-%d %H:%M:%S') AS start FROM o")
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = schedule.occurrences(patterns(spark, sf_dir), HOLIDAYS, ZONE)
    return made.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {OCCURRENCES} SELECT p_partkey AS item_id, strftime((((o.day + 8) || ' 23:59')::TIMESTAMP AT TIME ZONE 'America/Toronto') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS due
FROM part JOIN o ON o.pattern_id = (p_partkey % 150) || '-click-' || (p_partkey % 7) || '-1' || (p_size % 8) || ':00' AND o.number = p_partkey % 4 + 1""")
def relative_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items due eight days after the numbered occurrence of their pattern."""
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    items = table(spark, sf_dir, "part").select(k.alias("item_id"), F.concat(s(k % 150), F.lit("-click-"), s(k % 7), F.lit("-1"), s(F.col("p_size") % 8), F.lit(":00")).alias("pattern_id"), (k % 4 + 1).cast("int").alias("number"))
    out = schedule.due_after(items, schedule.occurrences(patterns(spark, sf_dir), HOLIDAYS, ZONE), 8, "23:59", ZONE)
    return out.withColumn("due", F.date_format("due", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, date_trunc('day', ts)::DATE AS day FROM events) SELECT event_id FROM e WHERE event_type = 'view' AND NOT EXISTS
  (SELECT 1 FROM e x WHERE x.event_type = 'click' AND x.user_id = e.user_id AND x.day = e.day)""")
def uncovered_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a user on days without a click of theirs."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return schedule.uncovered(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ["user_id", "day"]).select("event_id")


@query("""WITH l AS (SELECT p_brand AS course_id, p_type AS kind, count(*) AS found FROM part WHERE p_size > 10 GROUP BY 1, 2), e AS (SELECT p_brand AS course_id, p_type AS kind, count(*) AS promised FROM part GROUP BY 1, 2)
SELECT course_id, kind, promised - coalesce(found, 0) AS short, CASE WHEN coalesce(found, 0) = 0 THEN 'missing' ELSE 'shortfall' END AS gap FROM e LEFT JOIN l USING (course_id, kind) WHERE coalesce(found, 0) < promised""")
def stale_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("course_id"), F.col("p_type").alias("kind"), "p_size")
    return problems.stale_gaps(p.groupBy("course_id", "kind").agg(F.count("*").alias("promised")), p.filter("p_size > 10"))


@query("""WITH i AS (SELECT l_orderkey AS course_id, CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity END AS weight, l_returnflag = 'R' AS bonus FROM lineitem),
o AS (SELECT course_id, floor(sum(weight) FILTER (WHERE NOT bonus) * 10 + 0.5) / 10 AS assessment_sum, count(*) FILTER (WHERE NOT bonus AND weight IS NULL) AS missing FROM i GROUP BY 1),
c AS (SELECT l_orderkey AS course_id, floor(sum(l_tax * 1000) * 10 + 0.5) / 10 AS category_sum FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1),
j AS (SELECT *, CASE WHEN category_sum > 0 THEN 'categories' WHEN assessment_sum IS NOT NULL THEN 'assessments' ELSE 'none' END AS basis FROM o LEFT JOIN c USING (course_id)),
t AS (SELECT *, CASE basis WHEN 'categories' THEN category_sum WHEN 'assessments' THEN assessment_sum END AS total FROM j)
SELECT course_id, assessment_sum, category_sum, missing, basis, total, CASE WHEN basis = 'none' THEN 'no_weights' WHEN abs(total - 100) > 2 THEN 'weights_not_100' END AS problem FROM t""")
def weight_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    items = li.select(F.col("l_orderkey").alias("course_id"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")).alias("weight"), (F.col("l_returnflag") == "R").alias("bonus"))
    return problems.weight_summary(items, li.filter("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("course_id"), (F.col("l_tax") * 1000).alias("weight")))


@query("""WITH i AS (SELECT l_orderkey AS course_id, CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity END AS weight, CASE WHEN l_linenumber <> 6 THEN l_shipdate END AS due, CASE WHEN l_linenumber % 7 = 3 THEN 'unknown' ELSE 'exact' END AS certainty,
  l_linenumber % 4 = 3 AS is_final, l_returnflag = 'R' AS conflict FROM lineitem),
f AS (SELECT course_id, count(*) AS n, count(weight) AS weighed, coalesce(sum(weight), 0) AS s, count(*) FILTER (WHERE due IS NULL OR certainty = 'unknown') AS undated, count(*) FILTER (WHERE is_final) AS finals,
  count(*) FILTER (WHERE is_final AND certainty = 'unknown') AS bad, count(*) FILTER (WHERE conflict) AS conflicts FROM i GROUP BY 1),
g AS (SELECT o_orderkey AS course_id, o_orderkey % 5 <> 0 AS outline, o_orderkey % 3 <> 0 AS instructor, o_orderkey % 4 <> 0 AS schedule, coalesce(n, 0) AS n, coalesce(weighed, 0) AS weighed, coalesce(s, 0) AS s, coalesce(undated, 0) AS undated,
  coalesce(finals, 0) AS finals, coalesce(bad, 0) AS bad, coalesce(conflicts, 0) AS nc FROM orders LEFT JOIN f ON course_id = o_orderkey),
h AS (SELECT course_id, outline, n > 0 AS assessments, weighed > 0 AND abs(s - 100) <= 5 AS weights, n = weighed AS missing_weights, undated = 0 AS dates, finals > 0 AND bad = 0 AS final, nc = 0 AS conflicts, instructor, schedule,
  n > weighed OR (weighed > 0 AND abs(s - 100) > 5) AS weights_warn, nc > 0 OR undated > n / 2 AS worse FROM g),
k AS (SELECT *, floor((outline::INT + assessments::INT + weights::INT + missing_weights::INT + dates::INT + final::INT + conflicts::INT + instructor::INT + schedule::INT) * 100 / 9 + 0.5)::INT AS score,
  9 - (outline::INT + assessments::INT + (NOT weights_warn)::INT + missing_weights::INT + dates::INT + final::INT + conflicts::INT + instructor::INT + schedule::INT) AS warnings FROM h)
SELECT * EXCLUDE (weights_warn, worse), CASE WHEN warnings = 0 AND score >= 90 THEN 'complete' WHEN score >= 70 THEN 'good' WHEN worse THEN 'needs_attention' ELSE 'missing_information' END AS status FROM k""")
def course_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("o_orderkey"), F.col("l_linenumber")
    courses = table(spark, sf_dir, "orders").select(k.alias("course_id"), (k % 5 != 0).alias("outline"), (k % 3 != 0).alias("instructor"), (k % 4 != 0).alias("schedule"))
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("course_id"),
        F.when(n % 5 != 0, F.col("l_quantity")).alias("weight"),
        F.when(n != 6, F.col("l_shipdate")).alias("due"),
        F.when(n % 7 == 3, "unknown").otherwise("exact").alias("certainty"),
        F.when(n % 4 == 3, "final").otherwise("quiz").alias("kind"),
        (F.col("l_returnflag") == "R").alias("conflict"),
    )
    return problems.health(courses, items)


@query("""WITH k AS (SELECT unnest(['dropbox', 'quizzes', 'quiz_attempts', 'grades', 'grade_categories', 'news', 'calendar', 'content', 'discussions', 'feedback', 'checklists', 'groups']) AS capability,
  unnest(['/dropbox/folders/', '/quizzes/', '/quizzes/{id}/attempts/', '/grades/', '/grades/categories/', '/news/', '/calendar/events/', '/content/toc', '/discussions/forums/.../posts/', '/dropbox/folders/{id}/feedback/...', '/checklists/', '/groupcategories/']) AS endpoint),
c AS (SELECT source AS course_id, CASE doc_id % 9 WHEN 0 THEN 'dropbox' WHEN 1 THEN 'quizzes' WHEN 2 THEN 'grades' WHEN 3 THEN 'news' WHEN 4 THEN 'calendar' WHEN 5 THEN 'content' WHEN 6 THEN 'discussions' WHEN 7 THEN 'feedback' ELSE 'groups' END AS capability,
  count(*) AS discovered, count(quality) AS ingested, CASE WHEN max(doc_id) % 5 = 0 THEN 'timeout' END AS error, min(doc_id) % 7 = 0 AS forbidden FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2),
r AS (SELECT s.course_id, k.capability, k.endpoint, coalesce(c.discovered, 0) AS discovered, coalesce(c.ingested, 0) AS ingested, error, forbidden FROM (SELECT DISTINCT course_id FROM c) s CROSS JOIN k LEFT JOIN c ON c.course_id = s.course_id AND c.capability = k.capability)
SELECT course_id, capability, endpoint, discovered, ingested, CASE WHEN coalesce(forbidden, false) THEN 'forbidden' WHEN error IS NOT NULL THEN 'error' WHEN ingested < discovered THEN 'partial' WHEN discovered = 0 AND ingested = 0 THEN 'unavailable' ELSE 'available' END AS status FROM r""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source as what nine of its capabilities discover, and labelled ones as what they ingest."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    nine = [k for k in problems.CAPABILITIES if k not in ("quiz_attempts", "grade_categories", "checklists")]
    named = F.element_at(F.array(*map(F.lit, nine)), (F.col("doc_id") % 9 + 1).cast("int"))
    counts = d.groupBy(F.col("source").alias("course_id"), named.alias("capability")).agg(F.count("*").alias("discovered"), F.count("quality").alias("ingested"), F.when(F.max("doc_id") % 5 == 0, "timeout").alias("error"), (F.min("doc_id") % 7 == 0).alias("forbidden"))
    return problems.coverage(counts)


@query("""SELECT p_partkey AS course_id, p_type AS name, i AS number, p_type || ' ' || i AS title, floor(p_retailprice / (p_size % 6) * 1000 + 0.5) / 1000 AS weight FROM part, range(1, 7) t(i) WHERE i <= p_size % 6""")
def instance_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return problems.expanded(p.select(F.col("p_partkey").alias("course_id"), F.col("p_type").alias("name"), (F.col("p_size") % 6).alias("count"), F.col("p_retailprice").alias("weight")))


@query("""WITH p AS (SELECT p_brand AS course_id, p_type AS name, max(p_size) % 12 AS count FROM part GROUP BY 1, 2), f AS (SELECT DISTINCT p_brand AS course_id, p_type AS name, p_size % 15 AS number FROM part),
w AS (SELECT course_id, name, i AS number FROM p, range(1, 13) t(i) WHERE i <= count)
SELECT *, 'pad' AS action FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.course_id = w.course_id AND f.name = w.name AND f.number = w.number)
UNION ALL SELECT f.*, 'trim' FROM f JOIN p USING (course_id, name) WHERE f.number > p.count""")
def second_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("course_id"), F.col("p_type").alias("name"), "p_size")
    promised = p.groupBy("course_id", "name").agg((F.max("p_size") % 12).alias("count"))
    return problems.second_pass(promised, p.select("course_id", "name", (F.col("p_size") % 15).alias("number")).distinct())


@query("""WITH n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_regionkey AS ord, false AS hidden FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_nationkey % 7 = 3 FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, c_custkey % 11 = 5 FROM customer),
a AS (SELECT id, parent_id, lpad(ord::VARCHAR, 10, '0') AS path, 0 AS depth FROM n WHERE parent_id IS NULL AND NOT hidden),
b AS (SELECT n.id, n.parent_id, a.path || '/' || lpad(n.ord::VARCHAR, 10, '0') AS path, 1 AS depth FROM n JOIN a ON n.parent_id = a.id WHERE NOT n.hidden),
c AS (SELECT n.id, n.parent_id, b.path || '/' || lpad(n.ord::VARCHAR, 10, '0') AS path, 2 AS depth FROM n JOIN b ON n.parent_id = b.id WHERE NOT n.hidden)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def content_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and customers as a tree in preorder, with hidden branches pruned."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    node = lambda df, i, up, ord_col, hidden: df.select(i.alias("id"), up.alias("parent_id"), F.col(ord_col).cast("long").alias("ord"), hidden.alias("hidden"))
    r = node(table(spark, sf_dir, "region"), name("r", "r_regionkey"), F.lit(None).cast("string"), "r_regionkey", F.lit(False))
    n = node(table(spark, sf_dir, "nation"), name("n", "n_nationkey"), name("r", "n_regionkey"), "n_nationkey", F.col("n_nationkey") % 7 == 3)
    c = node(table(spark, sf_dir, "customer"), name("c", "c_custkey"), name("n", "c_nationkey"), "c_custkey", F.col("c_custkey") % 11 == 5)
    return tree.preorder(r.unionByName(n).unionByName(c))


@query("""WITH n AS (SELECT user_id, 'k' || (event_id % 50) AS id, 'k' || ((event_id * 7) % 90) AS parent_id FROM events WHERE event_type = 'view')
SELECT DISTINCT parent_id, id FROM n WHERE parent_id NOT IN (SELECT id FROM n)""")
def orphan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").filter("event_type = 'view'")
    nodes = e.select(F.concat(F.lit("k"), k % 50).alias("id"), F.concat(F.lit("k"), (k * 7) % 90).alias("parent_id")).distinct()
    return tree.orphans(nodes).select("parent_id", "id")


@query(r"""SELECT o_orderkey, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:order-' || o_orderkey || chr(13) || chr(10) || 'DTSTAMP:19980615T120000Z' || chr(13) || chr(10) || 'DTSTART:' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ')
  || chr(13) || chr(10) || 'SUMMARY:' || o_orderpriority || '\, status ' || o_orderstatus || chr(13) || chr(10) || 'END:VEVENT' AS event FROM orders WHERE o_orderkey % 10 <> 0""")
def ics_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a sure date as calendar events."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0")
    title = F.concat("o_orderpriority", F.lit(", status "), "o_orderstatus")
    return o.select("o_orderkey", ics.event_text(F.concat(F.lit("order-"), "o_orderkey"), title, F.col("o_orderdate").cast("timestamp"), F.lit("1998-06-15 12:00:00").cast("timestamp")).alias("event"))


@query("""WITH o AS (SELECT o_orderkey, o_orderpriority || ', status ' || o_orderstatus AS title, o_orderdate AS start FROM orders WHERE o_orderkey % 10 <> 0) SELECT 'order-' || o_orderkey AS uid, title, strftime(start, '%Y-%m-%d %H:%M:%S') AS start FROM o""")
def ics_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported events, read back from calendar texts: each has the orders of one run of a hundred keys, so texts grow in number."""
    made = ics_export(spark, sf_dir).withColumn("part", F.floor(F.col("o_orderkey") / 100))
    files = made.groupBy("part").agg(F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join(F.collect_list("event"), "\r\n"), F.lit("\r\nEND:VCALENDAR\r\n")).alias("text"))
    return ics.events(files).select("uid", "title", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


OUTLINES = """
o AS (SELECT p_partkey AS doc_id, p_name || chr(10) || 'Labs: 4 x ' || (p_size % 5 + 1) || '%' || chr(10) || 'Midterm ' || (p_size % 30) || '%' || chr(10) || 'Best ' || (p_size % 4 + 1) || ' of 7 quizzes count'
  || chr(10) || 'Reports are due ' || (p_size % 9) || ' days after the lab' AS text, p_size FROM part)"""


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda n, plus=0: (F.col("p_size") % n + plus).cast("string")
    text = F.concat(F.col("p_name"), F.lit("\nLabs: 4 x "), size(5, 1), F.lit("%\nMidterm "), size(30), F.lit("%\nBest "), size(4, 1), F.lit(" of 7 quizzes count\nReports are due "), size(9), F.lit(" days after the lab"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


@query(f"""WITH {OUTLINES} SELECT doc_id, 'Labs' AS title, 4 AS count, (p_size % 5 + 1)::DOUBLE AS weight, 'other' AS type FROM o UNION ALL SELECT doc_id, 'Midterm', 1, (p_size % 30)::DOUBLE, 'midterm' FROM o""")
def outline_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.weight_rows(outline.lines(outlines(spark, sf_dir))).select("doc_id", "title", "count", "weight", "type")


@query(f"""WITH {OUTLINES} SELECT doc_id, 'BestN' AS kind, p_size % 4 + 1 AS n, 7 AS "of", NULL AS anchor FROM o UNION ALL SELECT doc_id, 'RelativeDeadline', p_size % 9, NULL, 'lab' FROM o""")
def outline_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.rules(outline.lines(outlines(spark, sf_dir))).select("doc_id", "kind", "n", "of", "anchor")


@query("""SELECT event_id AS post_id, 'due_changed' AS kind, 'quiz ' || (event_id % 9) AS hint, '2024-03-' || lpad((event_id % 28 + 1)::VARCHAR, 2, '0') AS value FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'cancelled', 'lecture', NULL FROM events WHERE event_type = 'signup'""")
def clarifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed due dates and cancelled meetings in staff posts, as in its SQL; announcement_facts has all kinds."""
    k = F.col("event_id")
    s = lambda c: c.cast("string")
    moved = F.concat(F.lit("Hello all, Quiz #"), s(k % 9), F.lit(" has been moved to 2024-03-"), F.lpad(s(k % 28 + 1), 2, "0"), F.lit(". Good luck"))
    body = F.when(F.col("event_type") == "error", moved).when(F.col("event_type") == "signup", "The lecture on Monday is cancelled.").otherwise("See you in class.")
    posts = table(spark, sf_dir, "events").select(k.alias("post_id"), body.alias("text"))
    return outline.announcement_facts(posts).filter("kind IN ('due_changed', 'cancelled')").select("post_id", "kind", "hint", "value")


@query("""SELECT event_id AS post_id, unnest(['due_changed', 'extension', 'schedule']) AS kind, unnest(['quiz ' || (event_id % 9), 'assignment ' || (event_id % 7), NULL]) AS hint, unnest(['2024-03-' || lpad((event_id % 28 + 1)::VARCHAR, 2, '0'), '2024-04-09', NULL]) AS value FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'cancelled', unnest(['lecture', 'lab 2']), NULL FROM events WHERE event_type = 'signup'
UNION ALL SELECT event_id, unnest(['location', 'location', 'exam', 'grade_release', 'resource']), unnest(['midterm', 'quiz 4', 'midterm', 'midterm', 'midterm']), unnest(['MACN 105', 'Massey Hall 12', '2024-10-20', NULL, NULL]) FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, 'clarification', 'assignment 3', NULL FROM events WHERE event_type NOT IN ('error', 'signup', 'click')""")
def announcement_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all kinds in posts that hold several."""
    k = F.col("event_id")
    s = lambda c: c.cast("string")
    moved = F.concat(F.lit("Quiz #"), s(k % 9), F.lit(" has been moved to 2024-03-"), F.lpad(s(k % 28 + 1), 2, "0"), F.lit(" and the Assignment "), s(k % 7), F.lit(" deadline extended to April 9, 2024."))
    told = "The midterm is in MACN 105 and quiz 4 at Massey Hall 12. The midterm is on October 20, 2024. Grades are released; slides are posted."
    by = F.when(F.col("event_type") == "error", moved).when(F.col("event_type") == "signup", "The lecture on Monday is cancelled. Lab 2 will not be held.")
    posts = table(spark, sf_dir, "events").select(k.alias("post_id"), by.when(F.col("event_type") == "click", told).otherwise("In Assignment 3, count from zero.").alias("text"))
    return outline.announcement_facts(posts).select("post_id", "kind", "hint", "value")


def _stream_of_events(spark: SparkSession, sf_dir: str, columns: list) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).select(*columns)


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query()
def notification_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events stream as notes, each user and type once in its memory."""
    notes = _stream_of_events(spark, sf_dir, [F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("note_id"), F.col("ts").cast("timestamp").alias("at")])
    out = _folder(spark)
    incremental.once(notes).writeStream.format("parquet").option("path", f"{out}/notes").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("note_id string, at timestamp").parquet(f"{out}/notes")


@query()
def snapshot_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events stream as snapshots of a user's state; the changes that each batch makes."""
    user = F.col("user_id")
    rows = _stream_of_events(spark, sf_dir, [user.alias("id"), F.col("event_type").alias("title"), F.col("ts").alias("due"), F.round("value", 0).alias("weight"), F.lit(None).cast("double").alias("earned"), F.col("event_id").alias("ord")])
    out = _folder(spark)
    incremental.snapshots(rows, f"{out}/state", f"{out}/changes", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("id long, kind string, before_value string, after_value string, batch int").parquet(f"{out}/changes")
