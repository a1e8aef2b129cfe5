"""Queries on a student's day, on everything that can be searched, and on what announcements and outlines say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import day, grades, outline, search
from .grading import ASSESSMENTS, STANDING, assessments
from .library import _FNV
from .linked import _pick
from .planning import ITEMS, ZONE, _now, items
from .registry import query, table

#: Events happen this many days before they do in their table, about the time of the orders.
SHIFT = 9340

DAY_ITEMS = f"""d AS (SELECT id % 100 AS student, id, course_id, kind AS type, CASE WHEN certainty <> 'unknown' THEN due END AS due, weight, submission, CASE WHEN submission = 'submitted' THEN due - to_days((id % 5)::INT) END AS submitted_at,
  submission = 'submitted' OR graded AS done, missed, id % 19 = 0 AS dropped, id % 5 = 0 AS confirmed, needs_confirmation, TIMESTAMP '1998-06-15 12:00:00' AS now FROM h),
e AS (SELECT *, user_id % 100 AS student, ts - to_days({SHIFT}) AS moment, TIMESTAMP '1998-06-15 12:00:00' AS now FROM events)"""

MEETINGS = f"""m AS (SELECT event_id AS id, student, user_id AS course_id, CASE event_id % 4 WHEN 0 THEN 'lab' WHEN 1 THEN 'lecture' WHEN 2 THEN 'tutorial' ELSE 'seminar' END AS kind, moment AS s, moment + to_minutes((event_id % 90)::INT) AS f, event_id % 13 = 0 AS cancelled, now FROM e WHERE event_type = 'view'),
p AS (SELECT *, date_diff('day', '1998-06-15'::DATE, ((s AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}')::DATE) AS ahead, (epoch_us(now) - epoch_us(f)) / 6e7 AS over FROM m WHERE NOT cancelled)"""

_CLOCK = "strftime(({0} AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto', '%-I:%M %p')"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp") - F.make_dt_interval(days=F.lit(SHIFT))
    return table(spark, sf_dir, "events").withColumns({"student": F.col("user_id") % 100, "at": at, "id": F.col("event_id")})


def _meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = _events(spark, sf_dir).filter("event_type = 'view'")
    return e.select("id", "student", F.col("user_id").alias("course_id"), _pick(k % 4, "lab", "lecture", "tutorial", "seminar").alias("kind"), F.col("at").alias("start"), (F.col("at") + F.make_dt_interval(mins=(k % 90).cast("int"))).alias("end"), (k % 13 == 0).alias("cancelled"))


def _day_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    due = F.when(c("certainty") != "unknown", c("due"))
    rows = items(spark, sf_dir).withColumns({"student": c("id") % 100, "type": c("kind"), "submitted_at": F.when(c("submission") == "submitted", c("due") - F.make_dt_interval(days=(c("id") % 5).cast("int"))), "due": due, "end": due})
    return rows.withColumns({"done": (c("submission") == "submitted") | c("graded"), "dropped": c("id") % 19 == 0, "confirmed": c("id") % 5 == 0})


@query(rf"""WITH {ITEMS}, {DAY_ITEMS}, {MEETINGS},
k AS (SELECT *, CASE WHEN ahead > 0 THEN 'later' WHEN now BETWEEN s AND f THEN 'on' WHEN now < s AND s - INTERVAL 3 HOUR <= now THEN 'soon' WHEN now > f AND over <= 45 THEN 'over' WHEN s >= TIMESTAMP '1998-06-15 21:00:00' THEN 'evening' WHEN s > now THEN 'today' ELSE 'past' END AS b FROM p WHERE ahead BETWEEN 0 AND 7),
x AS (SELECT *, due IS NOT NULL AND due < now AS late FROM d),
y AS (SELECT *, CASE WHEN done THEN CASE WHEN submitted_at > now - INTERVAL 48 HOUR THEN 'done' END WHEN (needs_confirmation OR (late AND submission <> 'submitted' AND NOT confirmed AND (submission = 'unknown' OR type IN ('lab', 'quiz')))) AND NOT missed THEN 'ask' WHEN missed THEN 'missed'
   WHEN dropped OR (due IS NOT NULL AND confirmed) THEN NULL WHEN due IS NULL THEN CASE WHEN coalesce(weight, 0) >= 10 OR type IN ('midterm', 'final') THEN 'unk' END WHEN late THEN 'late' WHEN due <= now + INTERVAL 3 HOUR THEN 'soon'
   WHEN due BETWEEN TIMESTAMP '1998-06-15 21:00:00' AND TIMESTAMP '1998-06-16 03:59:59.999' THEN 'tonight' WHEN due <= TIMESTAMP '1998-06-16 03:59:59.999' THEN 'today' WHEN due <= now + INTERVAL 21 DAY THEN 'later' END AS b FROM x),
u AS (SELECT student, 'occ:' || id AS id, CASE b WHEN 'on' THEN 'right_now' WHEN 'soon' THEN 'next' WHEN 'today' THEN 'next' WHEN 'over' THEN 'needs_answer' WHEN 'evening' THEN 'tonight' WHEN 'past' THEN 'history' ELSE 'coming_up' END AS section, CASE WHEN kind IN ('lab', 'tutorial') THEN kind ELSE 'class' END AS kind,
   CASE b WHEN 'on' THEN 'In progress' WHEN 'soon' THEN 'Starts ' || {_CLOCK.format("s")} WHEN 'over' THEN 'Finished ' || floor(over + 0.5)::BIGINT || ' min ago' ELSE kind END AS status, b = 'over' AS actionable, s AS sort_at FROM k
 UNION ALL SELECT student, 'a:' || id || CASE WHEN b IN ('done', 'ask', 'missed', 'unk') THEN ':' || b ELSE '' END, CASE b WHEN 'done' THEN 'history' WHEN 'missed' THEN 'history' WHEN 'ask' THEN 'needs_answer' WHEN 'late' THEN 'needs_answer' WHEN 'soon' THEN 'right_now' WHEN 'tonight' THEN 'tonight' WHEN 'today' THEN 'next' ELSE 'coming_up' END,
   CASE WHEN type = 'lab' AND b NOT IN ('done', 'ask', 'missed', 'unk') THEN 'lab' ELSE 'assessment' END, CASE b WHEN 'done' THEN 'Submitted' WHEN 'ask' THEN 'Needs your answer' WHEN 'missed' THEN 'Missed' WHEN 'unk' THEN 'Date unknown' WHEN 'late' THEN 'Past due — confirm' WHEN 'soon' THEN 'Due soon' WHEN 'tonight' THEN 'Due ' || {_CLOCK.format("due")} WHEN 'today' THEN 'Due today ' || {_CLOCK.format("due")}
     ELSE strftime((due AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto', '%a %b %-d · %-I:%M %p') END, b IN ('ask', 'late', 'soon', 'tonight'), CASE b WHEN 'unk' THEN now + INTERVAL 30 DAY WHEN 'ask' THEN coalesce(due, now) ELSE coalesce(due, TIMESTAMP '1970-01-01') END FROM y WHERE b IS NOT NULL
 UNION ALL SELECT student, 'ch:' || event_id, 'since_last_checked', 'change', 'grade posted', event_id % 3 <> 0, moment FROM (SELECT *, row_number() OVER (PARTITION BY student ORDER BY moment DESC, event_id) AS n FROM e WHERE event_type = 'purchase' AND (moment >= now - INTERVAL 4 DAY OR event_id % 3 <> 0)) WHERE n <= 40
 UNION ALL SELECT student, 'ann:' || event_id, 'since_last_checked', 'announcement', 'Posted', true, moment FROM (SELECT *, row_number() OVER (PARTITION BY student ORDER BY moment DESC, event_id) AS n FROM e WHERE event_type = 'error' AND moment >= now - INTERVAL 4 DAY) WHERE n <= 20
 UNION ALL SELECT student, 'task:' || event_id, CASE WHEN event_id % 8 = 0 THEN 'coming_up' WHEN moment < now THEN 'needs_answer' WHEN moment BETWEEN TIMESTAMP '1998-06-15 21:00:00' AND TIMESTAMP '1998-06-16 03:59:59.999' THEN 'tonight' WHEN moment <= TIMESTAMP '1998-06-16 03:59:59.999' THEN 'next' ELSE 'coming_up' END, 'task', 'Task', true, CASE WHEN event_id % 8 = 0 THEN now + INTERVAL 14 DAY ELSE moment END FROM e WHERE event_type = 'signup' AND event_id % 4 <> 1
 UNION ALL SELECT student, 'cal:' || event_id, CASE WHEN moment BETWEEN now - INTERVAL 30 MINUTE AND now + INTERVAL 1 HOUR THEN 'right_now' WHEN moment BETWEEN TIMESTAMP '1998-06-15 21:00:00' AND TIMESTAMP '1998-06-16 03:59:59.999' THEN 'tonight' WHEN moment <= TIMESTAMP '1998-06-16 03:59:59.999' THEN 'next' ELSE 'coming_up' END,
   CASE event_id % 3 WHEN 0 THEN 'commute' WHEN 1 THEN 'study' ELSE 'personal' END, CASE event_id % 3 WHEN 0 THEN 'BUS' WHEN 1 THEN 'STUDY' ELSE 'GYM' END, false, moment FROM e WHERE event_type = 'click' AND moment BETWEEN TIMESTAMP '1998-06-15 04:00:00' AND now + INTERVAL 7 DAY)
SELECT student, id, section, kind, status, actionable, place FROM (SELECT *, row_number() OVER (PARTITION BY student, section ORDER BY sort_at, id) AS place FROM u)
WHERE place <= CASE section WHEN 'coming_up' THEN 16 WHEN 'since_last_checked' THEN 20 ELSE 12 END""")
def day_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of each student, who are orders, and users, that share the last two digits: meetings, items, changes, announcements, tasks, calendar."""
    now, k = _now(), F.col("event_id")
    e = _events(spark, sf_dir)
    of = lambda kind: e.filter(F.col("event_type") == kind)
    since = now - F.make_dt_interval(days=F.lit(day.UNCHECKED_DAYS))
    changed = of("purchase").select("student", "id", F.lit("grade_posted").alias("kind"), F.col("at").alias("created_at"), (k % 3 == 0).alias("read"))
    told = of("error").select("student", "id", F.col("at").alias("published_at"))
    to_do = of("signup").select("student", "id", F.when(k % 8 != 0, F.col("at")).alias("due"), (k % 4 == 1).alias("done"))
    entries = of("click").select("student", "id", _pick(k % 3, "BUS", "STUDY", "GYM").alias("category"), F.col("at").alias("start"))
    return day.day_list(
        day.meetings(_meetings(spark, sf_dir), now, ZONE),
        day.assessments(_day_items(spark, sf_dir), now, ZONE),
        day.changes(changed, since),
        day.announcements(told, since),
        day.tasks(to_do, now, ZONE),
        day.calendar(entries, now, ZONE),
    ).drop("sort_at")


@query(f"""WITH {ITEMS}, {DAY_ITEMS}, {MEETINGS} SELECT course_id, arg_min(id, (s, id)) AS id FROM p WHERE kind = 'lab' AND ahead = 0 GROUP BY 1""")
def tonight_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return day.tonight_labs(_meetings(spark, sf_dir), _now(), ZONE)


@query(f"""WITH {ITEMS} SELECT course_id, id, o_orderpriority AS status, row_number() OVER (PARTITION BY course_id, o_orderpriority ORDER BY CASE WHEN certainty <> 'unknown' THEN due END NULLS LAST, id) AS place FROM h""")
def status_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each course by status, as a task list shows them."""
    return day.status_groups(_day_items(spark, sf_dir), F.col("o_orderpriority"))


@query(f"""WITH {ITEMS} SELECT id, course_id, CASE id % 5 WHEN 0 THEN 'final' WHEN 1 THEN 'quiz' WHEN 2 THEN 'lab' ELSE 'assignment' END AS type, strftime(due, '%Y-%m-%d %H:%M:%S') AS due FROM h WHERE id % 5 <> 4 AND certainty <> 'unknown'""")
def content_dues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    title = F.concat(_pick(k % 5, "Final project", "Unit test", "Lab report", "Homework", "Labour law"), F.lit(" "), k.cast("string"))
    return day.content_dues(_day_items(spark, sf_dir).select("id", "course_id", title.alias("title"), "due")).withColumn("due", F.date_format("due", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT 'pattern:' || event_id AS id, user_id AS course_id, event_type AS kind, event_id % 9 AS day_of_week, '09:00' AS start_time, '10:20' AS end_time FROM events WHERE event_id % 9 < 7 AND event_id % 11 > 1""")
def meeting_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older meetings of which some lack a weekday or a time."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(k.alias("id"), F.col("user_id").alias("course_id"), F.col("event_type").alias("kind"), F.when(k % 9 < 7, k % 9).alias("day_of_week"), F.when(k % 11 != 0, "09:00").alias("start_time"), F.when(k % 11 == 1, "").otherwise("10:20").alias("end_time"))
    return day.patterns(rows)


def _body(*columns: Column | str) -> Column:
    """The texts that are there, with blanks between them."""
    texts = F.array(*(F.col(c) if isinstance(c, str) else c for c in columns))
    return F.array_join(F.filter(texts, lambda x: x.isNotNull() & (x != "")), " ")


@query("""WITH i AS (SELECT 'a:' || o_orderkey AS id, 'assessment' AS kind, o_orderpriority AS title, o_orderstatus || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS body FROM orders
  UNION ALL SELECT 'n:' || event_id, 'announcement', event_type, props FROM events WHERE event_type <> 'view'
  UNION ALL SELECT 'd:' || conv_id || '-' || turn, CASE WHEN role = 'assistant' THEN 'staff_discussion' ELSE 'discussion' END, 'turn ' || turn, concat_ws(' ', nullif(role, ''), nullif(text, '')) FROM conversations
  UNION ALL SELECT 'c:' || page_id, 'content', url, concat_ws(' ', 'reading', nullif(html, '')) FROM pages
  UNION ALL SELECT 'lib:' || doc_id, 'library', source, concat_ws(' ', nullif(lang, ''), nullif(text, '')) FROM documents
  UNION ALL SELECT 'doc:' || p_partkey, 'outline', p_name, p_type FROM part
  UNION ALL SELECT 'pol:' || s_suppkey, 'policy', s_name, 'Late work' FROM supplier
  UNION ALL SELECT 'af:' || event_id, 'announcement_fact', 'schedule', event_type || ' ' || props FROM events WHERE event_type = 'view')
SELECT 'si:' || id AS id, kind, title, left(coalesce(body, ''), 8000) AS body FROM i""")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that can be searched, in the index's shape, from eight kinds of rows."""
    t = lambda name: table(spark, sf_dir, name)
    entry = lambda rows, mark, key, kind, title, body: search.entries(rows, mark, key, kind, title, body)
    e, lit = t("events"), F.lit
    kind = F.when(F.col("role") == "assistant", "staff_discussion").otherwise("discussion")
    return search.together(
        entry(t("orders"), "a", "o_orderkey", lit("assessment"), F.col("o_orderpriority"), _body("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd"))),
        entry(e.filter("event_type <> 'view'"), "n", "event_id", lit("announcement"), F.col("event_type"), F.col("props")),
        entry(t("conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn")), "d", "key", kind, F.concat(lit("turn "), F.col("turn").cast("string")), _body("role", "text")),
        entry(t("pages"), "c", "page_id", lit("content"), F.col("url"), _body(lit("reading"), "html")),
        entry(t("documents"), "lib", "doc_id", lit("library"), F.col("source"), _body("lang", "text")),
        entry(t("part"), "doc", "p_partkey", lit("outline"), F.col("p_name"), F.col("p_type")),
        entry(t("supplier"), "pol", "s_suppkey", lit("policy"), F.col("s_name"), lit("Late work")),
        entry(e.filter("event_type = 'view'"), "af", "event_id", lit("announcement_fact"), lit("schedule"), _body("event_type", "props")),
    )


@query("""SELECT event_id AS post_id, unnest([0, 1]) AS number, unnest(['Quiz ' || (event_id % 7), 'A' || (event_id % 4)]) AS title, unnest(['Monday, May ' || (event_id % 28 + 1), '2024-05-01']) AS label FROM events WHERE event_type = 'click' AND event_id % 10 <> 0
UNION ALL SELECT event_id, k, 'Lab ' || k, 'May ' || (k + 1) FROM events, range(5) r(k) WHERE event_type = 'error' AND event_id % 10 <> 0""")
def announced_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that say what is due when; of seven such phrases of one post five are taken, and hidden posts say nothing."""
    k = F.col("event_id")
    s = lambda n, plus=0: (k % n + plus).cast("string")
    many = ". ".join(f"Lab {n} is due: May {n + 1}" for n in range(7))
    two = F.concat(F.lit("Hello. Quiz  "), s(7), F.lit(" on trees is due:  Monday, May "), s(28, 1), F.lit("! The A"), s(4), F.lit(" deadline: 2024-05-01. See you"))
    body = F.when(F.col("event_type") == "click", two).when(F.col("event_type") == "error", many).when(F.col("event_type") == "view", "Nothing is due")
    return outline.announced(table(spark, sf_dir, "events").select(k.alias("post_id"), body.alias("text"), (k % 10 == 0).alias("hidden")))


@query(f"""WITH p AS (SELECT p_partkey // 40 AS course_id, p_partkey, p_name, p_type, p_size FROM part),
l AS (SELECT DISTINCT course_id, 0 AS part, 0 AS ord, 'CIS*' || course_id || '::F26' AS line FROM p UNION ALL SELECT course_id, 1, p_partkey, p_name || '|' || p_size || '|exact||' FROM p
  UNION ALL SELECT course_id, 2, p_partkey, p_type || '||best|drop0' FROM p WHERE p_size % 10 = 0 UNION ALL SELECT course_id, 3, p_partkey, p_size || '|lab|' || p_name FROM p WHERE p_size % 15 = 0),
t AS (SELECT course_id, string_agg(line, '::' ORDER BY part, ord) AS text FROM l GROUP BY 1)
SELECT course_id, ltrim(substr({_FNV}, 5, 8), '0') AS fingerprint FROM t""")
def outline_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the outlines of courses of forty parts mean, hashed."""
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").withColumns({"course_id": F.floor(k / 40), "ord": k})
    heads = p.select("course_id").distinct().select("course_id", F.concat(F.lit("CIS*"), F.col("course_id").cast("string")).alias("code"), F.lit("F26").alias("term"))
    lines = lambda rows, *texts: rows.select("course_id", "ord", F.concat(*texts).alias("line"))
    s = size.cast("string")
    return outline.fingerprints(
        heads,
        lines(p, "p_name", F.lit("|"), s, F.lit("|exact||")),
        lines(p.filter(size % 10 == 0), "p_type", F.lit("||best|drop0")),
        lines(p.filter(size % 15 == 0), s, F.lit("|lab|"), "p_name"),
    )


@query(f"""WITH {ASSESSMENTS}, {STANDING.format(source="a")}, p AS (SELECT *, course_id % 100 AS student, row_number() OVER (PARTITION BY course_id % 100 ORDER BY course_id) AS place FROM t)
SELECT student, course_id, place, 'C' || course_id || CASE WHEN calculated IS NOT NULL THEN printf(': %.1f%% on %.0f%% graded', floor(calculated * 10 + 0.5) / 10, floor(completed_weight + 0.5)) ELSE ': standing unknown (' || graded_count || ' graded)' END AS line FROM p WHERE place <= 6""")
def standing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line on each of the first six courses of each student, who has the orders that share the last two digits."""
    s = grades.standing(assessments(spark, sf_dir))
    course = F.col("course_id")
    rows = s.select((course % 100).alias("student"), "course_id", course.alias("ord"), F.concat(F.lit("C"), course.cast("string")).alias("code"), F.col("calculated_percent").alias("calculated"), F.col("completed_weight").alias("completed"), F.col("graded_count").alias("graded"))
    return day.standing_lines(rows)
