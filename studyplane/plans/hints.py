"""Queries on what titles, texts and dates say, on deadlines that rules and facts make, and on problems of a course."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import state, text
from ..operators import changes, deadlines
from .planning import ITEMS, ZONE, _now, items
from .registry import query, table

#: Titles of calendar entries made of a part.
CALENDAR = """c AS (SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'CIS*2' || lpad((p_partkey % 900)::VARCHAR, 3, '0') || ' Lab ' || (p_partkey % 7) WHEN 1 THEN 'Quiz ' || (p_partkey % 7) || ' due' WHEN 2 THEN 'Lecture Week ' || (p_partkey % 13)
  WHEN 3 THEN 'Essay draft due' WHEN 4 THEN 'Office  hours' WHEN 5 THEN 'MATH 1200' WHEN 6 THEN 'Tutorial quiz' WHEN 7 THEN 'A' || (p_partkey % 30) || ' dropbox' ELSE p_name END AS title, p_name FROM part)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda n: (k % n).cast("string")
    made = [F.concat(F.lit("CIS*2"), F.lpad(s(900), 3, "0"), F.lit(" Lab "), s(7)), F.concat(F.lit("Quiz "), s(7), F.lit(" due")), F.concat(F.lit("Lecture Week "), s(13)), F.lit("Essay draft due")]
    made += [F.lit("Office  hours"), F.lit("MATH 1200"), F.lit("Tutorial quiz"), F.concat(F.lit("A"), s(30), F.lit(" dropbox")), F.col("p_name")]
    return table(spark, sf_dir, "part").select(k.alias("id"), F.element_at(F.array(*made), (k % 9 + 1).cast("int")).alias("title"), "p_name")


@query(rf"""WITH {CALENDAR}, f AS (SELECT *, regexp_matches(lower(title), '\b(lecture|lab|tutorial|seminar|class|lec\b|office\s*hours|discussion)\b') AS meets,
  regexp_matches(lower(title), '\b(due|deadline|assignment|dropbox|submission|quiz|mid[- ]?term|final\s*exam|exam|test|homework|hw|a[0-9]{{1,2}})\b') AS late FROM c)
SELECT id, CASE WHEN regexp_matches(lower(title), '\boffice\s*hours\b') THEN 'office_hours' WHEN regexp_matches(lower(title), '\blab\b') THEN 'lab' WHEN regexp_matches(lower(title), '\btutorial|tut\b') THEN 'tutorial' WHEN regexp_matches(lower(title), '\bseminar\b') THEN 'seminar' ELSE 'lecture' END AS kind,
  meets OR (NOT late AND regexp_matches(lower(title), '\b(cis|engr|math|stat|phys|chem|biol|psyc|soc|hist|econ)\s*\*?\s*[0-9]{{3,4}}\b')) AS is_meeting, late AND NOT meets AS is_deadline,
  CASE WHEN regexp_matches(lower(title), '\bfinal\b') THEN 'final' WHEN regexp_matches(lower(title), '\blab\b') THEN 'lab' WHEN regexp_matches(lower(title), '\b(quiz|test)\b') THEN 'quiz' WHEN regexp_matches(lower(title), '\bassign|\b(homework|hw|essay|report)\b') THEN 'assignment' ELSE 'other' END AS outline_type,
  CASE WHEN regexp_extract(title, '[A-Za-z]+\*?([0-9]{{4}})', 1) <> '' THEN 'c' || regexp_extract(regexp_replace(title, '\s', '', 'g'), '[A-Za-z]+\*?([0-9]{{4}})', 1) WHEN regexp_extract(regexp_replace(title, '\s', '', 'g'), '[A-Za-z]+\*?([0-9]{{4}})', 1) <> '' THEN 'c' || regexp_extract(regexp_replace(title, '\s', '', 'g'), '[A-Za-z]+\*?([0-9]{{4}})', 1)
    ELSE left(lower(regexp_replace(title, '[^A-Za-z0-9]', '', 'g')), 12) END AS course_key,
  CASE WHEN regexp_extract(lower(title), '\bweek\s*([0-9]{{1,2}})\b', 1) <> '' THEN 'Week ' || regexp_extract(lower(title), '\bweek\s*([0-9]{{1,2}})\b', 1) END AS week FROM f""")
def calendar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return calendar(spark, sf_dir).select("id", text.meeting_kind(t).alias("kind"), text.is_schedule_title(t).alias("is_meeting"), text.is_deadline_title(t).alias("is_deadline"), text.outline_type(t).alias("outline_type"), text.course_key(t).alias("course_key"), text.week_hint(F.lit(None).cast("string"), t).alias("week"))


@query(rf"""WITH {CALENDAR}, k AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '\ba *#? *([0-9]+)\b', 'assignment \1', 'g'), '\bq *#? *([0-9]+)\b', 'quiz \1', 'g'), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS b FROM c)
SELECT id, CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 100 WHEN contains(a, b) OR contains(b, a) THEN 75 ELSE 0 END AS score FROM k""")
def title_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a part's calendar title names the part."""
    return calendar(spark, sf_dir).select("id", text.title_score(F.col("title"), F.col("p_name")).alias("score"))


@query(r"""SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), '') AS email FROM documents""")
def first_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.first_email(F.col("text")).alias("email"))


@query(r"""WITH d AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '<p>Meet in  Rozh ' || (100 + p_partkey % 90) || '</p>' WHEN 1 THEN '<b> </b>' WHEN 2 THEN p_name || ' and ' || p_name || ' again' ELSE NULL END AS t FROM part),
p AS (SELECT id, trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM d)
SELECT id, CASE WHEN regexp_extract(upper(t), '\b((RICH|SSC|MACN|MACK|ROZH|THRN|ANNU|CRSC|SCI|WMEM|UC|LA)\s*[0-9]{2,4}[A-Z]?)\b', 1) <> '' THEN regexp_extract(upper(t), '\b((RICH|SSC|MACN|MACK|ROZH|THRN|ANNU|CRSC|SCI|WMEM|UC|LA)\s*[0-9]{2,4}[A-Z]?)\b', 1)
  WHEN t <> '' THEN trim(left(t, 48)) END AS location FROM p""")
def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    said = F.when(k % 4 == 0, F.concat(F.lit("<p>Meet in  Rozh "), 100 + k % 90, F.lit("</p>"))).when(k % 4 == 1, "<b> </b>").when(k % 4 == 2, F.concat("p_name", F.lit(" and "), "p_name", F.lit(" again")))
    return table(spark, sf_dir, "part").select(k.alias("id"), text.location_of(said).alias("location"))


@query("""WITH c AS (SELECT p_partkey AS id, p_size % 6 + 2 AS n, p_size % 4 + 1 AS m, p_size::DOUBLE AS w, p_partkey % 4 AS k FROM part)
SELECT id, CASE k WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n + m END AS count, CASE k WHEN 0 THEN 2.5 WHEN 1 THEN w / n END AS instance_weight, CASE k WHEN 2 THEN m WHEN 3 THEN m END AS best_n, CASE WHEN k = 2 THEN n ELSE 0 END AS drop_lowest FROM c""")
def category_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the titles of categories say of their items."""
    n, m, k = F.col("p_size") % 6 + 2, F.col("p_size") % 4 + 1, F.col("p_partkey") % 4
    s = lambda c: c.cast("string")
    title = F.when(k == 0, F.concat(F.lit("Labs "), s(n), F.lit(" x 2.5%"))).when(k == 1, F.concat(F.lit("Quizzes ("), s(n), F.lit(")"))).when(k == 2, F.concat(F.lit("Quizzes (best "), s(m), F.lit(" of "), s(n + m), F.lit(")"))).otherwise(F.concat(F.lit("Best "), s(m), F.lit(" assignments")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.category_expansion(title, F.col("p_size").cast("double")).alias("e")).select("id", "e.*")


@query("""SELECT p_partkey AS id, '- ' || p_brand || chr(10) || '+ ' || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || '+ more' ELSE '' END AS diff FROM part""")
def line_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.concat(F.lit("same\n"), "p_brand", F.lit("\nend"))
    after = F.concat(F.lit("same\n"), "p_type", F.lit("\nend"), F.when(F.col("p_size") % 2 == 0, "\nmore").otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.line_diff(before, after).alias("diff"))


@query("""WITH c AS (SELECT p_partkey AS id, p_partkey % 7 AS k, p_size % 31 + 1 AS d FROM part)
SELECT id, CASE k WHEN 0 THEN '2026-10-01'::DATE + (d - 1)::INT WHEN 1 THEN '2026-02-01'::DATE + (d - 1)::INT WHEN 4 THEN '2025-09-01'::DATE + (d - 1)::INT WHEN 5 THEN '2026-03-05'::DATE END AS day,
  CASE WHEN k IN (0, 1, 4, 5) THEN 'exact' WHEN k IN (2, 3) THEN 'approximate' ELSE 'unknown' END AS certainty FROM c""")
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in words, the thirty-first of February among them."""
    k, d = F.col("p_partkey") % 7, (F.col("p_size") % 31 + 1).cast("string")
    label = F.when(k == 0, F.concat(F.lit("Due October "), d, F.lit("th"))).when(k == 1, F.concat(d, F.lit(" Feb, 2026"))).when(k == 2, F.concat(F.lit("Week "), d)).when(k == 3, "TBA in class").when(k == 4, F.concat(F.lit("Sept. "), d, F.lit(", 2025"))).when(k == 5, "by 2026-03-05").otherwise("soon")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), deadlines.date_label(label, 2026).alias("e")).select("id", "e.*")


@query(f"""WITH {ITEMS} SELECT id, submission = 'submitted' OR graded AS done, coalesce(hours / 24 BETWEEN -150 AND 200, true) AS in_window, us < 0 AND submission <> 'submitted' AND NOT id % 5 = 0 AS confirm,
  us < 0 AND id % 3 = 0 AND NOT graded AND submission <> 'submitted' AS closed_quiz FROM h""")
def item_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is done, near enough to keep, to be confirmed, or a closed quiz that nobody is known to have missed."""
    c = F.col
    none = F.lit(None).cast("string")
    return items(spark, sf_dir).select(
        "id",
        state.is_done(c("submission"), none, none, F.when(c("graded"), 1.0), none).alias("done"),
        state.in_window(c("due"), _now()).alias("in_window"),
        state.needs_confirmation(c("due"), c("submission"), c("id") % 5 == 0, _now()).alias("confirm"),
        state.closed_quiz(c("due"), (c("id") % 3 != 0).cast("int"), F.when(c("graded"), 1.0), c("submission"), _now()).alias("closed_quiz"),
    )


@query("""SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 90 WHEN 1 THEN 60 WHEN 2 THEN 100 WHEN 3 THEN 75 ELSE 0 END AS due_rank, CASE event_id % 5 WHEN 0 THEN 50 WHEN 1 THEN 85 WHEN 2 THEN 100 WHEN 3 THEN 40 ELSE 0 END AS weight_rank,
  CASE event_id % 3 WHEN 0 THEN 100 WHEN 1 THEN 70 ELSE 10 END AS authority FROM events""")
def source_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    source = pick(5, "courselink_dropbox", "course_outline", "manual", "courselink_news", "elsewhere")
    authority = pick(3, "REGISTRAR_OFFICIAL", "STAFF_DISCUSSION", "EXTERNAL_UNVERIFIED")
    return table(spark, sf_dir, "events").select(k.alias("id"), changes.rank_of(source, "due").alias("due_rank"), changes.rank_of(source, "weight").alias("weight_rank"), changes.rank_of(authority, "authority").alias("authority"))


@query("""WITH o AS (SELECT l_orderkey AS course_id, l_orderkey || '-' || l_linenumber AS occurrence_id, CASE WHEN l_linenumber % 2 = 0 THEN 'lab' ELSE 'lecture' END AS kind, l_shipdate::DATE AS day, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey) * 2 AS number,
    l_shipdate + INTERVAL 20 HOUR AS end_at FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS copy FROM lineitem) WHERE copy = 1 AND l_returnflag <> 'R'),
i AS (SELECT o_orderkey AS item_id, o_orderkey AS course_id, o_orderkey % 4 + 1 AS n, o_orderkey % 5 AS k FROM orders WHERE o_orderkey % 3 <> 0),
a AS (SELECT *, 'r1' AS rule_id, 1 AS ord, 'lab' AS kind, n AS wanted, 8 AS plus FROM i WHERE k IN (0, 1, 2) UNION ALL SELECT *, 'r2', 2, 'lecture', 1, 0 FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY course_id, kind ORDER BY day, occurrence_id) AS place FROM o),
h AS (SELECT a.*, coalesce(x.occurrence_id, y.occurrence_id) AS occurrence_id, coalesce(x.day, y.day) AS day, coalesce(x.end_at, y.end_at) AS end_at FROM a LEFT JOIN p x ON x.course_id = a.course_id AND x.kind = a.kind AND x.number = a.wanted LEFT JOIN p y ON y.course_id = a.course_id AND y.kind = a.kind AND y.place = a.wanted)
SELECT item_id, arg_min(rule_id, ord) AS rule_id, arg_min(occurrence_id, ord) AS occurrence_id, strftime(arg_min(CASE WHEN ord = 2 THEN end_at ELSE ((day + 8)::TIMESTAMP + INTERVAL 12 HOUR) AT TIME ZONE 'America/Toronto' AT TIME ZONE 'UTC' END, ord), '%Y-%m-%d %H:%M:%S') AS due FROM h WHERE occurrence_id IS NOT NULL GROUP BY 1""")
def derived_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are due eight days after the lab of their number, else at the end of the first lecture."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_shipdate", "l_returnflag", "l_partkey", "l_suppkey"), F.struct("l_partkey", "l_suppkey")).alias("x")).select("l_orderkey", "l_linenumber", "x.*").filter("l_returnflag <> 'R'")
    w = Window.partitionBy("l_orderkey", F.col("l_linenumber") % 2).orderBy("l_linenumber", "l_partkey", "l_suppkey")
    occurrences = li.select(
        F.col("l_orderkey").alias("course_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("occurrence_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "lab").otherwise("lecture").alias("kind"),
        F.to_date("l_shipdate").alias("day"),
        (F.row_number().over(w) * 2).alias("number"),
        (F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 20 HOURS")).alias("end_at"),
        F.lit(False).alias("cancelled"),
    )
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    none = F.lit(None)
    source = F.when(k % 3 == 0, "courselink_quiz").otherwise("course_outline")
    rows = o.select(k.alias("item_id"), k.alias("course_id"), F.concat(F.lit("Lab "), k % 4 + 1).alias("title"), F.when(k % 5 <= 2, "lab").otherwise("quiz").alias("type"), F.lit("exact").alias("certainty"), F.col("o_orderdate").alias("due"), source.alias("source"), F.lit(False).alias("overridden"))
    rule = lambda name, at, types, kind, number, plus, wall, end: F.struct(F.lit(name).alias("rule_id"), F.lit(at).alias("ord"), types.cast("array<string>").alias("types"), none.cast("string").alias("word"), F.lit(kind).alias("meeting_kind"), none.cast("int").alias("day_of_week"), F.lit(number).cast("int").alias("number"), F.lit(plus).alias("offset_days"), F.lit(wall).cast("string").alias("at"), F.lit(end).alias("at_end"))
    rules = o.select(k.alias("course_id"), F.inline(F.array(rule("r1", 1, F.array(F.lit("lab")), "lab", None, 8, "12:00", False), rule("r2", 2, F.array(), "lecture", 1, 0, None, True))))
    return deadlines.derived(rows, rules, occurrences, ZONE).withColumn("due", F.date_format("due", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH f AS (SELECT user_id AS item_id, event_id AS ord, ts::DATE AS day, CASE event_id % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 ELSE 0.4 END AS sure FROM events WHERE event_type = 'click'),
r AS (SELECT item_id, ord, CASE WHEN sure >= 0.7 OR row_number() OVER w = 1 THEN day END AS sets, day, sure, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY item_id ORDER BY ord)),
s AS (SELECT *, last_value(sets IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM r)
SELECT item_id, strftime(arg_max(sets, ord) FILTER (WHERE sets IS NOT NULL), '%Y-%m-%d') AS due, count(*) FILTER (WHERE k > 1 AND day <> was AND sure >= 0.7) AS n_changed, count(*) FILTER (WHERE k > 1 AND day <> was AND sure < 0.7) AS n_reviews, count(*) FILTER (WHERE k > 1 AND day <> was AND sure >= 0.7 AND sure < 0.85) AS unsettled FROM s GROUP BY 1""")
def deadline_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of a user as facts about the deadline of their item, folded in order."""
    e = table(spark, sf_dir, "events").filter("event_type = 'click'")
    k = F.col("event_id") % 4
    facts = e.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("ord"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("due"), F.lit(None).cast("string").alias("label"), F.when(k == 0, 0.9).when(k == 1, 0.75).otherwise(0.4).alias("confidence"))
    rows = e.select(F.col("user_id").alias("item_id")).distinct().withColumn("due", F.lit(None).cast("timestamp"))
    return deadlines.clarified(rows, facts).select("item_id", F.date_format("due", "yyyy-MM-dd").alias("due"), F.size("changed").cast("long").alias("n_changed"), F.size("reviews").cast("long").alias("n_reviews"), "unsettled")


@query("""WITH n AS (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) / 3.6e9 AS h, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto')::DATE = '2024-01-10'::DATE AS today FROM events)
SELECT user_id AS course_id, arg_min(event_id, (NOT today, ts, event_id)) AS meeting_id, arg_min(event_type, (NOT today, ts, event_id)) AS kind FROM n WHERE h BETWEEN -1 AND 36 GROUP BY 1""")
def soon_meetings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event around a fixed noon, those of that day first."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("course_id"), F.col("event_id").alias("meeting_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("start"))
    return deadlines.soon_meetings(e, F.lit("2024-01-10 12:00:00").cast("timestamp"), ZONE).drop("start")


@query(f"""WITH {ITEMS} SELECT course_id, arg_min(id, (due, id)) AS id FROM h WHERE us >= 0 GROUP BY 1""")
def next_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deadlines.next_of(items(spark, sf_dir), "course_id", "due", _now(), ["id"])
