"""Queries on links between what titles name: parts are items of courses of forty parts, and lines, pages and events speak of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import linking
from .library import _KEY, TITLE_SQL, titled
from .registry import query, table

#: Parts as items; their courses are of forty parts, however many there are.
WORK = f"""w AS (SELECT p_partkey AS item_id, p_partkey // 40 AS course_id, p_partkey % 10 AS tool_id, title, {_KEY.format("lower(title)")} AS key FROM (SELECT *, {TITLE_SQL} AS title FROM part))"""

#: Lines of orders as grades of the course of their part.
GRADES = f"""g AS (SELECT *, {_KEY.format("lower(title)")} AS key FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS grade_id, l_partkey // 40 AS course_id, CASE WHEN l_linenumber = 1 THEN l_partkey % 12 END AS tool_id,
  CASE l_linenumber % 7 WHEN 0 THEN 'Quiz ' || (l_partkey % 7) || ' (online)' WHEN 1 THEN 'Exam' WHEN 2 THEN 'HW ' || (l_partkey % 5) WHEN 3 THEN 'Project plan' WHEN 4 THEN 'Q' || (l_partkey % 9) WHEN 5 THEN '' ELSE 'Laboratory ' || (l_partkey % 3) END AS title FROM lineitem))"""

CATEGORIES = """c AS (SELECT course_id, k.ord, k.name, k.key FROM (SELECT DISTINCT course_id FROM w), (VALUES (1, 'Laboratories', 'laboratories'), (2, 'Quizzes', 'quizzes'), (3, 'Quiz', 'quiz'), (4, 'Exams', 'exam')) k(ord, name, key))"""


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    t = titled(spark, sf_dir)
    return t.select(k.alias("item_id"), F.floor(k / 40).alias("course_id"), (k % 10).alias("tool_id"), "title", text.title_key(F.col("title")).alias("key"), k.alias("ord"))


def _pick(which: Column, *values: Column | str) -> Column:
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (which + 1).cast("int"))


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    s = lambda n: (p % n).cast("string")
    title = _pick(F.col("l_linenumber") % 7, F.concat(F.lit("Quiz "), s(7), F.lit(" (online)")), "Exam", F.concat(F.lit("HW "), s(5)), "Project plan", F.concat(F.lit("Q"), s(9)), "", F.concat(F.lit("Laboratory "), s(3)))
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("grade_id"), F.floor(p / 40).alias("course_id"), F.when(F.col("l_linenumber") == 1, p % 12).alias("tool_id"), text.title_key(title).alias("key"))


@query(f"""WITH {WORK}, {GRADES}, {CATEGORIES}, k AS (SELECT DISTINCT course_id, tool_id, key FROM g),
n AS (SELECT k.course_id, k.tool_id, k.key, min(w.item_id) FILTER (WHERE w.tool_id = k.tool_id) AS of_tool, arg_min(w.item_id, (w.key <> k.key, w.item_id)) FILTER (WHERE contains(w.key, k.key) OR contains(k.key, w.key)) AS of_title FROM k LEFT JOIN w USING (course_id) GROUP BY ALL),
h AS (SELECT k.course_id, k.tool_id, k.key, arg_min(c.name, c.ord) AS category_id FROM k JOIN c ON c.course_id = k.course_id AND contains(k.key, left(c.key, 8)) GROUP BY ALL)
SELECT grade_id, coalesce(of_tool, of_title) AS item_id, category_id, coalesce(of_tool, of_title) IS NULL AS unmatched FROM g LEFT JOIN n ON n.course_id = g.course_id AND n.key = g.key AND n.tool_id IS NOT DISTINCT FROM g.tool_id
LEFT JOIN h ON h.course_id = g.course_id AND h.key = g.key AND h.tool_id IS NOT DISTINCT FROM g.tool_id""")
def gradebook_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a grade, with its item and category."""
    w = work(spark, sf_dir)
    kinds = F.inline(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("category_id"), F.lit(k).alias("key")) for i, n, k in ((1, "Laboratories", "laboratories"), (2, "Quizzes", "quizzes"), (3, "Quiz", "quiz"), (4, "Exams", "exam")))))
    return linking.gradebook_map(_grades(spark, sf_dir), w, w.select("course_id").distinct().select("course_id", kinds))


@query(f"""WITH {WORK}, h AS (SELECT event_id AS fact_id, event_id % (SELECT max(course_id) + 1 FROM w) AS course_id, CASE event_id % 6 WHEN 0 THEN 'quiz ' || (event_id % 9) WHEN 1 THEN 'midterm' WHEN 2 THEN 'mid term exam' WHEN 3 THEN 'assignment ' || (event_id % 6) WHEN 4 THEN '' ELSE 'final exam' END AS key FROM events),
k AS (SELECT DISTINCT course_id, key FROM h WHERE key <> ''), m AS (SELECT k.course_id, k.key, arg_min(w.item_id, (w.key <> k.key, w.item_id)) AS item_id, CASE WHEN bool_or(w.key = k.key) THEN 100 ELSE 70 END AS score, min(w.item_id) AS first_id FROM k JOIN w ON w.course_id = k.course_id AND (contains(w.key, k.key) OR contains(k.key, w.key)) GROUP BY ALL)
SELECT fact_id, item_id, score, first_id FROM h JOIN m USING (course_id, key)""")
def fact_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints of facts and the item of their course that they name best (item_id, score), and the first one that they name at all (first_id)."""
    w = work(spark, sf_dir)
    e = F.col("event_id")
    s = lambda n: (e % n).cast("string")
    last = w.agg((F.max("course_id") + 1).alias("n"))  # one row
    key = _pick(e % 6, F.concat(F.lit("quiz "), s(9)), "midterm", "mid term exam", F.concat(F.lit("assignment "), s(6)), "", "final exam")
    h = table(spark, sf_dir, "events").join(F.broadcast(last)).select(e.alias("fact_id"), (e % F.col("n")).alias("course_id"), key.alias("key"))
    return h.join(linking.shuffled(linking.by_title(h, w, empty=False)), ["course_id", "key"]).select("fact_id", "item_id", "score", "first_id")


TOPICS = """t AS (SELECT event_id AS topic_id, event_id % (SELECT max(course_id) + 1 FROM w) AS course_id, CASE event_id % 5 WHEN 0 THEN 'Assignment ' || (event_id % 7) || ' handout' WHEN 1 THEN 'Mid-term exam and more' WHEN 2 THEN 'QUIZ #' || (event_id % 9) WHEN 3 THEN 'Reading list' ELSE 'hw' || (event_id % 6) END AS title FROM events)"""


def _topics(spark: SparkSession, sf_dir: str, w: DataFrame) -> DataFrame:
    e = F.col("event_id")
    s = lambda n: (e % n).cast("string")
    title = _pick(e % 5, F.concat(F.lit("Assignment "), s(7), F.lit(" handout")), "Mid-term exam and more", F.concat(F.lit("QUIZ #"), s(9)), "Reading list", F.concat(F.lit("hw"), s(6)))
    return table(spark, sf_dir, "events").join(F.broadcast(w.agg((F.max("course_id") + 1).alias("n")))).select(e.alias("topic_id"), (e % F.col("n")).alias("course_id"), title.alias("title"))


_NUMBERED = r"'\b(assignment|lab|quiz|project|homework|a)\s*#?\s*([0-9]+)\b'"


@query(rf"""WITH {WORK}, {TOPICS}, x AS (SELECT w.*, lower(title) AS low, regexp_extract(lower(title), {_NUMBERED}, ['kind', 'number']) AS m FROM w), y AS (SELECT DISTINCT course_id, lower(title) AS low, regexp_extract(lower(title), {_NUMBERED}, ['kind', 'number']) AS m FROM t),
h AS (SELECT y.course_id, y.low, min(x.item_id) FILTER (WHERE contains(y.low, x.low) OR contains(x.low, left(y.low, 24))) AS a, min(x.item_id) FILTER (WHERE x.m = y.m AND y.m.kind <> '') AS b FROM x JOIN y USING (course_id) GROUP BY ALL)
SELECT topic_id, coalesce(a, b) AS item_id FROM t JOIN h ON h.course_id = t.course_id AND h.low = lower(t.title) WHERE coalesce(a, b) IS NOT NULL""")
def content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content of a course and the item that its title names, in whole or by kind and number."""
    w = work(spark, sf_dir)
    return linking.content_items(_topics(spark, sf_dir, w), w)


@query(rf"""WITH {WORK}, {TOPICS}, k AS (SELECT *, {_KEY.format("lower(title)")} AS name FROM t)
SELECT topic_id AS post_id, min(w.item_id) AS item_id FROM k JOIN w ON w.course_id = k.course_id AND w.key <> '' AND contains(k.name, left(w.key, 12)) GROUP BY 1""")
def post_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item that a staff post is about by its words alone."""
    w = work(spark, sf_dir)
    posts = _topics(spark, sf_dir, w).select(F.col("topic_id").alias("post_id"), "course_id", text.title_key(F.col("title")).alias("key"))
    return linking.about(posts, w)


@query(f"""WITH {WORK}, {TOPICS}, n AS (SELECT course_id, lower(title) AS low, topic_id % 5 = 3 AS always, count(*) AS n FROM t GROUP BY ALL)
SELECT w.item_id, coalesce(sum(n) FILTER (WHERE always OR contains(low, left(lower(w.title), 8))), 0)::BIGINT AS n_related FROM w LEFT JOIN n USING (course_id) GROUP BY 1""")
def related_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of its course belong to an item, by their class or the head of its title."""
    w = work(spark, sf_dir)
    return linking.related(w, _topics(spark, sf_dir, w).select("course_id", F.col("title").alias("text"), (F.col("topic_id") % 5 == 3).alias("always")), 8)


@query("""WITH p AS (SELECT c_nationkey AS course_id, CASE c_custkey % 4 WHEN 0 THEN 'instructor' WHEN 1 THEN 'ta' WHEN 2 THEN 'staff' ELSE 'student' END AS role, unnest([c_mktsegment, c_mktsegment || ' ' || (c_custkey % 3)]) AS name FROM customer),
a AS (SELECT * FROM p UNION ALL SELECT n_nationkey, 'instructor', n_name FROM nation)
SELECT course_id, array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE role = 'instructor')), ',') AS instructors, coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE role = 'ta')), ','), '') AS tas, array_to_string(list_sort(list(DISTINCT name) FILTER (WHERE role <> 'student')), ',') AS everyone FROM a GROUP BY 1""")
def staff_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as courses that name one instructor, and customers as people with an alias."""
    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("course_id"), _pick(k % 4, "instructor", "ta", "staff", "student").alias("role"), F.col("c_mktsegment").alias("name"), F.array(F.concat("c_mktsegment", F.lit(" "), (k % 3).cast("string"))).alias("aliases"))
    courses = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("course_id"), F.array("n_name").alias("instructor_names"))
    found = linking.staff_names(courses, people)
    return found.select("course_id", *(F.array_join(c, ",").alias(c) for c in ("instructors", "tas", "everyone")))


@query(r"""WITH t AS (SELECT o_custkey AS course_id, o_orderkey AS ord, o_orderkey % 2 = 0 AS is_item, CASE o_orderkey % 6 WHEN 0 THEN 'zyBook Q' || (o_orderkey % 25) WHEN 1 THEN 'Activity q ' || (o_orderkey % 7) WHEN 2 THEN 'zyBooks, best 5 of 6' WHEN 3 THEN 'Chapter 3' WHEN 4 THEN 'Sleep' ELSE 'Q' || (o_orderkey % 4 + 1) || ' to Q' || (o_orderkey % 9 + 1) END AS title FROM orders),
m AS (SELECT course_id, ord, is_item, lower(title) AS low, list_filter(list_transform(regexp_extract_all(lower(title), 'q\s*([1-9][0-9]?)\b', 1), lambda x: x::INT), lambda n: n <= 20) AS said, regexp_extract(lower(title), '\bq\s*([1-9][0-9]?) to q([1-9][0-9]?)\b', ['a', 'b']) AS r FROM t),
s AS (SELECT course_id, unnest(said) AS n FROM m UNION SELECT course_id, unnest(range(least(a, b), least(greatest(a, b), 20) + 1)) FROM (SELECT course_id, arg_min(r.a::INT, ord) AS a, arg_min(r.b::INT, ord) AS b FROM m WHERE r.a <> '' GROUP BY 1)),
b AS (SELECT course_id, bool_or(contains(low, 'zybook')) AS book, bool_or(regexp_matches(low, 'best\s*5\s*(of|/)\s*6')) AS five FROM m GROUP BY 1),
f AS (SELECT * FROM s UNION ALL SELECT course_id, unnest(range(1, 7)) FROM b WHERE book AND five AND course_id NOT IN (SELECT course_id FROM s)),
c AS (SELECT course_id, count(*) AS n FROM f GROUP BY 1), i AS (SELECT DISTINCT course_id, unnest(said) AS n FROM m WHERE is_item AND contains(low, 'zybook'))
SELECT f.course_id, f.n::INT AS number, CASE WHEN c.n >= 6 THEN 5 ELSE greatest(1, c.n - 1) END::INT AS best_n, greatest(c.n, 6)::INT AS group_size, i.n IS NULL AS synthetic FROM f JOIN c USING (course_id) JOIN b USING (course_id) LEFT JOIN i ON i.course_id = f.course_id AND i.n = f.n WHERE c.n >= 3 OR book""")
def external_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activities of an online textbook that a customer's orders mention, as titles of content and items."""
    k = F.col("o_orderkey")
    s = lambda n, plus=0: (k % n + plus).cast("string")
    title = _pick(k % 6, F.concat(F.lit("zyBook Q"), s(25)), F.concat(F.lit("Activity q "), s(7)), "zyBooks, best 5 of 6", "Chapter 3", "Sleep", F.concat(F.lit("Q"), s(4, 1), F.lit(" to Q"), s(9, 1)))
    return linking.activities(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("course_id"), k.alias("ord"), title.alias("title"), (k % 2 == 0).alias("is_item")))
