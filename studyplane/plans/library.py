"""Text queries: titles, matching, hashes, classes, search, redaction, traces, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import matching, search
from .registry import query, table


#: Titles made of a part: its kind and number in turn, as coursework titles are written. A course is a brand's parts of one thousand keys.
TITLE_SQL = """CASE p_partkey % 8 WHEN 0 THEN 'Assignment #' || (p_partkey % 5) WHEN 1 THEN 'A' || (p_partkey % 5) || ' ' || p_name WHEN 2 THEN 'Quiz ' || (p_partkey % 7)
  WHEN 3 THEN 'Q' || (p_partkey % 7) WHEN 4 THEN 'Laboratory ' || (p_partkey % 3) || ': ' || p_name WHEN 5 THEN 'Mid-term exam' WHEN 6 THEN 'HW ' || (p_partkey % 5) ELSE 'Final Exam ' || p_name END"""


def titled(spark: SparkSession, sf_dir: str, course: Column | None = None) -> DataFrame:
    k = F.col("p_partkey")
    s = lambda n: (k % n).cast("string")
    made = [
        F.concat(F.lit("Assignment #"), s(5)),
        F.concat(F.lit("A"), s(5), F.lit(" "), "p_name"),
        F.concat(F.lit("Quiz "), s(7)),
        F.concat(F.lit("Q"), s(7)),
        F.concat(F.lit("Laboratory "), s(3), F.lit(": "), "p_name"),
        F.lit("Mid-term exam"),
        F.concat(F.lit("HW "), s(5)),
        F.concat(F.lit("Final Exam "), "p_name"),
    ]
    p = table(spark, sf_dir, "part").withColumn("title", F.element_at(F.array(*made), (k % 8 + 1).cast("int")))
    course = F.concat_ws("/", "p_brand", F.floor(k / 1000).cast("string")) if course is None else course
    return p.select(k.alias("id"), course.alias("course_id"), "title", text.title_type(F.col("title")).alias("type"), (F.lit("2026-09-01").cast("timestamp") + F.make_dt_interval(days=(k % 60).cast("int"))).alias("due"), F.col("p_size").cast("double").alias("weight"), k.alias("ord"))


_KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\bassign(ment)?s?\b', 'assignment', 'g'), '\b(hw|homework)\b', 'assignment', 'g'),
  '\ba *#? *([0-9]+)\b', 'assignment \1', 'g'), '\bq *#? *([0-9]+)\b', 'quiz \1', 'g'), '[^a-z0-9]+', ' ', 'g'))"""
_WIDE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), 'quizzes', 'quiz', 'g'), 'laborator(y|ies)', 'lab', 'g'), 'mid[ -]?terms?', 'midterm', 'g'),
  'final +exam(ination)?s?', 'final', 'g'), '\bl *#? *([0-9]+)\b', 'lab \1', 'g'), '\bp *#? *([0-9]+)\b', 'project \1', 'g')"""
TITLED = rf"""
p AS (SELECT p_partkey AS id, p_brand || '/' || (p_partkey // 1000) AS course_id, {TITLE_SQL} AS title, TIMESTAMP '2026-09-01' + to_days((p_partkey % 60)::INT) AS due FROM part),
k AS (SELECT *, {_KEY.format("lower(title)")} AS title_key,
   coalesce(nullif(regexp_extract(lower(title), '\b(?:assignment|quiz|lab|project|homework|hw) *#? *([0-9]+)', 1), ''), nullif(regexp_extract(lower(title), '\b[aqhlp] *#? *([0-9]+)\b', 1), ''),
     nullif(regexp_extract(lower(title), '# *([0-9]+)', 1), ''), nullif(regexp_extract(lower(title), '\b([0-9]+)\b', 1), '')) AS number_hint,
   CASE WHEN regexp_matches(lower(title), '\bfinal\b') THEN 'final' WHEN regexp_matches(lower(title), '\bmid[- ]?term\b') THEN 'midterm' WHEN regexp_matches(lower(title), '\blab\b') THEN 'lab'
     WHEN regexp_matches(lower(title), '\bproject\b') THEN 'project' WHEN regexp_matches(lower(title), '\bpresentation\b') THEN 'presentation' WHEN regexp_matches(lower(title), '\b(participation|attendance)\b') THEN 'participation'
     WHEN regexp_matches(lower(title), '\b(discussion|forum)\b') THEN 'discussion' WHEN regexp_matches(lower(title), '\b(quiz|test)\b') THEN 'quiz' WHEN regexp_matches(lower(title), '\bassign|\b(homework|hw)\b') THEN 'assignment' ELSE 'other' END AS type,
   list_sort(list_distinct(list_filter(string_split({_KEY.format("lower(title)")}, ' '), lambda t: length(t) > 1))) AS tokens,
   list_sort(list_distinct(list_filter(string_split({_KEY.format(_WIDE)}, ' '), lambda t: length(t) > 0))) AS wide FROM p)"""


@query(f"WITH {TITLED} SELECT id, title_key, number_hint, type FROM k")
def title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return titled(spark, sf_dir).select("id", text.title_key(t).alias("title_key"), text.number_hint(t).alias("number_hint"), "type")


_SHARE = "CASE WHEN len(a.{0}) = 0 OR len(b.{0}) = 0 THEN 0 ELSE len(list_intersect(a.{0}, b.{0})) / (len(a.{0}) + len(b.{0}) - len(list_intersect(a.{0}, b.{0}))) END"


@query(f"""WITH {TITLED}, c AS (SELECT min(id) AS id, count(*) AS n, course_id, title_key, number_hint, type, tokens, wide, due FROM k GROUP BY ALL),
m AS (SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, CASE WHEN a.title_key = b.title_key THEN 0.98
   WHEN NOT (a.type = b.type OR (a.type = 'assignment' AND b.type IN ('project', 'other')) OR (a.type = 'lab' AND b.type IN ('assignment', 'other')) OR (a.type = 'project' AND b.type IN ('assignment', 'other'))
     OR (a.type = 'midterm' AND b.type IN ('quiz', 'other')) OR (a.type IN ('quiz', 'final', 'participation', 'presentation', 'discussion') AND b.type = 'other')
     OR (a.type = 'other' AND b.type IN ('assignment', 'quiz', 'lab', 'project'))) OR coalesce(a.number_hint <> b.number_hint, false) THEN 0
   ELSE greatest(0, least(1, greatest({_SHARE.format("tokens")}, {_SHARE.format("wide")}) + CASE WHEN a.number_hint = b.number_hint THEN 0.25 ELSE 0 END
     + CASE WHEN abs(epoch(a.due) - epoch(b.due)) <= 3 * 86400 THEN 0.15 WHEN abs(epoch(a.due) - epoch(b.due)) > 21 * 86400 THEN -0.2 ELSE 0 END)) END::DOUBLE AS score
  FROM c a JOIN c b ON a.course_id = b.course_id AND a.id < b.id)
SELECT a, b, n_a, n_b, round(score, 6) AS score FROM m WHERE round(score, 6) >= 0.72 UNION ALL SELECT id, id, n, n, 0.98 FROM c WHERE n > 1""")
def match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of parts of one course that name the same item."""
    return matching.match_pairs(titled(spark, sf_dir))


@query(f"""WITH {TITLED} SELECT id, min(id) OVER (PARTITION BY course_id, title_key, number_hint, type, tokens, wide, due) AS class_id FROM k""")
def match_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each part, so that the pairs of classes say what every row matches."""
    return matching.match_classes(titled(spark, sf_dir)).select(F.explode("ids").alias("id"), F.col("id").alias("class_id"))


@query()
def reconcile_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand folded into the items that their titles name; the brand is the course, whole."""
    return matching.reconcile(titled(spark, sf_dir, F.col("p_brand")))


_FNV = """'fnv_' || lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(text, ''), lambda c: unicode(c)::BIGINT)), lambda h, u: (xor(h, u) * 16777619) % 4294967296))), 8, '0') || '_' || length(text)"""


@query(f"SELECT doc_id, CASE WHEN text = '' THEN 'fnv_811c9dc5_0' ELSE {_FNV} END AS content_hash FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("""WITH b AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END) AS h FROM documents)
SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'initial' WHEN a.h <> b.h THEN 'semantic' ELSE 'unchanged' END AS revision FROM a LEFT JOIN b USING (doc_id)""")
def artifact_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are new or differ from the previous revision, by hash."""
    d = table(spark, sf_dir, "documents")
    before = d.filter("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("old"))
    after = d.select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("new"))
    kind = F.when(F.col("old").isNull(), "initial").when(F.col("old") != F.col("new"), "semantic").otherwise("unchanged")
    return after.join(before, "doc_id", "left").select("doc_id", kind.alias("revision"))


_CLASS = r"lower(concat_ws(' ', source, left(coalesce(text, ''), 400)))"


@query(rf"""WITH c AS (SELECT doc_id, {_CLASS} AS t FROM documents) SELECT doc_id, CASE WHEN regexp_matches(t, 'outline|syllabus') THEN 'course_outline' WHEN contains(t, 'rubric') THEN 'grading_rubric'
  WHEN regexp_matches(t, 'grad(e|ing)\s*scheme|weighting') THEN 'grading_scheme' WHEN regexp_matches(t, 'academic\s*integrity|policy|accommodation') THEN 'policy' WHEN regexp_matches(t, '\bfaq\b|frequently\s+asked') THEN 'faq'
  WHEN regexp_matches(t, 'exam|mid[- ]?term|test\s+info') AND NOT contains(t, 'practice') THEN 'exam_information' WHEN regexp_matches(t, 'schedule|course\s+calendar') THEN 'course_schedule'
  WHEN regexp_matches(t, 'starter|skeleton|template\s*code|\.zip|\.tar') THEN 'starter_code_metadata' WHEN regexp_matches(t, '\blab\b|laboratory') THEN 'lab_instructions' WHEN regexp_matches(t, 'tutorial|tut\s*[0-9]') THEN 'tutorial'
  WHEN regexp_matches(t, 'assignment|a\s*[0-9]+|homework|\bhw\b|specification|spec\b') THEN 'assignment_specification' WHEN regexp_matches(t, 'slides|powerpoint|\.ppt') THEN 'lecture_slides'
  WHEN regexp_matches(t, 'lecture|notes|handout') THEN 'lecture_notes' WHEN regexp_matches(t, 'reading|chapter|textbook|article') THEN 'reading' WHEN regexp_matches(t, 'reference|cheat\s*sheet|appendix') THEN 'reference'
  WHEN regexp_matches(t, 'addendum|errata') THEN 'syllabus_addendum' ELSE 'unknown' END AS document_class FROM c""")
def document_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document by its source, as a title, and the beginning of its text, which is all that classing looks at."""
    return table(spark, sf_dir, "documents").select("doc_id", text.document_class(F.col("source"), F.col("text")).alias("document_class"))


@query(r"""SELECT doc_id, (CASE WHEN len(regexp_extract_all(lower(text), '[0-9]{1,3}\s*%')) >= 3 THEN 30 ELSE 0 END) + (CASE WHEN regexp_matches(lower(text), '\b(evaluation|grading|assessment|marking scheme|grade breakdown)\b') THEN 25 ELSE 0 END)
  + (CASE WHEN regexp_matches(lower(text), '\b(mid[- ]?term|final\s+exam)\b') THEN 15 ELSE 0 END) + (CASE WHEN regexp_matches(lower(text), '\b(instructor|professor)\b') THEN 10 ELSE 0 END)
  + (CASE WHEN regexp_matches(lower(text), '\b(best\s*[0-9]+|drop\s*(the\s+)?lowest)\b') THEN 12 ELSE 0 END) + (CASE WHEN regexp_matches(lower(text), '\b(syllabus|course\s*outline)\b') THEN 10 ELSE 0 END)
  + (CASE WHEN regexp_matches(lower(text), '\blecture\s*[0-9]+|assignment\s*solution|answer\s*key\b') THEN -20 ELSE 0 END) AS score FROM documents""")
def outline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.outline_score(F.col("text")).alias("score"))


@query(r"""WITH h AS (SELECT page_id, lower(coalesce(url, '')) AS u FROM pages), n AS (SELECT *, regexp_matches(u, '\b(course[\s_-]*outline|syllabus|course\s*info(rmation)?|welcome\s*package|course\s*overview|(grading|evaluation)\s*scheme|assessment\s*overview)\b') AS named,
   regexp_matches(u, '\.(pdf|txt|html?|rtf|md)(\?|$)') AS file, regexp_matches(u, '\b[a-z]{2,5}\s*[*_-]?\s*[0-9]{4}\s*[-_]?\s*(f|w|s|fall|winter|summer)?\s*[-_]?\s*[0-9]{2,4}\b|\b[a-z]{2,5}[0-9]{4}[-_][fws][0-9]{2}\b') AS coded FROM h)
SELECT page_id, (CASE WHEN named THEN 50 ELSE 0 END) + (CASE WHEN regexp_matches(u, '\bcourse[\s_-]*outline\b') THEN 30 ELSE 0 END) + (CASE WHEN contains(u, 'syllabus') THEN 20 ELSE 0 END) + (CASE WHEN contains(u, 'outline') AND NOT named THEN 15 ELSE 0 END)
  + (CASE WHEN NOT named AND regexp_matches(u, '\b(outline|overview|introduction|welcome|policies|expectations)\b') THEN 12 ELSE 0 END) + (CASE WHEN file THEN 10 ELSE 0 END) + (CASE WHEN regexp_matches(u, '\.pdf(\?|$)') THEN 8 ELSE 0 END)
  - (CASE WHEN regexp_matches(u, '\.(docx?|pptx?|zip)(\?|$)') THEN 30 ELSE 0 END) - (CASE WHEN regexp_matches(u, 'lecture|(week|assignment|lab|quiz|chapter)\s*[0-9]') THEN 25 ELSE 0 END)
  - (CASE WHEN regexp_matches(u, '\b(rubric|solution|answer\s*key|sample)\b') THEN 20 ELSE 0 END) + (CASE WHEN coded AND file THEN 28 ELSE 0 END) AS score FROM n""")
def outline_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each page's address looks like that of a course outline."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "pages").select("page_id", text.candidate_score(none, F.col("url"), none).alias("score"))


def _html_sql() -> str:
    out = "html"
    for p, by in text.HTML_STEPS:
        flags = "g" + ("s" if "(?is)" in p else "") + ("i" if "(?i" in p else "")
        out = f"regexp_replace({out}, {"'" + p.replace('(?is)', '').replace('(?i)', '') + "'"}, {'chr(10)' if by == chr(10) else chr(39) + by + chr(39)}, '{flags}')"
    return f"trim({out}, ' ')"


@query(f"SELECT page_id, md5({_html_sql()}) AS text_md5, length({_html_sql()}) AS n_chars FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = text.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(plain).alias("text_md5"), F.length(plain).alias("n_chars"))


_MASKED = r"""regexp_replace(regexp_replace(regexp_replace({0}, '\b(access_token|refresh_token|id_token|token|sessionid|session_id|d2lSessionVal|d2lSecureSessionVal|password)=([^&\s"'']+)', '\1=[redacted]', 'gi'),
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}', '[email]', 'g'), '\b(student\s*(?:id|number|no\.?|#)|id\s*(?:number|no\.?))(\s*[:#-]?\s*)[0-9]{{6,10}}\b', '\1\2[student-id]', 'gi')"""


@query(f"SELECT doc_id, md5({_MASKED.format('text')}) AS text_md5, {_MASKED.format('text')} <> text AS changed FROM documents")
def redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.redacted(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("text_md5"), (clean != F.col("text")).alias("changed"))


INDEX = """
i AS (SELECT 'document:' || doc_id AS id, 'document' AS kind, source AS title, left(coalesce(text, ''), 8000) AS body FROM documents
  UNION ALL SELECT 'page:' || page_id, 'page', url, left(coalesce(html, ''), 8000) FROM pages
  UNION ALL SELECT 'message:' || conv_id || '-' || turn, 'message', role, left(coalesce(text, ''), 8000) FROM conversations)"""


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    return (
        search.index_rows(table(spark, sf_dir, "documents"), "document", "doc_id", "source", "text")
        .unionByName(search.index_rows(table(spark, sf_dir, "pages"), "page", "page_id", "url", "html"))
        .unionByName(search.index_rows(talk, "message", "key", "role", "text"))
    )


@query(f"WITH {INDEX} SELECT id, kind, title, length(body) AS n_chars FROM i")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).select("id", "kind", "title", F.length("body").alias("n_chars"))


_HAY = "trim(regexp_replace(lower(array_to_string(list_filter([title, body, kind], lambda x: coalesce(length(x), 0) > 0), ' · ')), '[ \\t\\r\\n]+', ' ', 'g'))"


@query(f"""WITH {INDEX}, h AS (SELECT *, {_HAY} AS hay FROM i),
s AS (SELECT *, CASE WHEN contains(hay, 'the') AND contains(hay, 'that') THEN CASE WHEN contains(hay, 'the that') THEN 40 ELSE 0 END + CASE WHEN starts_with(hay, 'the') THEN 12 ELSE 8 END + CASE WHEN starts_with(hay, 'that') THEN 12 ELSE 8 END ELSE 0 END AS score FROM h),
f AS (SELECT *, trim(regexp_replace(body, '[ \\t\\r\\n]+', ' ', 'g')) AS flat FROM s WHERE score > 0 ORDER BY score DESC, title, id LIMIT 40),
g AS (SELECT *, instr(lower(flat), 'the') AS pos FROM f), b AS (SELECT *, greatest(1, pos - 60) AS x, least(length(flat), pos + 2 + 60) AS y FROM g)
SELECT id, kind, score, CASE WHEN pos > 0 THEN (CASE WHEN x > 1 THEN '…' ELSE '' END) || substr(flat, x, y - x + 1) || (CASE WHEN y < length(flat) THEN '…' ELSE '' END) ELSE left(flat, 120) END AS snippet FROM b""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 best hits for a query of two words."""
    return search.search(index(spark, sf_dir), "the that")


@query("""WITH t AS (SELECT conv_id, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' WHEN contains(lower(role), 'assistant') OR contains('assistant', lower(role)) THEN 'instructor' WHEN contains(lower(role), 'system') OR contains('system', lower(role)) THEN 'staff' ELSE 'student' END AS author, text FROM conversations)
SELECT conv_id, author, count(*) AS posts, count(*) FILTER (WHERE regexp_matches(lower(text), '(due|deadline|extended|moved|[0-9]+ ?%)')) AS signals FROM t GROUP BY 1, 2""")
def staff_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of each author role in each conversation, and how many of them speak of deadlines or weights; the assistant is the instructor by name."""
    names = lambda *n: F.array(*map(F.lit, n)).cast("array<string>")
    t = table(spark, sf_dir, "conversations").select("conv_id", text.author_role(F.col("role"), names("assistant"), names(), names("system")).alias("author"), F.lower("text").rlike("(due|deadline|extended|moved|[0-9]+ ?%)").alias("signal"))
    return t.groupBy("conv_id", "author").agg(F.count("*").alias("posts"), F.count_if("signal").alias("signals"))


_PATH = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '#.*$', ''), '=[^&]*', '', 'g'), '/[0-9]+\\.[0-9]+(/|$)', '/{v}\\1', 'g'), '[0-9]+', '{id}', 'g')"


@query(f"SELECT {_PATH} AS endpoint, count(*) AS calls, sum(length(html)) AS chars, min(page_id) AS first_page FROM pages GROUP BY 1")
def endpoint_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.groupBy(text.endpoint_template(F.col("url")).alias("endpoint")).agg(F.count("*").alias("calls"), F.sum(F.length("html")).alias("chars"), F.min("page_id").alias("first_page"))


LINKS = """
l AS (SELECT 'doc:' || doc_id AS from_id, 'source:' || source AS to_id, 'FROM_SOURCE' AS kind FROM documents
  UNION SELECT 'doc:' || doc_id, 'label:' || quality, 'LABELLED' FROM labels UNION SELECT 'doc:' || d.doc_id, 'lang:' || lang, 'IN_LANGUAGE' FROM documents d
  UNION SELECT 'doc:' || doc_id, 'label:' || toxic, 'LABELLED' FROM labels WHERE toxic = 1)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    edge = lambda rows, to, name, kind: rows.select(F.concat(F.lit("doc:"), "doc_id").alias("from_id"), F.concat(F.lit(f"{to}:"), F.col(name).cast("string")).alias("to_id"), F.lit(kind).alias("kind"))
    return matching.entity_links([edge(d, "source", "source", "FROM_SOURCE"), edge(lab, "label", "quality", "LABELLED"), edge(d, "lang", "lang", "IN_LANGUAGE"), edge(lab.filter("toxic = 1"), "label", "toxic", "LABELLED")])


@query(f"WITH {LINKS} SELECT 'link:' || kind || ':' || from_id || ':' || to_id AS id, from_id, to_id, kind FROM l")
def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir)


@query(f"""WITH {LINKS}, b AS (SELECT from_id AS id, to_id AS other, kind FROM l UNION SELECT to_id, from_id, kind FROM l) SELECT * FROM b WHERE id IN ('lang:fr', 'label:0', 'doc:7')""")
def workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All neighbours of three entities."""
    wanted = spark.createDataFrame([("lang:fr",), ("label:0",), ("doc:7",)], "id string")
    return matching.neighbourhood(links(spark, sf_dir), wanted)


@query("""WITH g AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey) AS grade_id, l_partkey % 500 AS tool_id, p_name AS title, p_brand AS course_id FROM lineitem JOIN part ON l_partkey = p_partkey),
i AS (SELECT p_partkey AS item_id, p_brand AS course_id, p_partkey % 500 AS tool_id, p_name AS title FROM part),
b AS (SELECT course_id, tool_id, title, min(item_id) AS i FROM i GROUP BY ALL), t AS (SELECT course_id, tool_id, min(item_id) AS i, count(*) AS n FROM i GROUP BY ALL), n AS (SELECT course_id, title, min(item_id) AS i FROM i GROUP BY ALL),
m AS (SELECT grade_id, b.i AS same, CASE WHEN t.n = 1 THEN t.i END AS sole, n.i AS named FROM g LEFT JOIN b USING (course_id, tool_id, title) LEFT JOIN t ON t.course_id = g.course_id AND t.tool_id = g.tool_id LEFT JOIN n ON n.course_id = g.course_id AND n.title = g.title)
SELECT grade_id, coalesce(same, sole, named) AS item_id, CASE WHEN same IS NOT NULL THEN 1 WHEN sole IS NOT NULL THEN 2 WHEN named IS NOT NULL THEN 3 END AS prio FROM m""")
def gradebook_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of lineitem is a grade; order, line and supplier repeat with other parts, so the part is in the id too."""
    return matched(spark, sf_dir, table(spark, sf_dir, "lineitem"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"))


@query()
def gradebook_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches under the name that they had while gradebook_match read two lines of each order."""
    return gradebook_match(spark, sf_dir)


def matched(spark: SparkSession, sf_dir: str, li: DataFrame, key: Column) -> DataFrame:
    p = table(spark, sf_dir, "part")
    g = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(key.alias("grade_id"), F.col("p_brand").alias("course_id"), (F.col("l_partkey") % 500).alias("tool_id"), F.col("p_name").alias("title"))
    i = p.select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("course_id"), (F.col("p_partkey") % 500).alias("tool_id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("ord"))
    return matching.gradebook_match(g, i)
