"""Queries on a written search index: eight kinds of entities, found by pieces of three characters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookup
from ..operators.graph import shared_folder
from .registry import query, table

_HAY = "trim(regexp_replace(lower(concat_ws(' · ', {})), '[ \\t\\r\\n]+', ' ', 'g'))"


def _kind(sql: str, *fields: str) -> str:
    hay = _HAY.format(", ".join(f"nullif({f}, '')" for f in fields))
    return sql.replace("HAY", f"{hay} AS hay")


#: Nations are courses; what has a customer is of that one's nation, and other rows deal their ids over all nations.
E = "e AS (" + " UNION ALL ".join((
    _kind("SELECT 'c:' || n_nationkey AS id, 'course' AS kind, n_name AS title, 'region ' || n_regionkey AS subtitle, NULL AS body, n_nationkey::VARCHAR AS course_id, 5 AS bonus, HAY FROM nation", "n_name", "'region ' || n_regionkey", "'F24'"),
    _kind("SELECT 'a:' || o_orderkey, 'assessment', o_orderpriority, concat_ws(' · ', nullif(n_name, ''), nullif(o_orderstatus, ''), (o_orderkey % 40) || '%'), NULL, n_nationkey::VARCHAR, 0, HAY FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 25", "o_orderpriority", "o_orderstatus", "n_name"),
    _kind("SELECT 'n:' || event_id, 'announcement', event_type, coalesce(n_name, ''), props, (user_id % 25)::VARCHAR, 0, HAY FROM events LEFT JOIN nation ON n_nationkey = user_id % 25", "event_type", "props", "n_name"),
    _kind("SELECT 'dp:' || conv_id || '-' || turn, CASE WHEN role = 'assistant' THEN 'staff_discussion' ELSE 'discussion' END, 'turn ' || turn, coalesce(role, ''), text, (conv_id % 25)::VARCHAR, CASE WHEN role = 'assistant' THEN 5 ELSE 0 END, HAY FROM conversations", "'turn ' || turn", "text", "role"),
    _kind("SELECT 'ci:' || page_id, 'content', url, 'reading', html, (page_id % 25)::VARCHAR, 0, HAY FROM pages", "url", "'reading'", "html"),
    _kind("SELECT 'lib:' || doc_id, 'library', source, coalesce(lang, ''), text, (doc_id % 25)::VARCHAR, 0, HAY FROM documents", "source", "text", "lang"),
    _kind("SELECT 'd:' || p_partkey, 'document', p_name, p_brand, p_type, (p_partkey % 25)::VARCHAR, 0, HAY FROM part", "p_name", "left(p_type, 2000)", "p_brand"),
    _kind("SELECT 'p:' || s_suppkey, 'policy', s_name, 'late', 'Late work', s_nationkey::VARCHAR, 0, HAY FROM supplier", "s_name", "'Late work'", "'late'"),
)) + ")"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that can be searched, from eight kinds of rows; courses and what staff say come with a bonus, documents with their first 2000 characters."""
    t = lambda name: table(spark, sf_dir, name)
    c, lit, text = F.col, F.lit, lambda x: F.col(x).cast("string")
    codes = t("nation").select(c("n_nationkey").alias("course"), "n_name")
    coded = lambda rows, key: rows.withColumn("course", (c(key) % 25).cast("int")).join(codes, "course", "left").withColumn("course_id", c("course"))
    dealt = lambda rows, key: rows.withColumn("course_id", c(key) % 25)
    orders = coded(t("orders"), "o_custkey").withColumn("course_id", F.when(c("n_name").isNotNull(), c("course")))
    talk = dealt(t("conversations"), "conv_id").withColumn("key", F.concat_ws("-", "conv_id", "turn"))
    staff = c("role") == "assistant"
    region = F.concat(lit("region "), text("n_regionkey"))
    turn = F.concat(lit("turn "), text("turn"))
    every = (
        lookup.entity(t("nation").withColumn("course_id", c("n_nationkey")), "c", "n_nationkey", lit("course"), c("n_name"), [c("n_name"), region, lit("F24")], [region], bonus=5),
        lookup.entity(orders, "a", "o_orderkey", lit("assessment"), c("o_orderpriority"), [c("o_orderpriority"), c("o_orderstatus"), c("n_name")], [c("n_name"), c("o_orderstatus"), F.concat((c("o_orderkey") % 40).cast("string"), lit("%"))]),
        lookup.entity(coded(t("events"), "user_id"), "n", "event_id", lit("announcement"), c("event_type"), [c("event_type"), c("props"), c("n_name")], [c("n_name")], c("props")),
        lookup.entity(talk, "dp", "key", F.when(staff, "staff_discussion").otherwise("discussion"), turn, [turn, c("text"), c("role")], [c("role")], c("text"), F.when(staff, 5).otherwise(0)),
        lookup.entity(dealt(t("pages"), "page_id"), "ci", "page_id", lit("content"), c("url"), [c("url"), lit("reading"), c("html")], [lit("reading")], c("html")),
        lookup.entity(dealt(t("documents"), "doc_id"), "lib", "doc_id", lit("library"), c("source"), [c("source"), c("text"), c("lang")], [c("lang")], c("text")),
        lookup.entity(dealt(t("part"), "p_partkey"), "d", "p_partkey", lit("document"), c("p_name"), [c("p_name"), F.left("p_type", lit(2000)), c("p_brand")], [c("p_brand")], c("p_type")),
        lookup.entity(t("supplier").withColumn("course_id", c("s_nationkey")), "p", "s_suppkey", lit("policy"), c("s_name"), [c("s_name"), lit("Late work"), lit("late")], [lit("late")], lit("Late work")),
    )
    rows = every[0]
    for more in every[1:]:
        rows = rows.unionByName(more)
    return rows


def _index(spark: SparkSession, sf_dir: str) -> str:
    folder = f"{shared_folder(spark)}/lookup-{uuid.uuid4().hex}"
    lookup.build(entities(spark, sf_dir), folder)
    return folder


def _scored(*words: str) -> str:
    holds = " AND ".join(f"contains(hay, '{w}')" for w in words)
    points = " + ".join(f"CASE WHEN starts_with(hay, '{w}') THEN 12 ELSE 8 END" for w in words)
    return f"CASE WHEN {holds} THEN CASE WHEN contains(hay, '{' '.join(words)}') THEN 40 ELSE 0 END + {points} ELSE 0 END"


@query(f"""WITH {E}, s AS (SELECT *, {_scored('avec', 'les')} AS found FROM e),
f AS (SELECT *, found + bonus AS score, trim(regexp_replace(body, '[ \\t\\r\\n]+', ' ', 'g')) AS flat FROM s WHERE found > 0 ORDER BY score DESC, title, id LIMIT 40),
g AS (SELECT *, instr(lower(flat), 'avec') AS pos FROM f), b AS (SELECT *, greatest(1, pos - 60) AS x, least(length(flat), pos + 3 + 60) AS y FROM g)
SELECT id, kind, title, subtitle, course_id, score, CASE WHEN body <> '' THEN CASE WHEN pos > 0 THEN (CASE WHEN x > 1 THEN '…' ELSE '' END) || substr(flat, x, y - x + 1) || (CASE WHEN y < length(flat) THEN '…' ELSE '' END) ELSE left(flat, 120) END END AS snippet FROM b""")
def indexed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 best hits of two words among all entities, by a written index."""
    return lookup.found(spark, _index(spark, sf_dir), "avec les")


#: Two words of a course's items, three of posts, a word that is nowhere, and one without pieces.
ASKED = ("nation_7 urgent", "turn avec les", "qqqzzz", "f2")


def _pieces(q: str) -> str:
    return " AND ".join(f"contains(hay, '{p}')" for p in lookup.needles(q)) or "TRUE"


@query(f"WITH {E} " + " UNION ALL ".join(f"SELECT '{q}' AS query, count(*) AS entries, count(*) FILTER (WHERE {_pieces(q)}) AS read, count(*) FILTER (WHERE {_scored(*q.split())} > 0) AS hits FROM e" for q in ASKED))
def lookup_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts some queries read of all, and how many they hit."""
    return lookup.reach(spark, _index(spark, sf_dir), ASKED)
