"""Queries on what is read again: rows of lineitem as content of suppliers' courses and as snapshots of parts, events as a log of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import traces, versions
from .registry import query, table


@query("""WITH i AS (SELECT l_suppkey AS course_id, l_orderkey * 10 + l_linenumber AS item_id, l_orderkey AS ord, bool_or(l_returnflag = 'R') AS ahead FROM lineitem WHERE l_linenumber <> 3 AND l_linestatus = 'O' AND l_tax < 0.075 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY ord, item_id) AS r FROM i),
p AS (SELECT *, count(*) FILTER (WHERE ahead AND r > 21) OVER (PARTITION BY course_id ORDER BY r) AS later FROM r)
SELECT course_id, item_id, CASE WHEN r <= 21 THEN r ELSE 21 + later END AS place FROM p WHERE r <= 21 OR (ahead AND later <= 19)""")
def content_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 40 reads of each course get: the first files of any class, then outlines."""
    n = F.col("l_linenumber")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("course_id"),
        (F.col("l_orderkey") * 10 + n).alias("item_id"),
        F.col("l_orderkey").alias("ord"),
        F.when(n == 3, "Week.MP4").when(n == 4, "notes.mp4.txt").otherwise("Notes.pdf").alias("title"),
        (F.col("l_linestatus") != "O").alias("external"),
        F.when(F.col("l_returnflag") == "R", "course_outline").otherwise("other").alias("document_class"),
        (F.col("l_tax") >= 0.075).alias("failed"),
    )
    return versions.within_budget(items)


@query("""WITH s AS (SELECT l_partkey AS item_id, l_shipdate AS day, arg_max((l_returnflag, l_linestatus), (l_orderkey * 10 + l_linenumber, md5(l_returnflag || chr(10) || l_linestatus))) AS t FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1, 2),
n AS (SELECT *, lag(t) OVER (PARTITION BY item_id ORDER BY day) AS before FROM s), c AS (SELECT * FROM n WHERE t IS DISTINCT FROM before),
h AS (SELECT *, md5(t[1] || chr(10) || t[2]) AS hash, row_number() OVER w AS version, lead(day) OVER w AS until FROM c WINDOW w AS (PARTITION BY item_id ORDER BY day))
SELECT item_id, version, 'lib:' || item_id || ':' || left(hash, 12) AS id, hash AS content_hash, strftime(day, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(until, '%Y-%m-%d %H:%M:%S') AS valid_to, md5(before[1] || chr(10) || before[2]) AS previous_hash,
  CASE WHEN before IS NOT NULL THEN concat_ws(chr(10), CASE WHEN before[1] <> t[1] THEN '- ' || before[1] || chr(10) || '+ ' || t[1] END, CASE WHEN before[2] <> t[2] THEN '- ' || before[2] || chr(10) || '+ ' || t[2] END) END AS detail FROM h""")
def content_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments as snapshots of a part, of which some weren't read and several may be of one time."""
    n = F.col("l_linenumber")
    said = F.concat_ws("\n", "l_returnflag", "l_linestatus")
    snapshots = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item_id"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + n).alias("ord"), F.when(n != 7, F.md5(said)).alias("content_hash"), said.alias("text"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return versions.versions(snapshots).select("item_id", "version", "id", "content_hash", day("valid_from"), day("valid_to"), "previous_hash", "detail")


@query("""WITH e AS (SELECT event_id, user_id % 100 AS unit, '/d2l/api/le/{v}/{id}/' || event_type || CASE WHEN event_id % 2 = 0 THEN '/{id}?k=…&page=…' ELSE '/{id}' END AS endpoint,
  CASE event_id % 4 WHEN 0 THEN '404' WHEN 1 THEN 'network_error' WHEN 2 THEN '200' ELSE 'none' END AS status, value::BIGINT AS items, length(props) AS bytes, CASE WHEN event_id % 4 < 2 THEN props END AS error FROM events WHERE event_id % 10 <> 9),
s AS (SELECT unit, endpoint, status, count(*) AS n FROM e GROUP BY ALL), h AS (SELECT unit, endpoint, string_agg(status || ':' || n, ',' ORDER BY status) AS statuses FROM s GROUP BY ALL),
f AS (SELECT unit, endpoint, error, min(event_id) AS ord FROM e WHERE error IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY unit, endpoint ORDER BY ord) AS place FROM f),
x AS (SELECT unit, endpoint, string_agg(error, '|' ORDER BY place) AS errors FROM r WHERE place <= 5 GROUP BY ALL)
SELECT unit AS org_unit, endpoint, count(*) AS calls, coalesce(sum(bytes), 0) AS bytes, any_value(h.statuses) AS statuses, coalesce(any_value(x.errors), '') AS errors FROM e JOIN h USING (unit, endpoint) LEFT JOIN x USING (unit, endpoint) GROUP BY unit, endpoint""")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by course and endpoint: their statuses with counts, and the first five distinct errors."""
    k, text = F.col("event_id"), lambda c: c.cast("string")
    unit = text(F.col("user_id") % 100)
    path = F.concat(F.lit("/d2l/api/le/1."), text(k % 80), F.lit("/"), unit, F.lit("/"), "event_type", F.lit("/"), text(k), F.when(k % 2 == 0, F.concat(F.lit("?k="), unit, F.lit("&page=2"))).otherwise(""))
    path = F.when(k % 3 == 0, F.concat(F.lit("https://school.example"), path)).otherwise(path)
    status = F.when(k % 4 == 0, "404").when(k % 4 == 1, "network_error").when(k % 4 == 2, "200")
    log = table(spark, sf_dir, "events").select(k.alias("ord"), F.when(k % 10 == 9, traces.NO_REQUEST).otherwise("api").alias("kind"), path.alias("path"), status.alias("status"), F.lit(None).cast("long").alias("items"), F.length("props").alias("bytes"), F.when(k % 4 < 2, F.col("props")).alias("error"), traces.org_unit(path).alias("org_unit"))
    said = F.array_join(F.transform(F.map_entries("statuses"), lambda s: F.concat_ws(":", s["key"], s["value"].cast("string"))), ",")
    return traces.summary(log, ["org_unit"]).select("org_unit", "endpoint", "calls", "bytes", said.alias("statuses"), F.array_join("errors", "|").alias("errors"))
