"""Planning queries over orders (an order is an assessment of its customer's course) and events (facts about users)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import state
from ..operators import changes, plan
from .registry import query, table

#: The instant from which the queries look at the orders, and the zone of their days.
NOW, ZONE = "1998-06-15 12:00:00", "America/Toronto"

ITEMS = f"""
items AS (
  SELECT o_orderkey AS id, o_custkey AS course_id, o_orderdate + to_hours((o_orderkey % 24)::INT) AS due,
    CASE o_orderkey % 10 WHEN 0 THEN 'unknown' WHEN 1 THEN 'approximate' WHEN 2 THEN 'conflicting' ELSE 'exact' END AS certainty,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE floor(o_totalprice / 25000) END AS weight,
    CASE o_orderstatus WHEN 'F' THEN 'submitted' WHEN 'P' THEN 'unknown' ELSE 'not_submitted' END AS submission,
    CASE o_orderkey % 6 WHEN 0 THEN 'midterm' WHEN 1 THEN 'quiz' WHEN 2 THEN 'lab' WHEN 3 THEN 'assignment' WHEN 4 THEN 'final' ELSE 'discussion' END AS kind,
    o_orderstatus = 'F' AND o_orderkey % 3 = 0 AS graded, o_orderkey % 17 = 0 AS missed, o_orderkey % 13 = 0 AS needs_confirmation,
    o_orderkey % 6 = 1 AS absorbed, o_orderpriority FROM orders),
h AS (SELECT *, epoch_us(due) - epoch_us(TIMESTAMP '{NOW}') AS us, (epoch_us(due) - epoch_us(TIMESTAMP '{NOW}')) / 3.6e9 AS hours,
        submission <> 'submitted' AND NOT missed AND NOT graded AS is_open FROM items)"""

LOCAL = "((due AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto')::DATE"
LOCAL_NOW = f"((TIMESTAMP '{NOW}' AT TIME ZONE 'UTC') AT TIME ZONE 'America/Toronto')::DATE"

SCORE = """
w AS (SELECT *, coalesce(weight, 5.0) AS w FROM h),
scored AS (SELECT *, (greatest(w, 0) * 3
   + CASE WHEN hours < 0 THEN 40 + least(20.0, abs(hours) / 6) WHEN hours <= 6 THEN 35 + (6 - hours) WHEN hours <= 24 THEN 25 + (24 - hours) / 2
          WHEN hours <= 72 THEN 12 + (72 - hours) / 10 ELSE 0 END
   + CASE WHEN submission = 'not_submitted' THEN 8 ELSE 0 END + CASE WHEN needs_confirmation THEN 15 ELSE 0 END
   + CASE WHEN kind IN ('midterm', 'final') THEN 20 ELSE 0 END + CASE WHEN kind IN ('lab', 'assignment', 'project') THEN 6 ELSE 0 END
   - CASE WHEN absorbed AND (missed OR hours < 0) THEN 12 ELSE 0 END) * CASE WHEN certainty IN ('approximate', 'unknown') THEN 0.97 ELSE 1 END AS score FROM w)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rung = lambda n, names, last: F.element_at(F.array(*map(F.lit, [*names, *[last] * (n - len(names))])), (k % n + 1).cast("int"))
    status = F.col("o_orderstatus")
    out = o.select(
        k.alias("id"),
        F.col("o_custkey").alias("course_id"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(k % 24).cast("int"))).alias("due"),
        rung(10, ["unknown", "approximate", "conflicting"], "exact").alias("certainty"),
        F.when(k % 11 != 0, F.floor(F.col("o_totalprice") / 25000).cast("double")).alias("weight"),
        F.when(status == "F", "submitted").when(status == "P", "unknown").otherwise("not_submitted").alias("submission"),
        rung(6, ["midterm", "quiz", "lab", "assignment", "final"], "discussion").alias("kind"),
        ((status == "F") & (k % 3 == 0)).alias("graded"),
        (k % 17 == 0).alias("missed"),
        (k % 13 == 0).alias("needs_confirmation"),
        (k % 6 == 1).alias("absorbed"),
        "o_orderpriority",
    )
    no = F.lit(False)
    return out.withColumns({"hours": state.hours_between(_now(), F.col("due")), "open": state.is_open(F.col("submission"), no, F.col("missed"), no, F.col("graded"))})


def _now():
    return F.lit(NOW).cast("timestamp")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    unsure = c("certainty").isin("approximate", "unknown")
    return items(spark, sf_dir).withColumn("score", state.priority(c("weight"), c("hours"), c("submission"), c("needs_confirmation"), c("kind"), c("missed"), F.when(c("absorbed"), "BestN"), unsure))


@query(f"""WITH {ITEMS} SELECT id, CASE WHEN graded THEN 'graded' WHEN submission = 'submitted' THEN 'submitted' WHEN certainty = 'unknown' THEN 'unknown'
  WHEN us < 0 AND submission = 'unknown' THEN 'unknown' WHEN us < 0 THEN 'overdue' WHEN {LOCAL} = {LOCAL_NOW} THEN 'due_today' WHEN hours <= 48 THEN 'due_soon' ELSE 'upcoming' END AS status FROM h""")
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return items(spark, sf_dir).select("id", state.task_status(c("graded"), c("submission"), c("due"), c("certainty"), _now(), ZONE).alias("status"))


@query(f"""WITH {ITEMS} SELECT id, CASE WHEN id % 37 = 0 THEN 'EXACT_USER_OVERRIDE' WHEN certainty = 'conflicting' THEN 'EXACT_SOURCE_CONFLICT' WHEN certainty = 'exact' THEN 'EXACT_AUTHORITATIVE'
  WHEN certainty = 'approximate' AND id % 20 = 1 THEN 'DERIVED' WHEN certainty = 'approximate' THEN 'APPROXIMATE' ELSE 'UNKNOWN' END AS safety FROM h""")
def deadline_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    source = F.when(c("id") % 20 == 1, "rule_engine").otherwise("courselink_dropbox")
    return items(spark, sf_dir).select("id", state.deadline_safety(c("certainty"), c("due"), F.lit(None).cast("string"), c("id") % 37 == 0, source).alias("safety"))


@query(f"""WITH {ITEMS}, k AS (SELECT date_trunc('week', {LOCAL})::DATE AS week_start, count(*) AS n, coalesce(sum(weight), 0) AS weight_sum FROM h WHERE certainty <> 'unknown' GROUP BY 1)
SELECT *, n >= greatest(3, ceil((SELECT avg(n) FROM k) * 1.5)) OR weight_sum >= 25 AS busy FROM k""")
def workload_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.workload_weeks(items(spark, sf_dir), ZONE)


@query(f"""WITH {ITEMS} SELECT {LOCAL} AS day, count(*) AS n FROM h WHERE certainty <> 'unknown' GROUP BY 1 HAVING count(*) >= 3""")
def overlap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.crowded_days(items(spark, sf_dir), ZONE)


@query(f"""WITH {ITEMS}, {SCORE} SELECT id, round(score, 6) AS score FROM scored WHERE is_open OR needs_confirmation OR missed""")
def priority_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).filter("open OR needs_confirmation OR missed").select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {ITEMS}, {SCORE}, b AS (SELECT 'pri:' || id AS item, CASE WHEN NOT is_open AND NOT needs_confirmation AND NOT missed THEN 'DONE' WHEN needs_confirmation THEN 'CONFIRMATION' WHEN hours < 0 THEN 'NEEDS_ACTION'
  WHEN hours <= 24 THEN 'NOW' WHEN hours <= 72 THEN 'NEXT' ELSE 'WATCH' END AS bucket, score FROM scored),
u AS (SELECT item, bucket, CASE bucket WHEN 'DONE' THEN 0 WHEN 'CONFIRMATION' THEN score + 8 WHEN 'NEEDS_ACTION' THEN score + 6 WHEN 'NOW' THEN score + 4 WHEN 'NEXT' THEN score + 2 ELSE score END AS score FROM b
  UNION ALL SELECT 'pri:ch:' || event_id, 'CHANGES', 60 FROM events WHERE event_type = 'error')
SELECT item, bucket, list_position(['NOW', 'NEEDS_ACTION', 'CONFIRMATION', 'CHANGES', 'NEXT', 'WATCH', 'DONE'], bucket) AS place, round(score, 6) AS score FROM u""")
def command_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item and unread change in its bucket; sort by place, score from high to low, and item."""
    unread = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"))
    return plan.command_centre(scored(spark, sf_dir), unread).withColumn("score", F.round("score", 6))


@query(f"""WITH {ITEMS}, {SCORE}, r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM scored WHERE is_open)
SELECT id, CASE WHEN rank = 1 THEN (SELECT id FROM r WHERE rank = 2) ELSE (SELECT id FROM r WHERE rank = 1) END AS next_id FROM r""")
def ignore_next_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.next_focus(scored(spark, sf_dir).filter("open").withColumn("ord", F.col("id")))


@query(f"""WITH {ITEMS}, {SCORE}, u AS (
  SELECT 'order:' || id AS item, CASE WHEN needs_confirmation THEN 'needs_answer' WHEN hours < 0 THEN 'overdue' WHEN hours <= 36 THEN 'soon' ELSE 'later' END AS section, -score AS sort_key FROM scored WHERE is_open
  UNION ALL SELECT 'event:' || event_id, CASE WHEN event_type = 'error' THEN 'needs_answer' ELSE 'changes' END, -value FROM events WHERE event_type IN ('error', 'purchase'))
SELECT item, section, place FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY sort_key, item) AS place FROM u)
WHERE place <= CASE section WHEN 'needs_answer' THEN 20 WHEN 'overdue' THEN 12 WHEN 'soon' THEN 16 WHEN 'changes' THEN 12 ELSE 16 END""")
def myday_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders and notable events as one list of items, cut to the length of each section."""
    h = F.col("hours")
    section = F.when(F.col("needs_confirmation"), "needs_answer").when(h < 0, "overdue").when(h <= 36, "soon").otherwise("later")
    a = scored(spark, sf_dir).filter("open").select(F.concat(F.lit("order:"), "id").alias("item"), section.alias("section"), (-F.col("score")).alias("sort_key"))
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "purchase"))
    b = e.select(F.concat(F.lit("event:"), "event_id").alias("item"), F.when(F.col("event_type") == "error", "needs_answer").otherwise("changes").alias("section"), (-F.col("value")).alias("sort_key"))
    limits = {"needs_answer": 20, "overdue": 12, "soon": 16, "changes": 12, "later": 16}
    return plan.top_per(a.unionByName(b), "section", limits, [F.col("sort_key"), F.col("item")]).select("item", "section", "place")


@query(f"""WITH {ITEMS}, {SCORE}, k AS (SELECT id, course_id, CASE WHEN is_open AND hours < 0 AND weight >= 8 THEN 'overdue' WHEN is_open AND hours <= 36 AND weight >= 8 THEN 'due' WHEN missed THEN 'missed' WHEN needs_confirmation THEN 'confirm' END AS kind, score, absorbed FROM scored),
r AS (SELECT 'risk:' || kind || ':' || id AS risk, course_id, kind, CASE WHEN kind = 'overdue' THEN score + 20 WHEN kind = 'missed' AND absorbed THEN score * 0.5 WHEN kind = 'confirm' THEN score + 5 ELSE score END AS score FROM k WHERE kind IS NOT NULL
  UNION ALL SELECT 'risk:provdrop:' || id, course_id, 'provdrop', 25 FROM scored WHERE absorbed AND is_open UNION ALL SELECT DISTINCT 'risk:rule:' || course_id, course_id, 'rule', 30 FROM scored WHERE kind = 'midterm' AND missed)
SELECT risk, course_id, kind, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY course_id % 100 ORDER BY score DESC, risk) AS rank FROM r) WHERE rank <= 8""")
def risk_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight greatest risks of each student, whose courses are the customers that share the last two digits."""
    rows = scored(spark, sf_dir)
    drops = rows.filter("absorbed AND open").select(F.concat(F.lit("risk:provdrop:"), "id").alias("risk"), "course_id", F.lit("provdrop").alias("kind"), F.lit(plan.PROVISIONAL_DROP).alias("score"))
    rules = rows.filter("kind = 'midterm' AND missed").select("course_id").distinct().select(F.concat(F.lit("risk:rule:"), "course_id").alias("risk"), "course_id", F.lit("rule").alias("kind"), F.lit(plan.RULE_PRESSURE).alias("score"))
    risks = plan.insights(rows).select(F.concat_ws(":", F.lit("risk"), "kind", "id").alias("risk"), "course_id", "kind", "score").unionByName(drops).unionByName(rules)
    return plan.greatest(risks.withColumn("student", F.col("course_id") % 100), "student").select("risk", "course_id", "kind", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {ITEMS}, {SCORE}, s AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY score DESC, id) AS rank,
   kind = 'quiz' AND absorbed AND hours < 0 AS can_wait FROM scored WHERE is_open),
q AS (SELECT *, count(*) FILTER (WHERE NOT can_wait) OVER (PARTITION BY course_id ORDER BY rank) AS place FROM s)
SELECT id, course_id, CASE WHEN can_wait THEN 'deferred' ELSE 'slate' END AS list, rank FROM q WHERE (NOT can_wait AND place <= 5) OR can_wait""")
def recovery_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per course the five items to do first, and the missed quizzes that a best-of rule lets wait."""
    from pyspark.sql import Window

    w = Window.partitionBy("course_id").orderBy(F.desc("score"), "id")
    rows = scored(spark, sf_dir).filter("open").withColumn("deferrable", (F.col("kind") == "quiz") & F.col("absorbed") & (F.col("hours") < 0))
    rows = rows.withColumns({"rank": F.row_number().over(w), "place": F.count_if(~F.col("deferrable")).over(w)})
    return rows.filter("deferrable OR place <= 5").select("id", "course_id", F.when(F.col("deferrable"), "deferred").otherwise("slate").alias("list"), "rank")


@query(f"""WITH {ITEMS}, p AS (SELECT course_id, 'block' AS severity, true AS structural FROM h WHERE certainty = 'conflicting' AND weight >= 10
  UNION ALL SELECT course_id, 'warn', weight IS NULL FROM h WHERE weight IS NULL OR certainty = 'unknown')
SELECT course_id, count(*) FILTER (WHERE severity = 'block') AS blocks, count(*) FILTER (WHERE severity = 'warn' AND structural) AS warnings,
  count(*) FILTER (WHERE severity = 'block') > 0 OR count(*) FILTER (WHERE severity = 'warn' AND structural) >= 3 AS recheck FROM p GROUP BY course_id""")
def planning_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    block = rows.filter("certainty = 'conflicting' AND weight >= 10").select("course_id", F.lit("block").alias("severity"), F.lit(True).alias("structural"))
    warn = rows.filter("weight IS NULL OR certainty = 'unknown'").select("course_id", F.lit("warn").alias("severity"), F.col("weight").isNull().alias("structural"))
    return plan.gate(block.unionByName(warn))


@query(f"""WITH {ITEMS}, o AS (SELECT * FROM h WHERE is_open)
SELECT id, 'n:due:' || id || ':' || strftime({LOCAL}, '%Y-%m-%d') AS note_id, 'due_tomorrow' AS note FROM o WHERE hours > 12 AND hours <= 36 AND submission <> 'submitted'
UNION ALL SELECT id, 'n:quiz:' || id, 'quiz_closing' FROM o WHERE kind = 'quiz' AND hours > 0 AND hours <= 6
UNION ALL SELECT id, 'n:exam:' || id, 'exam_room' FROM o WHERE kind IN ('midterm', 'final') AND hours > 0 AND hours <= 48""")
def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.notifications(items(spark, sf_dir), _now(), ZONE)


SNAPSHOTS = """
b AS (SELECT o_orderkey AS id, o_orderpriority AS title, o_orderdate AS due, o_totalprice AS weight, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 <> 0 THEN o_totalprice END AS earned
      FROM orders WHERE o_orderkey % 19 <> 0),
a AS (SELECT o_orderkey AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS due,
        CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS weight, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS earned FROM orders WHERE o_orderkey % 23 <> 0)"""


@query(f"""WITH {SNAPSHOTS}, j AS (SELECT a.id AS aid, b.id AS bid, a.due AS adue, b.due AS bdue, a.weight AS aw, b.weight AS bw, a.earned AS ae, b.earned AS be FROM a FULL JOIN b ON a.id = b.id)
SELECT aid AS id, 'new_assessment' AS kind FROM j WHERE bid IS NULL UNION ALL SELECT bid, 'removed_assessment' FROM j WHERE aid IS NULL
UNION ALL SELECT aid, 'deadline_changed' FROM j WHERE aid IS NOT NULL AND bid IS NOT NULL AND adue IS DISTINCT FROM bdue
UNION ALL SELECT aid, 'weight_changed' FROM j WHERE aid IS NOT NULL AND bid IS NOT NULL AND aw IS DISTINCT FROM bw
UNION ALL SELECT aid, 'grade_posted' FROM j WHERE aid IS NOT NULL AND bid IS NOT NULL AND be IS NULL AND ae IS NOT NULL""")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    done = F.col("o_orderstatus") == "F"
    base = [k.alias("id"), F.col("o_orderpriority").alias("title")]
    before = o.filter(k % 19 != 0).select(*base, F.col("o_orderdate").alias("due"), F.col("o_totalprice").alias("weight"), F.when(done & (k % 5 != 0), F.col("o_totalprice")).alias("earned"))
    due = F.when(k % 7 == 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate"))
    after = o.filter(k % 23 != 0).select(*base, due.alias("due"), F.when(k % 9 != 0, F.col("o_totalprice")).alias("weight"), F.when(done, F.col("o_totalprice")).alias("earned"))
    return changes.change_feed(before, after).select("id", "kind")


#: Authority of an event type as a source (fixed values of these queries).
AUTHORITY = {"purchase": 100, "signup": 80, "click": 70, "view": 60, "error": 50}
_CASE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in AUTHORITY.items())
FACTS = f"f AS (SELECT event_id AS id, user_id AS entity_id, 'k' || (event_id % 7) AS field, CASE event_type {_CASE} END AS authority, round(value, 0) AS value, event_id % 10 AS confidence, ts AS valid_from FROM events)"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.create_map(*(F.lit(x) for kv in AUTHORITY.items() for x in kv))[F.col("event_type")]
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), F.concat(F.lit("k"), F.col("event_id") % 7).alias("field"), rank.alias("authority"), F.round("value", 0).alias("value"), (F.col("event_id") % 10).alias("confidence"), F.col("ts").cast("timestamp").alias("valid_from"))


@query(f"""WITH {FACTS} SELECT o.id, (SELECT arg_min(n.id, (n.valid_from, n.id)) FROM f n WHERE n.entity_id = o.entity_id AND n.field = o.field AND n.authority >= o.authority
   AND (n.valid_from > o.valid_from OR (n.valid_from = o.valid_from AND n.id > o.id))) AS superseded_by FROM f o""")
def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.superseded_in_order(facts(spark, sf_dir).withColumn("arrival", F.struct("valid_from", "id"))).select("id", "superseded_by")


@query(f"""WITH {FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, field ORDER BY authority DESC, confidence DESC, valid_from DESC, id) AS rank FROM f)
SELECT x.entity_id, x.field, x.id AS winner, x.value, x.authority, x.confidence, coalesce(y.value <> x.value AND y.authority >= x.authority - 15, false) AS conflicted
FROM r x LEFT JOIN r y ON y.entity_id = x.entity_id AND y.field = x.field AND y.rank = 2 WHERE x.rank = 1""")
def field_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.field_resolution(facts(spark, sf_dir))


@query(f"""WITH {FACTS}, v AS (SELECT entity_id || ':' || field AS entity_id, date_trunc('day', valid_from)::DATE AS due, max(authority) AS p FROM f GROUP BY 1, 2)
SELECT entity_id, arg_min(due, (-p, due)) AS resolved, count(*) AS n_values, count(*) > 1 AS conflicting FROM v GROUP BY entity_id""")
def due_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The due date that the facts of each entity's field agree on, or that of the most authority."""
    rows = facts(spark, sf_dir).withColumns({"due": F.to_date("valid_from"), "entity_id": F.concat_ws(":", F.col("entity_id").cast("string"), "field")})
    return changes.resolve_conflict(rows, "due", F.col("authority"))


@query("""WITH v AS (SELECT l_partkey AS entity_id, l_quantity AS weight, max(l_linenumber) AS p FROM lineitem GROUP BY 1, 2)
SELECT entity_id, arg_min(weight, (-p, weight)) AS resolved, count(*) AS n_values, count(*) > 1 AS conflicting FROM v GROUP BY entity_id""")
def weight_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_quantity").alias("weight"), "l_linenumber")
    return changes.resolve_conflict(rows, "weight", F.col("l_linenumber"))


@query("""SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("ord"))
    return changes.first_wins(e, ["user_id", "event_type"], "ord").drop("ord")


@query("""SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value, min(event_id) AS first_order FROM events GROUP BY 1, 2""")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("ord"))
    return changes.last_wins(e, ["user_id", "event_type"], "ord").drop("ord")


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, arg_max(event_type, (n, -f)) AS usual FROM n GROUP BY 1""")
def current_semester(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value of each user, first seen on ties."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    return n.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", (-F.col("f")).alias("f"))).alias("usual"))
