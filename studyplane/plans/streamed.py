"""Queries on streams with state by key: the events of a month's thirds arrive one after the other, each run going on from the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import keyed
from .ingestion import _folder
from .registry import query, table

ARRIVALS = 3


def _arriving(spark: SparkSession, sf_dir: str, stream: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """What the stream gives over events that land in ARRIVALS batches, with a restart from the checkpoint before each."""
    out, rows = _folder(spark), table(spark, sf_dir, "events")
    for k in range(ARRIVALS):
        rows.filter(F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(ARRIVALS - 1)) == k).write.mode("append").parquet(f"{out}/landed")
        keyed.run_to_end(stream(spark.readStream.schema(rows.schema).parquet(f"{out}/landed")), f"{out}/found", f"{out}/checkpoint")
    return spark.read.schema(schema).parquet(f"{out}/found")


@query("""WITH b AS (SELECT *, least((day(ts) - 1) // 10, 2) AS batch, event_type || event_id % 20 AS note_id FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, batch ORDER BY event_id) AS n FROM b)
SELECT user_id::VARCHAR AS student_id, note_id, min(event_id) AS ord FROM f WHERE n <= 5 GROUP BY user_id, note_id""")
def notes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of each user, of whom fewer kinds exist than are remembered, so that none comes twice."""
    note = F.concat("event_type", (F.col("event_id") % 20).cast("string"))
    return _arriving(spark, sf_dir, lambda s: keyed.sent(s.select(F.col("user_id").alias("student_id"), note.alias("note_id"), F.col("event_id").alias("ord"))), "student_id string, note_id string, ord long")


@query("""WITH b AS (SELECT *, least((day(ts) - 1) // 10, 2) AS batch FROM events),
l AS (SELECT user_id, batch, max(event_id) AS ord, arg_max(event_type, event_id) AS title, arg_max(ts, event_id)::DATE::VARCHAR AS due, arg_max(value, event_id)::BIGINT::VARCHAR AS weight, arg_max(CASE WHEN event_id % 3 = 0 THEN event_id ELSE -1 END, event_id) AS e FROM b GROUP BY ALL),
g AS (SELECT *, nullif(e, -1)::VARCHAR AS earned, lag(ord) OVER w AS known, lag(due) OVER w AS due0, lag(weight) OVER w AS weight0, lag(e) OVER w AS e0 FROM l WINDOW w AS (PARTITION BY user_id ORDER BY batch))
SELECT user_id::VARCHAR AS id, 'new_assessment' AS kind, NULL::VARCHAR AS before_value, title AS after_value, ord FROM g WHERE known IS NULL
UNION ALL SELECT user_id::VARCHAR, 'deadline_changed', due0, due, ord FROM g WHERE known IS NOT NULL AND due0 <> due
UNION ALL SELECT user_id::VARCHAR, 'weight_changed', weight0, weight, ord FROM g WHERE known IS NOT NULL AND weight0 <> weight
UNION ALL SELECT user_id::VARCHAR, 'grade_posted', NULL, earned, ord FROM g WHERE known IS NOT NULL AND e0 = -1 AND e <> -1""")
def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of each user's last state from arrival to arrival."""
    e = F.col("event_id")
    items = lambda s: s.select(F.col("user_id").alias("id"), F.col("event_type").alias("title"), F.to_date("ts").alias("due"), F.rint("value").cast("long").alias("weight"), F.when(e % 3 == 0, e).alias("earned"), e.alias("ord"))
    return _arriving(spark, sf_dir, lambda s: keyed.changes(items(s)), "id string, kind string, before_value string, after_value string, ord long")
