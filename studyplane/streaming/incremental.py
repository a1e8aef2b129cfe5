"""Incremental forms: snapshot after snapshot into a change table, and notifications that are sent once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import change_feed, last_wins


def once(notes: DataFrame, key: str = "note_id", time: str = "at", memory: str = "7 days") -> DataFrame:
    """A stream's notes, each key once within the memory; later copies are dropped, and the state is bounded by the watermark."""
    return notes.withWatermark(time, memory).dropDuplicatesWithinWatermark([key])


def snapshots(arriving: DataFrame, table_path: str, changes_path: str, checkpoint: str, key: str = "id", order: str = "ord") -> StreamingQuery:
    """Runs a stream of snapshot rows (id, title, due, weight, earned, ord) to its end: each batch is the state after it.

    A batch's last row of an id replaces the stored one, others stay; the difference to the stored state goes to changes_path under the
    batch's number. Written paths are named by batch, so that a batch that is run again overwrites itself."""
    spark = arriving.sparkSession
    columns = ["id", "title", "due", "weight", "earned"]

    def merge(batch: DataFrame, number: int) -> None:
        incoming = last_wins(batch, [key], order).select(*columns)
        before = spark.read.parquet(f"{table_path}/{number - 1}") if number else incoming.limit(0)
        after = before.join(incoming.select(key), key, "left_anti").unionByName(incoming)
        after.write.mode("overwrite").parquet(f"{table_path}/{number}")
        change_feed(before, spark.read.parquet(f"{table_path}/{number}")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{changes_path}/batch={number}")

    return arriving.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
