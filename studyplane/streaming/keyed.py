"""Streams with state by key: notes of a student that are not sent again soon, and the changes of one item from its last state.

State is read and written for the keys of a batch only; no table is written anew. It lies in RocksDB, which `keyed_state` sets for the time in
which streams are started."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.capture import AT_ONCE, REMEMBERED

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Sender(StatefulProcessor):
    """A batch is a refresh: of a student's first at_once candidates those are sent that are not among the last `remembered` sent."""

    def __init__(self, at_once: int, remembered: int):
        self.at_once, self.remembered = at_once, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.shown = handle.getListState("shown", "note_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        shown = [r[0] for r in self.shown.get()] if self.shown.exists() else []
        sent = []
        for ord_, note in heapq.nsmallest(self.at_once, ((r["ord"], r["note_id"]) for r in rows)):
            if note not in shown:
                shown.append(note)
                sent.append(Row(student_id=key[0], note_id=note, ord=ord_))
        if sent:
            self.shown.put([(x,) for x in shown[-self.remembered :]])
        yield from sent

    def close(self) -> None:
        pass


class Differ(StatefulProcessor):
    """The changes from an item's stored state to the last row of a batch, which takes its place."""

    fields = ("title", "due", "weight", "earned")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "title string, due string, weight string, earned string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = max(rows, key=lambda r: r["ord"])
        after = {c: last[c] for c in self.fields}
        event = lambda kind, old, new: Row(id=key[0], kind=kind, before_value=old, after_value=new, ord=last["ord"])
        if not self.known.exists():
            yield event("new_assessment", None, after["title"])
        else:
            before = dict(zip(self.fields, self.known.get(), strict=True))
            for field, kind in (("due", "deadline_changed"), ("weight", "weight_changed")):
                if before[field] != after[field]:
                    yield event(kind, before[field], after[field])
            if before["earned"] is None and after["earned"] is not None:
                yield event("grade_posted", None, after["earned"])
        self.known.update(tuple(after.values()))

    def close(self) -> None:
        pass


def sent(candidates: DataFrame, at_once: int = AT_ONCE, remembered: int = REMEMBERED) -> DataFrame:
    """The notes (student_id, note_id, ord) of a stream of candidates that are to be sent, batch after batch.

    A student's state is `remembered` ids at most, whatever comes; candidates beyond a batch's first at_once are not kept. Rows without a
    student, note or place (ord) are left out."""
    rows = candidates.select(F.col("student_id").cast("string").alias("student_id"), F.col("note_id").cast("string").alias("note_id"), F.col("ord").cast("long").alias("ord")).dropna()
    return rows.groupBy("student_id").transformWithState(Sender(at_once, remembered), "student_id string, note_id string, ord long", "Append", "None")


def changes(arriving: DataFrame) -> DataFrame:
    """id, kind, before_value, after_value and ord of what a stream of items (id, title, due, weight, earned, ord) changes, batch after batch.

    Of an id's rows in a batch the last by ord counts; null values are states like others. Rows without an id or ord are left out. An id's
    state is its last row; items that are gone aren't noticed, since a stream of rows doesn't say so."""
    text = [F.col(c).cast("string").alias(c) for c in Differ.fields]
    rows = arriving.select(F.col("id").cast("string").alias("id"), *text, F.col("ord").cast("long").alias("ord")).dropna(subset=["id", "ord"])
    return rows.groupBy("id").transformWithState(Differ(), "id string, kind string, before_value string, after_value string, ord long", "Append", "None")


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what the stream gives to path until it has no more, from where the checkpoint left off."""
    with keyed_state(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
