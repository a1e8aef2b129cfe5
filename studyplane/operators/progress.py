"""How far items are: submissions, quiz attempts, progress by type, revisions of documents, changes that call for a new plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types that progress is shown for, and what counts as one of them besides (fixed values).
PROGRESS_TYPES, COUNTED_AS = ("quiz", "lab", "midterm", "final", "assignment"), {"project": "assignment"}

#: Kinds of changes after which a plan is made anew (fixed values).
REPLAN_KINDS = (
    "deadline_changed",
    "weight_changed",
    "new_assessment",
    "removed_assessment",
    "grade_posted",
    "announcement",
    "announcement_superseded",
    "document_version",
    "rule_changed",
    "section_changed",
    "occurrence_cancelled",
)


def with_submissions(items: DataFrame, read: DataFrame) -> DataFrame:
    """items (item_id, submission, submitted_at) with what their submission lists say: submitted with the latest date, or not_submitted.

    read: item_id and date, one row at least for each item whose list was read, with a null date where it is empty. Items whose list
    wasn't read stay as they are."""
    last = read.groupBy("item_id").agg(F.max("date").alias("_last"), F.lit(True).alias("_read"))
    out = items.join(last, "item_id", "left")
    state = F.when(F.col("_read").isNull(), F.col("submission")).when(F.col("_last").isNotNull(), "submitted").otherwise("not_submitted")
    return out.withColumn("submission", state).withColumn("submitted_at", F.when(F.col("_read"), F.col("_last")).otherwise(F.col("submitted_at"))).drop("_last", "_read")


def last_attempts(attempts: DataFrame) -> DataFrame:
    """Per quiz the last completed attempt in list order (not by date). attempts: quiz_id, number, completed_at, ord."""
    done = attempts.filter("completed_at IS NOT NULL")
    return done.groupBy("quiz_id").agg(F.max_by(F.struct("number", "completed_at"), "ord").alias("_a")).select("quiz_id", F.col("_a.number").alias("attempt"), F.col("_a.completed_at").alias("submitted_at"))


def progress(items: DataFrame, done: Column) -> DataFrame:
    """Per course and type how many items are done, of how many. items: course_id, kind."""
    shown = F.col("kind")
    for kind, other in COUNTED_AS.items():
        shown = F.when(shown == kind, other).otherwise(shown)
    return items.withColumn("type", shown).filter(F.col("type").isin(*PROGRESS_TYPES)).groupBy("course_id", "type").agg(F.count_if(done).alias("done"), F.count("*").alias("total"))


def revisions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """document_id, change_kind and rebuild: initial without a previous revision; semantic where the fingerprint of the meaning differs;
    else metadata_only where the content does, or reparse. Both tables: document_id, content_hash, semantic_hash."""
    old = previous.select("document_id", F.col("content_hash").alias("_content"), F.col("semantic_hash").alias("_semantic"), F.lit(True).alias("_known"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    kind = F.when(F.col("_known").isNull(), "initial").when(~same("semantic_hash", "_semantic"), "semantic").when(same("content_hash", "_content"), "reparse").otherwise("metadata_only")
    return current.join(old, "document_id", "left").select("document_id", kind.alias("change_kind")).withColumn("rebuild", F.col("change_kind").isin("initial", "semantic"))


def replan_triggers(changes: DataFrame, since: Column | None = None) -> DataFrame:
    """Changes of REPLAN_KINDS that are unread, or made at `since` or later. changes: kind, read, created_at."""
    recent = F.lit(False) if since is None else F.coalesce(F.col("created_at") >= since, F.lit(False))
    return changes.filter(F.col("kind").isin(*REPLAN_KINDS) & (~F.coalesce("read", F.lit(False)) | recent))
