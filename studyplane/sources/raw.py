"""Landed learning-system records: explicit schemas, readers, and their normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import title_type

#: Schemas of the landed JSON arrays; never inferred.
SCHEMAS = {
    "courses": "OrgUnitId string, Name string, Code string, IsActive boolean, CanAccessCourse boolean, StartDate string, EndDate string, SemesterName string",
    "assignments": "Id bigint, Name string, DueDate string, IsHidden boolean, Availability struct<StartDate: string, EndDate: string>",
    "quizzes": "QuizId bigint, Name string, DueDate string, EndDate string, IsActive boolean",
    "grade_objects": "Id bigint, Name string, MaxPoints double, Weight double, AssociatedTool struct<ToolId: bigint, ToolItemId: bigint>",
    "grade_values": "GradeObjectIdentifier string, PointsNumerator double, PointsDenominator double, DisplayedGrade string",
    "news": "Id bigint, Title string, Body struct<Text: string, Html: string>, StartDate string, IsHidden boolean",
    "calendar": "CalendarEventId bigint, Title string, Description string, StartDateTime string, EndDateTime string, IsAllDayEvent boolean",
}


def read(spark: SparkSession, kind: str, path: str | None) -> DataFrame:
    """Landed records of a kind (JSON lines or arrays); no path gives no rows. A broken record is a row of nulls."""
    schema = SCHEMAS[kind]
    return spark.read.schema(schema).option("multiLine", True).json(path) if path else spark.createDataFrame([], schema)


def instant(text: str) -> F.Column:
    """An ISO instant or date; null if it is neither."""
    return F.try_to_timestamp(F.col(text))


def courses(raw: DataFrame) -> DataFrame:
    """course_id, org_unit, code (its first two parts, else 14 characters of the name), title and dates."""
    code = F.nullif(F.regexp_extract("Code", r"^([A-Za-z]+\*[0-9]+)", 1), F.lit(""))
    return raw.select(F.concat(F.lit("course:"), "OrgUnitId").alias("course_id"), F.try_to_number("OrgUnitId", F.lit("999999999999")).cast("long").alias("org_unit"), F.coalesce(code, F.left("Name", F.lit(14))).alias("code"), F.col("Name").alias("title"), instant("StartDate").alias("start"), instant("EndDate").alias("end"), F.coalesce("IsActive", F.lit(True)).alias("active"))


def likely_current(course: DataFrame, now: F.Column) -> DataFrame:
    """Not ended over 14 days ago, not starting over 60 days ahead; without an end, started less than 200 days ago."""
    day = lambda n: F.expr(f"INTERVAL {n} DAYS")
    keep = (F.col("end").isNull() | (F.col("end") >= now - day(14))) & (F.col("start").isNull() | (F.col("start") <= now + day(60)))
    return course.filter(keep & (F.col("end").isNotNull() | F.col("start").isNull() | (F.col("start") > now - day(200))))


def _item(prefix: str, key: str, name: str, default: str) -> list[F.Column]:
    kind = title_type(F.col(name), default)
    return [F.concat_ws(":", F.lit(prefix), "course_id", F.col(key).cast("string")).alias("id"), "course_id", F.col(name).alias("title"), kind.alias("type")]


def _due(when: F.Column) -> list[F.Column]:
    return [when.alias("due"), F.when(when.isNull(), "unknown").otherwise("exact").alias("certainty"), F.when(when.isNull(), 0.2).otherwise(0.95).alias("confidence")]


def assignments(raw: DataFrame) -> DataFrame:
    """Visible folders as assessments; due falls back to the end of availability. raw has course_id."""
    return raw.filter(~F.coalesce("IsHidden", F.lit(False))).select(*_item("dropbox", "Id", "Name", "assignment"), *_due(F.coalesce(instant("DueDate"), F.try_to_timestamp("Availability.EndDate"))))


def quizzes(raw: DataFrame) -> DataFrame:
    """Active quizzes as assessments; a title can say that one is a midterm."""
    return raw.filter(F.coalesce("IsActive", F.lit(True))).select(*_item("quiz", "QuizId", "Name", "quiz"), *_due(F.coalesce(instant("DueDate"), instant("EndDate"))))


def announcements(raw: DataFrame) -> DataFrame:
    """Visible news with plain text and whether it speaks of a deadline."""
    body = F.coalesce(F.nullif("Body.Text", F.lit("")), F.regexp_replace("Body.Html", "<[^>]+>", " "))
    return raw.filter(~F.coalesce("IsHidden", F.lit(False))).select(F.concat_ws(":", F.lit("news"), "course_id", F.col("Id").cast("string")).alias("id"), "course_id", F.col("Title").alias("title"), F.trim(F.regexp_replace(body, r"\s+", " ")).alias("body"), instant("StartDate").alias("published"), F.lower(F.concat_ws(" ", "Title", body)).rlike("(due|deadline|extended|moved|rescheduled)").alias("signal"))


def grades(objects: DataFrame, values: DataFrame) -> DataFrame:
    """Grade objects with the last value of their id (string and number ids are one). values has ord."""
    last = values.groupBy(F.trim("GradeObjectIdentifier").alias("key")).agg(F.max_by(F.struct("PointsNumerator", "PointsDenominator", "DisplayedGrade"), "ord").alias("v"))
    out = objects.join(last, F.col("Id").cast("string") == F.col("key"), "left")
    return out.select(F.col("Id").alias("grade_id"), F.col("Name").alias("title"), F.col("Weight").alias("weight"), F.col("AssociatedTool.ToolItemId").alias("tool_id"), F.col("v.PointsNumerator").alias("earned"), F.coalesce("v.PointsDenominator", "MaxPoints").alias("possible"), F.col("v.DisplayedGrade").alias("display"))
