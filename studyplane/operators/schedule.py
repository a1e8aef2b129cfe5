"""Calendar operators: weekly patterns from single events, their occurrences, uncovered slots, deadlines from occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clusters(events: DataFrame, zone: str) -> DataFrame:
    """Weekly patterns: course_id, kind, day_of_week (0: Sunday), start_hm, n, first location that is known, first and last day.

    events: course_id, kind, start (UTC), location, ord. One event is enough for a pattern."""
    local = F.from_utc_timestamp("start", zone)
    rows = events.select("course_id", "kind", (F.dayofweek(local) - 1).alias("day_of_week"), F.date_format(local, "HH:mm").alias("start_hm"), F.to_date(local).alias("day"), "location", "ord")
    return rows.groupBy("course_id", "kind", "day_of_week", "start_hm").agg(
        F.count("*").alias("n"), F.min_by("location", F.when(F.col("location").isNotNull(), F.col("ord"))).alias("location"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


def occurrences(patterns: DataFrame, holidays: list[tuple[str, str]], zone: str) -> DataFrame:
    """Each day of a pattern that isn't excepted or in a holiday, numbered from 1, with its UTC start.

    patterns: pattern_id, day_of_week, start_hm, range_start, range_end (dates, inclusive), exdates. The first matching weekday begins
    the sequence, so one array entry is made per week and none per day."""
    lead = F.pmod(F.col("day_of_week") - (F.dayofweek("range_start") - 1), F.lit(7)).cast("int")
    first = F.date_add("range_start", lead)
    days = F.when(first <= F.col("range_end"), F.sequence(first, "range_end", F.expr("INTERVAL 7 DAYS"))).otherwise(F.array().cast("array<date>"))
    off = lambda d: F.lit(False) if not holidays else _any([(d >= F.lit(a).cast("date")) & (d <= F.lit(b).cast("date")) for a, b in holidays])
    kept = F.filter(days, lambda d: ~F.array_contains("exdates", d) & ~off(d))
    rows = patterns.select("pattern_id", "start_hm", F.posexplode(kept).alias("_p", "day"))
    wall = F.concat_ws(" ", F.col("day").cast("string"), "start_hm").cast("timestamp")
    return rows.select("pattern_id", F.concat_ws(":", F.lit("occ"), "pattern_id", F.col("day").cast("string")).alias("occurrence_id"), "day", (F.col("_p") + 1).alias("number"), F.to_utc_timestamp(wall, zone).alias("start"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def uncovered(events: DataFrame, made: DataFrame, key: list[str]) -> DataFrame:
    """Events without an occurrence of the same key."""
    return events.join(made.select(*key).distinct(), key, "left_anti")


def due_after(items: DataFrame, made: DataFrame, days: int, at: str, zone: str) -> DataFrame:
    """item_id and the instant `days` after the occurrence of the item's number, at a wall time there. items: item_id, pattern_id, number."""
    day = F.date_add("day", days)
    return items.join(made, ["pattern_id", "number"]).select("item_id", F.to_utc_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(at)).cast("timestamp"), zone).alias("due"))
