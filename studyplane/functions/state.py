"""Column expressions over one assessment: percent, openness, status, deadline safety, priority.

Conventions: a null stays unknown; `now` is a parameter and never the clock; days are civil days of a zone that the caller names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is computed once, however often the result names it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def filled(text: Column) -> Column:
    """Whether a display text is there and not empty."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def percent(earned: Column, possible: Column, display: Column, missed: Column) -> Column:
    """Points as a percentage, else the percentage in the display text. Missed without points is unknown, not zero."""
    shown = F.try_element_at(F.regexp_extract_all(display, F.lit(r"([0-9]+(?:\.[0-9]+)?)\s*%"), F.lit(1)), F.lit(1)).cast("double")
    return F.when(F.coalesce(missed, F.lit(False)) & earned.isNull(), None).when(earned.isNotNull() & (possible > 0), earned / possible * 100).otherwise(shown)


def hours_between(now: Column, then: Column) -> Column:
    return (F.unix_micros(then) - F.unix_micros(now)) / 3.6e9


def local_day(instant: Column, zone: str) -> Column:
    """The civil day of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def task_status(graded: Column, submission: Column, due: Column, certainty: Column, now: Column, zone: str, warn_hours: float = 48) -> Column:
    """graded, submitted, unknown, overdue, due_today, due_soon or upcoming; the first that applies."""
    past = due < now
    return (
        F.when(graded, "graded")
        .when(submission == "submitted", "submitted")
        .when(due.isNull() | (certainty == "unknown"), "unknown")
        .when(past & (submission == "unknown"), "unknown")
        .when(past, "overdue")
        .when(local_day(due, zone) == local_day(now, zone), "due_today")
        .when(hours_between(now, due) <= warn_hours, "due_soon")
        .otherwise("upcoming")
    )


def deadline_safety(certainty: Column, due: Column, label: Column, overridden: Column, source: Column) -> Column:
    """How far a deadline can be relied on: the first that applies, the user's own before a conflict of sources."""
    return (
        F.when(F.coalesce(overridden, F.lit(False)), "EXACT_USER_OVERRIDE")
        .when(certainty == "conflicting", "EXACT_SOURCE_CONFLICT")
        .when((certainty == "exact") & due.isNotNull(), "EXACT_AUTHORITATIVE")
        .when((certainty == "approximate") & F.coalesce(source == "rule_engine", F.lit(False)), "DERIVED")
        .when(certainty == "approximate", "APPROXIMATE")
        .when(filled(label) & due.isNull(), "TBD")
        .otherwise("UNKNOWN")
    )


def better_date(a: Column, b: Column) -> Column:
    """Of two dates (structs with certainty and iso) the surer one, then one with an instant, then the first."""
    rank = lambda d: F.when(d["certainty"] == "exact", 3).when(d["certainty"] == "approximate", 2).when(d["certainty"] == "conflicting", 1).otherwise(0)
    return F.when(rank(b) > rank(a), b).when(rank(a) > rank(b), a).when(a["iso"].isNull() & b["iso"].isNotNull(), b).otherwise(a)


def is_done(submission: Column, work: Column, confirmed: Column, earned: Column, display: Column) -> Column:
    """Submitted, completed, confirmed by the user, or with a grade."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(submission == "submitted") | yes(work == "completed") | yes(confirmed == "confirmed") | earned.isNotNull() | filled(display)


def in_window(due: Column, now: Column, past_days: int = 150, future_days: int = 200) -> Column:
    """Whether a deadline is near enough to keep; an unknown one is."""
    days = hours_between(now, due) / 24
    return F.coalesce((days >= -past_days) & (days <= future_days), F.lit(True))


def needs_confirmation(due: Column, submission: Column, confirmed: Column, now: Column) -> Column:
    """Past its deadline, not known to be submitted, and not confirmed."""
    return F.coalesce(due < now, F.lit(False)) & ~F.coalesce(submission == "submitted", F.lit(False)) & ~F.coalesce(confirmed, F.lit(False))


def closed_quiz(ends: Column, attempts: Column, grade: Column, submission: Column, now: Column) -> Column:
    """A closed quiz without attempt, grade or submission, of which nobody knows whether it was missed."""
    return F.coalesce(ends < now, F.lit(False)) & (F.coalesce(attempts, F.lit(0)) == 0) & grade.isNull() & ~F.coalesce(submission == "submitted", F.lit(False))


def is_open(submission: Column, completed: Column, missed: Column, dropped: Column, graded: Column) -> Column:
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return no(submission == "submitted") & no(completed) & no(missed) & no(dropped) & no(graded)


#: Priority points (fixed values): per weight point, for an unknown weight without and with a course blueprint, and by state and type.
WEIGHT_FACTOR, UNKNOWN_WEIGHT, UNKNOWN_IN_BLUEPRINT = 3.0, 5.0, 3.0
NOT_SUBMITTED, CONFIRM, EXAM, WORK, BEST_N, DROP_LOWEST, UNSURE = 8.0, 15.0, 20.0, 6.0, 12.0, 8.0, 0.97
IN_BLUEPRINT, RELATIVE_RULE, LAB_TONIGHT, MATERIALS = 4.0, 2.0, 10.0, 3.0


def urgency(hours: Column, weight: Column) -> Column:
    """Points for time left: overdue, 6 hours, a day, three days, no date."""
    return (
        F.when(hours.isNull(), F.when(weight >= 10, 8.0).otherwise(2.0))
        .when(hours < 0, 40 + F.least(F.lit(20.0), F.abs(hours) / 6))
        .when(hours <= 6, 35 + (6 - hours))
        .when(hours <= 24, 25 + (24 - hours) / 2)
        .when(hours <= 72, 12 + (72 - hours) / 10)
        .otherwise(0.0)
    )


def priority(
    weight: Column,
    hours: Column,
    submission: Column,
    needs_confirmation: Column,
    kind: Column,
    missed: Column,
    absorber: Column,
    unsure: Column,
    blueprint: Column | None = None,
    relative_rule: Column | None = None,
    lab_tonight: Column | None = None,
    materials: Column | None = None,
) -> Column:
    """Higher is more urgent; weight dominates.

    absorber: BestN or DropLowest where such a rule takes up a miss; unsure: the deadline isn't exact; blueprint: the course has one;
    relative_rule: it derives the item's deadline; lab_tonight: the course has a lab today; materials: something is linked to the item."""
    none = F.lit(False)
    blueprint, relative_rule, lab_tonight, materials = (none if c is None else F.coalesce(c, none) for c in (blueprint, relative_rule, lab_tonight, materials))
    w = F.coalesce(weight, F.when(blueprint, UNKNOWN_IN_BLUEPRINT).otherwise(UNKNOWN_WEIGHT))
    points = lambda condition, n: F.when(condition, n).otherwise(0.0)
    score = (
        F.greatest(w, F.lit(0.0)) * WEIGHT_FACTOR
        + points(blueprint & weight.isNotNull(), IN_BLUEPRINT)
        + points(relative_rule, RELATIVE_RULE)
        + urgency(hours, w)
        + points(submission == "not_submitted", NOT_SUBMITTED)
        + points(needs_confirmation, CONFIRM)
        + points(kind.isin("midterm", "final"), EXAM)
        + points(kind.isin("lab", "assignment", "project"), WORK)
        - F.when(missed | (hours < 0), F.when(absorber == "BestN", BEST_N).when(absorber == "DropLowest", DROP_LOWEST).otherwise(0.0)).otherwise(0.0)
        + points(lab_tonight & (kind == "lab"), LAB_TONIGHT)
        + points(materials, MATERIALS)
    )
    return F.when(unsure, score * UNSURE).otherwise(score)
