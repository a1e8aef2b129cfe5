"""A day's list on nulls, repeated ids and empty tables."""

from pyspark.sql import functions as F

from studyplane.operators import day

ZONE = "America/Toronto"


def now():
    return F.lit("2026-03-10 15:00:00").cast("timestamp")


def test_tasks_without_a_due_and_repeated_ids(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1, 7, timestamp'2026-03-10 14:00:00', false), (1, 7, timestamp'2026-03-10 13:00:00', false), (1, 8, NULL, false), (NULL, 9, timestamp'2026-03-10 22:00:00', false), (1, 10, NULL, true) t(student, id, due, done)""")
    got = {(r.student, r.id, r.section, r.place) for r in day.day_list(day.tasks(rows, now(), ZONE), day.tasks(rows.limit(0), now(), ZONE)).collect()}
    assert got == {(1, "task:7", "needs_answer", 1), (1, "task:8", "coming_up", 1), (None, "task:9", "tonight", 1)}


def test_meetings_without_an_end_and_empty_tables(spark):
    rows = spark.sql("""SELECT * FROM VALUES (1, 1, 'lab', timestamp'2026-03-10 14:00:00', timestamp'2026-03-10 14:40:00', false), (1, 2, 'lab', timestamp'2026-03-10 14:00:00', NULL, false), (1, 3, 'lecture', NULL, NULL, false) t(student, id, kind, start, end, cancelled)""")
    assert [(r.id, r.section, r.status) for r in day.meetings(rows, now(), ZONE).collect()] == [("occ:1", "needs_answer", "Finished 20 min ago")]
    assert day.meetings(rows.limit(0), now(), ZONE).count() == 0
