"""Streams with state by key: what is remembered, restarts, and what a batch changes."""

from studyplane.streaming import keyed

NOTES, ITEMS = "student_id string, note_id string, ord long", "id string, title string, due date, weight double, earned double, ord long"


def arrive(spark, base, schema, batches, stream):
    out = []
    seen = 0
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        keyed.run_to_end(stream(spark.readStream.schema(schema).parquet(f"{base}/in")), f"{base}/out", f"{base}/checkpoint")
        found = [tuple(r) for r in spark.read.parquet(f"{base}/out").collect()]
        out.append(found)
        assert len(found) >= seen
        seen = len(found)
    return out


def test_notes_are_sent_once_while_remembered_over_restarts(spark, tmp_path):
    """Two at once, three remembered: the oldest of four is sent again, and a note that waits is sent at a later refresh."""
    batches = [[("a", "n1", 1), ("a", "n2", 2), ("a", "n3", 3), ("b", "n1", 1), (None, "x", 1), ("a", None, 4)], [("a", "n1", 4), ("a", "n3", 5)], [("a", "n4", 6), ("a", "n4", 6)], [("a", "n1", 7), ("a", "n2", 8)]]
    found = arrive(spark, str(tmp_path), NOTES, batches, lambda s: keyed.sent(s, at_once=2, remembered=3))
    new = [sorted((set(b) - set(a))) for a, b in zip([[], *found], found, strict=False)]
    assert new == [[("a", "n1", 1), ("a", "n2", 2), ("b", "n1", 1)], [("a", "n3", 5)], [("a", "n4", 6)], [("a", "n1", 7)]]
    state = spark.read.format("statestore").option("stateVarName", "shown").load(f"{tmp_path}/checkpoint")
    sizes = {r["s"]: r["count"] for r in state.selectExpr("key.student_id AS s").groupBy("s").count().collect()}
    assert set(sizes) == {"a", "b"} and max(sizes.values()) <= 3


def test_changes_of_items_over_restarts(spark, tmp_path):
    from datetime import date

    d = date(2026, 10, 1)
    batches = [
        [("a", "A", d, 1.0, None, 1), ("a", "A2", d, 2.0, None, 2), ("b", None, None, None, None, 1), (None, "x", d, 1.0, None, 1)],
        [("a", "A2", None, 2.0, 9.0, 3), ("b", None, None, None, None, 2)],
        [("a", "A2", d, 2.5, 8.0, 4), ("c", "C", d, 1.0, 1.0, 1)],
    ]
    found = arrive(spark, str(tmp_path), ITEMS, batches, keyed.changes)
    new = [sorted(set(b) - set(a), key=repr) for a, b in zip([[], *found], found, strict=False)]
    assert new[0] == sorted([("a", "new_assessment", None, "A2", 2), ("b", "new_assessment", None, None, 1)], key=repr)
    assert new[1] == sorted([("a", "deadline_changed", "2026-10-01", None, 3), ("a", "grade_posted", None, "9.0", 3)], key=repr)
    assert new[2] == sorted([("a", "deadline_changed", None, "2026-10-01", 4), ("a", "weight_changed", "2.0", "2.5", 4), ("c", "new_assessment", None, "C", 1)], key=repr)


def test_the_session_keeps_its_own_state_store(spark):
    before = spark.conf.get(keyed._PROVIDER, None)
    with keyed.keyed_state(spark):
        assert "RocksDB" in spark.conf.get(keyed._PROVIDER)
    assert spark.conf.get(keyed._PROVIDER, None) == before
