"""The written search index against a scan in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from studyplane.operators import lookup

SCHEMA = "key long, course_id long, title string, text string, extra string, bonus int"


def entries(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    c = F.col
    return lookup.entity(df, "x", "key", F.lit("content"), c("title"), [c("title"), c("text"), c("extra")], [c("extra")], c("text"), c("bonus"))


def brute(rows, query, limit=40, course=None):
    words, out = query.lower().split(), []
    for key, course_id, title, text, extra, bonus in rows:
        hay = " ".join(" · ".join(f for f in (title, text, extra) if f).lower().split())
        if words and all(w in hay for w in words) and course in (None, course_id):
            score = 40 * (" ".join(words) in hay) + sum(12 if hay.startswith(w) else 8 for w in words)
            out.append((-(score + bonus), (title is not None, title or ""), "x" if key is None else f"x:{key}"))
    return [(i, -s) for s, _, i in sorted(out)[:limit]]


def hits(df):
    return [(r["id"], r["score"]) for r in df.collect()]


WORDS = ["lab", "labs", "the", "theory", "of", "a", "quiz", "Quiz", "é", "日本語", "😀😀😀", "a·b", "mid\tterm", "x" * 50]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    out = [(k, k % 3, rng.choice([None, "", some(4)]), rng.choice([None, some(12)]), rng.choice([None, "Lab"]), rng.choice([0, 5])) for k in range(300)]
    return out + [(1000, 1, "the lab", "y" * 200_000 + " theory", None, 0), (None, None, None, None, None, 0), (None, None, "lab", None, None, 0)] + [(7, 1, "same lab", "quiz", None, 0)] * 40


@pytest.mark.parametrize("query", ["lab", "theory of", "LAB the", "日本語", "😀😀😀 lab", "a", "of a", "quiz quiz", "nowhere", "lab nowhere", "  ", "mid term", "labx"])
def test_index_gives_the_hits_of_a_scan(spark, rows, tmp_path_factory, query):
    folder = str(tmp_path_factory.getbasetemp() / "lookup")
    if not (tmp_path_factory.getbasetemp() / "lookup").exists():
        lookup.build(entries(spark, rows), folder, block=16)
    assert hits(lookup.found(spark, folder, query, limit=500)) == brute(rows, query, 500)
    assert hits(lookup.found(spark, folder, query, limit=9, course_id="1")) == brute(rows, query, 9, 1)
    assert hits(lookup.scanned(entries(spark, rows), query)) == brute(rows, query)


def test_reads_only_what_has_all_pieces(spark, rows, tmp_path):
    lookup.build(entries(spark, rows), str(tmp_path), block=16)
    got = {r["query"]: (r["entries"], r["read"], r["hits"]) for r in lookup.reach(spark, str(tmp_path), ["theory", "nowhere", "a"]).collect()}
    n = len(brute(rows, "theory", 10**6))
    assert got["theory"] == (len(rows), n, n) and got["nowhere"] == (len(rows), 0, 0) and got["a"][:2] == (len(rows), len(rows))
    lists = spark.read.parquet(f"{tmp_path}/postings")
    assert lists.filter(F.size("places") > 16).isEmpty()  # a frequent piece has many rows, each of one block


def test_many_blocks_are_joined(spark, rows, tmp_path, monkeypatch):
    """Where more blocks have candidates than a filter names, the join alone tells."""
    lookup.build(entries(spark, rows), str(tmp_path), block=4)
    monkeypatch.setattr(lookup, "NAMED", 1)
    assert hits(lookup.found(spark, str(tmp_path), "lab", 500)) == brute(rows, "lab", 500)


def test_pieces_reach_the_scan(spark, rows, tmp_path):
    lookup.build(entries(spark, rows), str(tmp_path))
    plan = lookup.candidates(spark, str(tmp_path), "theory of")._jdf.queryExecution().toString()
    assert "In(piece" in plan and "struct<piece" in plan


def test_empty_table(spark, tmp_path):
    lookup.build(entries(spark, []), str(tmp_path))
    assert lookup.found(spark, str(tmp_path), "lab").count() == 0
    assert [tuple(r) for r in lookup.reach(spark, str(tmp_path), ["lab"]).collect()] == [("lab", 0, 0, 0)]
