"""Budgets and versions of content, and summaries of requests, against folds in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from studyplane.operators import traces, versions

ITEM = "course_id int, item_id int, ord int, title string, external boolean, document_class string, failed boolean"
SNAPSHOT = "item_id int, at int, ord int, content_hash string, text string"
ENTRY = "ord int, kind string, path string, status string, items int, bytes int, error string"


def read(items, most):
    """One item after the other, as a reader with a budget would."""
    out, spent = [], {}
    for course, item, _, title, external, kind, failed in sorted(set(items), key=lambda r: (r[2] is not None, r[2] or 0, r[1])):
        n = spent.get(course, 0)
        media = (title or "").lower().rsplit(".", 1)[-1] in {"mp4", "mov", "avi", "mkv", "mp3", "wav", "png", "jpg", "jpeg", "gif", "webp"} and "." in (title or "")
        if external or media or n >= most or kind not in versions.FIRST and n > most / 2 or failed:
            continue
        spent[course] = n + 1
        out.append((course, item, n + 1))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1, 2, 5, 8, 40])
def test_budget(spark, most):
    rng = random.Random(most)
    some = lambda *xs: rng.choice(xs)
    rows = [(some(None, 1, 1, 1, 2), k, some(None, k // 3, 400 - k), some(None, "a.PDF", "b.mp4", "c.jpeg", "mp4"), some(None, False, False, True), some(None, "other", "policy", "tutorial"), some(None, False, True)) for k in range(400)]
    rows += rows[:20]  # repeated rows
    assert sorted(map(tuple, versions.within_budget(spark.createDataFrame(rows, ITEM), most).collect()), key=repr) == read(rows, most)


def test_a_course_is_cut_before_it_is_sent(spark):
    plan = versions.within_budget(spark.createDataFrame([], ITEM))._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 4 and ", Partial" in plan


def test_versions(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(4), at, o, rng.choice([None, "h1", "h2"]), None) for at in range(30) for o in range(2)]
    rows = [(i, at, o, h, h and f"same\n{h}") for i, at, o, h, _ in rows] + [(None, 1, 0, "h1", "x"), (9, 5, 0, "h1", None), (9, 6, 0, "h1", None)]
    want = {}
    for item in {r[0] for r in rows} - {None}:
        at = {}
        for _, t, o, h, _ in sorted((r for r in rows if r[0] == item and r[3]), key=lambda r: (r[1], r[2], r[3])):
            at[t] = h
        kept = []
        for t, h in sorted(at.items()):
            if not kept or kept[-1][1] != h:
                kept.append((t, h))
        for n, (t, h) in enumerate(kept):
            before = kept[n - 1][1] if n else None
            want[item, n + 1] = (f"lib:{item}:{h}", h, t, kept[n + 1][0] if n + 1 < len(kept) else None, before, before and f"- {before}\n+ {h}")
    out = versions.versions(spark.createDataFrame(rows, SNAPSHOT))
    got = {(r["item_id"], r["version"]): (r["id"], r["content_hash"], r["valid_from"], r["valid_to"], r["previous_hash"], r["detail"]) for r in out.collect()}
    assert got == want and got[9, 1][5] is None and (9, 2) not in got


def test_three_snapshots_keep_their_ids(spark):
    """Each snapshot gives the versions that it gave before, and a text that comes back has its old id."""
    rows = [(1, 1, 0, "a", "x"), (1, 2, 0, "b", "y"), (1, 3, 0, "a", "x")]
    ids = [[(r["version"], r["id"]) for r in versions.versions(spark.createDataFrame(rows[:n], SNAPSHOT)).orderBy("version").collect()] for n in (1, 2, 3)]
    assert ids == [[(1, "lib:1:a")], [(1, "lib:1:a"), (2, "lib:1:b")], [(1, "lib:1:a"), (2, "lib:1:b"), (3, "lib:1:a")]]


PATHS = {
    "/d2l/api/le/1.67/123/content/9": ("/d2l/api/le/1.67/123/content/9", 123, "/d2l/api/le/{v}/{id}/content/{id}"),
    "https://other.example/users/55/x?a=1&b=&=3#top": ("/users/{userId}/x?a=…&b=…", None, "/users/{userId}/x?a=…&b=…"),
    "https://home.example/d2l/le/content/77/view#top": ("/d2l/le/content/77/view#top", 77, "/d2l/le/content/{id}/view#top"),
    "/User/12": ("/User/{userId}", None, "/User/{userId}"),
    "/a/1/2/3?": ("/a/1/2/3", None, "/a/{id}/{id}/{id}"),
    "/v2/12a/7?x=1?y=2": ("/v2/12a/7?x=…", None, "/v2/12a/{id}?x=…"),
    "HTTP://x": ("/", None, "/"),
    "": ("", None, ""),
}


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "path string")
    clean = traces.sanitized(F.col("path"), "https://home.example")
    got = {r[0]: tuple(r)[1:] for r in df.select("path", clean, traces.org_unit(clean), traces.template(clean)).collect()}
    assert got == PATHS


def test_summary(spark):
    rng = random.Random(4)
    some = lambda *xs: rng.choice(xs)
    rows = [(k, some(None, "api", "outline_candidate"), some(None, "/a/1", "/a/2", "/b"), some(None, "200", "404"), some(None, 2), some(None, 7), some(None, "", *(f"e{n}" for n in range(9)))) for k in range(300)]
    want = {}
    for _, kind, path, status, items, size, error in rows:
        if kind != "outline_candidate":
            w = want.setdefault(path and path.replace("/1", "/{id}").replace("/2", "/{id}"), [0, 0, 0, {}, []])
            w[0], w[1], w[2] = w[0] + 1, w[1] + (items or 0), w[2] + (size or 0)
            w[3][status or "none"] = w[3].get(status or "none", 0) + 1
            if error and len(w[4]) < 5 and error not in w[4]:
                w[4].append(error)
    got = {r["endpoint"]: [r["calls"], r["items"], r["bytes"], r["statuses"], r["errors"]] for r in traces.summary(spark.createDataFrame(rows, ENTRY)).collect()}
    assert got == want


def test_empty_tables(spark):
    assert traces.summary(spark.createDataFrame([], ENTRY)).isEmpty()
    assert versions.versions(spark.createDataFrame([], SNAPSHOT)).isEmpty() and versions.within_budget(spark.createDataFrame([], ITEM)).isEmpty()
