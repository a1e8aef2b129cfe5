"""Similarity joins of assessments inside a course, their reconciliation, gradebook matching, links between entities."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import COMPATIBLE, NUMBER_HINTS, SYNONYMS, TITLE_KEY, key_tokens, match_features, match_score
from .graph import components, settled

#: From this score two rows are one item, and what equal numbers and near dues add to it (fixed values).
THRESHOLD, NUMBER_AND_DUE = 0.72, 0.4

#: Kinds of rows that are folded in one Python group, about.
BUCKET_KINDS = 2000


def matchable(rows: DataFrame) -> DataFrame:
    """rows with match_features; tokens are made of the key, which is made once. Rows are dealt first, since a small file is one task."""
    made = match_features(F.col("title"))
    return rows.repartition("course_id", "title").withColumns({c: made[c] for c in ("title_key", "wide", "hint")}).withColumn("tokens", F.array_sort(key_tokens(F.col("title_key"))))


def match_classes(rows: DataFrame) -> DataFrame:
    """The rows (id, course_id, title, type, due, ord) as classes of those that no match can tell apart: equal course, title key, tokens, number,
    type and due. Columns: those of a class, with id (its row of least ord), n (its rows) and ids."""
    featured = matchable(rows)
    key = ["course_id", "title_key", "tokens", "wide", "hint", "type", "due"]
    return featured.groupBy(*key).agg(F.min_by("id", "ord").alias("id"), F.min("ord").alias("ord"), F.count("*").alias("n"), F.collect_set("id").alias("ids"))


def _rare(classes: DataFrame, column: str, least: float) -> DataFrame:
    """course_id, token, id and hint: the rare tokens of each class's set in `column`. Sets with a Jaccard similarity of `least` share one: in order of
    rarity, the first n - ceil(least * n) + 1 of a set's n tokens meet those of every set that is so alike."""
    tokens = classes.select("course_id", "id", "hint", F.size(column).alias("size"), F.explode(column).alias("token"))
    often = F.count("*").over(Window.partitionBy("course_id", "token"))
    ranked = tokens.withColumn("often", often).withColumn("place", F.row_number().over(Window.partitionBy("course_id", "id").orderBy("often", "token")))
    return ranked.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * F.lit(least - 1e-9)) + 1).select("course_id", "token", "id", "hint")


def _shares(classes: DataFrame, column: str, least: float) -> DataFrame:
    """a and b of classes of one course that share a rare token. Classes of different numbers match by equal keys alone, so they don't meet here."""
    rare = _rare(classes, column, least)
    side = lambda name: rare.select("course_id", "token", F.col("id").alias(name), F.col("hint").alias(f"hint_{name}"))
    met = side("a").join(side("b"), ["course_id", "token"]).filter("a <> b AND coalesce(hint_a = hint_b, true)")
    return met.select("a", "b")


def candidates(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a and b (ids of classes, in either order, once each) that may match: equal title keys, or no different numbers and as many tokens in
    common as the threshold leaves when number and due add all they can."""
    if threshold <= NUMBER_AND_DUE:
        raise ValueError(f"the threshold must be over {NUMBER_AND_DUE}")
    key = classes.select("course_id", "title_key", F.col("id").alias("a"))
    equal = key.join(key.withColumnRenamed("a", "b"), ["course_id", "title_key"]).filter("a <> b").select("a", "b")
    least = threshold - NUMBER_AND_DUE
    return equal.union(_shares(classes, "tokens", least)).union(_shares(classes, "wide", least)).distinct()


def block_links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a and b that lead to the same connected blocks as candidates, with no more rows than classes have keys and tokens: a class hangs under one of
    its title key, and for each rare token under one without a number, which meets all that have the token, or else one of its own number."""
    if threshold <= NUMBER_AND_DUE:
        raise ValueError(f"the threshold must be over {NUMBER_AND_DUE}")
    under = lambda *keys: F.min("id").over(Window.partitionBy(*keys))
    links = classes.filter("title_key IS NOT NULL").select(F.col("id").alias("a"), under("course_id", "title_key").alias("b"))
    for column in ("tokens", "wide"):
        rare = _rare(classes, column, threshold - NUMBER_AND_DUE)
        whole = F.min(F.when(F.col("hint").isNull(), F.col("id"))).over(Window.partitionBy("course_id", "token"))
        links = links.union(rare.select(F.col("id").alias("a"), F.coalesce(whole, under("course_id", "token", "hint")).alias("b")))
    return links.filter("a <> b").distinct()


def match_pairs(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b (ids of classes, a the earlier one by ord), n_a, n_b (their rows) and score of the classes of one course that match; a class of several
    rows matches itself. See match_classes for which rows a class has: copies are not written out as pairs.

    Null titles match nothing but each other's class; courses that are null match nothing."""
    classes = settled(match_classes(rows.filter("course_id IS NOT NULL")))  # read seven times below
    side = lambda n: classes.drop("ids").alias(n)
    met = candidates(classes, threshold).join(side("x"), F.col("a") == F.col("x.id")).join(side("y"), F.col("b") == F.col("y.id")).filter("x.ord < y.ord")
    scored = met.select("a", "b", F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"), F.round(match_score("x", "y"), 6).alias("score")).filter(F.col("score") >= threshold)
    alone = classes.filter("n > 1").select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.lit(0.98).alias("score"))
    return scored.unionByName(alone)


def _steps(steps):
    return [(re.compile(p), re.sub(r"\$(\d)", r"\\\1", by)) for p, by in steps]


_KEY, _WIDE = _steps(TITLE_KEY), _steps(SYNONYMS + TITLE_KEY)
_HINTS = [re.compile(p) for p in NUMBER_HINTS]


def _through(text: str, steps) -> str:
    for p, by in steps:
        text = p.sub(by, text)
    return text.strip()


def _there(x) -> bool:
    """Whether a value of pandas is neither None nor NaN nor NaT."""
    return x is not None and x == x


@lru_cache(4096)
def _features(title: str) -> tuple[str, frozenset, frozenset, str | None]:
    low = (title or "").lower()
    key = _through(low, _KEY)
    hint = next((m[1] for p in _HINTS if (m := p.search(low))), None)
    return key, frozenset(t for t in key.split(" ") if len(t) > 1), frozenset(t for t in _through(low, _WIDE).split(" ") if t), hint


def _score(a: dict, b: dict) -> float:
    ka, ta, ca, na = a["features"]
    kb, tb, cb, nb = b["features"]
    if ka == kb:
        return 0.98
    if a["type"] != b["type"] and b["type"] not in COMPATIBLE.get(a["type"], ()):
        return 0.0
    if na and nb and na != nb:
        return 0.0
    share = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    score = max(share(ta, tb), share(ca, cb)) + (0.25 if na and na == nb else 0.0)
    if _there(a["due"]) and _there(b["due"]):
        days = abs((a["due"] - b["due"]).total_seconds()) / 86400
        score += 0.15 if days <= 3 else -0.2 if days > 21 else 0.0
    return max(0.0, min(1.0, score))


def _merged(a: dict, b: dict) -> dict:
    """The longer title, the kind that says more, the left value where there is one."""
    out = dict(a)
    if len(b["title"] or "") > len(a["title"] or ""):
        out["title"], out["features"] = b["title"], b["features"]
    if a["type"] == "other":
        out["type"] = b["type"]
    for c in ("due", "weight"):
        if not _there(a[c]):
            out[c] = b[c]
    out["members"] = a["members"] + b["members"]
    return out


def _changes(mine: dict, other: dict) -> bool:
    """Whether taking in other changes what mine matches: its title, type or due."""
    return len(other["title"] or "") > len(mine["title"] or "") or (mine["type"] == "other" != other["type"]) or (not _there(mine["due"]) and _there(other["due"]))


def _folded(kinds: list[dict], threshold: float) -> list[dict]:
    """The items of one block, from its kinds of rows with their ords, ids and weights, as a fold row by row makes them.

    An item matches all rows of a kind or none while its title, type and due stay, so kinds are scored when these change, and the rows that
    come after it in order, up to the one that changes it next, are taken at once."""
    for k in kinds:
        k["features"] = _features(k["title"])
    every = lambda c: np.concatenate([np.asarray(k[c]) for k in kinds])
    order = np.argsort(every("ords"), kind="stable")
    ids, weights = every("ids")[order], every("weights").astype(float)[order]
    owner = np.repeat(np.arange(len(kinds)), [len(k["ords"]) for k in kinds])[order]
    left = {n: np.flatnonzero(owner == n) for n in range(len(kinds))}
    out = []
    while left:
        n = min(left, key=lambda n: left[n][0])
        at = left[n][0]
        mine = {c: kinds[n][c] for c in ("course_id", "title", "type", "due", "features")} | {"id": ids[at], "weight": weights[at], "members": 1}
        left[n] = left[n][1:]
        while at is not None:
            near = {n: np.searchsorted(left[n], at, "right") for n in left if len(left[n]) and left[n][-1] > at and _score(mine, kinds[n]) >= threshold}
            upto = min((left[n][b] for n, b in near.items() if _changes(mine, kinds[n])), default=None)
            taken = []
            for n, b in near.items():
                e = len(left[n]) if upto is None else np.searchsorted(left[n], upto, "right")
                taken.append(left[n][b:e])
                left[n] = np.delete(left[n], np.s_[b:e])
            rows = np.sort(np.concatenate(taken)) if taken else np.array([], dtype=int)
            known = rows[~np.isnan(weights[rows])]
            if not _there(mine["weight"]) and len(known):
                mine["weight"] = weights[known[0]]
            mine["members"] += len(rows)
            if upto is not None:
                mine = _merged(mine, kinds[owner[upto]] | {"weight": None, "members": 0})
            at = upto
        out.append(mine)
        left = {n: x for n, x in left.items() if len(x)}
    return out


def reconcile(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per real item of each course: id of its first row, title, type, due, weight, members.

    Row by row in input order, a row takes in each later one that matches it as it then is; so the result depends on the order (ord), and
    only a fold gives it. A merged row's title is that of one of its members, so what it can take in is found by candidates first, whatever
    type and due it then has: a fold takes the kinds of rows (equal course, title, type and due, with their ords, ids and weights) of one
    connected block of such candidates. Rows of null courses stay alone."""
    key = ["course_id", "title", "type", "due"]
    alone = rows.withColumn("_alone", F.when(F.col("course_id").isNull(), F.col("id")))
    kinds = alone.groupBy(*key, "_alone").agg(F.sort_array(F.collect_list(F.struct("ord", "id", F.col("weight").cast("double").alias("weight")))).alias("r"))
    kinds = settled(kinds.select(*key, F.col("r")[0]["id"].alias("id"), F.col("r")[0]["ord"].alias("ord"), F.col("r.ord").alias("ords"), F.col("r.id").alias("ids"), F.col("r.weight").alias("weights")))
    classes = settled(match_classes(kinds.filter("course_id IS NOT NULL").select("id", "ord", *key)))  # read four times below
    linked = components(block_links(classes, threshold))
    member = classes.select(F.col("id").alias("node"), F.explode("ids").alias("id")).join(linked, "node", "left").select("id", F.coalesce("component", "node").alias("_block"))
    blocked = kinds.join(member, "id", "left").withColumn("_block", F.coalesce("_block", "id"))

    def fold(bucket: pd.DataFrame) -> pd.DataFrame:
        blocks: dict = {}
        for r in bucket.to_dict("records"):
            blocks.setdefault(r["_block"] if _there(r["_block"]) else None, []).append(r)
        made = [r for block in blocks.values() for r in _folded(block, threshold)]
        return pd.DataFrame(made)[["course_id", "id", "title", "type", "due", "weight", "members"]]

    # many small blocks a group, about BUCKET_KINDS kinds; large ones are dealt to tasks of their own, which Spark would merge by their few bytes
    n = kinds.count() // BUCKET_KINDS + 1
    buckets = blocked.withColumn("_bucket", F.pmod(F.xxhash64("_block"), F.lit(n))).repartition(n, "_bucket")
    types = dict(rows.dtypes)
    return buckets.groupBy("_bucket").applyInPandas(fold, f"course_id {types['course_id']}, id {types['id']}, title string, type string, due {types['due']}, weight double, members long")


def gradebook_match(grades: DataFrame, items: DataFrame) -> DataFrame:
    """grade_id and item_id: by tool id and equal title, else by tool id alone if one item has it, else by equal title; first item on ties.

    grades: grade_id, course_id, tool_id, title. items: item_id, course_id, tool_id, title, ord. Rows of one grade_id are one grade. Items
    become one row for each key before they meet grades, so that no step has more rows than grades or items."""
    first = lambda keys, k: items.groupBy(*keys).agg(F.min(F.struct("ord", "item_id")).alias(f"i{k}"), F.count("*").alias(f"n{k}"))
    met = grades
    for k, keys in enumerate((["course_id", "tool_id", "title"], ["course_id", "tool_id"], ["course_id", "title"]), 1):
        met = met.join(first(keys, k), keys, "left")
    best = met.groupBy("grade_id").agg(F.min("i1").alias("both"), F.min("i2").alias("alone"), ((F.max("n2") == 1) & (F.min("i2") == F.max("i2"))).alias("sole"), F.min("i3").alias("named"))
    prio = F.when(F.col("both").isNotNull(), 1).when(F.col("sole"), 2).when(F.col("named").isNotNull(), 3)
    best = best.withColumn("prio", prio).select("grade_id", F.when(F.col("prio") == 1, F.col("both")).when(F.col("prio") == 2, F.col("alone")).otherwise(F.col("named"))["item_id"].alias("item_id"), "prio")
    return grades.select("grade_id").join(best, "grade_id", "left").select("grade_id", "item_id", "prio")


def entity_links(edges: list[DataFrame]) -> DataFrame:
    """Typed edges (from_id, to_id, kind) of several rules as one set with ids; an edge that several rules give counts once."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.select(F.concat_ws(":", F.lit("link"), "kind", "from_id", "to_id").alias("id"), "from_id", "to_id", "kind").distinct()


def neighbourhood(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, other and kind of the links of each wanted id, in either direction."""
    both = links.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "kind").unionByName(links.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "kind"))
    return both.join(wanted, "id", "left_semi").distinct()
