"""Ranked search against a brute-force form, and the cases that it must take."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
import pytest

from studyplane.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LAST = 1 << 63


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(w for _, c, _ in counted for w in c)
    out = []
    for item, text in items:
        asked = Counter(terms(text))
        found = []
        for i, c, size in counted:
            m = 75 + 25 * size * n // total
            score = sum(r * floor(1000 * log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, r in asked.items() if c[w])
            if score > 0:
                found.append((-score, LAST if i is None else i, i))
        out += [(item, p, i, -s) for p, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, row string, score int")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in lexical.ranked(d, b, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def sample(n=150, seed=1):
    r = random.Random(seed)
    vocab = [f"w{min(int(r.paretovariate(0.7)), 400)}" for _ in range(4000)]
    rows = [(i * 7 % 1009, " ".join(r.choice(vocab) for _ in range(r.randint(1, 90)))) for i in range(n)]
    rows += [(2000, None), (2001, ""), (2002, " -- "), (2003, rows[3][1]), (2004, rows[3][1]), (rows[3][0], rows[3][1]), (None, rows[3][1]), (None, "W1 alone"), (2005, " ".join(vocab)), (2006, "Ñandú ñandú NANDÚ 東京,w2")]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(1, 30)))) for i in range(12)]
    items += [(50, None), (51, ""), (52, rows[3][1]), (53, "ñandú w2 Ñandú 東京"), (54, "unheard of"), (5, "w1 w1 w1"), (None, "w3 w4"), (None, "w5")]
    return rows, items


def test_ranks_as_by_brute_force(spark):
    rows, items = sample()
    assert found(spark, rows, items) == brute(rows, items)


def test_many_shards_passes_and_blocks(spark):
    rows, items = sample(1500, 2)
    assert found(spark, rows, items, shard_bytes=20_000, pass_bytes=300) == brute(rows, items)
    assert found(spark, rows, items, k=3) == brute(rows, items, 3)


def test_empty_sides(spark):
    rows, items = sample(10)
    assert found(spark, [], items) == []
    assert found(spark, rows, []) == []
    assert found(spark, [(1, None), (2, "..")], items) == []


def test_equal_texts_are_ranked_by_id(spark):
    rows = [(i, "same words here") for i in range(60)] + [(i, "something else") for i in range(100, 300)]
    assert found(spark, rows, [(1, "same words")]) == brute(rows, [(1, "same words")])


@pytest.mark.parametrize("seed", range(3))
def test_a_shard_skips_blocks_and_finds_the_same(seed):
    """Lists of frequent terms are asked only where a candidate survives; results equal the full sums."""
    r = np.random.default_rng(seed)
    docs = [" ".join(["common"] * int(r.integers(1, 4)) + [f"r{x}" for x in r.zipf(1.4, 30) % 3000]) for _ in range(6000)]
    hashes, at = lexical._terms(pa.array(docs))
    n, total = len(docs), len(hashes)
    row = lexical.shard_of(np.arange(n), np.diff(at), hashes, n, total)
    shard = lexical.Shard(dict(zip([x.split()[0] for x in lexical._SHARD.split(", ")], (0, *row), strict=True)))
    asked = lexical._terms(pa.array(["common r1 r2 r7 r900 r901"]))[0]
    weights = np.array([1, 700, 900, 2500, 8000, 8200])
    best = lexical.Best()
    shard.search(asked, weights, 20, best)
    score = np.zeros(n, np.int64)
    for h, w in zip(asked.tolist(), weights.tolist(), strict=True):
        tf = np.add.reduceat((hashes == np.uint64(h)).astype(np.int64), at[:-1])
        score += np.where(tf > 0, w * lexical._share(tf, lexical._norm(np.diff(at), n, total)), 0)
    order = np.lexsort((np.arange(n), -score))[:20]
    assert best.ids.tolist() == order.tolist() and best.score.tolist() == score[order].tolist()
    assert shard.read < shard.seen


def test_norms_whose_product_passes_64_bits():
    lengths = np.array([1, 10**12, 3 * 10**12])
    assert lexical._norm(lengths, 10**11, 7 * 10**13).tolist() == [75 + 25 * x * 10**11 // (7 * 10**13) for x in lengths.tolist()]
