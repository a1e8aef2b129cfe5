"""The content hash against a plain loop over code units."""

import random

import pytest
from pyspark.sql import functions as F

from studyplane.functions import text


def brute(t):
    h, data = text.FNV_START, (t or "").encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = (h ^ int.from_bytes(data[i : i + 2], "little")) * text.FNV_FACTOR % 2**32
    return f"fnv_{h:08x}_{len(data) // 2}"


@pytest.mark.parametrize("n", [1, 5, 16, 17, 18, 300])
def test_hashes(spark, n):
    rng = random.Random(n)
    of = lambda k: "".join(rng.choice("abé日😀\n\0 ") for _ in range(k))
    texts = [None, "", of(50_000)] + [of(rng.randrange(40)) for _ in range(n)]
    rng.shuffle(texts)
    texts = texts[:n]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    got = dict(df.select("k", text.content_hash(F.col("t"))).collect())
    assert got == {k: brute(t) for k, t in enumerate(texts)}
    assert {r[0]: r[1] for r in df.select("k", text.fnv1a(F.col("t"))).collect() if texts[r[0]] is None} == {k: None for k, t in enumerate(texts) if t is None}


def test_no_rows(spark):
    assert spark.createDataFrame([], "t string").select(text.content_hash(F.col("t"))).count() == 0
