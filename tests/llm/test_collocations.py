"""Collocations against a brute-force form, and the cases that they must take."""

import random
import re
from collections import Counter, defaultdict

import pytest

from studyplane.llm import collocations


def brute(rows, least=10, cover=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            if len(p) == 2 and any(100 * b >= cover * a for q, b in often.items() if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2) for i, t, lang in rows], "doc_id long, text string, lang string, w1 string, n int, level int")


def found(spark, rows, **more):
    return sorted(tuple(r) for r in collocations.mined(frame(spark, rows), **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def sample(n=150, seed=1):
    r = random.Random(seed)
    vocab = ["the", "Of", "a", "ñandú", "東京", "x-y", "d'or", "b", "c", "e", "f(g)", " ", "é"]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) + r.choice(["", "", "", ".", ", ", "\n", ":;", "\x0b"]) for _ in range(r.randint(0, 60))]
        rows.append((i, r.choice([" ", "  ", "\t"]).join(words), r.choice(["en", "de", None, "und", "z h"])))
    return [*rows, (1, None, "en"), (2, "", None), (3, " .,\n", "fr"), (4, "New York City " * 400, "en"), (4, "New York City " * 400, "en"), (5, "rare words", "la"), (None, "of the of the. of the", "en")]


@pytest.mark.parametrize("wide", [None, 1])
def test_phrases_as_by_brute_force(spark, wide):
    """wide=1: nearly all pairs are dealt by all three words."""
    rows = sample()
    assert found(spark, rows, wide=wide) == brute(rows)


def test_other_bounds(spark):
    rows = sample(60, 2)
    assert found(spark, rows, least=2, cover=80, top=7) == brute(rows, 2, 80, 7)


def test_no_rows_and_no_phrases(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, "en"), (2, "one two three", None)]) == []


def test_counts_of_all_orders(spark):
    rows = sample(80, 3)
    got = {(r["lang"], *(w for w in (r["w1"], r["w2"], r["w3"]) if w)): r["n"] for r in collocations.phrases(frame(spark, rows), 1).collect()}
    want = Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            for i in range(len(w)):
                want[(lang or "und",)] += 1
                for k in (1, 2, 3):
                    if i + k <= len(w):
                        want[(lang or "und", *w[i : i + k])] += 1
    assert got == dict(want)


def test_scores_beyond_64_bits(spark):
    a = 3 * 10**12
    df = spark.createDataFrame([(a, a + 1, a + 5)], "a long, l long, r long").select(collocations._score("a", "l", "r").alias("s"))
    assert df.first()["s"] == 10**6 * a * a // ((a + 1) * (a + 5))


def test_equal_counts_tie_by_first_cut_then_phrase(spark):
    rows = [(i, "b a. d c. p q r", "en") for i in range(10)]
    assert found(spark, rows) == brute(rows)
    assert [r[2] for r in found(spark, rows)] == ["b a", "d c", "p q r"]
