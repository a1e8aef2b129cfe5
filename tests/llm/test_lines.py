"""Line dedup against a brute-force form, and the cases that it must take."""

import random
import re
from collections import defaultdict

import numpy as np

from studyplane.llm import lines

KEY = re.compile("^[ \t-\r]+|[ \t-\r]+$")


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in KEY.sub("", line))


def brute(rows, least_chars=10):
    held = defaultdict(set)
    last = float("inf")
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least_chars:
                held[key(x)].add(last if i is None else i)
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        own = last if i is None else i
        left = [x for x in every if len(held[key(x)]) < 2 or min(held[key(x)]) == own]
        out.append((i, len(every), len(every) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, chunk string, keys int, n_lines int")
    return sorted((tuple(r) for r in lines.deduplicated(df, **more).collect()), key=repr)


def sample(n=80, seed=3):
    r = random.Random(seed)
    known = [" ".join(r.choice("abcdefghij") * r.randint(1, 5) for _ in range(r.randint(1, 9))) for _ in range(60)]
    rows = []
    for i in range(n):
        picked = [r.choice([str.upper, str, lambda x: f" \t{x}\r", lambda x: f"\x0b{x} "])(r.choice(known)) for _ in range(r.randint(0, 12))]
        rows.append((i * 3 % 101, "\n".join(picked + [f"only here {i}"] * (i % 3))))
    return [*rows, (None, known[1]), (None, known[1] + "\nthe null id's own line"), (None, "the null id's own line"), (500, None), (501, ""), (502, "\n\n \n"), (503, "\n".join(known * 50)), (6, known[2]), (6, known[2]), (504, "línea ñandú\nlínea ñandú"), (505, "LíNEA ñandú "), (506, "línea ñandÚ"), (507, "123456789\n1234567890"), (508, "123456789\n1234567890\n")]


def test_lines_go_as_by_brute_force(spark):
    rows = sample()
    assert found(spark, rows) == brute(rows)


def test_rows_dealt_over_many_chunks_and_shards(spark):
    """Small chunks and shards, with shards that are summed in parts."""
    rows = sample(200, 5)
    assert found(spark, rows, chunk_bytes=300, shard_lines=40) == brute(rows)


def test_equal_texts_empty_tables_and_no_lines(spark):
    assert found(spark, []) == []
    rows = [(i, "one and the same line\nshort") for i in range(30)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, [(1, None), (2, None)]) == [(1, 1, 0, ""), (2, 1, 0, "")]


def test_more_documents_than_two(spark):
    rows = [(1, "in two documents"), (2, "in two documents\nin three documents"), (3, "in three documents"), (4, "in three documents")]
    assert [r[2] for r in found(spark, rows, least_docs=3)] == [0, 0, 1, 1]


def test_perfect_hash_is_minimal_and_probes_reject_strangers():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        made = lines.PerfectHash.of(keys)
        again = lines.PerfectHash(made.sizes, made.packed())
        assert sorted(again.slots(keys).tolist()) == list(range(len(keys)))
    assert made.sizes.sum() < 6 * len(keys)
    prints = r.integers(0, 1 << 32, len(keys)).astype(np.uint32)
    joined = lines._joined(keys, prints, 0)
    made = lines.PerfectHash.of(joined)
    order = np.argsort(made.slots(joined))
    index = {"n": len(keys), "seed": 0, "sizes": made.sizes.tolist(), "bits": made.packed(), "fingerprints": prints[order].tobytes(), "counts": np.full(len(keys), 3, np.uint8).tobytes(), "owners": keys[order].tobytes()}
    count, first = lines.probed(keys, prints, index)
    assert (count == 3).all() and (first == keys.astype(np.int64)).all()
    assert (lines.probed(keys + np.uint64(1), prints, index)[0] > 0).sum() < 5


def test_the_query_hashes_the_kept_text(spark, tmp_path):
    import hashlib

    from studyplane.llm import queries

    rows = sample(20)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_line_dedup(spark, str(tmp_path)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)
    assert got == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows)), key=repr)
