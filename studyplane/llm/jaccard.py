"""N-gram Jaccard join by vertical partitioning, and the groups that its links make: exact for the hashes of the n-grams.

N-grams are told apart by 64-bit hashes, of which all bits are kept, and sets by two such sums. Two n-grams of a corpus that share a hash
count as one; of a pair of sets with a thousand n-grams each that befalls one in about 10^13.

The n-grams' hashes are the global order, cut into fragments; each document's set is cut along. A fragment counts how many different
sets hold each of its n-grams, and later the partial overlap of each candidate pair; overlaps are summed per pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, over_batches, over_group, ragged, slices, small_batches, within, written
from .components import components
from .words import LOWER, NOT_BLANK, shingles, word_bounds, word_hashes

#: Bytes of text shingled at once, n-grams of a counting fragment, fragments in which overlaps are counted.
SLICE_BYTES, FRAGMENT_NGRAMS, OVERLAP_BITS = 1 << 22, 1 << 21, 2

#: Centres drawn in a group of candidates in each round after the first; a group of no more members is compared in full.
CENTRES = (16, 1024)


def _sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = ragged(column)
    data = LOWER[data]
    starts, ends, at = word_bounds(data, offsets, NOT_BLANK)
    return shingles(word_hashes(data, starts, ends), at, n)


def _set_keys(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set, alike for equal sets."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(keys) + 1, np.uint64)
        np.cumsum(mixed(keys ^ np.uint64(salt)), out=sums[1:])
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


def shingle_sets(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and the set's keys k1, k2 of each row."""
    small_batches(docs.sparkSession)
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = ragged(b.column(1))
            for a, e in slices(offsets, SLICE_BYTES):
                keys, at = _sets(b.column(1).slice(a, e - a), n)
                k1, k2 = _set_keys(keys, at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), pa.array(np.diff(at), pa.int64()), pa.array(k1), pa.array(k2)], ["doc_id", "n_shingles", "k1", "k2"])

    return body.mapInArrow(over_batches(rows), f"doc_id {dict(body.dtypes)['doc_id']}, n_shingles long, k1 long, k2 long")


def _wide(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<u8").astype(np.uint64)


def _runs(sorted_keys: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """The values of sorted keys, and where each begins and ends: only those that are there, however many there could be."""
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[at].tolist(), at.tolist(), np.append(at[1:], len(sorted_keys)).tolist()


def shared(docs: DataFrame, n: int, bits: int, least: int, text_col: str = "text") -> DataFrame:
    """The sets that can have a partner, in fragments: k1, n, alone, fragment, tokens, prefix, places.

    tokens: the set's n-grams that another set holds too; alone: how many no other set holds. Ordered by rarity, a set's first
    n - ceil(least * n / 100) + 1 n-grams meet those of each partner; those of them that are shared are in prefix, and their places by rarity in places. A set with so many
    n-grams of its own has no partner and is left out."""
    small_batches(docs.sparkSession)
    upper = lambda x: (x >> np.uint64(64 - bits)).astype(np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = ragged(b.column(0))
            for a, e in slices(offsets, SLICE_BYTES):
                keys, at = _sets(b.column(0).slice(a, e - a), n)
                k1, _ = _set_keys(keys, at)
                size = np.diff(at)
                _, first = np.unique(k1, return_index=True)  # one row for each set
                once = np.zeros(len(k1), bool)
                once[first] = True
                once &= size > 0
                row = np.repeat(np.arange(len(size)), size)
                keep = once[row]
                keys, row = keys[keep], row[keep]
                place = np.cumsum(once) - 1
                fragment = upper(keys)
                order = np.argsort(fragment, kind="stable")
                keys, row = keys[order], place[row[order]]
                kinds, sizes = k1[once], size[once]
                out = []
                for f, i, j in zip(*_runs(fragment[order]), strict=True):
                    there, runs = np.unique(row[i:j], return_counts=True)
                    out.append((f, kinds[there].tobytes(), sizes[there].astype("<u4").tobytes(), runs.astype("<u4").tobytes(), keys[i:j].astype("<u8").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), *(pa.array([o[k] for o in out], pa.binary()) for k in range(1, 5))], ["fragment", "k1", "n", "runs", "keys"])

    def occurring(t: pa.Table) -> pa.Table:
        k1, size, runs = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in (("k1", np.int64), ("n", "<u4"), ("runs", "<u4")))
        keys = _wide(t["keys"].to_pylist())
        _, first, kind = np.unique(k1, return_index=True, return_inverse=True)
        once = np.zeros(len(k1), bool)
        once[first] = True
        keep = np.repeat(once, runs)
        owner = np.repeat(np.arange(len(k1)), runs)[keep]
        keys = keys[keep]
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        begin = np.flatnonzero(new)
        held = np.repeat(np.diff(np.append(begin, len(keys))), np.diff(np.append(begin, len(keys))))
        some = held > 1
        keys, owner, held = keys[some], owner[some], held[some]
        order = np.lexsort((keys, owner, upper(k1[owner].view(np.uint64))))
        keys, owner, held = keys[order], owner[order], held[order]
        out = []
        for g, i, j in zip(*_runs(upper(k1[owner].view(np.uint64))), strict=True):
            there, number = np.unique(owner[i:j], return_counts=True)
            out.append((g, k1[there].tobytes(), size[there].astype("<u4").tobytes(), number.astype("<u4").tobytes(), keys[i:j].astype("<u8").tobytes(), held[i:j].astype("<u4").tobytes()))
        return pa.table({"g": pa.array([o[0] for o in out], pa.int64())} | {c: pa.array([o[k] for o in out], pa.binary()) for k, c in enumerate(("k1", "n", "runs", "keys", "held"), 1)})

    def partnered(t: pa.Table) -> pa.Table:
        runs = [np.frombuffer(x, "<u4") for x in t["runs"].to_pylist()]
        token = _wide(t["keys"].to_pylist())
        every = np.concatenate(runs)
        k1, size = (np.repeat(np.frombuffer(b"".join(t[c].to_pylist()), kind), every) for c, kind in (("k1", np.int64), ("n", "<u4")))
        held = np.frombuffer(b"".join(t["held"].to_pylist()), "<u4")
        order = np.lexsort((token, held, k1))
        k1, size, token = k1[order], size[order].astype(np.int64), token[order]
        begin = np.flatnonzero(np.concatenate([[True], k1[1:] != k1[:-1]]))
        common = np.diff(np.append(begin, len(k1)))
        n_of = size[begin]
        prefix = n_of + (-least * n_of) // 100 + 1  # n - ceil(least * n / 100) + 1
        alone = n_of - common
        able = alone < prefix
        rank = within(common)
        early = rank < np.repeat(prefix - alone, common)
        keep = np.repeat(able, common)
        place = rank + np.repeat(alone, common)
        k1, token, early, place = k1[keep], token[keep], early[keep], place[keep]
        set_of = np.repeat(np.arange(len(begin)), common)[keep]
        part = (token >> np.uint64(64 - OVERLAP_BITS)).astype(np.int64)
        order = np.lexsort((token, part, set_of))
        token, early, place, set_of, part = token[order].view(np.int64), early[order], place[order], set_of[order], part[order]
        cell = set_of * (1 << OVERLAP_BITS) + part
        at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        ends = np.append(at, len(cell))
        inside = np.concatenate([[0], np.cumsum(early)])
        return pa.table(
            {
                "k1": pa.array(k1[order][at], pa.int64()),
                "n": pa.array(n_of[set_of[at]], pa.int64()),
                "alone": pa.array(alone[set_of[at]], pa.int64()),
                "fragment": pa.array(part[at], pa.int32()),
                "tokens": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(token)),
                "prefix": pa.ListArray.from_arrays(pa.array(inside[ends], pa.int32()), pa.array(token[early])),
                "places": pa.ListArray.from_arrays(pa.array(inside[ends], pa.int32()), pa.array(place[early])),
            }
        )

    blobs = docs.select(F.col(text_col).alias("text")).mapInArrow(over_batches(cut), "fragment long, k1 binary, n binary, runs binary, keys binary")
    held = blobs.groupBy("fragment").applyInArrow(over_group(occurring), "g long, k1 binary, n binary, runs binary, keys binary, held binary")
    return held.groupBy("g").applyInArrow(over_group(partnered), "k1 long, n long, alone long, fragment int, tokens array<bigint>, prefix array<bigint>, places array<bigint>")


def verified(pairs: DataFrame, pieces: DataFrame, least: int) -> DataFrame:
    """Those of the pairs (a, b, n_a, n_b) with 100 * overlap >= least * union: partial overlaps by fragment, summed per pair."""
    left = pieces.select(F.col("k1").alias("a"), "fragment", F.col("tokens").alias("tokens_a"))
    right = pieces.select(F.col("k1").alias("b"), "fragment", F.col("tokens").alias("tokens_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long").alias("c"))
    both = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("c").alias("c"))
    return both.filter(100 * F.col("c") >= least * (F.col("n_a") + F.col("n_b") - F.col("c"))).select("a", "b")


def joined(docs: DataFrame, n: int = 5, least: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; a row's set has its distinct n-word shingles, or its whole sequence of
    fewer words. Rows link when 100 * intersection >= least * union. Equal sets are one class from the first step on. Null and empty
    texts and those without words have no shingles and are alone; null ids are kept, as component_id too where a group has no other;
    repeated rows are copies; texts are read whole; other columns are not read; no rows give no rows.

    Candidates share an n-gram of their prefixes. First each class is compared with the centre that most of its prefix points to; then,
    while a group of candidates has members in different components, with more and more of its members, up to all of them. Links inside
    a component are not looked for, since they change no component."""
    sets = written(shingle_sets(docs, n, id_col, text_col), "sets")
    total = sets.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    bits = max(2, (total // FRAGMENT_NGRAMS).bit_length())
    pieces = written(shared(docs, n, bits, least, text_col), "pieces")
    rows = written(pieces.select("k1", "n", (F.col("alone") / F.col("n")).alias("alone"), F.inline(F.arrays_zip(F.col("prefix").alias("token"), F.col("places").alias("place")))), "prefixes")

    def fits(a: str, b: str) -> F.Column:
        """Whether two sets can link if the shared n-gram is the first that they share, by rarity: what comes after it must suffice.
        A pair that links passes where it is the first."""
        most = F.least(F.col(a.format("n")) - F.col(a.format("place")), F.col(b.format("n")) - F.col(b.format("place")))
        return 100 * most >= least * (F.col(a.format("n")) + F.col(b.format("n")) - most)

    centre = rows.groupBy("token").agg(F.min(F.struct("alone", "k1", "n", "place")).alias("c"), F.count("*").alias("members")).filter("members > 1")
    votes = rows.join(centre, "token").filter((F.col("k1") != F.col("c.k1")) & fits("{}", "c.{}")).groupBy("k1", "n", F.struct("c.alone", "c.k1", "c.n").alias("c")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("k1", "n").agg(F.max(F.struct("votes", F.struct((-F.col("c.alone")).alias("alone"), F.col("c.k1").alias("k1"), F.col("c.n").alias("n")).alias("c"))).alias("best"))
    pairs = best.select(F.col("k1").alias("a"), F.col("best.c.k1").alias("b"), F.col("n").alias("n_a"), F.col("best.c.n").alias("n_b"))
    links = written(verified(pairs, pieces, least), "links")
    comps = written(components(links), "components")

    tested = 0
    open_rows = rows
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(min(least, 99) / 100) + 1e-9))
    for centres in [*CENTRES, None]:
        placed = open_rows.join(comps.withColumnRenamed("node", "k1"), "k1", "left").withColumn("component", F.coalesce("component", "k1"))
        groups = placed.groupBy("token").agg(F.count("*").alias("members"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token", "members")
        open_rows = written(placed.join(groups, "token").select("token", "k1", "n", "place", "component", "members"), "open")
        if open_rows.isEmpty():
            break
        draw = F.pmod(F.xxhash64("k1"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("members")
        new = open_rows.filter((draw < centres) & (draw >= tested)) if centres else open_rows.filter(draw >= tested)
        # sets that link differ in size by less than a band, so a hot n-gram's rows are split by size, and each pair meets once
        left = new.select("token", F.explode(F.array(*(band + k for k in (-1, 0, 1)))).alias("band"), F.col("k1").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("component").alias("component_b"))
        right = open_rows.filter(draw >= tested).select("token", band.alias("band"), F.col("k1").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), F.col("component").alias("component_a"))
        met = right.join(left, ["token", "band"])
        met = met.filter((F.col("component_a") != F.col("component_b")) & fits("{}_a", "{}_b"))
        low = F.col("a") < F.col("b")
        pairs = met.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("b"), F.when(low, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(low, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b")).distinct()
        more = written(verified(pairs, pieces, least), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            comps = written(components(links), "components")
        if not centres:
            break
        open_rows = open_rows.filter(F.col("members") > centres).select("token", "k1", "n", "place")
        tested = centres

    classes = sets.filter("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    classes = classes.join(comps.withColumnRenamed("node", "k1"), "k1", "left").withColumn("component", F.coalesce("component", "k1"))
    least_id = classes.groupBy("component").agg(F.min("first").alias("component_id"), F.sum("copies").alias("copies")).filter("copies > 1").select("component", "component_id")
    of_class = classes.join(least_id, "component").select("k1", "k2", "n_shingles", "component_id")
    out = sets.join(of_class, ["k1", "k2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
