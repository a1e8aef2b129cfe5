"""Ranked lexical search: Block-Max MaxScore over sharded inverted indexes with block-compressed postings.

A shard is the inverted index of a run of documents. Its terms are known by 64-bit hashes; a term's postings lie in blocks of up to BLOCK
documents, each with the greatest share of a score in it (its maximum) and its last document, which are read without the postings. A
search splits an item's lists by their greatest shares: while the sum of the smallest is below what the k-th best document has, no document
can enter by these lists alone, so only the others, the essential ones, are read for candidates. A candidate is dropped as soon as what it has
and the block maxima of the lists that are left can't reach the k-th best; only blocks that a candidate survives to are decoded."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import over_batches, ragged, slices, small_batches, within, written
from .words import ALNUM, LOWER, word_bounds, word_hashes

#: Bytes of text in a shard (one text at least) and taken into words at once; postings of a block; documents looked at between two thresholds.
SHARD_BYTES, SLICE_BYTES, BLOCK, WINDOW = 1 << 24, 1 << 22, 64, 2048

#: Bytes of item text whose terms are broadcast in one pass.
PASS_BYTES = 1 << 24

#: Stands for a null id, after all others.
_NULL = (1 << 63) - 1


def _terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of each row laid end to end, and their offsets by row."""
    _, offsets = ragged(text)
    hashes, counts = [], []
    for a, e in slices(offsets, SLICE_BYTES):
        data, at = ragged(text.slice(a, e - a))
        data = LOWER[data]
        starts, ends, rows = word_bounds(data, at, ALNUM)
        hashes.append(word_hashes(data, starts, ends))
        counts.append(np.diff(rows))
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def _share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _norm(length: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents of these lengths: 75 + 25 * length * n div total. By parts, since the product may pass 64 bits."""
    whole, rest = divmod(25 * n, max(total, 1))
    if rest * int(length.max(initial=0)) < 1 << 62:
        return 75 + length * whole + length * rest // max(total, 1)
    return np.array([75 + 25 * x * n // max(total, 1) for x in length.tolist()], np.int64)


def _width(x: np.ndarray) -> np.ndarray:
    """Bytes that hold each number: 1, 2 or 4."""
    return np.where(x < 1 << 8, 1, np.where(x < 1 << 16, 2, 4))


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    for w in (1, 2, 4):
        mine = np.flatnonzero(width == w)
        raw = values[mine].astype("<u4").view(np.uint8).reshape(-1, 4)
        for k in range(w):
            out[at[mine] + k] = raw[:, k]


_SHARD = "shard long, n_docs long, doc_ids binary, norms binary, terms binary, df binary, tops binary, n_blocks binary, lasts binary, maxima binary, sizes binary, widths binary, postings binary"


def shard_of(ids: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, n: int, total: int) -> tuple:
    """The index of one shard: documents in the order of their ids (null last), terms by hash, blocks by term, postings by block.

    A block's postings are its documents' gaps, then their occurrences, each in the fewest bytes that hold all of the block's."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    doc = np.repeat(place, lengths)
    by = np.lexsort((doc, hashes))
    h, d = hashes[by], doc[by]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
    h, d, tf = h[at], d[at], np.diff(np.append(at, len(by)))
    norm = _norm(lengths[order], n, total)
    terms, first = np.unique(h, return_index=True)
    df = np.diff(np.append(first, len(h)))
    blocks = -(-df // BLOCK)
    start = np.repeat(first, blocks) + within(blocks) * BLOCK
    size = np.diff(np.append(start, len(h)))
    share = _share(tf, norm[d])
    if len(start):
        maxima, lasts = np.maximum.reduceat(share, start), d[start + size - 1]
        tops = np.maximum.reduceat(share, first)
        gap = np.diff(d, prepend=0)
        gap[start] = d[start]
        wide = [_width(np.maximum.reduceat(x, start)) for x in (gap, tf)]
        bytes_of = size * (wide[0] + wide[1])
        base = np.cumsum(bytes_of) - bytes_of
        of = np.repeat(np.arange(len(start)), size)
        inside = np.arange(len(h)) - start[of]
        out = np.zeros(int(bytes_of.sum()), np.uint8)
        _put(out, base[of] + inside * wide[0][of], gap, wide[0][of])
        _put(out, base[of] + size[of] * wide[0][of] + inside * wide[1][of], tf, wide[1][of])
    else:
        maxima = lasts = tops = np.zeros(0, np.int64)
        wide, out = [np.zeros(0, np.int64)] * 2, np.zeros(0, np.uint8)
    u4 = lambda x: x.astype("<u4").tobytes()
    return len(ids), ids[order].astype("<i8").tobytes(), norm.astype("<i8").tobytes(), terms.tobytes(), u4(df), u4(tops), u4(blocks), u4(lasts), u4(maxima), size.astype(np.uint8).tobytes(), (wide[0] * 8 + wide[1]).astype(np.uint8).tobytes(), out.tobytes()


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            _, at = _terms(b.column(0))
            n, total = n + int((np.diff(at) > 0).sum()), total + int(at[-1])
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    small_batches(docs.sparkSession)
    got = docs.select(F.col(text_col).alias("text")).mapInArrow(over_batches(count), "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return got["n"] or 0, got["total"] or 0


def indexed(docs: DataFrame, n: int, total: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard: its documents and lengths, dictionary, block maxima and postings. n and total: see `totals`."""
    from pyspark import TaskContext

    small_batches(docs.sparkSession)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, room, held = TaskContext.get().partitionId() << 32, shard_bytes, []

        def made() -> pa.RecordBatch:
            ids, lengths, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            has = lengths > 0
            row = (shard, *shard_of(ids[has], lengths[has], hashes, n, total))
            kinds = [pa.int64()] * 2 + [pa.binary()] * 11
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], [x.split()[0] for x in _SHARD.split(", ")])

        for b in batches:
            _, offsets = ragged(b.column(1))
            begin = 0
            while begin < b.num_rows:
                end = int(np.searchsorted(offsets, offsets[begin] + room, side="right")) - 1
                end = max(end, begin + (room == shard_bytes))  # a text of any length goes into an empty shard
                if end > begin:
                    part = b.slice(begin, end - begin)
                    hashes, at = _terms(part.column(1))
                    held.append((pc.fill_null(part.column(0), pa.scalar(_NULL, pa.int64())).to_numpy(zero_copy_only=False), np.diff(at), hashes))
                    room -= int(offsets[end] - offsets[begin]) + 64 * (end - begin)
                    begin = end
                if begin < b.num_rows or room <= 0:
                    yield made()
                    shard, room, held = shard + 1, shard_bytes, []
        if held:
            yield made()

    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return body.mapInArrow(over_batches(build), _SHARD)


class Shard:
    """A shard's index as it is searched. read counts the blocks that were decoded, of seen that asked lists have."""

    def __init__(self, row: dict):
        kinds = {"doc_ids": "<i8", "norms": "<i8", "terms": "<u8", "df": "<u4", "tops": "<u4", "n_blocks": "<u4", "lasts": "<u4", "maxima": "<u4", "sizes": np.uint8, "widths": np.uint8, "postings": np.uint8}
        for name, kind in kinds.items():
            setattr(self, name, np.frombuffer(row[name], kind))
        self.first = np.concatenate([[0], np.cumsum(self.n_blocks, dtype=np.int64)])
        wide = (self.widths >> 3).astype(np.int64), (self.widths & 7).astype(np.int64)
        bytes_of = self.sizes.astype(np.int64) * (wide[0] + wide[1])
        self.base = np.cumsum(bytes_of) - bytes_of
        self.read = self.seen = 0
        self.decoded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def lists(self, hashes: np.ndarray) -> np.ndarray:
        """Each term's list, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and shares of a block; kept while the shard is searched, as items have terms in common."""
        if b not in self.decoded:
            n, w, v, at = int(self.sizes[b]), int(self.widths[b]) >> 3, int(self.widths[b]) & 7, int(self.base[b])
            doc = np.cumsum(np.frombuffer(self.postings, f"<u{w}", n, at), dtype=np.int64)
            tf = np.frombuffer(self.postings, f"<u{v}", n, at + n * w).astype(np.int64)
            self.decoded[b] = doc, _share(tf, self.norms[doc])
            self.read += 1
        return self.decoded[b]

    def span(self, t: int, low: int, high: int) -> tuple[int, int]:
        """The blocks of list t that may hold documents from low to before high."""
        a, e = int(self.first[t]), int(self.first[t + 1])
        lasts = self.lasts[a:e]
        return a + int(np.searchsorted(lasts, low)), min(e, a + int(np.searchsorted(lasts, high - 1)) + 1)

    def search(self, hashes: np.ndarray, weights: np.ndarray, k: int, best: Best) -> None:
        """Adds the shard's documents to an item's best k. weights: of each distinct term, its repeats counted."""
        t = self.lists(hashes)
        there = np.flatnonzero((t >= 0) & (weights > 0))
        if not len(there):
            return
        t, w = t[there], weights[there]
        bound = self.tops[t].astype(np.int64) * w
        order = np.argsort(bound, kind="stable")
        t, w, bound = t[order].tolist(), w[order].tolist(), bound[order]
        below = np.concatenate([[0], np.cumsum(bound)])  # what the first lists add at most
        self.seen += int(sum(self.n_blocks[x] for x in t))
        low, step = 0, WINDOW // 8  # a first short window gives a threshold
        while low < len(self.doc_ids):
            high, floor = min(low + step, len(self.doc_ids)), best.floor(k)
            low_, low, step = low, high, WINDOW
            essential = int(np.searchsorted(below[1:], floor, side="left"))  # lists before it stay below the floor together
            if essential == len(t):
                return
            score = np.zeros(high - low_, np.int64)
            for i in range(essential, len(t)):
                for b in range(*self.span(t[i], low_, high)):
                    doc, share = self.block(b)
                    a, e = np.searchsorted(doc, (low_, high))
                    score[doc[a:e] - low_] += share[a:e] * w[i]
            found = np.flatnonzero(score)
            score, found = score[found], found + low_
            if essential and len(found):
                # what the other lists may add, by the maximum of the block that each candidate would be in
                most, blocks = np.zeros((essential, len(found)), np.int64), np.zeros((essential, len(found)), np.int64)
                for i in range(essential):
                    a, e = int(self.first[t[i]]), int(self.first[t[i] + 1])
                    at = a + np.searchsorted(self.lasts[a:e], found)
                    some = at < e
                    most[i, some], blocks[i] = self.maxima[at[some]].astype(np.int64) * w[i], at
                left = most.sum(0)
                for i in reversed(range(essential)):
                    keep = score + left >= floor
                    score, found, most, blocks, left = score[keep], found[keep], most[:, keep], blocks[:, keep], left[keep]
                    left = left - most[i]
                    asked = np.flatnonzero(most[i])
                    for b in np.unique(blocks[i, asked]).tolist():
                        doc, share = self.block(b)
                        mine = asked[blocks[i, asked] == b]
                        at = np.minimum(np.searchsorted(doc, found[mine]), len(doc) - 1)
                        score[mine] += np.where(doc[at] == found[mine], share[at] * w[i], 0)
            keep = score >= max(floor, 1)
            best.add(score[keep], self.doc_ids[found[keep]], k)


class Best:
    """An item's best documents so far: score, then the smaller id."""

    def __init__(self):
        self.score, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self, k: int) -> int:
        """The score that a document must reach to be among them."""
        return int(self.score[k - 1]) if len(self.score) >= k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, k: int) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score))[:k]
        self.score, self.ids = score[order], ids[order]


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (of an item), item_id, hashes and counts of the distinct terms of each item that has one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, at = _terms(b.column(2))
            made = [np.unique(hashes[i:j], return_counts=True) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.view(np.int64).tolist() for x, _ in made], pa.list_(pa.int64())), pa.array([c.tolist() for _, c in made], pa.list_(pa.int64()))], ["row", "item_id", "hashes", "counts"])

    body = items.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    return body.mapInArrow(over_batches(cut), f"row long, item_id {dict(body.dtypes)['item_id']}, hashes array<bigint>, counts array<bigint>").filter(F.size("hashes") > 0)


def _pass(index: DataFrame, items: list, n: int, k: int) -> DataFrame:
    """Each task's best k documents of these items: item, score, doc_id."""
    hashes = [np.array(r["hashes"], np.int64).view(np.uint64) for r in items]
    asked = np.unique(np.concatenate(hashes))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(asked), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                terms = np.frombuffer(r["terms"], "<u8")
                _, mine, theirs = np.intersect1d(asked, terms, assume_unique=True, return_indices=True)
                sums[mine] += np.frombuffer(r["df"], "<u4")[theirs]
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["term", "df"])

    df = np.zeros(len(asked), np.int64)
    for r in index.select("terms", "df").mapInArrow(over_batches(found), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # no more rows than terms asked
        df[r["term"]] = r["df"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    queries = [(h, weight[np.searchsorted(asked, h)] * np.array(r["counts"], np.int64)) for h, r in zip(hashes, items, strict=True)]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best() for _ in queries]
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.slice(i, 1).to_pylist()[0])
                for heap, (h, w) in zip(best, queries, strict=True):
                    shard.search(h, w, k, heap)
        size = [len(x.score) for x in best]
        ids = np.concatenate([x.ids for x in best])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), size)), pa.array(np.concatenate([x.score for x in best])), pa.array(ids, pa.int64(), mask=ids == _NULL)], ["item", "score", "doc_id"])

    return index.mapInArrow(over_batches(search), "item long, score long, doc_id long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", shard_bytes: int = SHARD_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's k best documents with a score above 0, equal scores by doc_id (null last).

    Terms are [^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+ of whole texts, only A-Z lower-cased. A term's weight is
    floor(1000 * ln((2 N + 2) / (2 df + 1))), its share in a document 10^9 tf div (1000 tf + 12 m), m = 75 + 25 n N div L; a score sums
    weight times share over the item's terms, repeats included. N: documents with a term, L: their terms, n: one document's.

    Items and documents without a term (null and empty texts among them) give and take nothing. Rows are items and documents of their own
    also where ids repeat or are null. Whole texts are read, other columns are not; without rows on one side there are none. Terms are told apart by 64-bit hashes.

    The index is written once; items are searched for pass by pass, each of pass_bytes of text, after one another, so that one pass's items
    and no more are broadcast and collected. A task goes through its shards with the same heaps, so later shards start from its floors."""
    spark = docs.sparkSession
    n, total = totals(docs, text_col)
    index = written(indexed(docs, n, total, id_col, text_col, shard_bytes), "index")
    size = items.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    passes = -(-size // pass_bytes) or 1
    terms = written(_item_terms(items, item_col, text_col).withColumn("pass", F.pmod(F.xxhash64("row"), F.lit(passes))), "items")
    kind = dict(terms.dtypes)["item_id"]
    out = spark.createDataFrame([], f"row long, item_id {kind}, score long, doc_id long")
    for p in range(passes):
        mine = terms.filter(F.col("pass") == p).select("row", "item_id", "hashes", "counts").collect()
        if mine:
            names = spark.createDataFrame([(i, r["row"], r["item_id"]) for i, r in enumerate(mine)], f"item long, row long, item_id {kind}")
            found = written(_pass(index, mine, n, k).join(F.broadcast(names), "item").select("row", "item_id", "score", "doc_id"), "found")  # a pass's items
            out = out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
