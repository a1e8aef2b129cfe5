"""Exact top-k inner products over quantised vectors: impact-ordered posting segments, processed score-at-a-time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Components of the vectors of one index block and of one query block, at most; blocks are made smaller, down to SMALL vectors, until there
#: are BLOCKS of them. A vector block is read once for each query block, so a large query block keeps its copies few.
BLOCK, QUERY_BLOCK, SMALL, BLOCKS = 1 << 21, 1 << 20, 2048, 16

#: Queries that are searched for together; a query is finished exactly once no more than FEW of its block's vectors, or this share, are possible.
TOGETHER, FEW, FEW_SHARE = 256, 64, 16

#: Components beyond this count as this, and scores beyond a long as its largest or smallest.
_LARGEST = 1 << 62

#: Stands for a null id inside a block, after all others.
_NULL = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v: floor(scale * x) of each component as long, one row for each row that takes part, with a key of its own (row).

    Vectors that are null or hold a null or non-finite component take no part. Empty vectors and null ids do, and rows that share an id are
    vectors of their own. Components are held within 2 ** 62 either way."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    within = lambda c: F.greatest(F.lit(float(-_LARGEST)), F.least(F.lit(float(_LARGEST)), c * F.lit(float(scale))))
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(within(c)).cast("long")).alias("v"), F.monotonically_increasing_id().alias("row"))


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), d)


def segments(v: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The block's posting segments by falling impact: (largest size of a component there, dimension, row, value), postings by dimension.

    A segment holds the components whose size has one bit length; within it each dimension's postings lie together."""
    size = np.abs(v)
    level = np.frexp(size.astype(float))[1]
    out = []
    for k in sorted(set(np.unique(level).tolist()) - {0}, reverse=True):
        dim, row = np.nonzero((level == k).T)
        out.append((int(size[row, dim].max()), dim, row, v[row, dim]))
    return out


class ImpactBlock:
    """The impact-ordered index of one block of vectors, ordered by id (null ones last), then row."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, v: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.v = ids[order], v[order]
        self.by_row = np.argsort(rows[order])
        self.rows = rows[order][self.by_row]
        self.segments = segments(self.v)
        self.read = 0  # postings that searches went through, query by query
        self.skipped = 0  # and those that they did not need

    def own(self, rows: np.ndarray) -> np.ndarray:
        """The place of each query's own row here, or -1."""
        if not len(self.rows):
            return np.full(len(rows), -1)
        at = np.minimum(np.searchsorted(self.rows, rows), len(self.rows) - 1)
        return np.where(self.rows[at] == rows, self.by_row[at], -1)

    def search(self, query_rows: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, place of the vector, score): each query's best k of this block without its own row. Vectors that are below the
        query's floor, a score that k vectors elsewhere reach, may be left out.

        Segments add to the scores of all queries, the largest impacts first. What is still unread changes a score by no more than the
        query's absolute sum times the next segment's impact, nor than the query's length times the length of what the vector has unread.
        A query is finished when the k-th lowest possible score, or its floor, is over the highest possible one of all but a few vectors:
        those few are rescored exactly, in whole numbers. The last segment leaves exact scores."""
        n = len(self.ids)
        bound = self._bound(q)
        if bound >= 2.0**62:
            return self._plain(query_rows, q, k)
        exact = np.float64 if bound < 2**53 else np.int64
        kind = np.float32 if exact is np.float64 and bound < 2**24 else exact
        score = np.zeros((len(q), n), kind)
        own = self.own(query_rows)
        floor = np.full(len(q), -np.inf) if floor is None else floor
        active = np.arange(len(q))
        unread = (self.v.astype(float) ** 2).sum(1)
        sums, lengths = np.abs(q).sum(1).astype(float), np.sqrt((q.astype(float) ** 2).sum(1))
        places, found, values = [], [], []
        most, few_enough = min(k, n), max(FEW, n // FEW_SHARE)
        for s, (_, dim, row, value) in enumerate(self.segments):
            dense = np.zeros((q.shape[1], n), kind)
            dense[dim, row] = value
            score[active] += q[active].astype(kind) @ dense
            self.read += len(active) * len(value)
            unread -= np.bincount(row, weights=value.astype(float) ** 2, minlength=n)
            if s + 1 == len(self.segments) or n <= k:
                continue
            slack = np.minimum(sums[active, None] * self.segments[s + 1][0], lengths[active, None] * np.sqrt(np.maximum(unread, 0))[None, :] * (1 + 1e-9) + 1e-6)
            at = score[active].astype(float)
            low = at - slack
            has = np.flatnonzero(own[active] >= 0)
            low[has, own[active][has]] = -np.inf
            kth = np.maximum(np.partition(low, n - most, axis=1)[:, n - most], floor[active])
            possible = at + slack >= kth[:, None]
            few = possible.sum(1) <= few_enough
            if not few.any():
                continue
            self.skipped += int(few.sum()) * sum(len(x[3]) for x in self.segments[s + 1 :])
            for j in np.flatnonzero(few):
                i = active[j]
                c = np.flatnonzero(possible[j])
                c = c[c != own[i]]
                made = self.v[c].astype(exact) @ q[i].astype(exact)
                best = np.lexsort((c, -made))[:k]
                best = best[made[best] >= floor[i]]
                places.append(np.full(len(best), i))
                found.append(c[best])
                values.append(made[best].astype(np.int64))
            active = active[~few]
            if not len(active):
                break
        if len(active):
            left = score[active].astype(np.int64)
            # the score, then the smaller place, as one number: unique, so that ties are settled by it
            if int(np.abs(left).max(initial=0)) * 2 * n >= 2**62:
                return self._plain(query_rows, q, k)
            lowest = -(1 << 62)
            key = left * n + (n - 1 - np.arange(n))
            has = np.flatnonzero(own[active] >= 0)
            key[has, own[active][has]] = lowest
            best = np.argpartition(-key, most - 1, axis=1)[:, :most] if most < n else np.tile(np.arange(n), (len(active), 1))
            keep = ((np.take_along_axis(key, best, 1) != lowest) & (np.take_along_axis(left, best, 1) >= floor[active, None])).ravel()
            places.append(np.repeat(active, best.shape[1])[keep])
            found.append(best.ravel()[keep])
            values.append(np.take_along_axis(left, best, 1).ravel()[keep])
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return join(places), join(found), join(values)

    def _plain(self, query_rows: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same by whole numbers of any size, where a score may not fit into a long."""
        v, own = self.v.astype(object), self.own(query_rows)
        places, found, values = [], [], []
        for i, x in enumerate(q.astype(object)):
            made = (v * x).sum(1) if v.shape[1] else np.zeros(len(v), object)
            best = sorted((-max(-(2**63), min(2**63 - 1, int(s))), c) for c, s in enumerate(made) if c != own[i])[:k]
            places += [i] * len(best)
            found += [c for _, c in best]
            values += [-s for s, _ in best]
        return np.array(places, np.int64), np.array(found, np.int64), np.array(values, np.int64)

    def _bound(self, q: np.ndarray) -> float:
        return float(np.abs(self.v.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).sum(1).max(initial=0))


def _block(vectors: pa.Table) -> ImpactBlock:
    ids = pc.fill_null(vectors["vec_id"], pa.scalar(_NULL, pa.int64())).to_numpy()
    return ImpactBlock(ids, vectors["row"].to_numpy(), _matrix(vectors["v"], vectors["d"][0].as_py()))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query row's k best other rows: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, null ones last.

    is_query: which rows ask, an expression over vec_id. Vectors of one length are dealt at random into blocks, and so are queries. Each
    query is first searched for in one block; the k-th score found there is its floor for all blocks, of which each gives its own k best at
    most. Vectors of another length than the query's are not compared. See `quantised` for what takes part; other columns are not read;
    no rows give no rows."""
    rows = written(quantised(vectors, scale, id_col, vector_col), "quantised")
    asks = F.coalesce(is_query, F.lit(False))
    # blocks are of one vector length
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(asks.cast("long")).alias("q")).filter("q > 0")
    width = F.greatest(F.col("d"), F.lit(1))
    vector_blocks = F.greatest(F.ceil(F.col("n") * width / BLOCK), F.least(F.lit(BLOCKS), F.ceil(F.col("n") / SMALL)))
    blocks = sizes.select("d", vector_blocks.alias("vb"), F.ceil(F.col("q") * width / QUERY_BLOCK).alias("qb"))
    placed = rows.withColumn("d", F.size("v")).join(F.broadcast(blocks), "d")  # one row for each length of a vector
    placed = placed.select("*", F.pmod(F.xxhash64("row", F.lit("block")), F.col("vb")).alias("b"), F.pmod(F.xxhash64("row", F.lit("query")), F.col("qb")).alias("c"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asking = placed.filter(asks)
    query_columns = lambda df: df.select(*(F.col(x).alias(f"query_{x}") for x in ("d", "b", "c", "vec_id", "row", "v", "floor")))

    def each(vectors: pa.Table, queries: pa.Table):
        """A block's index with each batch of the queries: their places, and what it finds."""
        if not vectors.num_rows or not queries.num_rows:
            return
        block = _block(vectors)
        row, q, floor = queries["query_row"].to_numpy(), _matrix(queries["query_v"], block.v.shape[1]), queries["query_floor"].to_numpy().astype(float)
        for a in range(0, len(row), TOGETHER):
            place, found, score = block.search(row[a : a + TOGETHER], q[a : a + TOGETHER], k, np.nan_to_num(floor[a : a + TOGETHER], nan=-np.inf))
            yield block, place + a, found, score

    def floors(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        """The k-th score of each query that has k."""
        out = []
        for _, place, _, score in each(vectors, queries):
            order = np.lexsort((-score, place))
            place, score = place[order], score[order]
            at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
            count = np.diff(np.append(at, len(place)))
            out.append((place[at[count >= k]], score[at[count >= k] + k - 1]))
        at = np.concatenate([p for p, _ in out]) if out else np.zeros(0, np.int64)
        return pa.table({"row": queries["query_row"].take(pa.array(at)), "floor": pa.array(np.concatenate([s for _, s in out]) if out else np.zeros(0, np.int64), pa.int64())})

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = {n: [] for n in ("query_row", "query_id", "vec_id", "score")}
        for block, place, found, score in each(vectors, queries):
            at, ids = pa.array(place), block.ids[found]
            out["query_row"].append(queries["query_row"].take(at).combine_chunks())
            out["query_id"].append(queries["query_vec_id"].take(at).combine_chunks())
            out["vec_id"].append(pa.array(ids, pa.int64(), mask=ids == _NULL))
            out["score"].append(pa.array(score, pa.int64()))
        return pa.table({n: pa.chunked_array(x, pa.int64()) for n, x in out.items()})

    first = query_columns(asking.withColumns({"b": F.lit(0).cast("long"), "floor": F.lit(None).cast("long")}))
    vectors_of = lambda df: df.withColumn("c", upto("qb")).select("d", "b", "c", "vec_id", "row", "v")
    keys, query_keys = ("d", "b", "c"), ("query_d", "query_b", "query_c")
    floor = written(vectors_of(placed.filter("b = 0")).groupBy(*keys).cogroup(first.groupBy(*query_keys)).applyInArrow(floors, "row long, floor long"), "floors")
    every = query_columns(asking.join(floor, "row", "left").withColumn("b", upto("vb")))
    near = vectors_of(placed).groupBy(*keys).cogroup(every.groupBy(*query_keys)).applyInArrow(best, "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
