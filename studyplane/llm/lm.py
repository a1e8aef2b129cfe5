"""Language-model scoring by deleted interpolation of word bigrams.

Documents are tokenized once into chunks. Each chunk asks, bucket by bucket of a hash of the n-gram, for the corpus counts of its own
distinct n-grams; a bucket adds up what all chunks hold of it and answers in the order asked. So each n-gram crosses the network once
for each chunk that has it, and no task holds more than a bucket or a chunk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, over_batches, over_group, ragged, slices, small_batches, written
from .words import LOWER, NOT_BLANK, word_bounds, word_hashes

#: Bytes of text of a chunk, and tokens of the corpus for each bucket of n-grams.
CHUNK_BYTES, BUCKET_TOKENS = 1 << 22, 1 << 21

#: Hashes of the end of a text and of the context before its first word.
_END, _START = np.uint64(0xE0D0), np.uint64(0x57A7)

#: What a document is: scored only, training text, or training text held out for the mixture weights.
SCORED, MAIN, DELETED = 0, 1, 2

#: Steps of a probability's binary logarithm in the table from which weights are learned, and rounds of that.
_STEPS, ROUNDS = 8, 60


def _planes(x: np.ndarray) -> bytes:
    """uint32 values byte by byte, which compresses better."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _small(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    most = int(x.max(initial=0))
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def _counts(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, f"<u{len(b) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as the steps between them, byte by byte: the upper bytes are nearly all 0 and vanish when compressed."""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def tokenized(docs: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of documents: chunk (odd if its documents are DELETED, else none of them is), deleted, doc_ids, parts, sizes, tokens, vocabulary.

    Tokens are places in the chunk's own vocabulary of word hashes, which begins with its most frequent word."""
    small_batches(docs.sparkSession)
    body = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), part.cast("int").alias("part"))
    kind = dict(body.dtypes)["doc_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}

        def chunk(deleted: bool) -> pa.RecordBatch:
            nonlocal made
            t = pa.Table.from_batches(held[deleted])
            held[deleted] = []
            data, offsets = ragged(t["text"])
            data = LOWER[data]
            starts, ends, at = word_bounds(data, offsets, NOT_BLANK)
            hashes = np.insert(word_hashes(data, starts, ends), at[1:], _END)
            vocabulary, place, count = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            new = np.empty(len(order), np.int64)
            new[order] = np.arange(len(order))
            made += 1
            ids = t["doc_id"].combine_chunks()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([2 * (base + made) + deleted], pa.int64()),
                    pa.array([deleted]),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([t["part"].to_numpy().astype(np.uint8).tobytes()], pa.binary()),
                    pa.array([_planes(np.diff(at) + 1)], pa.binary()),
                    pa.array([_planes(new[place])], pa.binary()),
                    pa.array([vocabulary[order].tobytes()], pa.binary()),
                    pa.array([len(hashes)], pa.int64()),
                    pa.array([int((np.diff(at) + 1)[t["part"].to_numpy() != SCORED].sum())], pa.int64()),
                ],
                ["chunk", "deleted", "doc_ids", "parts", "sizes", "tokens", "vocabulary", "n", "n_train"],
            )

        size = {False: 0, True: 0}
        for b in batches:
            _, offsets = ragged(b.column(1))
            for a, e in slices(offsets, CHUNK_BYTES):
                piece = b.slice(a, e - a)
                is_deleted = piece.column(2).to_numpy() == DELETED
                lengths = np.diff(offsets[a : e + 1])
                for deleted in (False, True):
                    mine = piece.filter(pa.array(is_deleted == deleted))
                    more = int(lengths[is_deleted == deleted].sum())
                    if held[deleted] and size[deleted] + more > CHUNK_BYTES:
                        yield chunk(deleted)
                        size[deleted] = 0
                    if mine.num_rows:
                        held[deleted].append(mine)
                        size[deleted] += more
        for deleted in (False, True):
            if held[deleted]:
                yield chunk(deleted)

    return body.mapInArrow(over_batches(rows), f"chunk long, deleted boolean, doc_ids array<{kind}>, parts binary, sizes binary, tokens binary, vocabulary binary, n long, n_train long")


class Chunk:
    """A chunk's tokens with their distinct unigrams and bigrams, each in the order of the hashes."""

    def __init__(self, parts: bytes, sizes: bytes, tokens: bytes, vocabulary: bytes):
        words = np.frombuffer(vocabulary, np.uint64)
        self.sizes = _unplaned(sizes)
        self.part = np.repeat(np.frombuffer(parts, np.uint8), self.sizes)
        token = _unplaned(tokens)
        by = np.argsort(words)
        self.unigrams = words[by]
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.token = place[token]
        # the context of a text's first token is _START, which has the place after all words
        self.context = np.concatenate([[0], self.token[:-1]]) if len(token) else self.token
        self.context[np.cumsum(self.sizes) - self.sizes] = len(by)
        after = np.append(self.unigrams, _START)[self.context]
        keys = mixed(after * np.uint64(0x9E3779B97F4A7C15) + self.unigrams[self.token])
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        self.bigrams = keys[order][new]
        self.bigram = np.empty(len(keys), np.int64)
        self.bigram[order] = np.cumsum(new) - 1

    def counted(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        mine = self.part == part
        return np.bincount(self.token[mine], minlength=len(self.unigrams)), np.bincount(self.bigram[mine], minlength=len(self.bigrams))


def _cut(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall into, and where each begins (one more than buckets)."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return bucket[at], np.append(at, len(keys))


def counts(chunks: DataFrame, bits: int) -> DataFrame:
    """For each chunk and bucket in which it has n-grams the corpus counts of its unigrams (u) and bigrams (b) there, in the chunk's order;
    for chunks of DELETED documents those of MAIN text as well (u1, b1). Rows are never more than the chunks' distinct n-grams.

    distinct_main and distinct: on one row of each bucket, how many unigrams MAIN text and all training text have there."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c = Chunk(r["parts"], r["sizes"], r["tokens"], r["vocabulary"])
                cells: dict[int, list[bytes]] = {}
                for k, (keys, counted) in enumerate(((c.unigrams, 0), (c.bigrams, 1))):
                    first, second = c.counted(MAIN)[counted], c.counted(DELETED)[counted]
                    buckets, at = _cut(keys, bits)
                    for n, i, j in zip(buckets.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                        cells.setdefault(n, [b""] * 6)[3 * k : 3 * k + 3] = _packed(keys[i:j]), _small(first[i:j]), _small(second[i:j])
                order = sorted(cells)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order, pa.int64()), pa.array(np.full(len(order), r["chunk"]), pa.int64())] + [pa.array([cells[n][k] for n in order], pa.binary()) for k in range(6)], ["bucket", "chunk", "u", "u1", "u2", "b", "b1", "b2"]
                )

    def answer(t: pa.Table) -> pa.Table:
        out = {"bucket": t["bucket"], "chunk": t["chunk"]}
        firsts, deleted = np.zeros((2, t.num_rows), np.int64), (t["chunk"].to_numpy() % 2).tolist()
        for kind in "ub":
            asked = [_unpacked(x) for x in t[kind].to_pylist()]
            size = [len(x) for x in asked]
            at = np.cumsum([0, *size])
            distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
            total = []
            for p in "12":
                each = np.concatenate([_counts(x, n) for x, n in zip(t[kind + p].to_pylist(), size, strict=True)])
                total.append(np.bincount(place, weights=each, minlength=len(distinct)).astype(np.int64))
            main, every = total[0][place], (total[0] + total[1])[place]
            ranges = list(zip(at, at[1:], strict=False))
            out[kind] = pa.array([_small(every[i:j]) for i, j in ranges], pa.binary())
            out[kind + "1"] = pa.array([_small(main[i:j]) if odd else b"" for (i, j), odd in zip(ranges, deleted, strict=True)], pa.binary())
            if kind == "u":
                firsts[:, 0] = (total[0] > 0).sum(), (total[0] + total[1] > 0).sum()
        return pa.table(out | {"distinct_main": pa.array(firsts[0]), "distinct": pa.array(firsts[1])}).select(["bucket", "chunk", "u", "b", "u1", "b1", "distinct_main", "distinct"])

    asked = chunks.select("chunk", "parts", "sizes", "tokens", "vocabulary").mapInArrow(over_batches(ask), "bucket long, chunk long, u binary, u1 binary, u2 binary, b binary, b1 binary, b2 binary")
    return asked.groupBy("bucket").applyInArrow(over_group(answer), "bucket long, chunk long, u binary, b binary, u1 binary, b1 binary, distinct_main long, distinct long")


@dataclass(frozen=True)
class Interpolation:
    """Sizes of the training text, and for each bucket of context counts the weights of bigram, unigram and uniform probability."""

    tokens: int
    distinct: int
    weights: np.ndarray


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for no occurrence, then the bits of the count."""
    return np.frexp(count.astype(float))[1]


_BUCKETS, _LOGS = 64, 64 * _STEPS


def _cells(c2: np.ndarray, context: np.ndarray, c1: np.ndarray, tokens: int) -> np.ndarray:
    """The cell of each token: its context's bucket and both probabilities in steps (0: none)."""
    step = lambda a, b: np.where(a > 0, 1 + np.clip(np.round(-_STEPS * np.log2(np.maximum(a, 1) / np.maximum(b, 1))), 0, _LOGS - 2), 0).astype(np.int64)
    return (context_bucket(context) * _LOGS + step(c2, context)) * _LOGS + step(c1, np.full(len(c1), max(tokens, 1)))


def learned(cells: np.ndarray, n: np.ndarray, distinct: int) -> np.ndarray:
    """Mixture weights of each bucket by expectation-maximisation on the held-out tokens in each cell. Buckets without any take those of
    the nearest bucket of lower counts, or the first known."""
    bucket, rest = np.divmod(cells, _LOGS * _LOGS)
    p = np.stack([np.where(s > 0, 2.0 ** (-(s - 1) / _STEPS), 0) for s in np.divmod(rest, _LOGS)] + [np.full(len(cells), 1 / (distinct + 1))])
    weights = np.full((_BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5
    for _ in range(ROUNDS if len(cells) else 0):
        share = p * weights[bucket].T
        share *= n / share.sum(0)
        total = np.stack([np.bincount(bucket, weights=s, minlength=_BUCKETS) for s in share], 1)
        seen = total.sum(1) > 0
        weights[seen] = (total[seen] + 1e-3) / (total[seen] + 1e-3).sum(1, keepdims=True)
    have = np.bincount(bucket, minlength=_BUCKETS) > 0
    for b in range(1, _BUCKETS):
        if not have[b] and have[1:].any():
            near = np.flatnonzero(have[1:b])
            weights[b] = weights[near[-1] + 1] if len(near) else weights[np.flatnonzero(have[1:])[0] + 1]
    weights[0] = np.array([0, *weights[0][1:]]) / weights[0][1:].sum()
    return weights


def _answered(t: pa.Table, answers: pa.Table, bits: int, unigrams: str, bigrams: str) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """A chunk with the named corpus counts of its unigrams and bigrams."""
    c = Chunk(*(t[n][0].as_py() for n in ("parts", "sizes", "tokens", "vocabulary")))
    row_of = {n: i for i, n in enumerate(answers["bucket"].to_pylist())}
    got = []
    for name, keys in ((unigrams, c.unigrams), (bigrams, c.bigrams)):
        blobs = answers[name].to_pylist()
        buckets, at = _cut(keys, bits)
        got.append(np.concatenate([_counts(blobs[row_of[k]], n) for k, n in zip(buckets.tolist(), np.diff(at).tolist(), strict=True)]))
    return c, *got


def scored(docs: DataFrame, train: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score and score of every row.

    train: which rows the counts come from, an expression over doc_id; deleted: which of these are held out while the mixture weights
    are learned, whose counts join the others afterwards. A token is a word or a text's end; base_score is of add-half unigrams, score
    of the interpolated bigrams, log10 of the whole text. Null text counts as empty: one token. Rows for which train is null are only
    scored; repeated rows and null ids are kept and counted; other columns are not read; no rows give no rows; without training rows
    all texts have the uniform probability."""
    part = F.when(F.coalesce(train, F.lit(False)), F.when(F.coalesce(deleted, F.lit(False)), DELETED).otherwise(MAIN)).otherwise(SCORED)
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chunks = written(tokenized(body, part), "chunks")
    kind = dict(body.dtypes)["doc_id"]
    sums = chunks.agg(F.sum("n").alias("n"), F.sum("n_train").alias("train"), F.sum(F.when(F.col("deleted"), F.col("n"))).alias("deleted")).first()
    total, n_train, n_deleted = (sums[k] or 0 for k in ("n", "train", "deleted"))
    bits = max(3, (total // BUCKET_TOKENS).bit_length())
    answers = written(counts(chunks, bits), "counts")
    seen = answers.agg(F.sum("distinct_main").alias("main"), F.sum("distinct").alias("all")).first()
    v_main, v = (seen[k] or 0 for k in ("main", "all"))
    n_main = n_train - n_deleted

    def held_out(t: pa.Table, a: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        c, u, b = _answered(t, a, bits, "u1", "b1")
        context = np.append(u, u[np.searchsorted(c.unigrams, _END)])[c.context]
        cells, n = np.unique(_cells(b[c.bigram], context, u[c.token], n_main), return_counts=True)
        return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(n, pa.int64())})

    columns = ["chunk", "parts", "sizes", "tokens", "vocabulary"]
    few = chunks.filter("deleted").select(*columns)
    theirs = answers.filter("chunk % 2 = 1").select("chunk", "bucket", "u1", "b1")
    cells = few.groupBy("chunk").cogroup(theirs.groupBy("chunk")).applyInArrow(held_out, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = learned(np.array([r["cell"] for r in cells], np.int64), np.array([r["n"] for r in cells], np.int64), v_main)
    model = Interpolation(n_train, v, weights)

    def score(t: pa.Table, a: pa.Table) -> pa.Table:
        c, c1, c2 = _answered(t, a, bits, "u", "b")
        ids = t["doc_ids"].combine_chunks().flatten()
        context = np.append(c1, c1[np.searchsorted(c.unigrams, _END)])[c.context]
        c2, c1 = c2[c.bigram], c1[c.token]
        w = model.weights[context_bucket(context)]
        p = w[:, 0] * c2 / np.maximum(context, 1) + w[:, 1] * c1 / max(model.tokens, 1) + w[:, 2] / (model.distinct + 1)
        if not model.tokens:
            p = np.full(len(c1), 1 / (model.distinct + 1))
        base = np.log10((c1 + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
        first = np.cumsum(c.sizes) - c.sizes
        add = lambda x: np.add.reduceat(x, first)
        n = len(c.sizes)
        return pa.table(
            {
                "doc_id": ids,
                "train": pa.array(np.frombuffer(t["parts"][0].as_py(), np.uint8) != SCORED),
                "n_tokens": pa.array(c.sizes, pa.int64()),
                "n_known": pa.array(add((c1 > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(n, model.tokens), pa.int64()),
                "base_score": pa.array(add(base)),
                "score": pa.array(add(np.log10(p))),
            }
        )

    right = answers.select("chunk", "bucket", "u", "b")
    return chunks.select("chunk", "doc_ids", *columns[1:]).groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(score, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
