"""Benchmark decontamination: an FM-index per shard of documents, searched backward for the benchmark's word windows."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_names, lasting, over_batches, over_group, ragged, slices, small_batches, within, written
from .words import ALNUM, LOWER, word_bounds, word_hashes

#: Words of a window, bytes of one shard of documents, of one block of benchmark text, and of all blocks that go out in one pass.
WINDOW, SHARD_BYTES, BLOCK_BYTES, PASS_BYTES = 13, 1 << 22, 1 << 22, 1 << 28

#: Windows searched for at once.
_TOGETHER = 1 << 16

#: Every so many text positions the index keeps its suffix position.
SAMPLED = 16

#: Symbols below those of words: the end of the shard, and what stands for ends of documents and runs of words in no window.
_END, _OTHER = 0, 1


@dataclass(frozen=True)
class Phrases:
    """The items of a block: ids, words as hashes laid end to end, and the first word of each window with its length and its item."""

    items: list[str]
    words: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    item_of: np.ndarray


def phrases(items: list[str], texts: pa.Array, window: int = WINDOW) -> Phrases:
    """The windows of items: each run of `window` words, or all words of an item with fewer; none without words."""
    data, offsets = ragged(texts)
    data = LOWER[data]
    starts, ends, at = word_bounds(data, offsets, ALNUM)
    count = np.diff(at)
    windows = np.where(count > 0, np.maximum(1, count - window + 1), 0)
    item_of = np.repeat(np.arange(len(items)), windows)
    return Phrases(items, word_hashes(data, starts, ends), at[item_of] + within(windows), np.minimum(count, window)[item_of], item_of)


def packed(p: Phrases) -> bytes:
    return pickle.dumps((p.items, *(x.tobytes() for x in (p.words, p.starts.astype(np.int64), p.lengths.astype(np.int64), p.item_of.astype(np.int64)))))


def unpacked(b: bytes) -> Phrases:
    items, words, *rest = pickle.loads(b)
    return Phrases(items, np.frombuffer(words, np.uint64), *(np.frombuffer(x, np.int64) for x in rest))


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Suffix order of s, whose last symbol is its least and occurs once there; symbols have `bits` bits.

    The first key packs as many symbols as 63 bits hold; then only suffixes with a tie are sorted again, by twice as many symbols each round."""
    n = len(s)
    h = max(1, min(62 // bits, n))
    key = np.zeros(n, np.int64)
    for i in range(h):
        key <<= bits
        key[: n - i] |= s[i:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(new)
    group = begin[np.cumsum(new) - 1]  # a suffix's rank: where its group begins in the order
    rank = np.empty(n, np.int64)
    rank[order] = group
    size = np.diff(np.append(begin, n))
    tied = np.flatnonzero(np.repeat(size > 1, size))
    while len(tied):
        suffix = order[tied]
        after = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)], -1) + 1
        key = rank[suffix] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[tied] = suffix
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        rank[suffix] = tied[begin[np.cumsum(new) - 1]]
        size = np.diff(np.append(begin, len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        h *= 2
    return order


class FMIndex:
    """Burrows-Wheeler transform of a symbol sequence with wavelet-tree ranks and sampled suffix positions."""

    def __init__(self, s: np.ndarray, symbols: int):
        bits = max(1, int(symbols - 1).bit_length())
        order = suffix_array(s, bits)
        self.last = s[order - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=symbols))])
        self.levels = []
        rest = self.last.astype(np.int32)
        for shift in reversed(range(bits)):
            one = ((rest >> shift) & 1).astype(bool)
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.levels.append((shift, ones, len(s) - int(ones[-1])))
            rest = np.concatenate([rest[~one], rest[one]])
        sampled = order % SAMPLED == 0
        self.sampled = sampled
        self.sample_at = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first i of the transform."""
        low = np.zeros_like(i)
        for shift, ones, zeros in self.levels:
            up = ((symbol >> shift) & 1).astype(bool)
            low = np.where(up, zeros + ones[low], low - ones[low])
            i = np.where(up, zeros + ones[i], i - ones[i])
        return i - low

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern, by backward steps from its last symbol."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(self.last), np.int64)
        for t in range(patterns.shape[1]):
            on = np.flatnonzero((t < lengths) & (low < high))
            if not len(on):
                break
            c = patterns[on, lengths[on] - 1 - t]
            low[on], high[on] = self.below[c] + self.rank(c, low[on]), self.below[c] + self.rank(c, high[on])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, each found by steps back to a sampled one."""
        out = np.zeros(len(rows), np.int64)
        on, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(on):
            here = self.sampled[at]
            out[on[here]] = self.samples[self.sample_at[at[here]]] + steps
            on, at = on[~here], at[~here]
            c = self.last[at]
            at = self.below[c] + self.rank(c, at)
            steps += 1
        return out


def _found(index: FMIndex, symbols: np.ndarray, wanted: Phrases, present: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window, text position) of all occurrences of a block's windows, many windows at once. symbols: those of the block's words.

    Windows with a word that the shard doesn't have are left out first."""
    there = np.concatenate([[0], np.cumsum(present[symbols])])
    windows = np.flatnonzero(there[wanted.starts + wanted.lengths] - there[wanted.starts] == wanted.lengths)
    for a in range(0, len(windows), _TOGETHER):
        some = windows[a : a + _TOGETHER]
        length = wanted.lengths[some]
        column = np.arange(length.max())
        patterns = np.where(column < length[:, None], symbols[np.minimum(wanted.starts[some, None] + column, len(symbols) - 1)], 0)
        low, high = index.search(patterns, length)
        count = high - low
        yield np.repeat(some, count), index.locate(np.repeat(low, count) + within(count))


def hits(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray, blocks: list[tuple[np.ndarray, Phrases]], marks: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[list[str]], list[np.ndarray]]:
    """Of one shard's texts: words, merged spans of hit words (first, end, ...), items that occur, and the spans' bytes.

    vocabulary: sorted hashes of the words of all blocks; blocks: each block's words as places in it, and its phrases. The shard is indexed
    once for all of them. marks: spans found before, which are merged in."""
    data = LOWER[data]
    starts, ends, at = word_bounds(data, offsets, ALNUM)
    rows, n = len(offsets) - 1, len(starts)
    delta = np.zeros(n + 1, np.int64)
    for r, m in enumerate(marks):
        np.add.at(delta, at[r] + m[0::2], 1)
        np.add.at(delta, at[r] + m[1::2], -1)
    items: list[set[str]] = [set() for _ in range(rows)]
    if n and len(vocabulary):
        hashes = word_hashes(data, starts, ends)
        place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        # words of the shard that the benchmark has get the symbols from 2 on
        had = np.unique(place[vocabulary[place] == hashes])
        symbol_of = np.full(len(vocabulary), _OTHER)
        symbol_of[had] = np.arange(len(had)) + 2
        symbol = np.where(vocabulary[place] == hashes, symbol_of[place], _OTHER)
        # a document's end stands before its successor's first word; runs of _OTHER count once
        ends_at = np.unique(at[1:])
        s = np.insert(symbol, ends_at, _OTHER)
        word = np.insert(np.arange(n), ends_at, -1)
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != _OTHER) | (s[:-1] != _OTHER)
        s, word = np.append(s[keep], _END), np.append(word[keep], -1)
        index = FMIndex(s, len(had) + 2)
        present = np.ones(len(had) + 2, bool)
        present[: _OTHER + 1] = False
        for places, wanted in blocks:
            for window, position in _found(index, symbol_of[places], wanted, present):
                first = word[position]
                np.add.at(delta, first, 1)
                np.add.at(delta, first + wanted.lengths[window], -1)
                doc = np.searchsorted(at, first, side="right") - 1
                for d, i in zip(*divmod(np.unique(doc * len(wanted.items) + wanted.item_of[window]), max(1, len(wanted.items))), strict=True):
                    items[d].add(wanted.items[i])
    hit = np.cumsum(delta)[:-1] > 0
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.concatenate([[False], hit[:-1]]) if n else hit
    begin = np.flatnonzero(hit & (~before | cut[:-1]))
    end = np.flatnonzero(hit & (np.append(~hit[1:], True) | cut[1:])) + 1 if n else begin
    by_row = np.searchsorted(begin, at)
    spans = [np.column_stack([begin[a:b] - at[r], end[a:b] - at[r]]).ravel() for r, (a, b) in enumerate(zip(by_row, by_row[1:], strict=False))]
    texts = [np.column_stack([starts[begin[a:b]] - offsets[r], ends[end[a:b] - 1] - offsets[r]]).ravel() for r, (a, b) in enumerate(zip(by_row, by_row[1:], strict=False))]
    return np.diff(at), spans, [sorted(x) for x in items], texts


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    flat = np.concatenate(parts) if parts and kind == pa.int64() else [x for p in parts for x in p]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(p) for p in parts]), pa.int32()), pa.array(flat, kind))


def _blocks(items: DataFrame, count: int, window: int) -> DataFrame:
    """block and its packed phrases; items are dealt by a hash of id and text, each block is one task's group."""

    def made(t: pa.Table) -> pa.Table:
        order = np.argsort(t["item"].to_pandas().to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int64()), "phrases": pa.array([packed(phrases(t["item"].to_pylist(), t["text"].combine_chunks(), window))], pa.binary())})

    return items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(count))).groupBy("block").applyInArrow(over_group(made), "block long, phrases binary")


@dataclass(frozen=True)
class Sent:
    """The broadcast blocks of one pass, told apart by a key."""

    key: str
    blocks: tuple = field(compare=False)


@lasting
@lru_cache(1)
def _opened(sent: Sent) -> tuple[np.ndarray, list[tuple[np.ndarray, Phrases]]]:
    """The common vocabulary of the blocks and each block's words as places in it."""
    blocks = [unpacked(b.value) for b in sent.blocks]
    vocabulary = np.unique(np.concatenate([np.unique(p.words) for p in blocks])) if blocks else np.zeros(0, np.uint64)
    return vocabulary, [(np.searchsorted(vocabulary, p.words), p) for p in blocks]


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep`, n_words, n_hit (words inside an occurrence of a window), items (ids, sorted) and spans of every row.

    spans: merged removal spans as array of (begin, end) in bytes of the UTF-8 text, flattened. Words are runs of digits, letters
    a-z (after lower-casing A-Z) and all characters beyond ASCII. Windows of the benchmark are made in tasks, in blocks of about
    BLOCK_BYTES (or one item); blocks of at most about PASS_BYTES in all are broadcast and searched for in one pass over the documents, and
    a larger benchmark takes more passes, one after the other, each of which is written. Null texts have no words; null item ids count as the empty id; items with the same id are one;
    null ids and repeated rows are kept; other columns are read only where `keep` names them, and `keep` must not name a column of the
    result; an empty benchmark hits nothing; no rows give no rows."""
    distinct_names(keep, ("doc_id", "n_words", "n_hit", "items", "spans"))
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).filter(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    count = -(-total // BLOCK_BYTES)
    per_pass = max(1, PASS_BYTES // BLOCK_BYTES)
    blocks = written(_blocks(items, count, window), "phrases") if count else None
    kept = [f"_keep_{k}" for k in range(len(keep))]
    names = ["doc_id", *kept]
    body = docs.select(F.col(id_col).alias("doc_id"), *(F.col(k).alias(n) for k, n in zip(keep, kept, strict=True)), F.col(text_col).alias("_text"))
    kinds = dict(body.dtypes)
    body = body.select("*", F.lit(0).cast("long").alias("_n"), F.array().cast("array<bigint>").alias("_marks"), F.array().cast("array<string>").alias("_items"), F.array().cast("array<bigint>").alias("_bytes"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in [*names, "_text"]) + ", _n long, _marks array<bigint>, _items array<string>, _bytes array<bigint>"
    passes = max(1, -(-count // per_pass))
    for p in range(passes):
        # one block at a time comes to the driver, none of them over about BLOCK_BYTES of text
        numbers = range(p * per_pass, min(count, (p + 1) * per_pass))
        sent = Sent(uuid.uuid4().hex, tuple(spark.sparkContext.broadcast(bytes(r["phrases"])) for k in numbers for r in blocks.filter(F.col("block") == k).select("phrases").collect()))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            vocabulary, opened = _opened(sent)
            for b in batches:
                data, offsets = ragged(b.column("_text"))
                for a, e in slices(offsets, SHARD_BYTES):
                    part = b.slice(a, e - a)
                    marks = [np.array(m, np.int64) for m in part.column("_marks").to_pylist()]
                    n, spans, found, texts = hits(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a], vocabulary, opened, marks)
                    found = [sorted({*x, *y}) for x, y in zip(found, part.column("_items").to_pylist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [*names, "_text"]), pa.array(n, pa.int64()), _lists(spans, pa.int64()), _lists(found, pa.string()), _lists(texts, pa.int64())], [*names, "_text", "_n", "_marks", "_items", "_bytes"])

        body = body.mapInArrow(over_batches(search, keep=_opened), schema)
        if p + 1 < passes:  # a pass ends before the next one's blocks are sent
            body = written(body, f"pass{p}")
            for b in sent.blocks:
                b.unpersist()
    covered = F.aggregate(F.col("_marks"), F.lit(0).cast("long"), lambda s, x: x - s)  # ends less beginnings: the signs alternate
    return body.select("doc_id", *(F.col(n).alias(k) for n, k in zip(kept, keep, strict=True)), F.col("_n").alias("n_words"), covered.alias("n_hit"), F.col("_items").alias("items"), F.col("_bytes").alias("spans"))


def contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """Whether at least one in `share` words is hit."""
    return (n_hit > 0) & (n_hit * share >= n_words)
