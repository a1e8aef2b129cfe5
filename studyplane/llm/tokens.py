"""Token counts by byte-level pair merging, all pre-tokens of a batch at once in ragged numpy arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lasting, over_batches, small_batches

#: The pre-token pattern of byte-level BPE vocabularies of 50k (a fixed value of the format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Chunks whose counts a worker remembers, and the longest one (in characters) that it does.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64

#: Bytes of pre-tokens merged at once.
MERGE_BYTES = 1 << 22


class PairMerger:
    """Counts the symbols that survive byte-level BPE."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], specials: list[str]):
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        char = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.symbol = np.array([vocab[char[b]] for b in range(256)], np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        self.width = max(vocab.values()) + 1
        key = pairs[:, 0] * self.width + pairs[:, 1]
        # an open table: where the key's hash leads, or as few places further as the fullest run needs
        self.bits = max(4, int(len(key) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.rank = np.full(size, -1, np.int64), np.zeros(size, np.int32)
        self.made = pairs[:, 2]
        left, at, self.steps = np.arange(len(key)), self._slot(key), 0
        while len(left):
            free = self.keys[at] < 0
            _, firsts = np.unique(at[free], return_index=True)
            put = left[free][firsts]
            self.keys[at[free][firsts]], self.rank[at[free][firsts]] = key[put], put
            keep = np.isin(left, put, invert=True)
            left, at = left[keep], (at[keep] + 1) & (size - 1)
            self.steps += 1
        self.none = np.int32(len(key))
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.pattern = regex.compile(PRE_TOKEN)
        self.spaced = re.compile(r" \s")
        self.known: dict[str, int] = {}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; `none` for a pair that is never merged."""
        key = left * self.width + right
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.rank[at], self.none)
        todo = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        for step in range(1, self.steps):
            if not len(todo):
                break
            there = (at[todo] + step) & (len(self.keys) - 1)
            hit = self.keys[there] == key[todo]
            out[todo[hit]] = self.rank[there[hit]]
            todo = todo[~hit & (self.keys[there] >= 0)]
        return out

    def counts(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token.

        In every round each sequence merges its pair of lowest rank, wherever it stands in the sequence; sequences without such a pair leave."""
        raw = [w.encode() for w in words]
        length = np.array([len(b) for b in raw], np.int64)
        out = length.copy()
        symbol = self.symbol[np.frombuffer(b"".join(raw), np.uint8)]
        seq = np.repeat(np.arange(len(raw)), length)
        while len(symbol) > 1:
            rank = np.full(len(symbol), self.none, np.int32)
            same = seq[:-1] == seq[1:]
            rank[:-1][same] = self.ranks(symbol[:-1][same], symbol[1:][same])
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(rank, first)
            alive = lowest < self.none
            size = np.diff(np.append(first, len(symbol)))
            merge = (rank == np.repeat(lowest, size)) & np.repeat(alive, size)
            at = np.flatnonzero(merge)
            if not len(at):
                break
            # in a run of overlapping pairs (a a a) every other one merges, from the left
            runs = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            at = at[(np.arange(len(at)) - np.repeat(at_first := runs, np.diff(np.append(at_first, len(at))))) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            np.subtract.at(out, seq[at], 1)
            keep = np.repeat(alive, size)
            keep[at + 1] = False
            symbol, seq = symbol[keep], seq[keep]
        return out

    def _learn(self, words: list[str]) -> dict[str, int]:
        found: dict[str, int] = {}
        begin, held = 0, 0
        for i, w in enumerate(words):
            held += len(w)
            if held >= MERGE_BYTES or i == len(words) - 1:
                found.update(zip(words[begin : i + 1], self.counts(words[begin : i + 1]).tolist(), strict=True))
                begin, held = i + 1, 0
        return found

    def _chunk_counts(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk taken as a text of its own."""
        split = [self.pattern.findall(c) for c in chunks]
        get = self._learn(list(set().union(*split))).__getitem__ if chunks else None
        return [sum(map(get, words)) for words in split]

    def text_counts(self, texts: Iterable[str | None]) -> list[int]:
        """Tokens of each text; null counts as empty.

        No pre-token crosses from a character that isn't white space into a single space, so a text falls apart at its spaces, and
        each chunk (with the space before it) is counted once and remembered. A part in which white space follows a space is left whole."""
        extra, split, whole = [], [], []
        for t in texts:
            parts = self.specials.split(t or "") if self.specials else [t or ""]
            extra.append(len(parts) - 1)
            mine = []
            for p in parts:
                if self.spaced.search(p):
                    whole.append(p)
                    mine.append(None)
                else:
                    mine.append(p.split(" "))
            split.append(mine)
        firsts = list({c[0] for mine in split for c in mine if c})
        first = dict(zip(firsts, self._chunk_counts(firsts), strict=True))
        rest = iter(self._chunk_counts(whole))
        seen = set().union(*(c[1:] for mine in split for c in mine if c))
        new = [c for c in seen if c not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(seen)
        found = dict(zip(new, self._chunk_counts([" " + c for c in new]), strict=True))
        get = (self.known | found).__getitem__ if len(found) > REMEMBERED or any(len(c) > REMEMBERED_CHARS for c in new) else None
        self.known.update((c, n) for c, n in found.items() if len(c) <= REMEMBERED_CHARS)
        get = get or self.known.__getitem__
        return [n + sum(next(rest) if c is None else first[c[0]] + sum(map(get, c[1:])) for c in mine) for n, mine in zip(extra, split, strict=True)]


@lasting
@lru_cache(maxsize=2)
def merger(vocabulary: str) -> PairMerger:
    """The merger of a tokenizer file (JSON, byte-level BPE)."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return PairMerger(spec["model"]["vocab"], merges, [t["content"] for t in spec["added_tokens"]])


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's bytes and tokens: doc_id, n_bytes, n_tokens, over_limit (more tokens than the limit).

    vocabulary: path of the tokenizer file, on every machine. Null text counts as empty: no bytes, no tokens. Repeated rows and null
    ids are kept; other columns are not read; no rows give no rows. A very long text is one row, and so is counted in one task."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merger(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            tokens = bpe.text_counts(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    kind = dict(body.dtypes)["doc_id"]
    out = body.mapInArrow(over_batches(rows, merger), f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
