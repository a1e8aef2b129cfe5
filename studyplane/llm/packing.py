"""Hierarchical multi-length packing of tokenized documents into training sequences."""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import lasting, over_batches, ragged, slices, small_batches
from .words import LOWER, NOT_BLANK, word_bounds, word_hashes

#: Context sizes; the longest is the longest sequence. Each is a power of two, so that none of them is padded.
TIERS = (512, 1024, 2048, 4096)

#: Bytes of text tokenized at once.
SLICE_BYTES = 1 << 21

#: Tokens packed together, and tokens of one training step.
GROUP_TOKENS, STEP_TOKENS = 1 << 19, 1 << 16

#: Chunks between white space whose ids a worker remembers, and the longest one (in bytes) that it does. The first ones met, which are
#: the frequent ones, stay; it begins anew when more than FORGET of a batch's distinct chunks are unknown.
REMEMBERED, REMEMBERED_BYTES, FORGET = 300_000, 64, 0.6


#: The pre-token pattern of this vocabulary, after lower-casing, and its characters for bytes (fixed values of the format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_VISIBLE = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN) if b != 0x0A}

#: The same pattern for lower-cased ASCII, and for line feeds between chunks.
ASCII_PRE_TOKEN = rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+|\n"
_CONTROL = re.compile(rb"[\x00-\x1f\x7f]|\xc2[\x80-\x9f]")

#: Bytes of a chunk that falls apart by class: letters, digits (each by itself), marks; 0 for blanks. Chunks with any other byte, with an
#: apostrophe (contractions) or with what begins a special string stay whole.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[0x30:0x3A] = 2
_WHOLE = np.zeros(256, bool)
_WHOLE[[*range(0x09), *range(0x0E, 0x20), 0x27, *range(0x7F, 0x100)]] = True

#: Stands between the ids of two chunks; no id is as large.
_BORDER = b"\xff\xff\xff\xff"


class ChunkEncoder:
    """Token ids of whole texts. White space takes no part in this kind of vocabulary, so a text's ids are those of its chunks."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = Tokenizer(self.library.model)
        self.pattern, self.ascii_pattern = regex.compile(PRE_TOKEN + r"|\n"), re.compile(ASCII_PRE_TOKEN)
        self.known: dict[bytes, bytes] = {}

    def _split(self, chunks: list[bytes], ascii: bool) -> list[bytes]:
        """The lower-cased pieces of all chunks in turn, with a line feed after each chunk; no chunk holds one."""
        lines = b"\n".join(chunks) + b"\n"
        if ascii:
            return self.ascii_pattern.findall(lines.lower())
        return [p.encode() for p in self.pattern.findall(lines.decode().lower())]

    def _learn(self, new: list[bytes]) -> None:
        """Learns the ids of whole chunks that aren't known. Chunks of Latin letters, which normal form C leaves alone, are lower-cased and split here, and
        only pieces not known either are merged; all others, and those with control characters, go through the whole library."""
        simple, latin, hard = [], [], []
        for c in new:
            if b"<|" in c:
                hard.append(c)
            elif c.isascii():
                simple.append(c)
            else:
                (latin if max(c.decode()) < "\u0250" else hard).append(c)
        for chunks in (simple, latin):
            if _CONTROL.search(b"".join(chunks)):
                hard += [c for c in chunks if _CONTROL.search(c)]
                chunks[:] = [c for c in chunks if not _CONTROL.search(c)]
        split = [(chunks, self._split(chunks, ascii)) for chunks, ascii in ((simple, True), (latin, False)) if chunks]
        asked = [(hard, [c.decode() for c in hard], self.library)]
        seen = {b"\n"}
        for (_, parts), ascii in zip(split, [bool(simple), False], strict=False):
            pieces = [p for p in set(parts) if p not in self.known and p not in seen]
            seen.update(pieces)
            shown = b"\n".join(pieces).decode("latin-1")
            asked.append((pieces, (shown if ascii else shown.translate(_VISIBLE)).split("\n") if pieces else [], self.merges))
        for keys, texts, by in asked:
            if keys:
                self.known.update((k, array("I", e.ids).tobytes()) for k, e in zip(keys, by.encode_batch_fast(texts, add_special_tokens=False), strict=True))
        self.known[b"\n"] = _BORDER
        for chunks, parts in split:
            self.known.update(zip(chunks, b"".join(map(self.known.__getitem__, parts)).split(_BORDER)[:-1], strict=True))
        del self.known[b"\n"]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, end_id after each text, and where each text's ids begin (one more than texts).

        Plain ASCII chunks fall apart into letters, digits and marks by byte class; others stay whole. These units are found and grouped by
        hash over all texts at once, so that each different one is looked up once."""
        data, offsets = ragged(texts)
        begin, end, at, odd = _units(data, offsets)
        data = np.where(odd, data, LOWER[data])
        _, first, place = np.unique(word_hashes(data, begin, end), return_index=True, return_inverse=True)
        raw, odd = data.tobytes(), odd[begin[first]].tolist()
        seen = [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        missing = [k for k, c in enumerate(seen) if c not in self.known]
        if len(self.known) >= REMEMBERED and len(missing) > FORGET * len(seen):
            self.known, missing = {}, range(len(seen))
        before = len(self.known)
        plain = [seen[k] for k in missing if not odd[k]]
        self._learn([seen[k] for k in missing if odd[k]])
        plain = [c for c in plain if c not in self.known]
        merge = self.library.model.tokenize
        self.known.update((c, array("I", [t.id for t in merge(c.decode())]).tobytes()) for c in plain)
        found = [*map(self.known.__getitem__, seen), array("I", [end_id]).tobytes()]
        last = [self.known.popitem() for _ in range(len(self.known) - before)]
        if before < REMEMBERED:
            self.known.update((c, i) for c, i in last if len(c) <= REMEMBERED_BYTES)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        place = np.insert(place, at[1:], len(seen))
        sizes = size[place]
        after = np.cumsum(sizes)
        source = np.arange(after[-1] if len(after) else 0, dtype=np.int32)
        source += np.repeat(((np.cumsum(size) - size)[place] - (after - sizes)).astype(np.int32), sizes)
        return np.frombuffer(b"".join(found), np.uint32)[source], np.concatenate([[0], after[at[1:] + np.arange(len(at) - 1)]])


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each unit, the units' offsets by row, and for each byte whether it is in a chunk that stays whole."""
    n = len(data)
    starts, ends, _ = word_bounds(data, offsets, NOT_BLANK)
    strange = _WHOLE[data]
    strange[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    before = np.zeros(n + 1, np.int32)
    np.cumsum(strange, out=before[1:])
    whole = before[ends] > before[starts]
    mark = np.zeros(n + 1, np.int8)
    mark[starts[whole]] = 1
    mark[ends[whole]] -= 1  # a chunk may begin where another row's ends
    odd = np.cumsum(mark[:-1], dtype=np.int8) > 0
    kind = np.zeros(n + 2, np.uint8)  # a blank before and after
    kind[1:-1] = np.where(odd, 4, _KIND[data])
    border = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    border[offsets] = True
    begin = np.flatnonzero(border & (kind[1:] > 0))
    end = np.flatnonzero(border & (kind[:-1] > 0))
    return begin, end, np.searchsorted(begin, offsets), odd


@lasting
@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> ChunkEncoder:
    return ChunkEncoder(vocabulary)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces; each token of each document lies in one piece.

    Whole windows of the longest tier are cut from long documents. What is left of each is routed to the shortest tier that holds it.
    From the longest down, each opens a window of its tier; the gap is filled with the longest remainders that fit, all of shorter
    tiers, and at last with a piece cut from the shortest remainder. Only the last window can stay open; it is cut into sequences of
    lengths that are powers of two."""
    longest, out = tiers[-1], []
    left: list[tuple[int, int, int]] = []  # (length, document, start), shortest first
    for i, n in enumerate(lengths):
        whole = n // longest * longest
        out += [[(i, at, longest)] for at in range(0, whole, longest)]
        if n > whole:
            left.append((n - whole, i, whole))
    left.sort()
    while left:
        n, i, start = left.pop()
        window = [(i, start, n)]
        gap = tiers[bisect_left(tiers, n)] - n
        while gap and left:
            fits = bisect_right(left, (gap, len(lengths), 0)) - 1
            if fits >= 0:
                n, i, start = left.pop(fits)
                window.append((i, start, n))
                gap -= n
            else:
                n, i, start = left.pop(0)
                window.append((i, start, gap))
                insort(left, (n - gap, i, start + gap))
                gap = 0
        if gap:
            out += _powers_of_two(window)
        else:
            out.append(window)
    return out


def _powers_of_two(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The window's tokens as sequences of falling powers of two."""
    total, out, at = sum(p[2] for p in window), [], 0
    pieces = list(reversed(window))
    for bit in reversed(range(total.bit_length())):
        need = total & (1 << bit)
        if need:
            out.append([])
        while need:
            i, start, n = pieces.pop()
            take = min(n, need)
            out[-1].append((i, start, take))
            need -= take
            if take < n:
                pieces.append((i, start + take, n - take))
    return out


def steps(sizes: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A step for each sequence: the longest first, each into the step with the fewest tokens so far."""
    loads = [(0, s) for s in range(max(1, round(sum(sizes) / step_tokens)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        load, s = loads[0]
        out[k] = s
        heapq.heapreplace(loads, (load + sizes[k], s))
    return out


def packed(docs: DataFrame, vocabulary: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, then ids, sequence_tokens and step_id.

    A document's tokens are those of `vocabulary` (a tokenizer file's path on every machine) and end_id. Each task packs what it
    reads in groups of GROUP_TOKENS tokens, so nothing is shuffled; sequence and step ids carry the partition's number and hold within
    one run of the query. Null text counts as empty, which leaves end_id alone; null ids and repeated rows are kept, each row as a
    document of its own; a document of any length is cut; other columns are not read; no rows give no rows."""
    small_batches(docs.sparkSession)
    kind = docs.select(F.col(id_col).alias("doc_id"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        base = TaskContext.get().partitionId() << 40
        sequences = steps_made = held = 0
        names, ids = [], []

        def flush() -> pa.RecordBatch:
            nonlocal sequences, steps_made
            made = pack([len(x) for x in ids], tiers)
            sizes = [sum(p[2] for p in s) for s in made]
            step = steps(sizes)
            flat = [(i, start, n, k, offset) for k, s in enumerate(made) for (i, start, n), offset in zip(s, np.cumsum([0] + [p[2] for p in s]).tolist(), strict=False)]
            cut = [ids[i][start : start + n] for i, start, n, _, _ in flat]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays(names).take(pa.array([f[0] for f in flat], pa.int64())),
                    pa.array([f[1] for f in flat], pa.int64()),
                    pa.array([f[2] for f in flat], pa.int64()),
                    pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cut], pa.int64()),
                    pa.array([len(ids[f[0]]) for f in flat], pa.int64()),
                    pa.array([base + sequences + f[3] for f in flat], pa.int64()),
                    pa.array([f[4] for f in flat], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(c) for c in cut]), pa.int32()), pa.array(np.concatenate(cut).astype(np.int32))),
                    pa.array([sizes[f[3]] for f in flat], pa.int64()),
                    pa.array([base + steps_made + step[f[3]] for f in flat], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "sequence_tokens", "step_id"],
            )
            sequences += len(made)
            steps_made += max(step) + 1
            return out

        for b in batches:
            _, offsets = ragged(b.column(1))
            for first, end in slices(offsets, SLICE_BYTES):
                part = b.slice(first, end - first)
                made, at = encode(part.column(1), end_id)
                begin = 0
                for k, (i, j) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
                    ids.append(made[i:j])
                    held += j - i
                    if held >= GROUP_TOKENS:
                        names.append(part.column(0).slice(begin, k + 1 - begin))
                        yield flush()
                        names, ids, held, begin = [], [], 0, k + 1
                if begin < part.num_rows:
                    names.append(part.column(0).slice(begin))
        if ids:
            yield flush()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        over_batches(rows, encoder),
        f"doc_id {kind.dtypes[0][1]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>, sequence_tokens long, step_id long",
    )
