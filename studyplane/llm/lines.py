"""Line dedup: a sharded minimal perfect hash over distinct line hashes indexes fingerprint and count arrays, which documents probe.

A line is known by a 64-bit hash and a fingerprint of 32 bits, of which all bits are kept. A shard's minimal perfect hash leads each of its
lines to a slot of its own; the slot's fingerprint tells whether the line asked for is the one counted there, and its count in how many
documents the line stands. Lines themselves are never shuffled, and no join has lines as its rows: chunks of documents send shards the
hashes of their distinct lines, and get back those that stand in an earlier document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, over_batches, over_group, ragged, slices, small_batches, written
from .words import LOWER, NOT_BLANK, word_hashes

#: Bytes of text in a chunk (one text at least) and hashed at once; hashes that a shard takes in at once, about.
CHUNK_BYTES, SLICE_BYTES, SHARD_LINES = 1 << 24, 1 << 22, 1 << 21

#: Bits of a level of the minimal perfect hash for each key that is left.
GAMMA = 2

#: Stands for a null id, after all others.
_NULL = (1 << 63) - 1

#: A permutation of byte values, so that the fingerprint is of another polynomial than the hash.
_OTHER = np.random.default_rng(11).permutation(256).astype(np.uint8)


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(data, starts, ends), (word_hashes(_OTHER[data], starts, ends) >> np.uint64(32)).astype(np.uint32)


def _bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each line (without its \\n), and the lines' offsets by row: every row has a line at least."""
    breaks = np.flatnonzero(data == 10)
    per_row = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    at = np.concatenate([[0], np.cumsum(per_row)])
    starts = np.empty(at[-1], np.int64)
    ends = np.empty(at[-1], np.int64)
    first, last = np.zeros(at[-1], bool), np.zeros(at[-1], bool)
    first[at[:-1]] = True
    last[at[1:] - 1] = True
    starts[first], starts[~first] = offsets[:-1], breaks + 1
    ends[last], ends[~last] = offsets[1:], breaks
    return starts, ends, at


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each line's key (the line without blanks at its ends), and the key's code points."""
    solid = np.flatnonzero(NOT_BLANK[data])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = high > low
    key_starts, key_ends = starts.copy(), starts.copy()
    key_starts[some], key_ends[some] = solid[low[some]], solid[high[some] - 1] + 1
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    return key_starts, key_ends, points[key_ends] - points[key_starts]


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: level by level, a key that has a bit of the level to itself takes it; the others go on
    to the next level. A key's slot is the rank of its bit."""

    def __init__(self, sizes: np.ndarray, bits: bytes):
        self.sizes = sizes
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes.sum())).astype(bool)
        self.rank = np.zeros(len(self.bits) + 1, np.int32)
        np.cumsum(self.bits, out=self.rank[1:])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys ^ mixed(np.full(1, level + 1, np.uint64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            size = GAMMA * len(left) + 64
            place = cls._place(left, len(sizes), size)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[place]]
        return cls(np.array(sizes, np.int64), np.packbits(np.concatenate(levels)).tobytes() if levels else b"")

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, or -1; a key that is not in the set may get any."""
        out = np.full(len(keys), -1, np.int64)
        open_keys, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            place = base + self._place(keys[open_keys], level, size)
            hit = self.bits[place]
            out[open_keys[hit]] = self.rank[place[hit]]
            open_keys = open_keys[~hit]
            base += size
        return out


def _joined(keys: np.ndarray, prints: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit key of hash and fingerprint."""
    return mixed(keys ^ mixed(prints.astype(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)))


def _blob(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8).tobytes()


def _numbers(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // n if n else 1}")


_INDEX = "shard long, n long, seed long, sizes array<bigint>, bits binary, fingerprints binary, counts binary, owners binary"
_ASKED = "shard long, chunk long, n long, keys binary, fingerprints binary, firsts binary, lasts binary, rows binary"


def _merged(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Distinct lines of records: hash, fingerprint, least and greatest id, rows that hold it."""
    keys, prints, firsts, lasts = (np.frombuffer(b"".join(t[c].to_pylist()), kind) for c, kind in (("keys", "<u8"), ("fingerprints", "<u4"), ("firsts", "<i8"), ("lasts", "<i8")))
    rows = np.concatenate([_numbers(b, n) for b, n in zip(t["rows"].to_pylist(), t["n"].to_pylist(), strict=True)]).astype(np.int64)
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])])) if len(keys) else np.zeros(0, np.int64)
    if not len(at):
        return keys, prints, firsts, lasts, rows
    return keys[at], prints[at], np.minimum.reduceat(firsts[order], at), np.maximum.reduceat(lasts[order], at), np.add.reduceat(rows[order], at)


def _record(keys: np.ndarray, prints: np.ndarray, firsts: np.ndarray, lasts: np.ndarray, rows: np.ndarray) -> tuple:
    return len(keys), keys.tobytes(), prints.tobytes(), firsts.tobytes(), lasts.tobytes(), _blob(rows)


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """chunk, doc_id (long), n_lines and text of every row; a chunk is a run of a task's rows with chunk_bytes of text or one row."""
    from pyspark import TaskContext

    small_batches(docs.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, room = TaskContext.get().partitionId() << 32, chunk_bytes
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            of_row = np.empty(len(size), np.int64)
            for i, n in enumerate(size.tolist()):
                if n > room and room < chunk_bytes:
                    chunk, room = chunk + 1, chunk_bytes
                of_row[i], room = chunk, room - n - 64
            lines = pc.fill_null(pc.count_substring(b.column(1), "\n"), 0).to_numpy(zero_copy_only=False) + 1
            yield pa.RecordBatch.from_arrays([pa.array(of_row), b.column(0), pa.array(lines.astype(np.int64)), b.column(1)], ["chunk", "doc_id", "n_lines", "text"])

    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return body.mapInArrow(over_batches(deal), "chunk long, doc_id long, n_lines long, text string")


def _lines(ids: pa.Array, text: pa.Array, least_chars: int) -> tuple[np.ndarray, ...]:
    """Of texts: lower-cased bytes, line bounds, line offsets by row, the lines that have a key of least_chars, their hashes and
    fingerprints, and the ids of their rows."""
    data, offsets = ragged(text)
    starts, ends, at = _bounds(data, offsets)
    folded = LOWER[data]
    key_starts, key_ends, points = _keys(folded, starts, ends)
    long = np.flatnonzero(points >= least_chars)
    keys, prints = _hashes(folded, key_starts[long], key_ends[long])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))[long]
    owner = pc.fill_null(ids, pa.scalar(_NULL, pa.int64())).to_numpy(zero_copy_only=False)[row]
    return data, starts, ends, at, long, keys, prints, owner


def asked(chunks: DataFrame, bits: int, least_chars: int) -> DataFrame:
    """What each chunk asks each shard: its distinct lines there, each once however many of its documents hold it."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        chunk = None

        def sent() -> pa.RecordBatch:
            keys, prints, owner, rows = (np.concatenate(x) for x in held.values())
            order = np.lexsort((prints, keys))
            keys, prints, owner, rows = keys[order], prints[order], owner[order], rows[order]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])])) if len(keys) else np.zeros(0, np.int64)
            keys, prints = keys[new], prints[new]
            firsts, lasts, n = (np.minimum.reduceat(owner, new), np.maximum.reduceat(owner, new), np.add.reduceat(rows, new)) if len(new) else (owner, owner, rows)
            shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
            begin = np.unique(shard, return_index=True)[1]
            out = [(shard[i], chunk, *_record(*(x[i:j] for x in (keys, prints, firsts, lasts, n)))) for i, j in zip(begin.tolist(), np.append(begin, len(shard))[1:].tolist(), strict=True)]
            kinds = [pa.int64()] * 3 + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in _ASKED.split(", ")])

        for b in batches:
            ids = b.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
            for i, j in zip(cuts.tolist(), np.append(cuts, len(ids))[1:].tolist(), strict=True):
                if held and ids[i] != chunk:
                    yield sent()
                    held = {}
                chunk = int(ids[i])
                part = b.slice(i, j - i)
                _, offsets = ragged(part.column(3))
                for x, y in slices(offsets, SLICE_BYTES):
                    _, _, _, at, long, keys, prints, owner = _lines(part.column(1).slice(x, y - x), part.column(3).slice(x, y - x), least_chars)
                    row = np.searchsorted(at, long, side="right")
                    order = np.lexsort((row, prints, keys))
                    k, p, r = keys[order], prints[order], row[order]
                    once = np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (r[1:] != r[:-1])]) if len(k) else np.zeros(0, bool)  # a row counts once
                    for name, value in (("keys", k[once]), ("prints", p[once]), ("owner", owner[order][once]), ("rows", np.ones(once.sum(), np.int64))):
                        held.setdefault(name, []).append(value)
        if held:
            yield sent()

    return chunks.select("chunk", "doc_id", "n_lines", "text").mapInArrow(over_batches(ask), _ASKED)


def indexed(records: DataFrame, parts: DataFrame) -> DataFrame:
    """The shards' indexes of the lines in records: minimal perfect hash, fingerprints, counts, and the first document of lines with more.

    A shard that a few lines of very many chunks fill is summed in parts first (shard, parts). counts: rows that hold the line, 1 where they
    all have one id."""

    def summed(t: pa.Table) -> pa.Table:
        made = _record(*_merged(t))
        kinds = [pa.int64()] * 3 + [pa.binary()] * 5
        return pa.table([pa.array([v], kind) for v, kind in zip((t["shard"][0].as_py(), 0, *made), kinds, strict=True)], [x.split()[0] for x in _ASKED.split(", ")])

    def build(t: pa.Table) -> pa.Table:
        keys, prints, firsts, lasts, rows = _merged(t)
        seed = 0
        while len(np.unique(joined := _joined(keys, prints, seed))) < len(keys):
            seed += 1
        made = PerfectHash.of(joined)
        slot = made.slots(joined)
        order = np.argsort(slot)
        counts = np.where(firsts == lasts, 1, np.maximum(rows, 2))[order]
        out = (t["shard"][0].as_py(), len(keys), seed, made.sizes.tolist(), made.packed(), prints[order].tobytes(), _blob(counts), firsts[order][counts > 1].tobytes())
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] + [pa.binary()] * 4
        return pa.table([pa.array([v], kind) for v, kind in zip(out, kinds, strict=True)], [x.split()[0] for x in _INDEX.split(", ")])

    merged = records.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("chunk"), "parts"))
    partly = merged.filter("parts > 1").drop("parts").groupBy("shard", "part").applyInArrow(over_group(lambda t: summed(t.drop(["part"]))), _ASKED)
    return merged.filter("parts = 1").drop("parts", "part").unionByName(partly).groupBy("shard").applyInArrow(over_group(build), _INDEX)


def probed(keys: np.ndarray, prints: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """Documents that hold each line, and the first of them where they are more than one (else the null id's stand-in)."""
    n = index["n"]
    slot = PerfectHash(np.array(index["sizes"], np.int64), index["bits"]).slots(_joined(keys, prints, index["seed"]))
    known = slot >= 0
    known[known] = np.frombuffer(index["fingerprints"], "<u4")[slot[known]] == prints[known]
    counts = _numbers(index["counts"], n)
    place = np.cumsum(counts > 1) - 1
    count = np.zeros(len(keys), np.int64)
    count[known] = counts[slot[known]]
    first = np.full(len(keys), _NULL, np.int64)
    some = count > 1
    first[some] = np.frombuffer(index["owners"], "<i8")[place[slot[some]]]
    return count, first


def deduplicated(docs: DataFrame, least_chars: int = 10, least_docs: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, shard_lines: int = SHARD_LINES) -> DataFrame:
    """doc_id, n_lines, n_dropped and text of every row, text without the lines that an earlier document of least_docs or more holds.

    A line's key is the line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased. Lines whose key has least_chars code points or more and
    stands in least_docs documents or more are dropped in all of these but the one with the smallest doc_id, which keeps all of them; other
    lines, and what remains of each text's order, stay as they are. Null and empty texts have one empty line and give an empty text. Rows of
    one doc_id are parts of one document (a line that only they hold stays in all of them; beyond 2, least_docs counts rows); null ids are one
    document, which comes last. A text whose lines all go is empty. Whole texts are read; other columns are not; no rows give no rows."""
    chunks = written(chunked(docs, id_col, text_col, chunk_bytes), "chunks")
    total = chunks.agg(F.sum("n_lines").alias("n")).first()["n"] or 0
    bits = max(3, (total // shard_lines).bit_length())
    records = written(asked(chunks, bits, least_chars), "asked")
    parts = written(records.groupBy("shard").agg(F.greatest(F.ceil(F.sum("n") / (2 * shard_lines)), F.lit(1)).alias("parts")), "parts")
    index = written(indexed(records, parts), "index")

    def answer(asking: pa.Table, index: pa.Table) -> pa.Table:
        names = ["chunk", "keys", "fingerprints", "firsts"]
        if not asking.num_rows:
            return pa.table({n: pa.array([], kind) for n, kind in zip(names, [pa.int64()] + [pa.binary()] * 3, strict=True)})
        of = index.to_pylist()[0]
        size = asking["n"].to_pylist()
        keys, prints = (np.frombuffer(b"".join(asking[c].to_pylist()), kind) for c, kind in (("keys", "<u8"), ("fingerprints", "<u4")))
        count, first = probed(keys, prints, of)
        last = np.frombuffer(b"".join(asking["lasts"].to_pylist()), "<i8")
        gone = (count >= least_docs) & (last > first)
        out, begin = [], 0
        for c, n in zip(asking["chunk"].to_pylist(), size, strict=True):
            mine = begin + np.flatnonzero(gone[begin : begin + n])
            begin += n
            if len(mine):
                out.append((c, keys[mine].tobytes(), prints[mine].tobytes(), first[mine].tobytes()))
        return pa.table([pa.array([o[k] for o in out], kind) for k, kind in enumerate([pa.int64()] + [pa.binary()] * 3)], names)

    part = records.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("chunk"), "parts")).select("shard", "part", "chunk", "n", "keys", "fingerprints", "lasts")
    copies = index.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    answers = written(part.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(answer, "chunk long, keys binary, fingerprints binary, firsts binary"), "answers")

    def kept(rows: pa.Table, answers: pa.Table) -> pa.Table:
        keys, prints, firsts = (np.frombuffer(b"".join(answers[c].to_pylist()), kind) for c, kind in (("keys", "<u8"), ("fingerprints", "<u4"), ("firsts", "<i8")))
        order = np.lexsort((prints, keys))
        keys, prints, firsts = keys[order], prints[order], firsts[order]
        dropped, texts = [], []
        text, ids = rows["text"].combine_chunks(), rows["doc_id"].combine_chunks()
        _, offsets = ragged(text)
        for x, y in slices(offsets, SLICE_BYTES):
            data, starts, ends, at, long, k, p, owner = _lines(ids.slice(x, y - x), text.slice(x, y - x), least_chars)
            gone = np.zeros(len(starts), bool)
            if len(keys):
                place = np.searchsorted(keys, k)
                hit = np.zeros(len(k), bool)
                for _ in range(int(np.unique(keys, return_counts=True)[1].max())):  # lines that share a hash stand together
                    inside = np.minimum(place, len(keys) - 1)
                    hit |= (place < len(keys)) & (keys[inside] == k) & (prints[inside] == p) & (owner > firsts[inside])
                    place = place + 1
                gone[long[hit]] = True
            raw = data.tobytes()
            sums = np.concatenate([[0], np.cumsum(gone)])
            dropped.append(np.diff(sums[at]))
            starts, ends = starts.tolist(), ends.tolist()
            for r, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                if dropped[-1][r]:
                    texts.append(b"\n".join(raw[starts[q] : ends[q]] for q in range(i, j) if not gone[q]))
                else:
                    texts.append(raw[starts[i] : ends[j - 1]])
        n = np.concatenate(dropped) if dropped else np.zeros(0, np.int64)
        return pa.table({"doc_id": ids, "n_lines": rows["n_lines"], "n_dropped": pa.array(n, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())})

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(kept, "doc_id long, n_lines long, n_dropped long, text string")
