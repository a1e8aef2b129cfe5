"""Phrase collocation mining by top-order marginalisation: only the longest windows are counted, and ROLLUP sums their prefixes.

A word and the two after it in its piece are a window; where the piece ends, a window is padded. Counts of two words and of one are sums of
windows that begin with them, so ROLLUP (lang, w1, w2, w3) gives all phrases of three words, two and one, and each language's words, without
counting shorter n-grams on their own.

Tasks count their windows as words of a table of their own, and deal them by their first two words, so that a window's whole count is known
before the ROLLUP: one below the floor gives up its last word there, and two words below the floor give up the second, since they can't be
candidates, nor parts of candidates, and only the counts of their prefixes matter. A pair that very many words follow would make one bucket large:
its windows are dealt by all three words, a mark tells its bucket so, and they go to the ROLLUP as they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, over_batches, over_group, ragged, slices, small_batches, written
from .words import LOWER, word_bounds, word_hashes

#: Bytes of text counted at once (one text at least), and of text whose windows meet in one bucket, about.
FLUSH_BYTES, BUCKET_BYTES = 1 << 23, 1 << 23

#: Windows of one pair that a flush deals by pair, at most and at least; between them, as many as keep a bucket's surplus under SURPLUS.
WIDE, LEAST_WIDE, SURPLUS = 256, 4, 1 << 21

_ENDS = [ord(c) for c in ".,;:!?\n\x0b\x0c\r"]

#: Bytes that end a piece, and bytes of words.
PIECE_END = np.zeros(256, bool)
PIECE_END[_ENDS] = True
WORD = ~PIECE_END
WORD[[0x20, 0x09]] = False

NARROW, SPREAD, MARK = 0, 1, 2

_RECORD = "bucket long, kind int, lang string, n long, words binary, w1 binary, w2 binary, w3 binary, counts binary"
_COLUMNS = [x.split()[0] for x in _RECORD.split(", ")]


def _strings(body: np.ndarray, size: np.ndarray) -> pa.Array:
    """Bytes laid end to end as an Arrow array of strings of these sizes."""
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(body)])


def _split(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and sizes of words joined by spaces."""
    data = np.frombuffer(joined, np.uint8)
    gaps = np.flatnonzero(data == 0x20)
    return data[data != 0x20], np.diff(np.concatenate([[-1], gaps, [len(data)]])) - 1


def _packed(x: np.ndarray) -> bytes:
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // n}").astype(np.int64)


def windows(texts: pa.Array, lang: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts, their distinct windows as rows (lang, w1, w2, w3), words from 1 and 0 for padding, and how often each stands."""
    data, offsets = ragged(texts)
    data = LOWER[data]
    starts, ends, rows = word_bounds(data, offsets, WORD)
    coded = _strings(data[WORD[data]], ends - starts).dictionary_encode()  # words are all bytes of their kind
    w = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(PIECE_END[data], out=breaks[1:])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    piece = breaks[starts] + row  # grows from piece to piece, and from row to row
    lead = lambda k: np.where(piece[k:] == piece[: len(w) - k], w[k:], 0)
    w2, w3 = np.zeros(len(w), np.int64), np.zeros(len(w), np.int64)
    w2[: max(len(w) - 1, 0)], w3[: max(len(w) - 2, 0)] = lead(1), lead(2)
    return coded.dictionary, *_counted(lang[row], w, w2, w3, np.ones(len(w), np.int64), len(coded.dictionary) + 1)


def _counted(lang: np.ndarray, w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, n: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows in order, and the sums of n."""
    first, pair = np.unique((lang * words + w1) * words + w2, return_inverse=True) if len(w1) else (np.zeros(0, np.int64),) * 2
    key, at = np.unique(pair * words + w3, return_inverse=True) if len(w1) else (np.zeros(0, np.int64),) * 2
    pair, w3 = np.divmod(key, words)
    rest, w2 = np.divmod(first[pair], words)
    lang, w1 = np.divmod(rest, words)
    return np.stack([lang, w1, w2, w3], 1), np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)


def _pairs(rows: np.ndarray) -> np.ndarray:
    """Where each pair (lang, w1, w2) of ordered windows begins."""
    return np.flatnonzero(np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])) if len(rows) else np.zeros(0, np.int64)


def dealt(docs: DataFrame, bits: int, wide: int) -> DataFrame:
    """Windows of each flush by bucket and language, with the words that they need."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            langs = t["lang"].combine_chunks().dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            words, rows, n = windows(t["text"].combine_chunks(), lang)
            data, offsets = ragged(words)
            hashes = np.concatenate([np.zeros(1, np.uint64), word_hashes(data, offsets[:-1], offsets[1:])])
            data_l, at_l = ragged(langs.dictionary)
            of_lang = word_hashes(data_l, at_l[:-1], at_l[1:])
            begin = _pairs(rows)
            follow = np.diff(np.append(begin, len(rows)))
            pair = mixed(mixed(mixed(of_lang[rows[begin, 0]]) ^ hashes[rows[begin, 1]]) + hashes[rows[begin, 2]])
            spread = np.repeat(follow > wide, follow)
            key = np.repeat(pair, follow)
            key = np.where(spread, mixed(key + hashes[rows[:, 3]]), key)
            marks = begin[follow > wide]
            rows = np.concatenate([rows, rows[marks] * [1, 1, 1, 0]])
            n = np.concatenate([n, np.zeros(len(marks), np.int64)])
            bucket = (np.concatenate([key, pair[follow > wide]]) >> np.uint64(64 - bits)).astype(np.int64)
            kind = np.concatenate([spread.astype(np.int64), np.full(len(marks), MARK)])
            cell = (bucket * 3 + kind) * (len(langs.dictionary) + 1) + rows[:, 0]
            order = np.argsort(cell, kind="stable")
            cells, first = np.unique(cell[order], return_index=True)
            out = []
            raw = data.tobytes()
            for i, j in zip(first.tolist(), np.append(first, len(order))[1:].tolist(), strict=True):
                mine = order[i:j]
                used, local = np.unique(rows[mine, 1:], return_inverse=True)
                local = local.reshape(-1, 3)
                pad = used[0] != 0  # places of words from 1 on
                used = used[used > 0] - 1
                text = b" ".join(raw[a:e] for a, e in zip(offsets[used].tolist(), offsets[used + 1].tolist(), strict=True))
                out.append((int(bucket[mine[0]]), int(kind[mine[0]]), langs.dictionary[int(rows[mine[0], 0])].as_py(), j - i, text, *(_packed(local[:, c] + pad) for c in range(3)), _packed(n[mine])))
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], x) for k, x in enumerate(kinds)], _COLUMNS)

        for b in batches:
            _, offsets = ragged(b.column(1))
            for i, j in slices(offsets, FLUSH_BYTES):
                if held and size + offsets[j] - offsets[i] > FLUSH_BYTES:
                    yield sent()
                    held, size = [], 0
                held.append(b.slice(i, j - i))
                size += offsets[j] - offsets[i]
        if held:
            yield sent()

    return docs.mapInArrow(over_batches(deal), _RECORD)


def folded(rows: np.ndarray, n: np.ndarray, marked: np.ndarray, least: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows below the floor without their last word, and pairs below it without their second, but for pairs that are marked: of these
    other buckets have windows too."""
    begin = _pairs(rows)
    follow = np.diff(np.append(begin, len(rows)))
    total = np.repeat(np.add.reduceat(n, begin), follow) if len(begin) else n
    free = ~marked
    w3 = np.where(free & (n < least), 0, rows[:, 3])
    w2 = np.where(free & (total < least), 0, rows[:, 2])
    return _counted(rows[:, 0], rows[:, 1], w2, w3, n, words)


def summed(records: DataFrame, least: int) -> DataFrame:
    """Rows lang, w1, w2, w3 and n for the ROLLUP; padding and words that were given up are empty strings."""

    def meet(t: pa.Table) -> pa.Table:
        size = t["n"].to_numpy()
        langs = t["lang"].combine_chunks().dictionary_encode()
        of_lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        tables = [_split(x) for x in t["words"].to_pylist()]
        every = pa.concat_arrays([_strings(*x) for x in tables]).dictionary_encode()
        place = every.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        base = np.cumsum([0, *(len(x[1]) for x in tables)])
        columns = []
        for c in ("w1", "w2", "w3"):
            local = [_unpacked(x, n) for x, n in zip(t[c].to_pylist(), size.tolist(), strict=True)]
            columns.append(np.concatenate([np.where(x > 0, place[np.maximum(x - 1, 0) + b], 0) for x, b in zip(local, base, strict=False)]))
        n = np.concatenate([_unpacked(x, k) for x, k in zip(t["counts"].to_pylist(), size.tolist(), strict=True)])
        lang, kind = np.repeat(of_lang, size), np.repeat(t["kind"].to_numpy(), size)
        words = len(every.dictionary) + 1
        out = []
        for spread in (False, True):
            mine = kind == SPREAD if spread else kind == NARROW
            rows, count = _counted(lang[mine], *(x[mine] for x in columns), n[mine], words)
            if not spread:
                key = lambda a, b, c: (a * words + b) * words + c
                marks = kind == MARK
                marked = np.isin(key(*rows[:, :3].T), key(lang[marks], columns[0][marks], columns[1][marks]))
                rows, count = folded(rows, count, marked, least, words)
            out.append((rows, count))
        rows, count = (np.concatenate(x) for x in zip(*out, strict=True))
        strings = pa.concat_arrays([pa.array([b""], pa.large_binary()), every.dictionary]).cast(pa.binary()).cast(pa.string())
        return pa.table([langs.dictionary.take(pa.array(rows[:, 0])), *(strings.take(pa.array(rows[:, k])) for k in (1, 2, 3)), pa.array(count)], ["lang", "w1", "w2", "w3", "n"])

    return records.groupBy("bucket").applyInArrow(over_group(meet), "lang string, w1 string, w2 string, w3 string, n long")


def phrases(docs: DataFrame, least: int = 10, lang_col: str = "lang", text_col: str = "text", none: str = "und", wide: int | None = None) -> DataFrame:
    """lang, w1, w2, w3, size and n of all phrases of one to three words that stand `least` times or more in their language, and each
    language's words (size 0); words that a phrase doesn't have are empty. wide: see `dealt`."""
    small_batches(docs.sparkSession)
    body = docs.select(F.coalesce(F.col(lang_col), F.lit(none)).alias("lang"), F.col(text_col).alias("text")).filter("text <> ''")
    total = body.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(3, (total // BUCKET_BYTES).bit_length())
    wide = wide or min(WIDE, max(LEAST_WIDE, SURPLUS // (total // FLUSH_BYTES + 1)))
    rows = summed(dealt(body, bits, wide), least)
    level = F.grouping_id("lang", "w1", "w2", "w3")
    sums = rows.rollup("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"), level.alias("level"))
    kept = ((F.col("level") == 0) & (F.col("w3") != "")) | ((F.col("level") == 1) & (F.col("w2") != "")) | (F.col("level") == 3)
    sums = sums.filter((kept & (F.col("n") >= least)) | (F.col("level") == 7))
    size = F.when(F.col("level") == 0, 3).when(F.col("level") == 1, 2).when(F.col("level") == 3, 1).otherwise(0)
    return sums.select("lang", *(F.coalesce(w, F.lit("")).alias(w) for w in ("w1", "w2", "w3")), size.alias("size"), "n")


def _score(a: str, left: str, right: str) -> Column:
    """floor(10^6 a^2 / (l r)), in whole numbers of up to 38 digits."""
    big = lambda x: f"cast({x} as decimal(19,0))"
    return F.expr(f"(cast({big(a)} * {big(a)} as decimal(38,0)) * cast(1000000 as decimal(7,0))) div cast({big(left)} * {big(right)} as decimal(38,0))")


def mined(docs: DataFrame, least: int = 10, cover: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text", wide: int | None = None) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n and score: each language's `top` phrases of two or three words, by score, then a, then phrase.

    Texts are lower-cased (A-Z), cut at [.,;:!?\\x0A-\\x0D] into pieces and these into words [^\\x20\\x09]+. a: occurrences of the phrase in
    pieces of texts of its language, `least` or more; l and r: those of its parts at the cut that scores least (the first of equal ones);
    score: floor(10^6 a^2 / (l r)); n: words of the language. A phrase goes where a longer one that holds it (dropped or not, but of `least`
    occurrences) has cover per cent of its occurrences or more.

    A null lang is 'und', and one with texts of lang 'und'; null and empty texts have no words; repeated rows count as often as they stand.
    Whole texts are read, other columns are not. No rows, or no phrase often enough, give no rows."""
    found = written(phrases(docs, least, lang_col, text_col, wide=wide), "phrases")
    of = lambda k, *names: found.filter(F.col("size") == k).select("lang", *(F.col(w).alias(x) for w, x in zip(("w1", "w2", "w3"), names[:-1], strict=False)), F.col("n").alias(names[-1]))
    pairs = of(2, "x", "y", "a")
    two = pairs.join(of(1, "x", "l"), ["lang", "x"]).join(of(1, "y", "r"), ["lang", "y"])
    longer = of(3, "x", "y", "z", "b")
    holds = longer.select("lang", "x", "y", "b").unionByName(longer.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), "b")).groupBy("lang", "x", "y").agg(F.max("b").alias("b"))
    two = two.join(holds, ["lang", "x", "y"], "left").filter(F.col("b").isNull() | (100 * F.col("b") < cover * F.col("a")))
    two = two.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    three = of(3, "x", "y", "z", "a").join(of(1, "x", "l1"), ["lang", "x"]).join(of(2, "y", "z", "r1"), ["lang", "y", "z"]).join(of(2, "x", "y", "l2"), ["lang", "x", "y"]).join(of(1, "z", "r2"), ["lang", "z"])
    three = three.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    three = three.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = two.unionByName(three).withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.join(of(0, "n"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
