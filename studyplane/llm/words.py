"""Words of many texts at once: byte classes, word bounds and 64-bit word hashes over ragged byte arrays."""

from __future__ import annotations

import numpy as np

from .common import mixed, within

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of words [^\x20\x09-\x0D]+.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n."""
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done, step = done + more, step * step % (1 << 64)
    return out


_UP, _DOWN = _powers(_BASE, _SEGMENT + 1), _powers(_BASE_INVERSE, _SEGMENT + 1)


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the words' offsets by row. data is lower-cased already; no word crosses a row."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (~before | edge))
    ends = np.flatnonzero(before & (~inside | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + _SEGMENT, side="right")))
        last = ends[to - 1]
        up, down = (_UP, _DOWN) if last - first <= _SEGMENT else (_powers(_BASE, last - first + 1), _powers(_BASE_INVERSE, last - first + 1))
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * up[: last - first], out=sums[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def shingles(words: np.ndarray, row_of_words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingle hashes of each row, laid end to end, and their offsets by row.

    A row of fewer than n words but not none has its whole sequence as one shingle. row_of_words: the words' offsets by row."""
    counts = np.diff(row_of_words)
    rows = len(counts)
    total = len(words)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    key = words.copy()
    for i in range(1, n):  # what is mixed in from beyond a row's end is never used
        key[: total - i] = mixed(key[: total - i] * factor + words[i:])
    sizes = np.where(counts >= n, counts - (n - 1), counts > 0)
    ends = np.cumsum(sizes)
    first = np.where(counts >= n, row_of_words[:-1], 0)
    out = key[within(sizes) + np.repeat(first, sizes)]
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        whole = np.full(1, counts[r], np.uint64)
        for i in range(row_of_words[r], row_of_words[r + 1]):
            whole = mixed(whole * factor + words[i : i + 1])
        out[ends[r] - 1] = whole[0]
    for b, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        out[b:e].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[(ends - sizes)[sizes > 0]] = True
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out[keep], np.concatenate([[0], kept[ends]])
