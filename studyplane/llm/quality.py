"""Quality classification by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_names, over_batches, ragged, slices, small_batches, written
from .words import LOWER, NOT_BLANK, word_bounds, word_hashes

#: Byte classes whose shares are features: letters by case, digits, blanks, line ends, beyond ASCII, then each mark of ASCII.
_MARKS = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS = np.full(256, 6, np.int64)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x20], _CLASS[0x0A], _CLASS[0x80:] = 0, 1, 2, 3, 4, 5
_CLASS[_MARKS] = 7 + np.arange(len(_MARKS))
_CLASSES = 7 + len(_MARKS)

#: Features: shares of the byte classes (square roots), log of the bytes, mean word length, share of words that are repeats, words per
#: line (log), share of words that end in a mark, empty text.
FEATURES = _CLASSES + 6

#: Newton rounds at most, the gradient's size at which they end, and the weight decay.
ROUNDS, CLOSE, DECAY = 40, 1e-7, 5e-3

#: Rounds of halving for the multiplier of the risk's non-negative part, and how near to 0 that part must come.
HALVINGS, NEAR = 30, 1e-3

#: Bins of a score's histogram, and the chance that the class prior's bound is wrong.
BINS, CHANCE = 1024, 0.05

_BYTE_CLASS = np.zeros((256, _CLASSES))
_BYTE_CLASS[np.arange(256), _CLASS] = 1


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers for each text."""
    rows = len(offsets) - 1
    counts = np.array([np.bincount(data[offsets[r] : offsets[r + 1]], minlength=256) for r in range(rows)]).reshape(rows, 256) @ _BYTE_CLASS
    size = np.diff(offsets)
    starts, ends, at = word_bounds(LOWER[data], offsets, NOT_BLANK)
    hashes = word_hashes(LOWER[data], starts, ends)
    words = np.diff(at)
    distinct = np.array([len(np.unique(hashes[at[r] : at[r + 1]])) for r in range(rows)], float)
    marked = np.zeros(len(ends) + 1)
    np.cumsum(_CLASS[data[ends - 1]] >= 7, out=marked[1:])
    some, least = np.maximum(size, 1), np.maximum(words, 1)
    return np.column_stack(
        [
            np.sqrt(counts / some[:, None]),
            np.log1p(size) / 10,
            np.minimum((size - counts[:, 3] - counts[:, 4]) / least, 50) / 10,
            1 - distinct / least,
            np.log1p(words / (counts[:, 4] + 1)) / 5,
            (marked[at[1:]] - marked[at[:-1]]) / least,
            size == 0,
        ]
    ).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -3, 3), np.ones(len(x))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights, -500, 500)))


def _matrix(column: pa.Array) -> np.ndarray:
    data, _ = ragged(column)
    return data.view(np.float32).reshape(-1, FEATURES).astype(float)


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), model: QualityModel | None = None) -> DataFrame:
    """doc_id, `keep` and x (float features as bytes) of every whole text, or its score by the model instead of x; null counts as empty.

    `keep` must not name a column of the result, nor one twice."""
    distinct_names(keep, ("doc_id", "x", "score"))
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = ragged(b.column(1))
            for a, e in slices(offsets, 1 << 21):
                made = text_features(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a])
                last = pa.array([m.tobytes() for m in made], pa.binary()) if model is None else pa.array(model.scores(made.astype(float)), pa.float64())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, e - a) for c in (b.column(0), *b.columns[2:])), last], ["doc_id", *keep, "x" if model is None else "score"])

    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *(F.col(k) for k in keep))
    kinds = dict(body.dtypes)
    return body.mapInArrow(over_batches(rows), ", ".join(f"`{k}` {kinds[k]}" for k in ("doc_id", *keep)) + (", x binary" if model is None else ", score double"))


def _summed(rows: DataFrame, width: int, of_batch) -> np.ndarray:
    """Sums over all rows of the `width` numbers that of_batch gives for a batch; each task adds up its own first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += of_batch(b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], ["at", "value"])

    out = np.zeros(width)
    for r in rows.mapInArrow(part, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


@dataclass(frozen=True)
class Sums:
    """What one pass over all rows gives at some weights: the two parts of the risk, their gradients and curvatures.

    positive: prior * E_positive[l(g)]. negative: E_unlabelled[l(-g)] - prior * E_positive[l(-g)]."""

    positive: float
    d_positive: np.ndarray
    h_positive: np.ndarray
    negative: float
    d_negative: np.ndarray
    h_negative: np.ndarray


class Table:
    """A written table of x and positive (boolean); every row is unlabelled text as well. Tasks return sums only."""

    def __init__(self, features: DataFrame):
        self.rows = features.select("x", "positive")

        def moments(b: pa.RecordBatch) -> np.ndarray:
            x = _matrix(b.column(0))
            return np.concatenate([x.sum(0), (x * x).sum(0), [len(x), b.column(1).to_numpy(zero_copy_only=False).sum()]])

        m = _summed(self.rows, 2 * FEATURES + 2, moments)
        self.n, self.n_pos = m[-2], m[-1]
        self.mean = m[:FEATURES] / max(self.n, 1)
        scale = np.sqrt(np.maximum(m[FEATURES : 2 * FEATURES] / max(self.n, 1) - self.mean**2, 0))
        scale[scale < 1e-4] = 1
        self.scale = scale

    def model(self, weights: np.ndarray, prior: float) -> QualityModel:
        return QualityModel(self.mean, self.scale, weights, prior)

    def at(self, w: np.ndarray, prior: float) -> Sums:
        model, k = self.model(w, prior), FEATURES + 1

        def sums(b: pa.RecordBatch) -> np.ndarray:
            z, pos = model.inputs(_matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            g = z @ w
            p = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
            up, curve = np.logaddexp(0, g), z * (p * (1 - p))[:, None]
            return np.concatenate([[up.sum(), up[pos].sum(), g[pos].sum()], z.T @ p, z[pos].T @ p[pos], z[pos].sum(0), (curve.T @ z).ravel(), (curve[pos].T @ z[pos]).ravel()])

        s = _summed(self.rows, 3 + 3 * k + 2 * k * k, sums)
        share, each = prior / self.n_pos, 1 / self.n
        d_up, d_up_pos, d_g_pos = s[3 : 3 + k] * each, s[3 + k : 3 + 2 * k] * share, s[3 + 2 * k : 3 + 3 * k] * share
        h_up, h_up_pos = s[3 + 3 * k : 3 + 3 * k + k * k].reshape(k, k) * each, s[3 + 3 * k + k * k :].reshape(k, k) * share
        # l(g) = log(1 + exp(g)) - g of the positives, l(-g) = log(1 + exp(g)) of what counts as negative
        return Sums((s[1] - s[2]) * share, d_up_pos - d_g_pos, h_up_pos, s[0] * each - s[1] * share, d_up - d_up_pos, h_up - h_up_pos)

    def histogram(self, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
        """How many rows, and how many positives, have a score in each of BINS bins."""

        def counts(b: pa.RecordBatch) -> np.ndarray:
            at = np.minimum((model.scores(_matrix(b.column(0))) * BINS).astype(int), BINS - 1)
            pos = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at[pos], minlength=BINS)]).astype(float)

        both = _summed(self.rows, 2 * BINS, counts)
        return both[:BINS], both[BINS:]


def _least(table: Table, prior: float, share: float, weights: np.ndarray) -> tuple[np.ndarray, Sums]:
    """Weights of least positive + share * negative with weight decay, by Newton's method from `weights`; for share in 0 to 1 that is
    convex: it is a mean of prior * E_positive[l(g)] and of E_unlabelled[l(-g)] - prior * E_positive[g]."""
    decay = np.full(FEATURES + 1, DECAY)
    decay[-1] = DECAY / 100

    def value(w: np.ndarray, s: Sums) -> float:
        return s.positive + share * s.negative + (decay * w * w).sum() / 2

    s, step = table.at(weights, prior), 1.0
    for _ in range(ROUNDS):
        gradient = s.d_positive + share * s.d_negative + decay * weights
        if np.abs(gradient).max() < CLOSE or step < 1 / 4096:
            break
        move = np.linalg.solve(s.h_positive + share * s.h_negative + np.diag(decay + 1e-6), gradient)
        tried = weights - step * move
        there = table.at(tried, prior)
        if value(tried, there) <= value(weights, s):
            weights, s, step = tried, there, min(1.0, 2 * step)
        else:
            step /= 4
    return weights, s


def prior_from(rows: np.ndarray, positives: np.ndarray) -> float:
    """The class prior from histograms of one score over unlabelled text and over trusted positives: no negatives are read.

    Of texts that score over some threshold no more than all can be positive, so the share of unlabelled text over it, divided by that of
    the positives, bounds the prior; the least such bound is taken where both shares are known well (best bin, with a deviation that a
    chance of CHANCE exceeds)."""
    n, n_pos = rows.sum(), positives.sum()
    if not n or not n_pos:
        return 0.5
    above = lambda x: np.cumsum(x[::-1])[::-1]
    q, p = above(rows) / n, above(positives) / n_pos
    sure = np.sqrt(np.log(4 / CHANCE) / (2 * n)) + np.sqrt(np.log(4 / CHANCE) / (2 * n_pos))
    fine = p > 0
    best = np.argmin((q[fine] + sure) / p[fine])
    return float(np.clip(q[fine][best] / p[fine][best], 0.01, 0.99))


def fit(table: Table, prior: float | None = None) -> QualityModel:
    """The weights of least non-negative unbiased risk, prior * E_positive[l(g)] + max(0, E_unlabelled[l(-g)] - prior * E_positive[l(-g)])
    with the logistic loss l, and weight decay.

    prior: the class prior; else it is estimated by `prior_from` from the scores of a first classifier of positives against unlabelled
    text. The risk is the larger of two convex functions, positive and positive + negative; its least value is that of a mean of the
    two: the second alone if its negative part isn't below 0 there, else the mean at which the negative part is 0, which is found by
    halving. Every round is one pass over all rows, of which tasks return sums. Without positives all scores are the prior, 0.5 if unknown."""
    none = np.zeros(FEATURES + 1)
    if not table.n_pos:
        known = 0.5 if prior is None else prior
        none[-1] = np.log(known / (1 - known))
        return table.model(none, known)
    weights = none
    if prior is None:
        weights, _ = _least(table, 0.5, 1.0, none)
        prior = prior_from(*table.histogram(table.model(weights, 0.5)))
    weights, s = _least(table, prior, 1.0, weights)
    if s.negative < 0:
        low, high, begin = 0.0, 1.0, none
        for _ in range(HALVINGS):
            middle = (low + high) / 2
            weights, s = _least(table, prior, middle, begin)
            if abs(s.negative) < NEAR:
                break
            if s.negative > 0:
                low, begin = middle, weights
            else:
                high = middle
    return table.model(weights, prior)


def fitted(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> tuple[QualityModel, DataFrame]:
    """The model of the rows where train (an expression over doc_id) holds, and the written features (doc_id, x) of all rows.

    Those rows are the unlabelled text; those of them labelled 1 are the trusted positives. Labels of 0 are not read, nor any other label;
    the class prior is estimated. A row labelled twice is positive if one label is 1; null ids are unlabelled."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(quality_col).alias("quality")).filter(train)
    positives = known.filter(F.col("quality") == 1).select("doc_id").distinct()
    features = written(featured(docs, id_col, text_col), "features")
    marked = written(features.filter(train).join(positives.withColumn("positive", F.lit(True)), "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive")), "marked")
    return fit(Table(marked)), features


def predicted(score: Column, threshold: float = 0.3) -> Column:
    """1 where the score reaches the threshold, else 0."""
    return (score >= threshold).cast("int")


def with_scores(features: DataFrame, model: QualityModel) -> DataFrame:
    """A table of x with score instead of it."""
    keep = [c for c in features.columns if c != "x"]
    kinds = dict(features.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.scores(_matrix(b.column(len(keep)))) if b.num_rows else [], pa.float64())], [*keep, "score"])

    return features.select(*keep, "x").mapInArrow(over_batches(rows), ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", score double")


def scored(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality") -> DataFrame:
    """doc_id and score (the chance of label 1) of every row, by the model of the rows where train holds; see `fitted`.

    Null and empty texts have features and a score like all others; null ids and repeated rows are kept; very long texts are read whole;
    other columns are not read; no rows give no rows."""
    model, features = fitted(docs, labels, train, id_col, text_col, quality_col)
    return with_scores(features, model)
