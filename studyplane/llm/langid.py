"""Language identification: the nearest of several TF-IDF centroids per language, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import distinct_names, over_batches, ragged, slices, small_batches
from .words import LOWER

#: n-gram lengths in bytes, and the bins that they are hashed into.
GRAMS, BINS = (2, 3), 4096

#: Bound of the fit: labelled rows drawn per language, and in all.
SAMPLE_PER_LANGUAGE, SAMPLE = 400, 8000

#: Centroids per language, and rounds of their clustering.
CENTROIDS, ROUNDS = 4, 12

#: A text farther (1 - cosine) from every centroid than this is rejected.
MAX_DISTANCE = 0.95

UNDETERMINED = "und"

#: Letters of a-z and bytes beyond ASCII stay; all else is a blank.
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_FOLD = _LETTER[LOWER]


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashed n-gram counts, one row per text. Grams of blanks alone are left out."""
    letters = _FOLD[data].astype(np.uint32)
    out = np.zeros((len(offsets) - 1, BINS), np.float32)
    shift = np.uint32(32 - BINS.bit_length() + 1)
    for n in GRAMS:
        if len(letters) < n:
            continue
        key = np.full(len(letters) - n + 1, n, np.uint32)
        blank = np.ones(len(key), bool)
        for i in range(n):
            part = letters[i : len(letters) - n + 1 + i]
            key = key * np.uint32(257) + part
            blank &= part == 0x20
        bins = ((key * np.uint32(2654435769)) >> shift).astype(np.int64)
        bins[blank] = BINS
        for r in range(len(out)):
            a, b = offsets[r], offsets[r + 1] - n + 1
            if b > a:
                out[r] += np.bincount(bins[a:b], minlength=BINS + 1)[:BINS]
    return out


def normalised(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of (1 + log count) * idf, scaled to length 1; rows without grams stay 0."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1)


@dataclass(frozen=True)
class CentroidModel:
    idf: np.ndarray
    centroids: np.ndarray
    labels: tuple[str, ...]

    def nearest(self, counts: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The label of the centroid with the highest cosine, and that cosine (0 to 1). Ties go to the smaller label."""
        cosine = normalised(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        return [self.labels[k] for k in best], np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(float)


def _clustered(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means: begins with the mean's nearest row, then the rows farthest from all centroids so far."""
    centers = [x[(x @ x.mean(0)).argmax()]]
    while len(centers) < min(k, len(x)):
        centers.append(x[np.max(x @ np.array(centers).T, axis=1).argmin()])
    c = np.array(centers)
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def fitted(counts: np.ndarray, labels: list[str]) -> CentroidModel | None:
    """The model of labelled gram counts; None without any."""
    names = sorted(map(str, set(labels)))
    if not names:
        return None
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 1
    x, y = normalised(counts, idf), np.array(labels)
    parts = [_clustered(x[y == name], CENTROIDS) for name in names]
    return CentroidModel(idf, np.concatenate(parts).astype(np.float32), tuple(n for n, p in zip(names, parts, strict=True) for _ in p))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CentroidModel | None:
    """A model of the rows where train holds, lang isn't null and the text has a letter.

    A bounded sample of labelled rows: each language's rows are drawn by a hash of their id at a rate that leaves
    SAMPLE_PER_LANGUAGE of them (fewer if there are over SAMPLE / SAMPLE_PER_LANGUAGE languages, of which at most SAMPLE count). Grams are counted in the tasks."""
    small_batches(docs.sparkSession)
    rows = docs.filter(train & F.col(lang_col).isNotNull() & has_letter(F.col(text_col))).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("langid")).alias("draw"))
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE).collect()}
    if not total:
        return None
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE // len(total)))
    rates = rows.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in sorted(total.items())], "lang string, rate double")
    drawn = rows.join(F.broadcast(rates), "lang").filter(F.pmod("draw", F.lit(1 << 30)) < F.col("rate") * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = ragged(b.column(1))
            for a, e in slices(offsets, 1 << 21):
                made = gram_counts(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, e - a), pa.array([m.tobytes() for m in made], pa.binary())], ["lang", "counts"])

    got = sorted((r["lang"], bytes(r["counts"])) for r in drawn.mapInArrow(over_batches(count), "lang string, counts binary").collect())
    return fitted(np.array([np.frombuffer(c, np.float32) for _, c in got]).reshape(-1, BINS), [k for k, _ in got])


def identified(docs: DataFrame, model: CentroidModel | None, max_distance: float = MAX_DISTANCE, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (cosine to the nearest centroid) and rejected (farther than max_distance, or `und`) of each row.

    `und` with score 0: the text is null or has no letter, or there is no model. The whole text counts, however long. Null ids and
    repeated rows are kept; other columns are read only where `keep` names them, which must not name a column of the result; no rows give
    no rows."""
    distinct_names(keep, ("doc_id", "lang_pred", "score", "rejected"))
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = ragged(b.column(1))
            lettered = b.column(2).to_numpy(zero_copy_only=False)
            for a, e in slices(offsets, 1 << 21):
                names, score = [UNDETERMINED] * (e - a), np.zeros(e - a)
                if model is not None:
                    near, score = model.nearest(gram_counts(data[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a]))
                    names = [n if ok else UNDETERMINED for n, ok in zip(near, lettered[a:e], strict=True)]
                    score = np.where(lettered[a:e], score, 0.0)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, e - a) for c in (b.column(0), *b.columns[3:])), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", *keep, "lang_pred", "score"])

    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), has_letter(F.col(text_col)).alias("_lettered"), *(F.col(k) for k in keep))
    kinds = dict(body.dtypes)
    out = body.mapInArrow(over_batches(rows), ", ".join(f"`{k}` {kinds[k]}" for k in ("doc_id", *keep)) + ", lang_pred string, score double")
    return out.withColumn("rejected", (F.col("lang_pred") == UNDETERMINED) | (1 - F.col("score") > max_distance))
