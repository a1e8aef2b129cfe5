"""Search over a uniform index of (id, kind, title, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_score, searchable, snippet

#: Characters of a body that the index keeps (a fixed value of the feature).
INDEXED = 8000


def index_rows(rows: DataFrame, kind: str, id_col: str, title: str, body: str) -> DataFrame:
    """One entity's rows in the shape of the index; sources are joined by unionByName."""
    return rows.select(F.concat(F.lit(f"{kind}:"), F.col(id_col).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(title).cast("string").alias("title"), F.left(F.coalesce(F.col(body), F.lit("")), F.lit(INDEXED)).alias("body"))


def search(index: DataFrame, query: str, limit: int = 40) -> DataFrame:
    """The best hits: id, kind, score and snippet; ties by title and id. A top-k, which tasks cut before they send."""
    hay = searchable(F.col("title"), F.col("body"), F.col("kind"))
    hits = index.withColumn("score", search_score(query, hay)).filter("score > 0")
    return hits.orderBy(F.desc("score"), "title", "id").limit(limit).select("id", "kind", "score", snippet(F.col("body"), query).alias("snippet"))


def entries(rows: DataFrame, mark: str, key: str, kind: Column, title: Column, body: Column) -> DataFrame:
    """Rows of one kind of thing in the shape of the index: id, kind, title and the first INDEXED characters of body, as the index keeps them."""
    return rows.select(F.concat_ws(":", F.lit("si"), F.lit(mark), F.col(key).cast("string")).alias("id"), kind.alias("kind"), title.cast("string").alias("title"), F.left(F.coalesce(body, F.lit("")), F.lit(INDEXED)).alias("body"))


def together(first: DataFrame, *more: DataFrame) -> DataFrame:
    """One index of several kinds."""
    for rows in more:
        first = first.unionByName(rows)
    return first
