"""The corpus pipeline: language identification, quality, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Between two stages the rows are written as
Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyplane.llm import decontaminate, jaccard, langid, packing, quality
from studyplane.llm.common import written
from studyplane.llm.queries import fold, table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Word shingles and similarity (per cent) of near duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a known language; those that are rejected (null, without a letter, far from all centroids) go."""
    out = langid.identified(docs, langid.fit(docs, fold(4) != 2), keep=COLUMNS[1:])
    return out.filter(~F.col("rejected")).select(*COLUMNS)


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as of label 1."""
    model, _ = quality.fitted(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    out = quality.featured(docs, keep=COLUMNS[1:], model=model)
    return out.filter(quality.predicted(F.col("score")) == 1).select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest doc_id, and every row that is in no group.

    Rows are told apart by a key of their own, since doc_ids may be null or repeat with other texts. Of rows with one doc_id in a group
    the one with the smallest hash stays; an id comes before null."""
    rows = written(docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("tie"), F.monotonically_increasing_id().alias("row")), "rows")
    groups = written(jaccard.joined(rows, SHINGLE_WORDS, SIMILARITY, "row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "groups")
    later = groups.filter("row <> group")
    members = later.unionByName(later.select(F.col("group").alias("row"), "group").distinct()).join(rows.select("row", "doc_id", "tie"), "row")
    members = written(members, "members")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "tie", "row")).alias("first")).select("first.row")
    gone = written(members.join(first, "row", "left_anti").select("row"), "gone")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def cleared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold benchmark windows in one word of twenty or more."""
    out = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS[1:])
    return out.filter(~decontaminate.contaminated(F.col("n_words"), F.col("n_hit"))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the documents, as pieces with their token ids."""
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("quality classifier", classified),
    ("n-gram Jaccard join", deduplicated),
    ("benchmark decontamination", cleared),
    ("packing", packed),
]

#: SQL can't express centroids, the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
