"""The registered queries of the operators: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, html_main, jaccard, langid, lexical, lines, lm, packing, quality, sharding, sql, tokens, topk


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file: part of the installed tokenizer files, else below /opt/tokenizers."""
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return str(public_tokenizers.path(name))
    return f"/opt/tokenizers/{name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def held_out(folds: int, remainder: int) -> Column:
    """Whether a row is of the fold that nothing is learned from; a null id is of none."""
    return F.coalesce(fold(folds) == remainder, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5) != 0)
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", quality.predicted(F.col("score")).alias("predicted"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).withColumn("rank", F.col("rank").cast("int"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"), n=4, least=85)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_fold = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    out = lm.scored(table(spark, sf_dir, "documents"), text_fold % 5 != 1, F.floor(text_fold / 5) % 16 == 0)
    return out.select("doc_id", held_out(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")).drop("ids")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), sharding.regular_tree(2, 2, 4))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_main.extracted(pages, html_main.fit(pages))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identified(docs, langid.fit(docs, fold(4) != 2))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_top_k, op3_ngram_join, op4_token_counts, op5_decontaminate, op6_lm, op7_packing, op8_sharding, op9_main_text, op10_language, op11_line_dedup, op12_ranked_search, op13_collocations)}


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": sql.TOP_K, "op3_ngram_join": sql.NGRAM_JOIN, "op5_decontaminate": sql.DECONTAMINATION, "op11_line_dedup": sql.LINE_DEDUP, "op12_ranked_search": sql.RANKED_SEARCH, "op13_collocations": sql.COLLOCATIONS}
