"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import bpe, fill_in_middle, fingerprints, jaccard_join, lm_scoring, media, minhash, packing, quality, resampling, sharding, substring_dedup, toxicity
from matchlake.llm.blocks import narrow_batches
from matchlake.llm.oracles import ORACLE_SQL


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def remainder(of: int) -> Column:
    """crc32 of the id's decimal form, modulo ``of``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(documents(spark, sf_dir), held_out=F.coalesce(remainder(7) == 2, F.lit(False)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of rows whose crc32 modulo 3 is 1 are not learned from."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    scored = quality.score(docs, labels(spark, sf_dir), learn=remainder(3) != 1, carry=["doc_id", "source", "lang"])
    return scored.select("doc_id", (F.coalesce(remainder(3) == 1, F.lit(False))).alias("held_out"), "source", "lang", "evidence", "quality_score", "quality_kept")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle=2, percent=80)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=24)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2, ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.coding_digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir), learn=remainder(3) != 1, carry=["doc_id"])
    return scored.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.form_digests(documents(spark, sf_dir))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir), size=4, percent=85)


__all__ = ["ORACLE_SQL", "QUERIES", "documents", "labels", "remainder"]
QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_lm_scoring, op3_substring_dedup, op4_quality, op5_minhash, op6_sharding, op7_media, op8_packing, op9_bpe, op10_toxicity, op11_resampling, op12_fill_in_middle, op13_jaccard)}
