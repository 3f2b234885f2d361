"""Corpus preparation: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns the columns of
documents; the last returns the packed pieces. Labels are read only to fit the two classifiers.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import minhash, packing, quality, substring_dedup, toxicity
from matchlake.llm.blocks import staged
from matchlake.llm.queries import labels, remainder


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return quality.accepted(docs, labels(spark, sf_dir), learn=remainder(3) != 1)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that are predicted toxic."""
    return toxicity.accepted(docs, labels(spark, sf_dir), learn=remainder(3) != 1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose sets of five-word shingles are similar by 0.8 or more."""
    return minhash.keep_one(docs, shingle=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut words of passages that occur elsewhere too; n_chars follows the text."""
    cut = substring_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of all documents into sequences of 1024."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end=2, ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality", reject_low_quality),
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("packing", pack_sequences),
]

#: Fitted models and tokenisation are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
    return docs
