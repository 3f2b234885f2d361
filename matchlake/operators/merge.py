"""Merging rows of several sources: deduplication, repair and backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the given order."""
    return df.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_place = 1").drop("_place")


def fill_if_unique(df: DataFrame, column: str, keys: list[str], to: str) -> DataFrame:
    """Where a column is null, the one value that the rows of the same key have; null if there are several or none."""
    known = F.collect_set(column).over(W.partitionBy(*keys))
    return df.withColumn("_known", known).withColumn(to, F.coalesce(F.col(column), F.when(F.size("_known") == 1, F.col("_known")[0]))).drop("_known")


def mode_by(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The commonest value of a column for each key; the smallest of equally common ones."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_m")).select(*keys, F.col("_m.v").alias(column))


def upsert(old: DataFrame, new: DataFrame, key: str, frozen: list[str], fresh: list[str], settled: str) -> DataFrame:
    """Full outer merge by key. Frozen columns keep an old value that is not null; fresh ones take the new value, unless
    the old row is settled."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    kept = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in frozen]
    updated = [F.when(F.coalesce(F.col(f"o.{settled}"), F.lit(False)), F.col(f"o.{c}")).otherwise(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).alias(c) for c in fresh]
    done = (F.coalesce(F.col(f"o.{settled}"), F.lit(False)) | F.coalesce(F.col(f"n.{settled}"), F.lit(False))).alias(settled)
    return joined.select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), *kept, *updated, done)
