"""Files as sources and sinks: tables with provenance, typed JSON lines, partitioned and sharded products."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the checkpoint folder that driver and executors share; a local one only where none is configured. What
    is written there lives as long as the folder: the cluster clears it as it clears checkpoints."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: what follows starts from files, not from lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_at_once(*makes: Callable[[], DataFrame]) -> list[DataFrame]:
    """Tables that don't need each other, made and staged at once: one with few long tasks leaves cores to the others."""
    spark = SparkSession.getActiveSession()
    scratch(spark)  # the folder is set once, not by each
    with ThreadPool(len(makes)) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda make: staged(make())), makes)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of CSV files with a header, with the name of the file that each row came from; extra columns are ignored
    and missing ones null."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(path).withColumn("file", F.col("_metadata.file_name"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known shape; a line that doesn't parse is kept as text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def finite(df: DataFrame) -> DataFrame:
    """Doubles that are no finite numbers become null, as JSON has no form for them."""
    return df.withColumns({c: F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def write_json(df: DataFrame, path: str) -> None:
    finite(df).write.mode("overwrite").json(path)


def write_shards(df: DataFrame, path: str, *keys: str) -> None:
    """One folder for each key; shards that are no longer written go."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
