"""Ways to cut a corpus into blocks of bounded size, to send texts to Python once and to number rows without a single task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from matchlake.sources.files import staged

__all__ = ["BLOCK_BYTES", "beside", "block_count", "groups", "narrow_batches", "staged", "totals", "with_block"]

#: Bytes of text in a block that one task holds at once.
BLOCK_BYTES = 16 << 20
#: Rows of documents that cross to Python together, where the session has not been told of fewer.
BATCH_ROWS = 512
#: Bytes of any rows that cross to Python together, about: rows may be whole groups.
BATCH_BYTES = 8 << 20


def narrow_batches(spark: SparkSession) -> None:
    """Whole texts make wide rows, so a task keeps few of them in a batch on either side."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def block_count(docs: DataFrame, column: str = "text", most: int = BLOCK_BYTES) -> int:
    """Blocks needed so that a block holds about ``most`` bytes."""
    total = docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0]
    return max(1, -(-(total or 0) // most))


def with_block(docs: DataFrame, blocks: int, *keys: str) -> DataFrame:
    """Add ``block``; equal keys share a block."""
    narrow_batches(docs.sparkSession)
    return docs.withColumn("block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))


def beside(docs: DataFrame, compute: Callable[[pa.Array], np.ndarray], column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of docs as c0, c1, ... and ``value``, a number for each row from its text.

    A text crosses to Python once, and back only if it is kept; names of columns, their order and clashes don't matter.
    """
    narrow_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    inner = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], *([] if column in keep else [F.col(column).cast("string").alias("text")]))
    at = keep.index(column) if column in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(compute(batch.column(at)), pa.float64())], names=[*[f"c{i}" for i in range(len(keep))], "value"])

    schema = T.StructType([*inner.schema.fields[: len(keep)], T.StructField("value", T.DoubleType())])
    return inner.mapInArrow(run, schema)


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts rows by the keys (first key first), and where each group of equal keys starts."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


def totals(df: DataFrame, key: list[str], part: str, count: str, name: str) -> DataFrame:
    """For a table of counts by (key, part): the sum of the counts in the parts before, within the key."""
    before = W.partitionBy(*key).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(count).over(before), F.lit(0)).cast("long"))
