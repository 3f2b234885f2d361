"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Groups (equal texts) are dealt to parts by hash. Each part turns every group into a partial partition (its bytes in one
shard, the others empty) and repeatedly combines the two partial partitions of largest spread, oppositely ordered, until
one is left. The parts' results are partial partitions themselves and are combined the same way, level by level, so no
task holds more than PART groups or FAN partial partitions.

Edge cases: a null text counts as empty (0 bytes, group of the empty text); equal texts share a shard, even if one group
outweighs a fair share; repeated rows and null ids are placed once each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.llm.blocks import staged, totals

#: Groups that one task combines, and partial partitions that one task combines on the next level.
PART, FAN = 20_000, 512
#: Rows numbered by one task.
ROWS = 100_000
#: Groups with this share of all rows or more are joined by broadcast; there are at most 1/HOT of them.
HOT = 0.001


def difference(parts: np.ndarray) -> np.ndarray:
    """Combine partial partitions (rows of shard weights); returns the final shard of each row's each column."""
    n, k = parts.shape
    place = np.zeros((max(1, 2 * n - 1), k), np.int32)
    if n == 0:
        return place[:0]
    sums = {i: parts[i] for i in range(n)}
    heap = [(-int(parts[i].max() - parts[i].min()), i) for i in range(n)]
    heapq.heapify(heap)
    joined = []
    for new in range(n, 2 * n - 1):
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = sums.pop(a), sums.pop(b)
        down, up = np.argsort(-x, kind="stable"), np.argsort(y, kind="stable")
        sums[new] = both = x[down] + y[up]
        joined.append((new, a, down, b, up))
        heapq.heappush(heap, (-int(both.max() - both.min()), new))
    place[2 * n - 2] = np.arange(k)
    for new, a, down, b, up in reversed(joined):
        place[a, down] = place[new]
        place[b, up] = place[new]
    return place[:n]


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` to a table of distinct ``key`` and ``weight``."""

    def part(table: pa.Table) -> pa.Table:
        weights = table.column("weight").to_numpy()
        lone = np.zeros((len(weights), shards), np.int64)
        lone[:, 0] = weights
        return table.append_column("bin", pa.array(difference(lone)[:, 0], pa.int32()))

    def level(table: pa.Table) -> pa.Table:
        node, column, weight = (table.column(c).to_numpy() for c in ("node", "bin", "weight"))
        nodes, at = np.unique(node, return_inverse=True)
        partial = np.zeros((len(nodes), shards), np.int64)
        partial[at, column] = weight
        place = difference(partial)
        return table.append_column("to", pa.array(place[at, column], pa.int32()))

    groups = staged(groups)
    parts = max(1, -(-groups.count() // PART))
    dealt = groups.withColumn("node", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + ", bin int"
    found = staged(dealt.groupBy("node").applyInArrow(part, schema))
    nodes = parts
    while nodes > 1:
        sums = found.groupBy("node", "bin").agg(F.sum("weight").alias("weight")).withColumn("parent", F.expr(f"node div {FAN}").cast("int"))
        combined = sums.groupBy("parent").applyInArrow(level, "node int, bin int, weight bigint, parent int, to int")
        moved = found.join(combined.select("node", "bin", "parent", "to"), ["node", "bin"])
        found = staged(moved.select(*[c for c in found.columns if c not in ("node", "bin")], F.col("parent").alias("node"), F.col("to").alias("bin")))
        nodes = -(-nodes // FAN)
    return found.withColumnRenamed("bin", "shard").drop("node")


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row; bytes of the shards are near equal."""
    text = F.coalesce(F.col("text").cast("binary"), F.unhex(F.lit("")))
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key")))
    groups = assign_groups(rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("weight")), shards)
    count = groups.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") >= max(2.0, HOT * count)
    hot = F.broadcast(groups.filter(large).select("key", "shard"))
    placed = rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(groups.filter(~large).select("key", "shard"), "key"))
    blocks = max(1, -(-count // ROWS))
    placed = staged(placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int").alias("block")))
    before = totals(placed.groupBy("shard", "block").agg(F.count("*").alias("n")), ["shard"], "block", "n", "before").select("shard", "block", "before")
    numbered = placed.withColumn("rank", F.row_number().over(W.partitionBy("block", "shard").orderBy("doc_id")) - 1).join(before, ["block", "shard"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
