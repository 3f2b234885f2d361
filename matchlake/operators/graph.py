"""Connected components over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.sources.files import staged

#: Edges that one task contracts at once.
EDGES = 100_000


def stars(edges: DataFrame, blocks: int) -> DataFrame:
    """a, b: edges dealt to blocks, each as the stars of its own components: every vertex with the smallest that it reaches there."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def top(x):
            while (y := parent[x]) != x:
                parent[x] = x = parent[y]
            return x

        kinds = None
        for batch in batches:
            kinds = [c.type for c in batch.columns]
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(x) if x in parent else parent.setdefault(x, x), top(y) if y in parent else parent.setdefault(y, y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        if kinds:
            found = [(x, top(x)) for x in parent]
            found = [(x, y) for x, y in found if x != y]
            for i in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_pydict({k: pa.array([row[at] for row in found[i : i + 10_000]], kinds[at]) for at, k in enumerate("ab")})

    return edges.repartition(blocks).mapInArrow(contract, edges.schema)


def smallest_member(edges: DataFrame, a: str, b: str) -> DataFrame:
    """vertex, root: the smallest vertex of each component. Edges are contracted to stars in blocks of EDGES first; where that is
    several blocks, by alternating star steps over joins and grouped minima then."""
    x, y = F.col(a), F.col(b)
    now, before = staged(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a <> b")), None
    blocks = 1 + now.count() // EDGES
    now = staged(stars(now, blocks))
    if blocks == 1:
        return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        now = staged(large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        before = state
