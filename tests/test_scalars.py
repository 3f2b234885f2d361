"""Bisections against the chances that they invert, and windows that sort bounded partitions."""

import pytest
from pyspark.sql import functions as F

from matchlake.functions import scalars as s
from matchlake.operators import context as c


@pytest.mark.parametrize("best_of", [3, 5])
def test_set_chances_are_halved_by_batches(spark, best_of):
    p = (F.col("id") + 1) / 200.0
    rows = spark.range(199).select(p.alias("p"), s.set_from_match(p, best_of).alias("s"))
    assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert all(abs(r.p - r.back) < 1e-12 for r in rows.withColumn("back", s.match_from_set(F.col("s"), F.lit(best_of))).collect())


def test_players_are_dealt_by_the_rows_there_are(spark):
    rows = spark.range(100).select(F.col("id").alias("player"))
    least = spark.sparkContext.defaultParallelism
    assert c.by_player(rows, 100).rdd.getNumPartitions() == least
    assert c.by_player(rows, (least + 5) * c.SORTED).rdd.getNumPartitions() == least + 6
