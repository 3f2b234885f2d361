"""Tasks of the watch board's ranks hold about as many rows whatever the table."""

from pyspark.sql import functions as F

from matchlake import plans
from matchlake.operators import context
from matchlake.plans import boards

SF = "/root/testdata/sf0.001"


def test_days_of_the_board_are_dealt_to_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(context, "SORTED", 40)
    rows = boards.watched(spark, SF)
    found = boards.ranked(rows)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == rows.count() and found.rdd.getNumPartitions() == 1 + rows.count() // 40
    assert max(sizes) < rows.count() / 4


def test_ranks_are_checked_by_day(spark):
    rows = [r for r in plans.QUERIES["gate_watch_ranking"](spark, SF).collect() if r["check"] == "ranks"]
    damaged = {r[0] for r in boards.watched(spark, SF).filter("match_id % 29 = 0").select(F.col("date").cast("string")).distinct().collect()}
    assert {r["key"] for r in rows} == damaged
    assert len(rows) == len(damaged)
