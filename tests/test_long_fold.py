"""Folds over packed blocks, last states of walks, and how the log lands, against the plain ways."""

import os

from pyspark.sql import functions as F

from matchlake.operators import ratings as r
from matchlake.operators.order import blocks_of, long_fold, ordered_fold
from matchlake.plans import predictor, stream
from matchlake.plans.ratings import TUNED, TUNED_SERVE, elo, league, parted, serve
from matchlake.sources.adapters import ORDER, matches
from matchlake.sources.files import staged
from matchlake.streaming import walks

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_blocks_and_rows_give_the_same_walk(spark):
    m = staged(matches(spark, SF).withColumns({"w_home": F.lit(0), "l_home": F.lit(0)}))
    fold = r.rating_walk(*TUNED)
    found = long_fold(m, "tour", list(ORDER), fold, r.ELO)
    assert rows_of(found) == rows_of(ordered_fold(m, "tour", list(ORDER), fold, r.ELO))
    blocks = blocks_of(m.select("tour", *ORDER), "tour", list(ORDER))  # many tasks sort a tour, and one task opens its blocks
    assert blocks.groupBy("tour").agg(F.count("*").alias("n")).agg(F.min("n")).first()[0] > 12
    where = found.select("tour", F.spark_partition_id().alias("part")).distinct()
    assert where.count() == where.select("tour").distinct().count() == where.select("part").distinct().count()


def test_pairs_from_last_states_are_those_of_the_walks(spark):
    m = staged(matches(spark, SF))
    walk, rated = parted(staged(elo(spark, SF, TUNED, m, ends=True)))
    assert rows_of(walk) == rows_of(elo(spark, SF, TUNED, m))
    _, served = parted(staged(serve(spark, SF, TUNED_SERVE, m, ends=True)))
    targets = staged(predictor.pairs(spark, SF, m, rated).filter("i <= 4").withColumn("day", F.unix_date("date")))
    found = predictor.foretold(targets, rated, served, *league(m))
    old = elo(spark, SF, TUNED, m, targets=targets).join(serve(spark, SF, TUNED_SERVE, m, targets=targets).withColumnsRenamed({"w_points": "w_served", "l_points": "l_served"}), "match_id")
    assert rows_of(found) == rows_of(old.select(*found.columns)) and found.count()
    assert rows_of(predictor.contexts_before(targets, m, few=True)) == rows_of(predictor.contexts_before(targets, m))


def test_states_of_a_group_are_bound_and_unbound():
    states = {3: [1.0, float("nan"), 2.5], 7: [], 9: [4.0]}
    assert repr(walks.unbound(walks.bound(states))) == repr(states)


def test_a_period_lands_as_many_files(spark, monkeypatch):
    """A period is several files of several tasks, and the stream takes all of them in one batch."""
    rows = spark.range(4000).select("id", F.timestamp_seconds("id").alias("at"))
    monkeypatch.setattr(stream, "LANDED", 250)
    path, files = stream.arriving(rows, "at")
    path = path.removeprefix("file:")
    names = sorted((os.stat(f"{path}/{x}").st_mtime_ns, x) for x in os.listdir(path) if x.endswith(".parquet"))
    assert files == 5 and len(names) == files * stream.FILES
    first = [spark.read.parquet(*[f"{path}/{x}" for _, x in names[i : i + files]]).agg(F.min("id"), F.max("id")).first() for i in range(0, len(names), files)]
    assert all(a[1] < b[0] for a, b in zip(first, first[1:], strict=False))
