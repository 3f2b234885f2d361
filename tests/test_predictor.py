"""Features of matches to come against those of training, and the evidence of pairs against single predictions."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlake.operators import training as t
from matchlake.plans import features as f
from matchlake.plans import predictor
from matchlake.sources.adapters import matches
from matchlake.sources.files import staged

SF = "/root/testdata/sf0.001"
COLUMNS = [*f.SIGNED, *f.EVEN]


@pytest.fixture(scope="module")
def played(spark):
    return staged(matches(spark, SF))


def test_features_of_played_matches_are_those_of_training(spark, played):
    want = f.assembled(spark, SF).toPandas().set_index("match_id").sort_index()
    found = predictor.features_as_of(spark, SF).toPandas().set_index("match_id").sort_index()
    assert list(found.index) == list(want.index) and len(want) > 1000
    for x in (*COLUMNS, "p_blend", "p_point"):
        assert np.allclose(found[x], want[x], atol=1e-9), x
        assert want[x].nunique() > 1 or x == "has_style", x


def test_features_of_a_match_to_come(spark, played):
    """Matches are appended, with results to come, and training's features of them are what prediction gave before."""
    latest = played.agg(F.max("date")).first()[0]
    i = F.row_number().over(W.orderBy("match_id")).cast("long")  # five rows; nobody plays twice
    some = played.filter("match_id % 29 = 5").orderBy("match_id").limit(5).withColumn("i", i)
    later = some.withColumns({"match_id": F.col("match_id") + 10**7, "date": F.date_add(F.lit(latest), 30), "event_id": F.lit("3-2001"), "winner": 2 * F.col("i") - 2, "loser": 2 * F.col("i") - 1, "surface": F.lit("Clay")}).drop("i")
    later = staged(later.withColumns({"day": F.datediff("date", F.lit("1970-01-01")), "tour": F.lit(1)}))
    columns = ("match_id", "tour", "winner", "loser", "surface", "best_of", "tier_k", "round_order", "event_id", "date")
    targets = later.select(*columns, f.indoor().alias("indoor"), f.qualified("winner").alias("w_qualified"), f.qualified("loser").alias("l_qualified"))
    found = predictor.unplayed(spark, SF, targets, played, "match_id").toPandas().set_index("match_id").sort_index()
    both = staged(played.unionByName(later))
    # what a match adds to league averages and charted points isn't known before it
    blank = both.withColumns({c: F.when(F.col("match_id") < 10**7, F.col(c)) for c in ("w_svpt", "l_svpt", "w_won", "l_won")})
    want = f.assembled(spark, SF, staged(blank)).filter(F.col("match_id") >= 10**7).toPandas().set_index("match_id").sort_index()
    assert len(found) == len(want) == 5
    for x in COLUMNS:
        assert np.allclose(found[x], want[x], atol=1e-9), x


def test_evidence_of_pairs(spark, played, monkeypatch):
    protocol = replace(predictor.QUICK, bags=1, trees=3)
    monkeypatch.setattr(predictor, "BOARD", 4)
    targets = staged(predictor.pairs(spark, SF, played))
    rows = staged(predictor.unplayed(spark, SF, targets, played, "match_id", "p_blend", "p_point"))
    predict = predictor.final_model(spark, SF, played, protocol)
    found = {r.match_id: r for r in predictor.grouped_evidence(rows, predict).collect()}
    per_tour = [r["count"] for r in targets.groupBy("tour").count().collect()]
    assert per_tour == [6] * 5 and len(found) == 30 == rows.count()
    plain = {r.match_id: r.p for r in predict(rows, "p").collect()}
    assert sorted(x for g in predictor.EVIDENCE.values() for x in g) == sorted({x for g in predictor.EVIDENCE.values() for x in g})
    for k, (group, columns) in enumerate(predictor.EVIDENCE.items()):
        without = {r.match_id: r.p for r in predict(rows.withColumns({x: F.lit(0.0) for x in columns}), "p").collect()}
        for i, r in found.items():
            assert np.isclose(r.p, plain[i]) and np.isclose(r.effects[k], plain[i] - without[i]), group
    assert any(abs(x) > 1e-6 for r in found.values() for x in r.effects)
    told = {r.match_id: r for r in rows.collect()}
    assert all(r.available == [True, True, True, True, False, told[i].log1p_h2h_total > 0, told[i].has_style > 0] for i, r in found.items())


def test_turned_pairs_negate(spark, played):
    """Side B's view of a pair has the signed features negated and the others alike."""
    targets = staged(predictor.pairs(spark, SF, played).filter("i <= 3 and j <= 5"))
    turned = targets.withColumnsRenamed({"winner": "x"}).withColumnsRenamed({"loser": "winner"}).withColumnsRenamed({"x": "loser"})
    one, other = (predictor.unplayed(spark, SF, x, played, "match_id").toPandas().set_index("match_id").sort_index() for x in (targets, turned))
    assert len(one) == len(other) > 20
    assert np.allclose(one[f.SIGNED], -other[f.SIGNED]) and np.allclose(one[f.EVEN], other[f.EVEN])


def test_ranked_evidence_of_played_matches(spark, played):
    """Points of each group are what single predictions give, largest first."""
    from matchlake.plans.training import evidence

    rows = staged(f.assembled(spark, SF, played).filter("draw_level = 'main' and completed"))
    predict = t.final_fit(rows, f.SIGNED, COLUMNS, replace(predictor.QUICK, bags=1, trees=3))[0]
    some = staged(rows.filter("match_id % 50 = 1"))
    found = {(r.match_id, r.group): (r.points, r["rank"]) for r in evidence(some, predict).collect()}
    plain = {r.match_id: r.p for r in predict(some, "p").collect()}
    assert len(found) == len(f.GROUPS) * len(plain) > 50
    for group, columns in f.GROUPS.items():
        for r in predict(some.withColumns({x: F.lit(0.0) for x in columns}), "p").collect():
            assert abs(found[r.match_id, group][0] - 100 * (plain[r.match_id] - r.p)) < 1e-3
    for i in plain:
        sizes = [abs(x) for x, _ in sorted((v for k, v in found.items() if k[0] == i), key=lambda v: v[1])]
        assert sizes == sorted(sizes, reverse=True)


def test_packed_matrices(spark):
    """Rows of the upper triangle one after the other, for every group and tour."""
    names = list(predictor.EVIDENCE)
    rows = [(t, i, j, 0.5 + i / 100 - j / 90, [(k + 1) * (i - j) / 50 for k in range(len(names))], [(i + j + k) % 2 == 0 for k in range(len(names))]) for t in (1, 2) for i in range(1, 6) for j in range(i + 1, 6 + t)]
    df = spark.createDataFrame(rows, "tour int, i int, j int, p double, effects array<double>, available array<boolean>").repartition(3)
    found = {(r.tour, r.group): r for r in predictor.packed(df).collect()}
    assert len(found) == 2 * (len(names) + 1)
    for tour in (1, 2):
        own = sorted(r for r in rows if r[0] == tour)
        assert found[tour, "combiner"].effects == [round(r[3], 6) for r in own] and found[tour, "combiner"].players == 5 + tour
        for k, name in enumerate(names):
            assert found[tour, name].effects == [round(r[4][k], 6) for r in own] and found[tour, name].available == [int(r[5][k]) for r in own]


def test_no_state_leaves_a_walk(spark, played):
    """Features of matches to come shuffle no packed states and no target more than once for its contexts."""
    targets = staged(predictor.pairs(spark, SF, played).filter("i <= 3"))
    plan = predictor.unplayed(spark, SF, targets, played, "match_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "_state" not in plan and "_row" not in plan
    context = predictor.contexts_before(targets, played)
    physical = context._jdf.queryExecution().sparkPlan().toString()
    prepared = context._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Window") >= 4 and prepared.count("Exchange hashpartitioning(player") == 1 and "hashpartitioning(opponent" not in prepared
