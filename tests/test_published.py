"""The final model is fitted with the published settings, and stopped by patience."""

import numpy as np
import pytest

from matchlake.operators import training as t
from matchlake.plans import predictor, training

SF = "/root/testdata/sf0.001"


def asked(monkeypatch, query):
    """The protocol that a query fits its final model with."""
    class Seen(Exception):
        pass

    def fit(rows, signed, columns, protocol, seed=0):
        raise Seen(protocol)

    monkeypatch.setattr(t, "final_fit", fit)
    with pytest.raises(Seen) as found:
        query()
    return found.value.args[0]


def test_bagged_trees_are_the_published_ones(spark, monkeypatch):
    assert asked(monkeypatch, lambda: training.bagged_trees(spark, SF)) == t.Protocol() and (t.Protocol().bags, t.Protocol().trees, t.Protocol().patience) == (5, 600, 40)


def test_evidence_of_pairs_has_the_published_model(spark, monkeypatch):
    assert asked(monkeypatch, lambda: predictor.evidence_matrices(spark, SF)) == t.Protocol()


def test_patience():
    assert t.patient([3.0, 2.0, 2.5, 1.0, 1.0, 1.0, 0.5], 2) == (4, True)
    assert t.patient([3.0, 2.0, 2.5, 1.0, 1.0, 0.5], 3) == (6, False) and t.patient([1.0], 40) == (1, False)


def test_trees_that_better_the_loss_by_little_are_kept(spark):
    """At a small rate every tree betters the loss by less than a hundredth; Spark's own stop would keep a few of them."""
    pick = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(pick.normal(0.4, 1, (500, 2)))]
    df = t.oriented(spark.createDataFrame(rows, "match_id bigint, x double, z double").coalesce(2), ["x", "z"], 3).cache()
    core, held = df.filter("match_id % 3 > 0"), df.filter("match_id % 3 = 0")
    protocol = t.Protocol(trees=30, patience=6, depth=2)
    found = t.boosted(core, held, ["x", "z"], protocol, 1)
    whole = t.boosted(core, held, ["x", "z"], t.Protocol(trees=30, patience=30, depth=2), 1)
    losses = whole.evaluateEachIteration(t._vector(held, ["x", "z"]))
    short = t.boosted(core, held, ["x", "z"], t.Protocol(trees=30, patience=None, depth=2), 1)
    assert found.getNumTrees == t.patient(losses + [9.0] * 30, 6)[0] > short.getNumTrees
    again = found.evaluateEachIteration(t._vector(held, ["x", "z"]))
    assert np.allclose(again, losses[: len(again)], atol=1e-12)


def test_tables_are_staged_at_once(spark):
    """In the order asked for, and while another is still being made."""
    import threading

    from matchlake.sources.files import staged_at_once

    both = threading.Barrier(2, timeout=60)
    found = staged_at_once(*[lambda n=n: (both.wait(), spark.range(n))[1] for n in (3, 5)])
    assert [x.count() for x in found] == [3, 5]
