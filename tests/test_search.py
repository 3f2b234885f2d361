"""Many settings in one walk against single walks, and the halving of arms."""

import numpy as np
import pytest

from matchlake.operators import ratings as r
from matchlake.operators import training as t
from matchlake.plans import training
from matchlake.plans.metrics import log_loss
from matchlake.plans.ratings import ALL_RULES, elo
from matchlake.sources.adapters import matches
from matchlake.sources.files import staged
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_each_arm_is_its_own_walk():
    """Row by row, with and without every rule of the walk."""
    settings = [r.Rating(), ALL_RULES, r.ATP, r.WTA, r.Rating(k=40, shape=0.6, skip_walkovers=True)]
    pick = np.random.default_rng(3)
    many, single = r.Arms(settings), [r.RatingWalk(s) for s in settings]
    for i in range(400):
        a, b = pick.choice(9, 2, replace=False).tolist()
        walkover, completed = bool(pick.random() < 0.1), bool(pick.random() < 0.8)
        row = {"tier_k": 1.1, "w_games": int(pick.integers(6, 14)), "l_games": int(pick.integers(0, 12)), "completed": completed and not walkover, "walkover": walkover, "best_of": int(pick.choice([3, 5])), "w_home": int(pick.integers(2)), "l_home": int(pick.integers(2))}
        day, surface = i * 9, str(pick.choice(r.SURFACES))
        found = many.step(i, 0, a, b, day, surface, **row)[2]
        want = [w.step(i, 0, a, b, None, day, surface, **row)[10] for w in single]
        assert np.allclose(found, want, atol=1e-12), i


def test_losses_of_arms(spark):
    m = staged(matches(spark, SF))
    settings = [r.Rating(), r.Rating(k=60, transfer=0.3)]
    found = training.arm_losses(m, settings, 1997)
    judged = m.filter("draw_level = 'main' and completed").select("match_id", "year")
    for s, (tune, later) in zip(settings, found, strict=True):
        walk = elo(spark, SF, s, m).join(judged, "match_id")
        loss = [walk.filter(c).agg(F.avg(log_loss(F.col("p_blend")))).first()[0] for c in ("year <= 1997", "year > 1997")]
        assert np.allclose([tune, later], loss, atol=1e-9)


@pytest.mark.parametrize("arms", [1, 5, 64])
def test_halving(arms):
    calls = []

    def evaluate(left, share):
        calls.append((list(left), share))
        return [abs(i - 3) + 1 for i in left]

    reached, loss = t.halving(evaluate, arms, 3, 0.25)
    assert len(calls) == 3 and calls[0][0] == list(range(arms)) and all(0 in x for x, _ in calls)
    assert [len(x) for x, _ in calls] == sorted((len(x) for x, _ in calls), reverse=True)
    best = min(3, arms - 1)
    assert reached[best] == 3 == reached[0] and not any(np.isnan(loss))


def test_search(spark):
    rows = training.rating_search(spark, SF).collect()
    assert len(rows) == training.ARMS and {x["pass"] for x in rows} == {1, 2, 3}
    assert rows[0]["pass"] == 3 and all(0.3 < x.tune < 2 for x in rows) and all((x.later is not None) == (x["pass"] == 3) for x in rows)
    best = min((x for x in rows if x["pass"] == 3), key=lambda x: x.tune)
    assert best.tune <= rows[0].tune


def test_batches_are_walked_at_once():
    """A batch in which players meet again gives what single matches give, in about as many array steps as its longest chain."""
    settings, pick = [r.Rating(), ALL_RULES, r.Rating(k=40, skip_walkovers=True)], np.random.default_rng(5)
    many, single, steps = r.Arms(settings), r.Arms(settings), []
    together = many._together
    many._together = lambda *x, **k: steps.append(1) or together(*x, **k)
    rows = []
    for i in range(600):
        a, b = pick.choice(200, 2, replace=False).tolist()
        walkover = bool(pick.random() < 0.1)
        rows.append((a, b, i // 3, str(pick.choice(r.SURFACES)), 1.1, int(pick.integers(6, 14)), int(pick.integers(0, 12)), not walkover and bool(pick.random() < 0.9), walkover, int(pick.choice([3, 5])), 0, 1))
    found = np.concatenate([many.chances(*zip(*part, strict=True)) for part in (rows[:350], rows[350:])])
    assert np.allclose(found, [single.step(0, 0, *x)[2] for x in rows], atol=1e-12)
    assert len(steps) < 200
