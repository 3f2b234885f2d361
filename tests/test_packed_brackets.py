"""Rounds played by stretches and by tiles of packed ratings against the plain joins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.operators import bracket as b
from matchlake.plans.sim import chance, price
from tests.test_settled import BRACKETS, SCHEMA, enumerated


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(e, len(x).bit_length() - 1, i, p and p[0], p and p[1]) for e, (x, _) in BRACKETS.items() for i, p in enumerate(x)]
    settled = [(e, *m) for e, (_, x) in BRACKETS.items() for m in x]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(settled, "event int, round int, block int, winner bigint")


@pytest.mark.parametrize(("depth", "stretch"), [(12, 4096), (2, 1), (1, 2)])
def test_packed_rounds_are_exact(spark, tables, monkeypatch, depth, stretch):
    """Every round of every bracket, with and without played matches, whatever is played in a stretch or in tiles."""
    monkeypatch.setattr(b, "DEPTH", depth)
    monkeypatch.setattr(b, "STRETCH", stretch)
    rows, settled = tables
    for held in (None, settled):
        found = {(r.event, r["round"], r.player): r.reach for r in b.propagate(rows, "event", 3, chance(), settled=held, price=price).filter("player is not null and reach > 0").collect()}
        want = {(e, r, p): v for e, (x, s) in BRACKETS.items() for r, law in enumerate(enumerated(x, [] if held is None else s), 1) for p, v in law.items() if v > 0}
        assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-12 for k, v in want.items())


def test_a_final_is_the_work_of_many_tasks(spark, monkeypatch):
    """Stretches of a half meet one by one, and the few bytes of a field are dealt to many tasks."""
    monkeypatch.setattr(b, "DEPTH", 3)
    monkeypatch.setattr(b, "STRETCH", 8)
    pick = np.random.default_rng(3).permutation(128)
    field = spark.createDataFrame([(1, i, float(80 * x)) for i, x in enumerate(pick.tolist())], "event int, player bigint, rating double")
    slots, rounds = b.seeded_whole(field, "event", "rating")
    plain, packed = ({(r.slot, r["round"]): r.reach for r in b.propagate(slots, "event", rounds, chance(), **more).collect()} for more in ({}, {"price": price}))
    assert plain.keys() == packed.keys() and len(plain) == 7 * 128 and all(abs(packed[k] - v) < 1e-12 for k, v in plain.items())
    assert b.opened(slots, "event", price).select(F.spark_partition_id().alias("p"), "slot").filter("slot is not null").distinct().select("p").distinct().count() > 4


def test_prices_of_far_ratings():
    x, y = np.array([[0.0], [3e6], [np.nan]]), np.array([[1000.0, 2e6, -3e6]])
    with np.errstate(all="ignore"):
        want = 1 / (1 + 10 ** (-(x - y) / 4000))
        assert np.allclose(price(x, y), want, equal_nan=True)
        assert np.allclose(price(x[:1], y[:, :1]), want[:1, :1], atol=1e-15)


def test_forced_outcomes_follow_their_paths():
    """Title laws under each outcome are those of whole brackets, and prices are asked for no oftener for many outcomes than for one."""
    import pandas as pd

    pick, asked = np.random.default_rng(4), []
    player = [float(i) if i % 7 else np.nan for i in range(32)]
    slots = pd.DataFrame({"slot": range(32), "player": player, "rating": [np.nan if x != x else float(v) for x, v in zip(player, pick.integers(0, 9000, 32), strict=True)]})
    settled = {(1, 1): 2.0, (2, 1): 4.0, (3, 1): 9.0, (1, 5): 10.0}
    forced = [(1, k, float(x)) for k, x in ((1, 3), (2, 5), (4, 8), (4, 9), (6, 13), (15, 31))] + [(2, 5, 23.0), (4, 0, 3.0), (1, 0, 0.0), (5, 0, 2.0)]

    def counted(x, y):
        asked.append(np.broadcast(x, y).size)
        return price(x, y)

    found = b.titles(slots, counted, settled, forced)
    for row, (r, k, w) in zip(found, forced, strict=True):
        law = np.zeros(32)
        for i, p in b.tabled(slots, price, settled | {(r, k): w})[-1].items():
            law[i] = p
        assert np.allclose(row, law, atol=1e-12), (r, k, w)
    laws = b.unforced(slots, price, settled)
    work = []
    for many in ([(1, 4, 8.0)], [(1, 4, 8.0), (1, 4, 9.0)] * 20):
        asked.clear()
        b.titles(slots, counted, settled, many, laws)
        work.append(sum(asked))
    assert 0 < work[1] <= 2 * work[0] < 2 * 32 * 32
