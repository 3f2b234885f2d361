"""The rating walk in batches against the walk over all matches at once."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.operators import ratings as r
from matchlake.plans import stream
from matchlake.plans.ratings import ALL_RULES, elo
from matchlake.sources.adapters import matches
from matchlake.sources.files import staged

SF = "/root/testdata/sf0.001"
NUMBERS = ["w_elo", "l_elo", "w_selo", "l_selo", "p_blend", "w_after", "l_after", "w_n", "l_n", "w_form", "l_form"]


@pytest.fixture(scope="module")
def recent(spark):
    return staged(matches(spark, SF).filter("tour < 2"))


def same(found, want):
    found, want = (x.toPandas().set_index("match_id").sort_index() for x in (found, want))
    assert list(found.index) == list(want.index) and len(want)
    for x in NUMBERS:
        assert np.allclose(found[x], want[x], atol=1e-9), x
    assert (found["counted"] == want["counted"]).all()


def test_packed_states_are_what_they_were():
    walk, again = r.RatingWalk(ALL_RULES), None
    rows = [(k, 0, 1 + k % 3, 4 + k % 2, None, 10 * k, "Clay" if k % 2 else "Hard", 1.0, 12, 7, k % 5 > 0, k % 7 == 0, 3, k % 2, 0) for k in range(60)]
    for k, row in enumerate(rows):
        if k == 30:
            kept = {p: s.packed() for p, s in walk.players.items()}
            again = r.RatingWalk(ALL_RULES, known=kept.get)
        out = walk.step(*row)
        if again:
            assert again.step(*row) == out


def test_daily_batches_after_history(spark, recent):
    """Batches of single days, each from the checkpoint that the last left, after a history whose states were saved."""
    days = [x.date for x in recent.select("date").distinct().orderBy(F.desc("date")).limit(4).collect()][::-1]
    before = recent.filter(F.col("date") < days[0])
    past = staged(elo(spark, SF, r.WTA, before, states=True).join(before.select("match_id", "event_id", "round_order"), "match_id"))
    found = stream.rated_in_batches(recent.filter(F.col("date") >= days[0]), r.WTA, [str(d) for d in days], past)
    same(found, elo(spark, SF, r.WTA, recent).filter(F.col("date") >= days[0]))


def test_batches_from_nothing_with_idle_players(spark, recent):
    """Long gaps between batches: timers shrink what is kept of idle players, and nothing changes."""
    rows = recent.filter("year in (1995, 1997, 2000)")
    found = stream.rated_in_batches(rows, r.ATP, ["1995-01-01", "1997-01-01", "2000-01-01"])
    same(found, elo(spark, SF, r.ATP, rows))
    assert isinstance(recent.first().date, datetime.date)
