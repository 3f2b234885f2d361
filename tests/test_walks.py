"""The serve walk, the point model and the features against plain restatements."""

import math
import random

import numpy as np
import pytest

from matchlake.operators import ratings as r
from matchlake.operators.order import ordered_fold
from matchlake.plans import features
from matchlake.plans.ratings import TUNED, serve
from matchlake.sources.adapters import matches

SF = "/root/testdata/sf0.001"


def restated(rows, s, average, base):
    """Skills from each player's whole list of earlier matches, without running state."""
    played, out, venues = {}, [], {}

    def total(player, day, surface):
        sums = [0.0] * 4
        for then, where, *four in played.get(player, []):
            if surface in (None, where):
                weight = 0.5 ** ((day - then) / s.half_life)
                sums = [a + weight * b for a, b in zip(sums, four, strict=True)]
        return sums

    def skill(player, day, surface):
        sw, sp, rw, rp = total(player, day, None)
        g, h = (sw + average * s.shrink) / (sp + s.shrink) - average, (rw + (1 - average) * s.shrink) / (rp + s.shrink) - 1 + average
        sw, sp, rw, rp = total(player, day, surface)
        b = base[surface]
        return g, h, (sw + (b + g) * s.surface_shrink) / (sp + s.surface_shrink) - b, (rw + (1 - b + h) * s.surface_shrink) / (rp + s.surface_shrink) - 1 + b

    for m in rows:
        w, l = skill(m.winner, m.day, m.surface), skill(m.loser, m.day, m.surface)
        esw, esp = venues.get((m.event, m.surface), (0.0, 0.0))
        shift = esw / (esp + s.venue_shrink)
        pa, pb = (min(max(base[m.surface] + shift + x, 0.05), 0.95) for x in (w[2] - l[3], l[2] - w[3]))
        out.append((m.match_id, w[2], l[2], w[3], l[3], total(m.winner, m.day, None)[1], pa, pb))
        if m.w_svpt:
            ws, ls, ww, lw = m.w_svpt, m.l_svpt, m.w_won, m.l_won
            played.setdefault(m.winner, []).append((m.day, m.surface, ww + ws * (l[1] - shift), ws, ls - lw + ls * (l[0] + shift), ls))
            played.setdefault(m.loser, []).append((m.day, m.surface, lw + ls * (w[1] - shift), ls, ws - ww + ws * (w[0] + shift), ws))
            expected = base[m.surface] * (ws + ls) + (w[2] - l[3]) * ws + (l[2] - w[3]) * ls
            venues[m.event, m.surface] = (esw + ww + lw - expected, esp + ws + ls)
    return out


def test_serve_walk(spark):
    m = matches(spark, SF).filter("tour = 3").cache()
    settings = r.Serve(half_life=200, shrink=150, surface_shrink=90, venue_shrink=500)
    rows = sorted(m.collect(), key=lambda x: (x.date, x.event_id, x.round_order, x.match_id))
    sums = {}
    for x in rows:
        if x.w_svpt:
            for key in (None, x.surface):
                won, n = sums.get(key, (0, 0))
                sums[key] = (won + x.w_won + x.l_won, n + x.w_svpt + x.l_svpt)
    average, base = sums[None][0] / sums[None][1], {k: a / b for k, (a, b) in sums.items() if k}
    found = {x.match_id: x for x in serve(spark, SF, settings, m).collect()}
    want = restated(rows, settings, average, base)
    assert len(found) == len(want) > 100
    for i, *values in want:
        x = found[i]
        assert np.allclose([x.w_serve, x.l_serve, x.w_return, x.l_return, x.w_points, x.pa, x.pb], values, atol=1e-9)
        one = r.point_match(np.array([x.pa]), np.array([x.pb]), np.array([x.best_of]))[0]
        assert math.isclose(x.p_point, one)


def simulated_set(serve_p, back, runs, rng):
    """Share of sets won by the side that serves first, point by point."""

    def game(p):
        a = b = 0
        while max(a, b) < 4 or abs(a - b) < 2:
            if rng.random() < p:
                a += 1
            else:
                b += 1
        return a > b

    won = 0
    for _ in range(runs):
        a = b = 0
        while True:
            if a == b == 6:
                x = y = n = 0
                while max(x, y) < 7 or abs(x - y) < 2:
                    own = (n + 1) // 2 % 2 == 0
                    if rng.random() < (serve_p if own else back):
                        x += 1
                    else:
                        y += 1
                    n += 1
                won += x > y
                break
            if game(serve_p if (a + b) % 2 == 0 else back):
                a += 1
            else:
                b += 1
            if max(a, b) >= 6 and abs(a - b) >= 2:
                won += a > b
                break
    return won / runs


@pytest.mark.parametrize(("p", "q"), [(0.62, 0.38), (0.7, 0.35), (0.55, 0.5)])
def test_set_chance_against_simulation(p, q):
    runs = 4000
    found = float(r.set_chance(np.array([p]), np.array([q]))[0])
    assert abs(simulated_set(p, q, runs, random.Random(1)) - found) < 4 * math.sqrt(0.25 / runs)


def test_set_chance_is_even_for_equals():
    p = np.linspace(0.4, 0.8, 9)
    assert np.allclose(r.point_match(p, p, np.full(9, 3)), 0.5) and np.allclose(r.point_match(p, p[::-1], np.full(9, 5)) + r.point_match(p[::-1], p, np.full(9, 5)), 1)


def test_fold_streams_keys_in_order(spark):
    def start():
        seen = []

        def step(key: str, at: int, value: float) -> tuple:
            seen.append(value)
            return key, at, sum(seen)

        return step

    rows = [(k, i, float(i)) for k in "abc" for i in range(50)]
    random.Random(2).shuffle(rows)
    found = ordered_fold(spark.createDataFrame(rows, "key string, at int, value double").repartition(5), "key", ["at"], start, "key string, at int, total double").collect()
    assert {(r.key, r.at): r.total for r in found} == {(k, i): i * (i + 1) / 2 for k, i, _ in rows}


def test_features(spark):
    """42 columns; swapping sides negates 31 and keeps 11; skills and ratings are those of the walks."""
    assert (len(features.SIGNED), len(features.EVEN)) == (31, 11) and len({*features.SIGNED, *features.EVEN}) == 42
    assert sorted(x for g in features.GROUPS.values() for x in g) == sorted([*features.SIGNED, "has_style"])
    rows = features.assembled(spark, SF).cache()
    assert rows.count() == matches(spark, SF).count()
    some = rows.filter("match_id % 2 = 1").limit(50).toPandas().set_index("match_id")
    turned = features.oriented(rows).toPandas().set_index("match_id").loc[some.index]
    for x in features.SIGNED:
        assert np.allclose(turned[x], -some[x]), x
    for x in features.EVEN:
        assert np.allclose(turned[x], some[x]), x
    assert (turned["label"] == 0).all()
    one = rows.orderBy("date", "match_id").toPandas()
    assert (one[["surf_hard", "surf_clay", "surf_grass"]].sum(axis=1) == 1).all() and one["log_min_srv_pts"].min() == 0
    for k, settings in enumerate(TUNED):
        own = one[one["tour"] % 2 == k]
        assert np.allclose(own["elo_diff"], (1 - settings.blend) * own["elo_overall_diff"] + settings.blend * own["elo_surface_diff"])
    assert np.allclose(1 / (1 + np.exp(-one["logit_p_blend"])), one["p_blend"], atol=1e-6)
    assert not one.drop(columns=["date"]).isna().any().any()
