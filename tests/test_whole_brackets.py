"""Brackets, reach and matrices of whole fields against plain recursion."""

from collections import defaultdict

import duckdb
import pytest

from matchlake import plans
from matchlake.operators.bracket import seed_order

SF = "/root/testdata/sf0.01"


def beats(x, y):
    return 1 / (1 + 10 ** (-(x - y) / 4000))


@pytest.fixture(scope="module")
def fields():
    out = defaultdict(list)
    for event, player, rating in duckdb.sql(f"SELECT s_nationkey, s_suppkey, CAST(s_acctbal AS DOUBLE) FROM '{SF}/supplier.parquet' ORDER BY s_acctbal DESC, s_suppkey").fetchall():
        out[event].append((player, rating))
    return out


def draw(field):
    rounds = max(1, (len(field) - 1).bit_length())
    return [field[s - 1] if s <= len(field) else None for s in seed_order(rounds)]


def meet(slots, lock=None):
    """Law of the winner of each round's matches; lock is (round, block, winner as in slots)."""
    now, r = [{x: 1.0} if x else {} for x in slots], 0
    while len(now) > 1:
        r += 1
        after = []
        for i in range(0, len(now), 2):
            x, y, out = now[i], now[i + 1], defaultdict(float)
            for a, p in x.items():
                for b, q in y.items():
                    w = (1.0 if a == lock[2] else 0.0) if lock and lock[:2] == (r, i // 2) else beats(a[1], b[1])
                    out[a] += p * q * w
                    out[b] += p * q * (1 - w)
            after.append(dict(out) if x and y else x or y)
        now = after
        yield now


def test_every_player_has_a_place_and_a_reach(spark, fields):
    assert max(map(len, fields.values())) > 8
    placed = {(r["event"], r["slot"]): r["player"] for r in plans.QUERIES["standard_draw_all"](spark, SF).collect()}
    assert placed == {(e, i): x and x[0] for e, f in fields.items() for i, x in enumerate(draw(f))}
    want = {(e, p[0], r): v for e, f in fields.items() for r, now in enumerate(meet(draw(f)), 1) for law in now for p, v in law.items()}
    found = {(r["event"], r["player"], r["round"]): r["reach"] for r in plans.QUERIES["exact_reach_all"](spark, SF).collect()}
    assert found.keys() == want.keys()
    assert all(abs(found[k] - v) < 2e-6 for k, v in want.items())


def test_simulation_and_gate_cover_every_player(spark, fields):
    found = plans.QUERIES["monte_carlo_reach"](spark, SF).collect()
    last = {e: max(1, (len(f) - 1).bit_length()) for e, f in fields.items()}
    title = defaultdict(float)
    for r in found:
        assert r["round"] <= last[r["event"]]
        title[r["event"]] += r["reach"] * (r["round"] == last[r["event"]])
    assert all(abs(x - 1) < 1e-9 for x in title.values()) and title.keys() == fields.keys()
    assert plans.QUERIES["gate_projection"](spark, SF).count() == 0


def test_matrix_holds_every_pair(spark, fields):
    pairs = {(r["event"], r["i"], r["j"]): r["p"] for r in plans.QUERIES["pair_matrix_all"](spark, SF).collect()}
    assert pairs.keys() == {(e, a[0], b[0]) for e, f in fields.items() for a in f for b in f if a != b}
    packed = plans.QUERIES["packed_triangle_all"](spark, SF).collect()
    assert {(r["event"], r["place"]) for r in packed} == {(e, i) for e, f in fields.items() for i in range(len(f) * (len(f) - 1) // 2)}
    assert plans.QUERIES["matrix_contract_violations_all"](spark, SF).count() == sum(len(f) > 1 for f in fields.values())


def test_every_lockable_match_has_its_leverage(spark, fields):
    want = {}
    for e, f in fields.items():
        slots = draw(f)
        pairs = [(slots[i], slots[i + 1]) for i in range(0, len(slots), 2)]
        matches = [(1, i, a, b) for i, (a, b) in enumerate(pairs) if a and b]
        through = [(a or b) if not (a and b) else None for a, b in pairs]
        matches += [(2, i // 2, through[i], through[i + 1]) for i in range(0, len(through) - 1, 2) if through[i] and through[i + 1]]
        for r, block, a, b in matches:
            laws = [list(meet(slots, (r, block, x)))[-1][0] for x in (a, b)]
            want[e, r, block, a[0], b[0]] = 0.5 * sum(abs(laws[0].get(x, 0) - laws[1].get(x, 0)) for x in f)
    found = {(r["event"], r["round"], r["block"], r["a"], r["b"]): r["leverage"] for r in plans.QUERIES["title_leverage_all"](spark, SF).collect()}
    assert found.keys() == want.keys() and {k[1] for k in want} == {1, 2}
    assert all(abs(found[k] - v) < 2e-6 for k, v in want.items())


def test_fold_fills_the_final(spark):
    from matchlake.plans import sim

    rows = spark.createDataFrame([("e", 2, i, p) for i, p in enumerate([1, None, 3, 4])] + [("f", 1, 0, 5), ("f", 1, 1, 6)], "event string, rounds int, slot int, player bigint")
    m = spark.createDataFrame([(9, 1, 3, 4), (8, 2, 3, 1), (7, 3, 6, 5)], "date int, match_id int, winner bigint, loser bigint")
    found = {tuple(r) for r in sim.folded(rows, 2, m).collect()}
    assert found == {("e", 1, 0, 1, None, 1), ("e", 1, 1, 3, 4, 3), ("e", 2, 0, 1, 3, 3), ("f", 1, 0, 5, 6, 6)}
    last = plans.QUERIES["bracket_fold_all"](spark, SF).groupBy("event").agg({"round": "max"}).collect()
    assert max(r[1] for r in last) > 3


def test_draw_is_expanded_to_the_first_round(spark):
    from matchlake.plans import sim

    games = [(7, 1, 2), (6, 1, 3), (6, 2, 4), (5, 1, 5), (5, 4, 6), (3, 5, 7), (3, 3, 8)]
    m = spark.createDataFrame([("e", 1, i, r, w, x) for i, (r, w, x) in enumerate(games)], "event_id string, date int, match_id int, round_order int, winner bigint, loser bigint")
    found = [r["player"] for r in sim.expanded(m).orderBy("slot").collect()]
    assert found == [1, 5, 7, 3, 2, 4, 6]
