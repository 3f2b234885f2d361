"""Simulation with the registered number of runs against the exact reach."""

from matchlake import plans

SF = "/root/testdata/sf0.01"


def test_number_of_runs(spark):
    runs = 20_000
    found = plans.QUERIES["monte_carlo_reach"](spark, SF).collect()
    exact = {(r["event"], r["player"], r["round"]): r["reach"] for r in plans.QUERIES["exact_reach_all"](spark, SF).collect()}
    wins = {(r["event"], r["player"], r["round"]): r["reach"] for r in found}
    assert wins.keys() <= exact.keys()
    assert all(abs(wins.get(k, 0.0) - p) <= 4 * 0.5 / runs**0.5 for k, p in exact.items())
