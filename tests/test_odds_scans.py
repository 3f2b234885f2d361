"""The odds file sums up the lines of orders once, and keys are made of the wanted years' rows only."""

from matchlake.plans import sources
from matchlake.sources import tables

SF = "/root/testdata/sf0.001"


def test_lines_are_read_once(spark, monkeypatch):
    seen = []
    read = tables.read_odds
    monkeypatch.setattr(tables, "read_odds", lambda spark, path, years=None: seen.append(years) or read(spark, path, years))
    from matchlake.sources import adapters

    calls, made = [], adapters.pairings
    monkeypatch.setattr(adapters, "pairings", lambda *x: calls.append(x) or made(*x))
    assert sources.odds_file(spark, SF).count() and len(calls) == 1 and seen == [[1994, 1997]]
