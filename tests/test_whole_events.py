"""Identity of events and gates over whole tables."""

import datetime

from matchlake import plans
from matchlake.plans import events, gate
from matchlake.sources.adapters import matches

SF = "/root/testdata/sf0.01"


def test_components_cover_every_event(spark):
    every = {r[0] for r in matches(spark, SF).select("event_id").distinct().collect()}
    found = plans.QUERIES["event_coverage_components_all"](spark, SF).collect()
    assert {r["event_id"] for r in found} == every
    assert len({e[-4:] for e in every}) == 7
    assert sum(r["events"] for r in plans.QUERIES["event_coalesce_all"](spark, SF).collect()) == len(every)


def test_components_link_other_seasons_and_draws(spark):
    day = datetime.date(1999, 5, 1)
    rows = [("a", day, 1, 2, "main", 1999), ("b", day, 2, 1, "chall", 1999), ("c", day, 3, 4, "main", 1999), ("d", datetime.date(1998, 5, 1), 1, 2, "main", 1998)]
    m = spark.createDataFrame(rows, "event_id string, date date, winner bigint, loser bigint, draw_level string, year int")
    assert {tuple(r) for r in events.components(m).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}


def test_near_misses_of_every_name(spark):
    t = [(r["k"], set(r["w"])) for r in events.spellings(spark.read.parquet("/root/testdata/sf0.001/part.parquet")).collect()]
    t += [(100000, {"red"}), (100001, {"red", "tin"}), (100002, {"tin", "red"}), (100003, {"red", "tin", "cup"})]
    want = {}
    for k, w in t:
        other = [j for j, v in t if j != k and w <= v]
        if other:
            want[k] = (len(other), min(other))
    found = events.near_misses(spark.createDataFrame([(k, sorted(w)) for k, w in t], "k bigint, w array<string>")).collect()
    assert {r["k"]: (r["near"], r["first"]) for r in found} == want
    assert len(found) == len(want)
    whole = {r["k"] for r in plans.QUERIES["alias_near_miss_all"](spark, "/root/testdata/sf0.001").collect()}
    assert whole == {k for k, w in t[:-4] if any(j != k and w <= v for j, v in t[:-4])}


def test_surface_splits_by_whole_name_and_dates(spark):
    d = datetime.date
    rows = [("x1", "Open A", 0, "Hard", d(1996, 3, 1)), ("x1", "Open A", 0, "Hard", d(1996, 3, 8)), ("y1", "Open A", 1, "Clay", d(1996, 3, 4)), ("y1", "Open A", 1, "Clay", d(1996, 3, 9)),
            ("x2", "Open A", 0, "Hard", d(1997, 3, 1)), ("x2", "Open A", 0, "Hard", d(1997, 3, 8)), ("y2", "Open B", 1, "Clay", d(1997, 3, 4)), ("y2", "Open B", 1, "Clay", d(1997, 3, 9)),
            ("y3", "Open A", 1, "Clay", d(1997, 3, 7)), ("y3", "Open A", 1, "Clay", d(1997, 3, 9))]
    m = spark.createDataFrame(rows, "event_id string, event string, tour int, surface string, date date")
    assert [tuple(r) for r in gate.surface_splits(m).collect()] == [("split", "x1/0/y1/1", "Hard and Clay")]


def test_unshipped_in_every_season(spark):
    m = matches(spark, "/root/testdata/sf0.001")
    rows = m.select("event_id", "tier", "match_id").collect()
    want = {r["event_id"] for r in rows} - {r["event_id"] for r in rows if r["tier"] <= 4 and r["match_id"] % 11 == 0}
    found = {r["key"] for r in plans.QUERIES["gate_event_coverage_all"](spark, "/root/testdata/sf0.001").collect()}
    assert found == want and len({e[-4:] for e in found}) > 1
