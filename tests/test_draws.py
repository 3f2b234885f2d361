"""Live draws, withdrawals, planted faults and streams on small fixtures."""

import random

from pyspark.sql import functions as F

from matchlake.operators import draws as d
from matchlake.operators.bracket import seed_order
from matchlake.functions.levels import is_real
from matchlake.plans import draws as plans
from matchlake.plans import evidence
from matchlake.plans.gate import projection_problems
from matchlake.sources.files import scratch
from matchlake.streaming import forecast_log as log


def folded(slots, out):
    """The frontier of a draw by a loop over rounds."""
    def winner(a, b):
        if a is None or a in out:
            return b
        return a if b is None or b in out else None

    while len(slots) > 2:
        pairs = list(zip(slots[::2], slots[1::2], strict=True))
        live = [a is not None and b is not None and a not in out and b not in out for a, b in pairs]
        if any(live):
            return [x for (a, b), open_ in zip(pairs, live, strict=True) for x in ((a, b) if open_ else (winner(a, b), None))]
        slots = [winner(a, b) for a, b in pairs]
    return slots


def test_advance(spark):
    rng = random.Random(3)
    slots, out, want = [], [], {}
    for event in range(40):
        n = 2 ** rng.randint(1, 5)
        own = [event * 100 + i if rng.random() < 0.85 else None for i in range(n)]
        rate = rng.choice([0.0, 0.3, 0.6, 0.9])
        gone = {p for p in own if p is not None and rng.random() < rate}
        for i in range(0, n, 2):  # of two that meet one is left
            if own[i] in gone and own[i + 1] in gone:
                gone.discard(own[i])
        slots += [(event, i, p) for i, p in enumerate(own)]
        out += [(event, p) for p in gone]
        want[event] = folded(own, gone)
    found = d.advance(spark.createDataFrame(slots, "event int, slot int, player bigint"), spark.createDataFrame(out, "event int, player bigint")).collect()
    got = {e: [None] * len(x) for e, x in want.items()}
    for row in found:
        got[row.event][row.slot] = row.player
    assert got == want and len(found) == sum(map(len, want.values()))


def seated(alive, pairs):
    """alive: player to rating; pairs in order."""
    used, made = set(), []
    for a, b in pairs:
        if a in alive and b in alive and a != b and not {a, b} & used:
            made.append(sorted((a, b), key=lambda p: (-alive[p], p)))
            used |= {a, b}
    rest = [[p] for p in alive if p not in used]
    units = sorted(made + rest, key=lambda u: (-alive[u[0]], u[0]))
    if not made or len(units) & (len(units) - 1):
        order = sorted(alive, key=lambda p: (-alive[p], p))
        size = 1
        while size < len(order):
            size *= 2
        return [order[s - 1] if s <= len(order) else None for s in seed_order(size.bit_length() - 1)]
    return [x for s in seed_order(len(units).bit_length() - 1) for x in (units[s - 1] + [None])[:2]]


def test_live_draw(spark):
    rng = random.Random(4)
    alive, pairs, want = [], [], {}
    for event in range(30):
        n = rng.choice([1, 2, 3, 5, 6, 8, 12])
        own = {event * 100 + i: float(rng.randint(1, 6)) for i in range(n)}
        players = [*own]
        rng.shuffle(players)
        posted = [(players[i], players[i + 1]) for i in range(0, rng.randint(0, n // 2) * 2, 2)]
        posted += [(players[0], 9999)] if rng.random() < 0.5 else []
        alive += [(event, p, x) for p, x in own.items()]
        pairs += [(event, event * 1000 + i, a, b) for i, (a, b) in enumerate(posted)]
        want[event] = seated(own, posted)
    units = d.units(spark.createDataFrame(alive, "event int, player bigint, rating double"), spark.createDataFrame(pairs, "event int, seq bigint, a bigint, b bigint"), "rating")
    found = d.seat(units).collect()
    got = {e: [None] * len(x) for e, x in want.items()}
    for row in found:
        got[row.event][row.slot] = row.player
    assert got == want
    assert {r.status for r in found} == {"real", "partial", "seeded"}


def test_withdrawals(spark):
    slots = [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("a", 3, 4), ("b", 0, 5), ("b", 1, 6), ("c", 0, 7), ("c", 1, 8), *[("d", i, 20 + i) for i in range(8)]]
    field = [("a", 2), ("a", 3), ("a", 4), ("a", 9), ("b", 6), ("c", 8), ("c", 10), ("c", 11), ("d", 27)]
    results = [("a", 2, 9), ("a", 3, 4), ("c", 8, 10), ("c", 11, 8), ("d", 27, 26)]
    frames = [spark.createDataFrame(rows, s) for rows, s in ((slots, "event_id string, slot int, player bigint"), (field, "event_id string, player bigint"), (results, "event_id string, winner bigint, loser bigint"))]
    found = {(r.event_id, r.gone): (r.replacement, r.status) for r in evidence.withdrawals(*frames).collect()}
    assert found == {("a", 1): (9, "replaced"), ("b", 5): (None, "walkover"), ("c", 7): (None, "unresolved"), **{("d", 20 + i): (None, "unresolved") for i in range(6)}}


def test_a_replacement_comes_in_once(spark):
    """One new player who met two absent players' opponents replaces the first of them; placeholders don't withdraw."""
    slots = [("a", 0, "1"), ("a", 1, "2"), ("a", 2, "3"), ("a", 3, "4"), ("a", 4, "Qualifier 1"), ("a", 5, "5")]
    field = [("a", "2"), ("a", "4"), ("a", "9"), ("a", "5")]
    results = [("a", "9", "2"), ("a", "9", "4")]
    frames = [spark.createDataFrame(rows, s) for rows, s in ((slots, "event_id string, slot int, player string"), (field, "event_id string, player string"), (results, "event_id string, winner string, loser string"))]
    found = {r.gone: (r.replacement, r.status) for r in evidence.withdrawals(*frames, real=is_real(F.col("player"))).collect()}
    assert found == {"1": ("9", "replaced"), "3": (None, "unresolved")}


def test_one_match_a_round(spark):
    rows = [("e", 1, f"1998-01-0{i}", i, w, l) for i, (w, l) in enumerate([(1, 2), (1, 3), (3, 4), (5, 4), (5, 6)], 1)] + [("e", 2, "1998-01-09", 9, 1, 3), ("f", 1, "1998-01-01", 10, 1, 2)]
    m = spark.createDataFrame(rows, "event_id string, round_order int, date string, match_id bigint, winner bigint, loser bigint").withColumn("date", F.col("date").cast("date"))
    assert {r.match_id for r in evidence.first_match_a_round(m).filter("kept").collect()} == {1, 3, 5, 9, 10}


def test_planted_bracket_faults(spark):
    good = [(1, 1, 0, 1, 2, 1), (1, 1, 1, 3, 4, 4), (1, 2, 0, 1, 4, 4)]
    schema = "event int, round int, slot int, a bigint, b bigint, winner bigint"
    problems = lambda rows: sorted((r.check, r.key) for r in plans.bracket_problems(spark.createDataFrame(rows, schema)).collect())
    assert problems(good) == []
    assert problems([*good[:2], (1, 2, 0, 1, 3, 1)]) == [("feeder", "1/2/0/1")]
    assert problems([good[0], good[1], (1, 2, 0, 1, 4, 2)]) == [("winner", "1/2/0")]
    assert ("halving", "1/2") in problems([*good, (1, 2, 1, 5, 6, 5)])


def test_planted_projection_faults(spark):
    rows = [(1, 7, 1, 0.9), (1, 7, 2, 0.95), (1, 8, 1, 0.1), (1, 8, 2, 0.0), (2, 9, 1, 1.0)]
    reach = spark.createDataFrame(rows, "event int, player bigint, round int, reach double")
    last = spark.createDataFrame([(1, 2), (2, 1)], "event int, round int")
    assert sorted((r.check, r.key) for r in projection_problems(reach, last).collect()) == [("mass", "1"), ("monotone", "1/7")]


def test_sightings_are_locked_over_batches(spark):
    """A match's first batch decides, and a restart goes on behind it; rows late by less than the watermark still count."""
    path, at = scratch(spark), "2026-01-01 0{}:00:00"
    schema = "event_id bigint, as_of timestamp, match bigint, p double"
    batches = [[(1, 5, 7, 0.5), (2, 4, 7, 0.4), (3, 5, 8, 0.3)], [(4, 1, 7, 0.9), (5, 6, 9, 0.2)], [(6, 0, 9, 0.1), (7, 7, 8, 0.6)]]

    def land(rows):
        spark.createDataFrame([(i, at.format(h), m, p) for i, h, m, p in rows], "event_id bigint, as_of string, match bigint, p double").withColumn("as_of", F.col("as_of").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)

    out, checkpoint = scratch(spark), scratch(spark)
    for rows in batches[:2]:
        land(rows)
    run = lambda: {r.match: r.event_id for r in log.run(log.first_sightings(log.source(spark, path, schema)), checkpoint=checkpoint, out=out).collect()}
    assert run() == {7: 2, 8: 3, 9: 5}
    land(batches[2])
    assert run() == {7: 2, 8: 3, 9: 5}


def test_sightings_take_a_row_a_match_to_the_state(spark):
    """The earliest of many rows over small batches, of no match too; no call to Python for each match."""
    path, schema = scratch(spark), "event_id bigint, as_of timestamp, match bigint, p double"
    rows = spark.range(3000).selectExpr("id as event_id", "timestamp_seconds(10000 - id) as as_of", "if(id % 50 = 0, null, id % 50 + 4611686018427387904) as match", "0.5D as p")
    rows.coalesce(1).write.parquet(path)
    stream = log.first_sightings(log.source(spark, path, schema))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        found = {r.match: r.event_id for r in log.run(stream).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {k + 4611686018427387904 if k else None: 2950 + k for k in range(50)}
    assert "FlatMapGroups" not in stream._jdf.queryExecution().logical().toString()


def test_state_expires(spark):
    """A match's state goes a day after its last row; a later row starts anew."""
    path = scratch(spark)
    rows = [[(1, "2026-01-01 00:00:00", 7, 0.5), (2, "2026-01-01 01:00:00", 7, 0.6)], [(3, "2026-01-05 00:00:00", 8, 0.1)], [(4, "2026-01-05 01:00:00", 7, 0.7)], [(5, "2026-01-20 00:00:00", 9, 0.2)], [(6, "2026-01-21 00:00:00", 9, 0.2)]]
    for batch in rows:
        spark.createDataFrame(batch, "event_id bigint, as_of string, match bigint, p double").withColumn("as_of", F.col("as_of").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    found = log.run(log.latest(log.source(spark, path, "event_id bigint, as_of timestamp, match bigint, p double"), "1 hour", 24)).collect()
    assert {(r.match, r.event_id) for r in found} >= {(7, 2), (8, 3), (7, 4)} and all(r.event_id != 1 for r in found)
