"""Brackets conditioned on played matches against enumeration of all outcomes, and the audit of their scenarios."""

import itertools
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from matchlake.operators import bracket as b
from matchlake.plans import draws
from matchlake.plans.sim import chance

SCHEMA = "event int, rounds int, slot int, player bigint, rating double"


def beats(x, y):
    return 1 / (1 + 10 ** (-(x - y) / 4000))


def enumerated(slots, settled, forced=()):
    """Law of each round's winners by going through every outcome of all matches; slots: (player, rating) or None."""
    held, out = {(r, k): w for r, k, w in [*settled, *forced]}, [defaultdict(float) for _ in range(len(slots).bit_length() - 1)]

    def play(now, r, p, path):
        if len(now) == 1:
            for law, winners in zip(out, path, strict=True):
                for x in winners:
                    if x:
                        law[x[0]] += p
            return
        options = []
        for k in range(len(now) // 2):
            x, y = now[2 * k], now[2 * k + 1]
            if not x or not y:
                options.append([(x or y, 1.0)])
            elif held.get((r, k)) in (x[0], y[0]):
                options.append([(x if held[r, k] == x[0] else y, 1.0)])
            else:
                options.append([(x, beats(x[1], y[1])), (y, 1 - beats(x[1], y[1]))])
        for choice in itertools.product(*options):
            q = p
            for _, w in choice:
                q *= w
            after = [c for c, _ in choice]
            play(after, r + 1, q, [*path, after])

    play(list(slots), 1, 1.0, [])
    return out


PLAYERS = [(k, 1000.0 + 700 * (k % 5)) for k in range(1, 9)]
BRACKETS = {
    1: (PLAYERS, [(1, 0, 1), (1, 2, 6)]), 2: ([*PLAYERS[:3], None, *PLAYERS[4:7], None], [(1, 0, 2), (1, 2, 5), (2, 1, 7)]), 3: (PLAYERS[:4], []),
    4: (PLAYERS, [(1, 0, 1), (1, 1, 3), (1, 2, 5), (1, 3, 7), (2, 0, 3), (2, 1, 5), (3, 0, 5)]), 5: ([PLAYERS[0], None], []),
}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(e, len(x).bit_length() - 1, i, p and p[0], p and p[1]) for e, (x, _) in BRACKETS.items() for i, p in enumerate(x)]
    settled = [(e, *m) for e, (_, x) in BRACKETS.items() for m in x]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(settled, "event int, round int, block int, winner bigint")


def test_reach_of_settled_brackets(spark, tables):
    rows, settled = tables
    found = {(r.event, r["round"], r.player): r.reach for r in b.propagate(rows, "event", 3, chance(), settled=settled).filter("player is not null and reach > 0").collect()}
    want = {(e, r, p): v for e, (x, s) in BRACKETS.items() for r, law in enumerate(enumerated(x, s), 1) for p, v in law.items() if v > 0}
    assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-12 for k, v in want.items())
    assert found[4, 3, 5] == 1.0 and (1, 1, 2) not in found


def test_winners_who_could_not_be_there(spark, tables):
    rows, settled = tables
    bad = settled.unionByName(spark.createDataFrame([(1, 2, 1, 1), (3, 1, 0, 4), (1, 2, 0, 2)], settled.schema))
    reach = b.propagate(rows, "event", 3, chance(), settled=settled)
    assert {tuple(r) for r in b.unreachable(reach, rows, "event", bad).select("event", "round", "block", "winner").collect()} == {(1, 2, 1, 1), (3, 1, 0, 4), (1, 2, 0, 2)}
    assert b.unreachable(reach, rows, "event", settled).isEmpty()


def test_seeds_by_bits(spark):
    for k in range(1, 7):
        found = spark.range(2**k).select(b.seed_at(F.col("id").cast("int"), F.lit(k)).alias("s")).collect()
        assert [r.s for r in found] == b.seed_order(k)


def folded(spark):
    """Matches of the brackets with what has been played."""
    out = []
    for e, (slots, settled) in BRACKETS.items():
        held, now, r = {(x, k): w for x, k, w in settled}, [p and p[0] for p in slots], 0
        while len(now) > 1:
            r += 1
            pairs = [(now[i], now[i + 1]) for i in range(0, len(now), 2)]
            won = [(x or y) if r == 1 and not (x and y) else held.get((r, k)) if x and y else None for k, (x, y) in enumerate(pairs)]
            out += [(e, r, k, x, y, w) for k, ((x, y), w) in enumerate(zip(pairs, won, strict=True))]
            now = won
    return spark.createDataFrame(out, "event int, round int, slot int, a bigint, b bigint, winner bigint")


def test_scenarios_and_their_audit(spark, tables):
    rows, _ = tables
    found = folded(spark)
    published = draws.settled_scenarios(rows, 3, found).cache()
    want = {}
    for m in found.filter("a is not null and b is not null and winner is null").collect():
        for forced in (m.a, m.b):
            law = enumerated(*BRACKETS[m.event], [(m["round"], m.slot, forced)])[-1]
            want |= {(m.event, m["round"], m.slot, forced, p): v for p, v in law.items() if v > 0}
    got = {(r.event, r["round"], r.block, r.forced, r.player): r.title for r in published.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and len(want) > 20
    again = draws.tabled_scenarios(rows, found)
    audit = {r.event: r for r in draws.scenario_audit(published, again).collect()}
    assert all((r.wrong, r.lacking, r.extra) == (0, 0, 0) for r in audit.values()) and sum(r.compared for r in audit.values()) >= len(want)
    key = (F.col("event") == 1) & (F.col("forced") == 3)
    one = published.filter(key).orderBy("player").first().player
    damaged = published.filter(~(key & (F.col("player") == one))).withColumn("title", F.when(F.col("event") == 3, F.col("title") + 0.01).otherwise(F.col("title")))
    damaged = damaged.unionByName(spark.createDataFrame([(2, 1, 0, 99, 1, 0.5)], "event int, round int, block int, forced bigint, player bigint, title double"))
    audit = {r.event: r for r in draws.scenario_audit(damaged, again).collect()}
    assert audit[1].lacking == 1 and audit[3].wrong == audit[3].compared > 0 and audit[2].extra == 1


def test_packed_audit_finds_planted_faults(spark, tables):
    """A chance changed, a match left out and one that isn't open."""
    rows, _ = tables
    found = folded(spark)
    published = draws.settled_outcomes(rows, 3, found)
    audit = {r.event: r for r in draws.packed_audit(published, rows, found).collect()}
    assert audit and all((r.wrong, r.lacking, r.extra) == (0, 0, 0) and r.compared for r in audit.values())
    kept = published.filter("event <> 1").withColumn("before", F.when(F.col("event") == 3, F.transform("before", lambda p: F.when(p > 0, p + 0.01).otherwise(p))).otherwise(F.col("before")))
    strange = published.filter("event = 2").limit(1).withColumn("block", F.col("block") + 100)
    audit = {r.event: r for r in draws.packed_audit(kept.unionByName(strange), rows, found).collect()}
    assert audit[1].lacking == audit[1].compared > 0 and audit[3].wrong > 0 and audit[3].lacking == 0 and audit[2].extra > 0


def test_registered_queries_settle(spark):
    sf = "/root/testdata/sf0.01"
    reach = draws.settled_reach(spark, sf).toPandas()
    per_round = reach.groupby(["event", "round"])["reach"].sum()
    assert (reach["reach"] == 1).sum() > 0 and ((per_round - per_round.round()).abs() < 1e-4).all()
    audit = draws.gate_scenarios(spark, sf).collect()
    assert audit and all((r.wrong, r.lacking, r.extra) == (0, 0, 0) for r in audit)
