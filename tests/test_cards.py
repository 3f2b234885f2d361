"""Cards of events to come and projected fields against a plain recursion over whole fields."""

from collections import defaultdict

import duckdb

from matchlake.plans import draws
from matchlake.sources.adapters import MATCHES
from tests.test_whole_brackets import SF, beats, draw, meet


def chances(field):
    """Champion, final and semi-final chances of a field of (player, rating), best first."""
    laws = list(meet(draw(field)))
    total = lambda back: {p[0]: v for law in laws[-1 - back] for p, v in law.items()} if back < len(laws) else {}
    return [total(k) for k in range(3)]


def close(row, laws):
    for name, law in zip(("champion", "final", "semi"), laws, strict=True):
        found, want = getattr(row, name), law.get(row.player) if law else None
        assert (found is None) == (want is None) and (want is None or abs(found - want) < 1e-4), name


def test_upcoming_cards(spark):
    con = duckdb.connect()
    for name in ("lineitem", "orders", "customer", "nation", "supplier", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    day = f"DATE '{draws.EVE}'"
    rows = con.execute(MATCHES + f""", e AS (SELECT event_id FROM matches WHERE draw_level = 'main' GROUP BY event_id HAVING min(date) > {day} AND min(date) <= {day} + {draws.AHEAD})
SELECT DISTINCT event_id, player, CAST(coalesce(p.points, 0) AS DOUBLE) FROM pl JOIN players p USING (player) WHERE event_id IN (FROM e) AND draw_level = 'main'""").fetchall()
    fields = defaultdict(list)
    for event, player, rating in sorted(rows, key=lambda r: (-r[2], r[1])):
        fields[event].append((player, rating))
    found = draws.upcoming_cards(spark, SF).collect()
    assert {(r.event, r.player) for r in found} == {(e, p) for e, f in fields.items() for p, _ in f} and len(found) > 100
    laws = {e: chances(f) for e, f in fields.items()}
    for r in found:
        close(r, laws[r.event])


def test_projected_field(spark):
    rows = duckdb.sql(f"SELECT s_nationkey, s_suppkey, CAST(s_acctbal AS DOUBLE) FROM '{SF}/supplier.parquet' ORDER BY s_acctbal DESC, s_suppkey").fetchall()
    fields = defaultdict(list)
    for event, player, rating in rows:
        fields[event].append((player, rating))
    laws = {e: chances(f[:32]) for e, f in fields.items()}
    found = defaultdict(list)
    for r in draws.projected_field(spark, SF).collect():
        close(r, laws[r.event])
        found[r.event].append(r)
    assert found.keys() == fields.keys() and all(len(x) == min(24, len(fields[e])) for e, x in found.items())
    for x in found.values():
        assert [r.player for r in sorted(x, key=lambda r: r.place)] == [r.player for r in sorted(x, key=lambda r: (-r.champion, r.player))]


def test_title_swings(spark):
    """The three largest changes between both outcomes of every lockable match, from the plain laws."""
    rows = duckdb.sql(f"SELECT s_nationkey, s_suppkey, CAST(s_acctbal AS DOUBLE) FROM '{SF}/supplier.parquet' ORDER BY s_acctbal DESC, s_suppkey").fetchall()
    fields = defaultdict(list)
    for event, player, rating in rows:
        fields[event].append((player, rating))
    found = defaultdict(list)
    for r in draws.title_swings(spark, SF).collect():
        found[r.event, r["round"], r.block].append(r)
    checked = 0
    for (event, rnd, block), three in sorted(found.items())[:12]:
        slots = draw(fields[event])
        if rnd > 1:
            continue
        a, b = slots[2 * block], slots[2 * block + 1]
        one, other = (list(meet(slots, (1, block, w)))[-1][0] for w in (a, b))
        swing = {p: other.get(p, 0.0) - one.get(p, 0.0) for p in {*one, *other}}
        best = sorted((-round(abs(v), 9), p[0]) for p, v in swing.items())[:3]
        assert [r.player for r in sorted(three, key=lambda r: r.place)] == [p for _, p in best]
        checked += 1
    assert checked and beats(1, 1) == 0.5
