"""Live draws of the nations' players: seated, advanced, priced, cut into sections, and what results would change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.operators import bracket as b
from matchlake.operators import draws as d
from matchlake.plans.registry import query
from matchlake.plans.sim import brackets, by_player, chance, fields, folded, locked, price
from matchlake.sources.adapters import MATCHES, forecasts, matches, players, table
from matchlake.sources.files import staged


def living(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, player, rating of those that no match of the last season threw out."""
    m = matches(spark, sf_dir)
    lost = m.join(F.broadcast(m.agg(F.max("year").alias("last"))), F.col("year") == F.col("last")).filter("match_id % 3 = 0").select(F.col("loser").alias("player"))
    return fields(spark, sf_dir).join(lost, "player", "left_anti")


def posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, seq, a, b: announced pairs of players of one nation."""
    p = players(spark, sf_dir).select("player", F.col("ioc").alias("event"))
    m = matches(spark, sf_dir).filter("match_id % 5 < 2").select(F.col("match_id").alias("seq"), "winner", "loser")
    one = m.join(p.withColumnRenamed("player", "winner"), "winner")
    both = one.join(p.select(F.col("player").alias("loser"), F.col("event").alias("other")), "loser").filter("event = other")
    return both.select("event", "seq", F.col("winner").alias("a"), F.col("loser").alias("b"))


@query()
def live_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors seated by posted pairs where these seat the round, else by rating. Tested against a plain version."""
    return d.seat(staged(d.units(living(spark, sf_dir), posted(spark, sf_dir), "rating")))


@query()
def draw_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the current round the posted pairs tell."""
    return d.units(living(spark, sf_dir), posted(spark, sf_dir), "rating").groupBy("event").agg(F.first("status").alias("status"), F.count("*").alias("units"), F.count("b").alias("pairs"))


@query()
def advanced_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known draws folded to their frontier by who is out. Tested against a plain fold."""
    slots, _ = brackets(spark, sf_dir)
    out = matches(spark, sf_dir).filter("match_id % 4 = 0").select(F.col("loser").alias("player")).distinct()
    return d.advance(slots.select("event", "slot", "player"), slots.filter("player is not null").select("event", "player").join(out, "player"))


_PRICE = MATCHES + """, g AS (SELECT match_id, winner, loser, CASE WHEN match_id % 2 = 0 THEN winner ELSE loser END AS a, CASE WHEN match_id % 2 = 0 THEN loser
  ELSE winner END AS b, CASE WHEN match_id % 7 > 0 THEN winner END AS w, walkover FROM matches),
lg AS (SELECT least(winner, loser) AS lo, greatest(winner, loser) AS hi, arg_min(winner, match_id) AS pa, round(0.3 + min(match_id) % 45 / 100.0,
  6) AS lp FROM matches WHERE match_id % 3 = 0 GROUP BY ALL),
pr AS (SELECT g.*, CASE WHEN lg.pa = g.a THEN lp ELSE 1 - lp END AS logged, 1 / (1 + pow(10, -(x.points - y.points) / 4000.0)) AS model FROM g LEFT
  JOIN lg ON lg.lo = least(g.a, g.b) AND lg.hi = greatest(g.a, g.b) LEFT JOIN players x ON x.player = g.a LEFT JOIN players y ON y.player = g.b)
"""


@query(_PRICE + """, q AS (SELECT match_id, a, w, CASE WHEN walkover THEN NULL WHEN w IS NOT NULL THEN coalesce(logged, model) ELSE model END AS p0, CASE
  WHEN walkover THEN NULL WHEN w IS NOT NULL AND logged IS NOT NULL THEN 'logged' WHEN model IS NOT NULL THEN 'model' END AS source FROM pr)
SELECT match_id, round(p0, 4) AS p, source, CASE WHEN w IS NOT NULL AND p0 IS NOT NULL THEN CASE WHEN w = a THEN round(p0, 4) ELSE 1 - round(p0,
  4) END < 0.5 END AS upset FROM q""")
def priced_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of matches: what was logged before goes before the model of now."""
    m, k = matches(spark, sf_dir), F.col("match_id")
    even = k % 2 == 0
    games = m.select(k, F.when(even, F.col("winner")).otherwise(F.col("loser")).alias("a"), F.when(even, F.col("loser")).otherwise(F.col("winner")).alias("b"), F.when(k % 7 > 0, F.col("winner")).alias("winner"), "walkover")
    log = m.filter(k % 3 == 0).groupBy(F.least("winner", "loser").alias("lo"), F.greatest("winner", "loser").alias("hi")).agg(F.min_by("winner", "match_id").alias("pa"), F.round(F.lit(0.3) + F.min("match_id") % 45 / 100.0, 6).alias("lp"))
    rated = players(spark, sf_dir)
    joined = games.join(log, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left")
    for c in "ab":
        joined = joined.join(rated.select(F.col("player").alias(c), F.col("points").alias(f"r{c}")), c, "left")
    logged = F.when(F.col("pa") == F.col("a"), F.col("lp")).otherwise(1 - F.col("lp"))
    model = 1 / (1 + F.pow(F.lit(10.0), -(F.col("ra") - F.col("rb")) / 4000.0))
    return d.priced(joined, model, logged).select("match_id", "p", "source", "upset")


@query()
def projected_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 best of each nation seeded and played out exactly: title, final and semi-final chances of the best 24 (a top-k
    report), unknown players counted but not shown."""
    best = fields(spark, sf_dir).withColumn("i", F.row_number().over(W.partitionBy("event").orderBy(F.desc("rating"), "player"))).filter("i <= 32")
    slots, rounds = b.seeded_whole(best.select("event", "player", "rating"), "event", "rating")
    reach = b.propagate(slots, "event", rounds, chance()).filter("player is not null").join(slots.select("event", F.col("rounds").alias("n")).distinct(), "event")
    at = lambda back: F.max(F.when(F.col("round") == F.col("n") - back, F.col("reach")))
    each = reach.groupBy("event", "player").agg(F.round(at(0), 4).alias("champion"), F.round(at(1), 4).alias("final"), F.round(at(2), 4).alias("semi"))
    place = F.row_number().over(W.partitionBy("event").orderBy(F.desc("champion"), "player"))
    return each.withColumn("place", place).filter("place <= 24")


_CARD = MATCHES + """, e AS (SELECT event_id, min(date) AS start, max(date) AS finish, count(DISTINCT player) AS field FROM pl
  GROUP BY event_id), x AS (SELECT event_id, count(DISTINCT loser) AS out, arg_max(winner, (date, match_id)) FILTER (WHERE round_order = 7) AS champion
  FROM matches WHERE date <= DATE '1998-06-01' GROUP BY event_id)
"""


@query(_CARD + """SELECT e.event_id, CASE WHEN start > DATE '1998-06-01' THEN 'upcoming' WHEN champion IS NOT NULL OR finish < DATE '1998-06-01' - 3 THEN 'completed'
  ELSE 'live' END AS status, field, field - coalesce(x.out, 0) AS alive, champion FROM e LEFT JOIN x USING (event_id)""")
def tournament_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, field, survivors and champion of every event on a stated day: what a card shows before its odds."""
    now = F.lit("1998-06-01").cast("date")
    m = matches(spark, sf_dir)
    e = m.select("event_id", "date", F.explode(F.array("winner", "loser")).alias("player")).groupBy("event_id").agg(F.min("date").alias("start"), F.max("date").alias("finish"), F.count_distinct("player").alias("field"))
    x = m.filter(F.col("date") <= now).groupBy("event_id").agg(F.count_distinct("loser").alias("out"), F.max_by("winner", F.when(F.col("round_order") == 7, F.struct("date", "match_id"))).alias("champion"))
    status = F.when(F.col("start") > now, "upcoming").when(F.col("champion").isNotNull() | (F.col("finish") < F.date_sub(now, 3)), "completed").otherwise("live")
    return e.join(x, "event_id", "left").select("event_id", status.alias("status"), "field", (F.col("field") - F.coalesce("out", F.lit(0))).alias("alive"), "champion")


#: The day that upcoming events are looked for, and how many days ahead.
EVE, AHEAD = "1997-12-15", 60


@query()
def upcoming_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that begin within AHEAD days after a stated day, with the chances of all their entrants to win the title and to reach the
    final and the semi-finals; a test holds them to a plain recursion."""
    now = F.lit(EVE).cast("date")
    m = staged(matches(spark, sf_dir).filter("draw_level = 'main'").select("event_id", "date", "winner", "loser"))
    start = m.groupBy("event_id").agg(F.min("date").alias("start")).filter((F.col("start") > now) & (F.col("start") <= F.date_add(now, AHEAD)))
    entrants = m.join(start, "event_id", "left_semi").select("event_id", F.explode(F.array("winner", "loser")).alias("player")).distinct()
    rated = players(spark, sf_dir).select("player", F.coalesce("points", F.lit(0)).cast("double").alias("rating"))
    field = entrants.join(rated, "player").select(F.col("event_id").alias("event"), "player", "rating")
    slots, rounds = b.seeded_whole(staged(field), "event", "rating")
    reach = b.propagate(slots, "event", rounds, chance(), price=price).filter("player is not null").join(slots.select("event", F.col("rounds").alias("n")).distinct(), "event")
    at = lambda back: F.round(F.max(F.when(F.col("round") == F.col("n") - back, F.col("reach"))), 4)
    return reach.groupBy("event", "player").agg(at(0).alias("champion"), at(1).alias("final"), at(2).alias("semi"))


_SECTION = MATCHES + ", r AS (SELECT match_id, round_order AS round, match_id % 64 AS match FROM matches WHERE round_order <= 5) "


@query(_SECTION + """SELECT match_id, CAST(match // greatest(1, 16 // CAST(pow(2, round) AS INTEGER)) AS INTEGER) AS section, CAST(match % greatest(1, 16 // CAST(pow(2,
  round) AS INTEGER)) AS INTEGER) AS place FROM r""")
def draw_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of sixteen places: of every match its section and its place in the column of its round."""
    rows = matches(spark, sf_dir).filter("round_order <= 5").select("match_id", F.col("round_order").alias("round"), (F.col("match_id") % 64).alias("match"))
    return d.sections(rows).select("match_id", "section", "place")


@query()
def title_swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest changes of title chances between the two outcomes of each lockable match (a top-k report)."""
    return d.swings(locked(spark, sf_dir), 3).select("event", "round", "block", "player", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "place")


_ONE = MATCHES + ", f AS (SELECT event, lower(event) AS l, year, event_id, count(*) AS n FROM matches GROUP BY ALL) "


@query(_ONE + "SELECT event_id, n, row_number() OVER (ORDER BY n DESC, event_id) AS place FROM f WHERE contains(l, 'ni') AND year = 1996")
def find_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a season whose name holds some text, by their number of matches."""
    hits = matches(spark, sf_dir).filter(F.lower("event").contains("ni") & (F.col("year") == 1996)).groupBy("event_id").agg(F.count("*").alias("n"))
    return hits.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "event_id")))  # one season's events of like names


def _folds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows, rounds = brackets(spark, sf_dir)
    return folded(rows, rounds, matches(spark, sf_dir)), rounds


@query()
def gate_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry of folded brackets: rounds that don't halve, players that nobody fed, winners that didn't play; none are
    expected. A test plants each."""
    found, _ = _folds(spark, sf_dir)
    return bracket_problems(found)


def bracket_problems(rows: DataFrame) -> DataFrame:
    """check, key, message; rows: event, round, slot, a, b, winner of every match."""
    from matchlake.plans.gate import violations

    key = F.concat_ws("/", F.col("event").cast("string"), F.col("round").cast("string"), F.col("slot").cast("string"))
    size = rows.groupBy("event", "round").agg(F.count("*").alias("n"))
    step = size.join(size.select("event", (F.col("round") + 1).alias("round"), F.col("n").alias("before")), ["event", "round"])
    halves = violations(step, "halving", F.concat_ws("/", F.col("event").cast("string"), F.col("round").cast("string")), 2 * F.col("n") != F.col("before"), F.lit("doesn't halve"))
    fed = rows.select("event", (F.col("round") + 1).alias("round"), F.shiftright("slot", 1).alias("slot"), (F.col("slot") % 2).alias("side"), F.col("winner").alias("sent"))
    sides = rows.select("event", "round", "slot", F.posexplode(F.array("a", "b")).alias("side", "player")).filter("round > 1").join(fed, ["event", "round", "slot", "side"], "left")
    feeder = violations(sides, "feeder", F.concat_ws("/", key, F.col("side").cast("string")), ~F.col("player").eqNullSafe(F.col("sent")), F.lit("was not sent by the match before"))
    strange = violations(rows, "winner", key, F.col("winner").isNotNull() & ~(F.col("winner").eqNullSafe(F.col("a")) | F.col("winner").eqNullSafe(F.col("b"))), F.lit("did not play"))
    return halves.unionByName(feeder).unionByName(strange)


def settled_matches(found: DataFrame) -> DataFrame:
    """event, round, block, winner of the matches of folded brackets that two players have played."""
    return found.filter("a is not null and b is not null and winner is not null").select("event", "round", F.col("slot").alias("block"), "winner")


@query()
def settled_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances to win each round when all played matches are settled; a test holds them to plain enumeration."""
    rows, rounds = brackets(spark, sf_dir)
    settled = staged(settled_matches(folded(rows, rounds, recent(spark, sf_dir))))
    won = b.propagate(rows, "event", rounds, chance(), settled=settled)
    return won.filter("player is not null and reach > 0").select("event", "player", "round", F.round("reach", 6).alias("reach"))


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the matches, as played so far."""
    return matches(spark, sf_dir).filter("match_id % 3 > 0")


def settled_scenarios(rows: DataFrame, rounds: int, found: DataFrame) -> DataFrame:
    """event, round, block, forced, player, title: title chances under each outcome of every match whose two players are known
    and that hasn't been played, with all played matches settled."""
    return by_player(settled_outcomes(rows, rounds, found)).filter("title > 0")


def settled_outcomes(rows: DataFrame, rounds: int, found: DataFrame) -> DataFrame:
    """The same with a row a match, as ``outcomes`` gives them."""
    rows, open_ = staged(rows), found.filter("a is not null and b is not null and winner is null")
    reach = staged(b.propagate(rows, "event", rounds, chance(), settled=settled_matches(found), price=price))
    return b.outcomes(rows, reach, open_.select("event", "round", F.col("slot").alias("block"), "a", "b"), "event", price)


@query()
def scenario_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unsettled bracket's scenarios; a test holds them to enumeration."""
    rows, rounds = brackets(spark, sf_dir)
    found = staged(folded(rows, rounds, recent(spark, sf_dir)))
    return settled_scenarios(rows, rounds, found).withColumn("title", F.round("title", 6))


def tabled_scenarios(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The same scenarios by another way: each bracket's matrix in one task, outcome after outcome."""
    price = lambda x, y: 1 / (1 + 10 ** (-(x - y) / 4000))

    def run(bracket: pd.DataFrame, played: pd.DataFrame) -> pd.DataFrame:
        out, held = [], {}
        live = played[played["a"].notna() & played["b"].notna()]
        for m in live[live["winner"].notna()].itertuples():
            held[m.round, m.slot] = m.winner
        player = bracket.sort_values("slot")["player"].tolist()
        for m in live[live["winner"].isna()].itertuples():
            for forced in (m.a, m.b):
                for i, p in b.tabled(bracket, price, held | {(m.round, m.slot): forced})[-1].items():
                    out.append((int(m.event), int(m.round), int(m.slot), int(forced), int(player[i]), float(p)))
        return pd.DataFrame(out, columns=["event", "round", "block", "forced", "player", "title"])

    return rows.groupBy("event").cogroup(found.groupBy("event")).applyInPandas(run, "event int, round int, block int, forced bigint, player bigint, title double")


@query()
def gate_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published scenarios audited against matrices of whole brackets, which share no code with the propagation that published
    them: of each event the chances that were compared, and those that differ, lack or are too many (none are expected; a test
    plants each)."""
    rows, rounds = brackets(spark, sf_dir)
    rows = staged(rows)
    found = staged(folded(rows, rounds, recent(spark, sf_dir)))
    cut = lambda c: F.transform(c, lambda p: F.round(p, 6)).alias(c)
    published = settled_outcomes(rows, rounds, found).select("event", "round", "block", "a", "b", "players", cut("before"), cut("after"))
    return packed_audit(published, rows, found)


def packed_audit(published: DataFrame, rows: DataFrame, found: DataFrame, tolerance: float = 2e-6) -> DataFrame:
    """What ``scenario_audit`` gives, of published rows a match: each is held to its bracket's matrices where it is, so no chances are
    shuffled; open matches that nobody published follow, with all their chances lacking."""
    keys = ["event", "round", "block", "a", "b"]
    open_ = found.filter("a is not null and b is not null and winner is null").select("event", "round", F.col("slot").alias("block"), "a", "b")
    places = rows.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("slot", "player", "rating"))).alias("places"))
    played = settled_matches(found).groupBy("event").agg(F.collect_list(F.struct("round", "block", "winner")).alias("played"))
    number = lambda c: F.transform("places", lambda x: F.coalesce(x[c].cast("double"), F.lit(float("nan")))).alias(c)
    whole = staged(places.join(played, "event", "left").select("event", number("player"), number("rating"), "played"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, laws, names, own = None, [], None, None
        for frame in frames:
            for _, some in frame.groupby("event"):
                player, settled = np.asarray(some["player"].iloc[0], float), some["played"].iloc[0]
                bracket = pd.DataFrame({"slot": np.arange(len(player)), "player": player, "rating": np.asarray(some["rating"].iloc[0], float)})
                held = {(x["round"], x["block"]): x["winner"] for x in ([] if settled is None else settled)}
                forced = [(m.round, m.block, x) for m in some.itertuples() for x in (m.a, m.b)]
                if of != some["event"].iloc[0]:
                    of, laws, names = some["event"].iloc[0], b.unforced(bracket, price, held), None
                again, at, out = b.titles(bracket, price, held, forced, laws), {x: i for i, x in enumerate(player.tolist()) if x == x}, []
                for k, m in enumerate(some.itertuples()):
                    told, known = np.zeros((2, len(player))), np.zeros(len(player), bool)
                    strange = 0
                    if m.players is not None:
                        if names is None or not np.array_equal(names, m.players):  # rows of an event mostly name the same players
                            names, own = m.players, np.array([at.get(x, -1) for x in m.players])
                        for side, law in enumerate((m.before, m.after)):
                            told[side, own[own >= 0]] = np.asarray(law, float)[own >= 0]
                            strange += int((np.asarray(law, float)[own < 0] > tolerance).sum())
                        known[own[own >= 0]] = True
                    real = again[2 * k : 2 * k + 2] if m.wanted else np.zeros_like(told)
                    both, apart = known & (real > 0) & (told > 0), np.abs(told - real) > tolerance
                    out.append((int(m.event), int(m.round), int(m.block), int(m.a), int(m.b), int(((real > 0) | (told > 0)).sum()) + strange, int((both & apart).sum()), int((apart & ~both & (told == 0)).sum()), int((apart & ~both & (real == 0)).sum()) + strange))
                yield pd.DataFrame(out, columns=[*keys, "compared", "wrong", "lacking", "extra"])

    def audited(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(whole), "event").mapInPandas(run, "event int, round int, block int, a bigint, b bigint, compared bigint, wrong bigint, lacking bigint, extra bigint")

    wanted = open_.withColumn("wanted", F.lit(True))
    first = staged(audited(published.join(F.broadcast(wanted), keys, "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))))
    none = [F.lit(None).cast(f"array<{kind}>").alias(c) for c, kind in (("players", "bigint"), ("before", "double"), ("after", "double"))]
    rest = audited(wanted.join(first.select(*keys), keys, "left_anti").select(*keys, *none, "wanted"))
    return first.unionByName(rest).groupBy("event").agg(*[F.sum(c).alias(c) for c in ("compared", "wrong", "lacking", "extra")])


def scenario_audit(published: DataFrame, again: DataFrame, tolerance: float = 2e-6) -> DataFrame:
    """event, compared, wrong, lacking, extra."""
    keys = ["event", "round", "block", "forced", "player"]
    both = published.join(again.withColumnRenamed("title", "again"), keys, "full")
    bare = lambda c: F.coalesce(F.col(c), F.lit(0.0)) <= tolerance
    wrong = F.abs(F.col("title") - F.col("again")) > tolerance
    return both.groupBy("event").agg(F.count("*").alias("compared"), F.count_if(wrong).alias("wrong"), F.count_if(F.col("title").isNull() & ~bare("again")).alias("lacking"), F.count_if(F.col("again").isNull() & ~bare("title")).alias("extra"))


@query(MATCHES + """, top AS (SELECT s_nationkey AS event, s_suppkey AS player, CAST(s_acctbal AS DOUBLE) AS rating,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS seed FROM supplier)
SELECT event, seed AS place, player, round(rating / sum(rating) OVER (PARTITION BY event), 6) AS odds FROM top
  WHERE rating > 0 QUALIFY row_number() OVER (PARTITION BY event ORDER BY rating DESC, player) <= 3""")
def title_contenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three with the highest title odds above 0 in each event (a top-k report)."""
    rows = fields(spark, sf_dir).filter("rating > 0")
    odds = F.round(F.col("rating") / F.sum("rating").over(W.partitionBy("event")), 6)
    place = F.row_number().over(W.partitionBy("event").orderBy(F.desc("rating"), "player"))
    return rows.select("event", place.alias("place"), "player", odds.alias("odds")).filter("place <= 3")


@query(MATCHES + """, h AS (SELECT match, date_trunc('hour', as_of) AS hour, arg_max(p, (as_of, event_id)) AS p FROM forecasts
  GROUP BY ALL), f AS (SELECT match, count(*) AS snapshots, round(arg_min(p, hour), 6) AS first, round(arg_max(p, hour), 6) AS current FROM h
  GROUP BY match)
SELECT match, snapshots, first, current, round(current - first, 6) AS delta FROM f""")
def forecast_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a match's card shows of its log: snapshots, first and current chance and the change."""
    at = F.struct("as_of", "event_id")
    h = forecasts(spark, sf_dir).groupBy("match", F.date_trunc("hour", "as_of").alias("hour")).agg(F.max_by("p", at).alias("p"))
    f = h.groupBy("match").agg(F.count("*").alias("snapshots"), F.round(F.min_by("p", "hour"), 6).alias("first"), F.round(F.max_by("p", "hour"), 6).alias("current"))
    return f.withColumn("delta", F.round(F.col("current") - F.col("first"), 6))


@query(MATCHES + """SELECT n_nationkey AS event, n_name AS name, s.n IS NOT NULL AS has_bracket, coalesce(s.n, 0) AS players FROM nation LEFT
  JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey HAVING count(*) >= 2) s ON s_nationkey = n_nationkey""")
def bracket_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with the mark whether a bracket of theirs is published (two known players at least)."""
    sizes = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("players")).filter("players >= 2")
    joined = table(spark, sf_dir, "nation").join(sizes, "n_nationkey", "left")
    return joined.select(F.col("n_nationkey").alias("event"), F.col("n_name").alias("name"), F.col("players").isNotNull().alias("has_bracket"), F.coalesce("players", F.lit(0)).cast("long").alias("players"))
