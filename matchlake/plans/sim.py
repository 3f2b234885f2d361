"""Seeding, brackets, exact propagation, locks, leverage and simulation. Fields are the nations' players: suppliers by
account balance."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.operators import bracket as b
from matchlake.operators.merge import keep_best
from matchlake.plans.registry import query
from matchlake.sources.adapters import MATCHES, matches, table
from matchlake.sources.files import staged

ROUNDS = 3
_ORDER = ", ".join(f"({i}, {x})" for i, x in enumerate(b.seed_order(ROUNDS)))
_SLOTS = MATCHES.replace("WITH qty", "WITH RECURSIVE qty", 1) + f""", field AS (SELECT s_nationkey AS event, s_suppkey AS player, CAST(s_acctbal AS DOUBLE) AS rating, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS seed FROM supplier),
places AS (SELECT * FROM (VALUES {_ORDER}) AS v(slot, seed)),
slots AS (SELECT e.event, p.slot, p.seed, f.player, f.rating FROM (SELECT DISTINCT event FROM field) e CROSS JOIN places p LEFT JOIN field f ON f.event = e.event AND f.seed = p.seed)
"""


def rounds_sql(name: str, source: str, extra: str = "", lock: str = "NULL", rounds: int = ROUNDS) -> str:
    """SQL of the same propagation, one pair of expressions a round."""
    keys = "event" + extra
    parts, previous = [], f"(SELECT *, CAST(1 AS DOUBLE) AS reach FROM {source})"
    for r in range(1, rounds + 1):
        block, half = 2**r, 2 ** (r - 1)
        on = " AND ".join(f"x.{k} = y.{k}" for k in keys.split(", "))
        price = f"CASE WHEN x.player IS NULL AND y.player IS NULL THEN 0.5 WHEN x.player IS NULL THEN 0.0 WHEN y.player IS NULL THEN 1.0 ELSE coalesce({lock if r == rounds else 'NULL'}, 1 / (1 + pow(10, -(x.rating - y.rating) / 4000))) END"
        parts.append(f"{name}{r} AS MATERIALIZED (SELECT {', '.join('x.' + k for k in keys.split(', '))}, x.slot, x.player, x.rating, sum(x.reach * y.reach * {price}) AS reach FROM {previous} x JOIN {previous} y ON {on} AND x.slot // {block} = y.slot // {block} AND x.slot // {half} <> y.slot // {half} GROUP BY ALL)")
        previous = f"{name}{r}"
    return ", ".join(parts)


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_nationkey").alias("event"), F.col("s_suppkey").alias("player"), F.col("s_acctbal").cast("double").alias("rating"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.seeded(fields(spark, sf_dir), "event", "rating", ROUNDS)


def brackets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The bracket of each whole field, and the rounds of the largest."""
    return b.seeded_whole(fields(spark, sf_dir), "event", "rating")


def chance() -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -(F.col("x.rating") - F.col("y.rating")) / 4000))


@query(f"SELECT v.slot, v.seed FROM (VALUES {_ORDER}) AS v(slot, seed)")
def seed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(b.seed_order(ROUNDS))), "slot int, seed int")


@query(_SLOTS + "SELECT event, slot, seed, player FROM slots")
def standard_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(spark, sf_dir).select("event", "slot", "seed", "player")


@query(_SLOTS + ", " + rounds_sql("r", "slots") + """ SELECT event, player, round, round(reach, 6) AS reach FROM (SELECT *, 1 AS round FROM r1 UNION ALL SELECT *, 2 FROM r2 UNION ALL SELECT *, 3 FROM r3)
  WHERE player IS NOT NULL""")
def exact_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.propagate(slots(spark, sf_dir), "event", ROUNDS, chance()).filter("player is not null").select("event", "player", "round", F.round("reach", 6).alias("reach"))


#: Rounds that the SQL of whole fields knows; fields of up to 128 players.
MOST = 7
_WHOLE = _SLOTS + ", sizes AS (SELECT event, greatest(1, CAST(ceil(log2(count(*))) AS INTEGER)) AS rounds FROM field GROUP BY event), spots AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {i}, {x})" for k in range(1, MOST + 1) for i, x in enumerate(b.seed_order(k))) + """) AS v(rounds, slot, seed)), whole AS (SELECT z.event, p.slot, p.seed, f.player, f.rating FROM sizes z JOIN spots p USING (rounds) LEFT
  JOIN field f ON f.event = z.event AND f.seed = p.seed)"""
_REACH = " UNION ALL ".join(f"SELECT *, {r} AS round FROM w{r}" for r in range(1, MOST + 1))


@query(_WHOLE + " SELECT event, slot, seed, player FROM whole")
def standard_draw_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every player of each field, and byes."""
    return brackets(spark, sf_dir)[0].select("event", "slot", "seed", "player")


@query(_WHOLE + ", " + rounds_sql("w", "whole", rounds=MOST) + f" SELECT event, player, round, round(reach, 6) AS reach FROM ({_REACH}) WHERE player IS NOT NULL")
def exact_reach_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every player of each field, in every round."""
    rows, rounds = brackets(spark, sf_dir)
    return b.propagate(rows, "event", rounds, chance()).filter("player is not null").select("event", "player", "round", F.round("reach", 6).alias("reach"))


_LOCK = "CASE WHEN x.player = x.forced THEN 1.0 WHEN y.player = x.forced THEN 0.0 END"
_SCENARIOS = _SLOTS + """, top AS (SELECT event, player AS forced FROM slots WHERE seed <= 2 AND player IS NOT NULL), sc AS (SELECT s.*, t.forced FROM slots s
  JOIN top t USING (event)), """ + rounds_sql("s", "sc", ", forced", _LOCK) + ", " + rounds_sql("r", "slots")


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title chances of every player if one of the two top seeds wins any final that it reaches."""
    rows = slots(spark, sf_dir)
    top = rows.filter("seed <= 2 and player is not null").select("event", F.col("player").alias("forced"))
    keyed = rows.join(top, "event").withColumn("case", F.struct("event", "forced")).drop("event", "forced")
    lock = F.when(F.col("x.player") == F.col("x.case.forced"), 1.0).when(F.col("y.player") == F.col("x.case.forced"), 0.0)
    now = keyed.select("case", "slot", "player", "rating")
    return b.propagate(now, "case", ROUNDS - 1, chance()).filter(F.col("round") == ROUNDS - 1).join(now.select("case", "slot", "rating"), ["case", "slot"]).transform(lambda d: _final(d, lock))


def _final(semi: DataFrame, lock: Column) -> DataFrame:
    """The last round with a settled winner: each side's finalists meet."""
    side = semi.withColumn("half", F.shiftright("slot", ROUNDS - 1))
    x, y = side.alias("x"), side.alias("y")
    meet = x.join(y, (F.col("x.case") == F.col("y.case")) & (F.col("x.half") != F.col("y.half")))
    p = F.when(F.col("x.player").isNull(), F.when(F.col("y.player").isNull(), 0.5).otherwise(0.0)).when(F.col("y.player").isNull(), 1.0).otherwise(F.coalesce(lock, chance()))
    won = meet.groupBy(F.col("x.case").alias("case"), F.col("x.player").alias("player")).agg(F.sum(F.col("x.reach") * F.col("y.reach") * p).alias("title"))
    return won.filter("player is not null").select("case.event", "case.forced", "player", "title")


@query(_SCENARIOS + " SELECT event, forced, player, round(reach, 6) AS title FROM s3 WHERE player IS NOT NULL")
def scenario_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios(spark, sf_dir).select("event", "forced", "player", F.round("title", 6).alias("title"))


@query(_SCENARIOS + """ SELECT s.event, s.forced, round(0.5 * sum(abs(s.reach - r.reach)), 6) AS leverage FROM s3 s JOIN r3 r ON r.event = s.event AND r.player = s.player
  GROUP BY s.event, s.forced""")
def title_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total-variation distance of the title law under each lock from the plain one."""
    plain = b.propagate(slots(spark, sf_dir), "event", ROUNDS, chance()).filter(F.col("round") == ROUNDS).select("event", "player", "reach")
    return scenarios(spark, sf_dir).join(plain, ["event", "player"]).groupBy("event", "forced").agg(F.round(0.5 * F.sum(F.abs(F.col("title") - F.col("reach"))), 6).alias("leverage"))


def lockable(rows: DataFrame) -> DataFrame:
    """event, round, block, a, b: the matches whose two players are certain before any result, those of the first round and
    those of the second between players with byes."""
    known = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a"))
    first = _pairs(rows.select("event", "slot", "player")).withColumn("player", known)
    second = _pairs(first.select("event", "slot", "player"))
    return first.select("event", F.lit(1).alias("round"), F.col("slot").alias("block"), "a", "b").unionByName(second.select("event", F.lit(2).alias("round"), F.col("slot").alias("block"), "a", "b")).filter("a is not null and b is not null")


def price(x, y):
    """``chance`` over arrays of ratings. Powers are taken of each side alone, as pairs are many more; where those would
    overflow, of the differences."""
    if max(np.fmax.reduce(np.abs(v), axis=None, initial=0.0) for v in (x, y)) > 1e6:
        return 1 / (1 + 10 ** (-(x - y) / 4000))
    a, b = 10 ** (x / 4000), 10 ** (y / 4000)
    return a / (a + b)


def locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, round, block, a, b, players, before, after: title chances of every player under each outcome of every lockable
    match, a row a match."""
    rows, rounds = brackets(spark, sf_dir)
    rows = staged(rows)
    return b.outcomes(rows, staged(b.propagate(rows, "event", rounds, chance())), lockable(rows), "event", price)


def by_player(found: DataFrame) -> DataFrame:
    """event, round, block, forced, player, title of ``outcomes``."""
    side = F.explode(F.array(*[F.struct(F.col(x).alias("forced"), F.arrays_zip("players", F.col(of).alias("titles")).alias("law")) for x, of in (("a", "before"), ("b", "after"))])).alias("s")
    each = found.select("event", "round", "block", side).select("event", "round", "block", "s.forced", F.explode("s.law").alias("x"))
    return each.select("event", "round", "block", "forced", F.col("x.players").alias("player"), F.col("x.titles").alias("title"))


@query()
def scenario_locks_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_player(locked(spark, sf_dir)).withColumn("title", F.round("title", 6))


@query()
def title_leverage_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total-variation distance of the title laws under the two outcomes of every lockable match."""
    apart = F.aggregate(F.zip_with("before", "after", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda x, y: x + y)
    return locked(spark, sf_dir).select("event", "round", "block", "a", "b", F.round(0.5 * apart, 6).alias("leverage"))


@query()
def monte_carlo_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated reach over the reference's number of runs."""
    return simulated(spark, sf_dir, 20_000)


def simulated(spark: SparkSession, sf_dir: str, runs: int) -> DataFrame:
    rows, _ = brackets(spark, sf_dir)
    return b.simulate(rows, "event", lambda x, y: 1 / (1 + 10 ** (-(x - y) / 4000)), runs, seed=7).select("event", "player", "round", (F.col("wins") / runs).alias("reach"))


def _pairs(now: DataFrame) -> DataFrame:
    """event, slot, a, b: the two players that meet, of event, slot, player."""
    side = lambda i: F.max(F.when(F.col("slot") % 2 == i, F.col("player")))
    return now.groupBy("event", F.shiftright("slot", 1).alias("slot")).agg(side(0).alias("a"), side(1).alias("b"))


_FOLD = _SLOTS + """, res AS (SELECT least(winner, loser) AS lo, greatest(winner, loser) AS hi, arg_max(winner, (date, match_id)) AS w FROM matches GROUP BY ALL),
f1 AS (SELECT a.event, a.slot // 2 AS slot, a.player AS a, b.player AS b, CASE WHEN a.player IS NULL THEN b.player WHEN b.player IS NULL THEN a.player
  ELSE r.w END AS player FROM slots a JOIN slots b ON a.event = b.event AND a.slot % 2 = 0 AND b.slot = a.slot + 1 LEFT
  JOIN res r ON r.lo = least(a.player, b.player) AND r.hi = greatest(a.player, b.player)),
f2 AS (SELECT a.event, a.slot // 2 AS slot, a.player AS a, b.player AS b, CASE WHEN a.player IS NULL OR b.player IS NULL THEN NULL
  ELSE r.w END AS player FROM f1 a JOIN f1 b ON a.event = b.event AND a.slot % 2 = 0 AND b.slot = a.slot + 1 LEFT
  JOIN res r ON r.lo = least(a.player, b.player) AND r.hi = greatest(a.player, b.player))
"""


@query(_FOLD + "SELECT event, 1 AS round, slot, a, b, player AS winner FROM f1 UNION ALL SELECT event, 2, slot, a, b, player FROM f2")
def bracket_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds filled forward from results: byes pass in the first round, unplayed matches stay open."""
    return folded(slots(spark, sf_dir).select("event", F.lit(2).alias("rounds"), "slot", "player"), 2, matches(spark, sf_dir))


@query()
def bracket_fold_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every round of whole fields, to the final."""
    rows, rounds = brackets(spark, sf_dir)
    return folded(rows, rounds, matches(spark, sf_dir))


def folded(rows: DataFrame, rounds: int, m: DataFrame) -> DataFrame:
    """event, round, slot, a, b, winner; rows of event, rounds, slot, player."""
    results = staged(m.groupBy(F.least("winner", "loser").alias("lo"), F.greatest("winner", "loser").alias("hi")).agg(F.max_by("winner", F.struct("date", "match_id")).alias("w")))
    last = rows.select("event", "rounds").distinct()
    now, out = rows.select("event", "slot", "player"), None
    for r in range(1, rounds + 1):
        pair = _pairs(now).join(last.filter(F.col("rounds") >= r), "event", "left_semi")
        met = pair.join(results, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")) & F.col("a").isNotNull() & F.col("b").isNotNull(), "left")
        bye = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")) if r == 1 else F.lit(None).cast("bigint")
        done = met.select("event", F.lit(r).alias("round"), "slot", "a", "b", F.coalesce(bye, F.col("w")).alias("winner"))
        out = done if out is None else out.unionByName(done)
        now = done.select("event", "slot", F.col("winner").alias("player"))
    return out


_MATRIX = _SLOTS + """, top AS (SELECT * FROM field WHERE seed <= 8), pm AS (SELECT a.event, a.player AS i, b.player AS j, a.seed AS si, b.seed AS sj, 1 / (1 + pow(10,
  -(a.rating - b.rating) / 4000)) AS p FROM top a JOIN top b ON a.event = b.event AND a.seed < b.seed)"""

#: Players in a published matrix (a top-k report), as in the reference.
TOP = 120
_MATRIX_ALL = _MATRIX.replace("seed <= 8", f"seed <= {TOP}")


def matrix(spark: SparkSession, sf_dir: str, top: int = 8) -> DataFrame:
    """event, i, j, si, sj, p of the upper triangle over each event's best; the sides are bounded by ``top``."""
    ranked = fields(spark, sf_dir).withColumn("seed", F.row_number().over(W.partitionBy("event").orderBy(F.desc("rating"), "player"))).filter(F.col("seed") <= top)
    x, y = ranked.alias("x"), ranked.alias("y")
    return x.join(y, (F.col("x.event") == F.col("y.event")) & (F.col("x.seed") < F.col("y.seed"))).select(F.col("x.event").alias("event"), F.col("x.player").alias("i"), F.col("y.player").alias("j"), F.col("x.seed").alias("si"), F.col("y.seed").alias("sj"), chance().alias("p"))


_PAIRS = " SELECT event, i, j, round(p, 6) AS p FROM pm UNION ALL SELECT event, j, i, round(1 - p, 6) FROM pm"
_BAD = """, bad AS (SELECT event, i, j, CASE WHEN si = 1 AND sj = 2 THEN p + 0.1 ELSE p END AS p, 1 - p AS q
  FROM pm) SELECT event, i, j, CASE WHEN p < 0 OR p > 1 THEN 'range' ELSE 'complement' END AS problem FROM bad
  WHERE p < 0 OR p > 1 OR abs(p + q - 1) > 1e-6"""
_PACKED = """, n AS (SELECT event, count(*) AS k FROM top GROUP BY event) SELECT pm.event, CAST((si - 1) * (2 * k - si) / 2 + sj - si - 1 AS BIGINT) AS place,
  CAST(round(p * 10000) AS BIGINT) AS bps FROM pm JOIN n USING (event)"""


@query(_MATRIX + _PAIRS)
def pair_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirrored(matrix(spark, sf_dir))


@query(_MATRIX_ALL + _PAIRS)
def pair_matrix_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mirrored(matrix(spark, sf_dir, TOP))


def mirrored(upper: DataFrame) -> DataFrame:
    mirror = F.explode(F.array(F.struct("i", "j", "p"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (1 - F.col("p")).alias("p"))))
    return upper.select("event", mirror.alias("m")).select("event", "m.i", "m.j", F.round("m.p", 6).alias("p"))


@query(_MATRIX + _BAD)
def matrix_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells out of range or not complementary, in a matrix with one cell of each event damaged."""
    return contract(matrix(spark, sf_dir))


@query(_MATRIX_ALL + _BAD)
def matrix_contract_violations_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract(matrix(spark, sf_dir, TOP))


def contract(upper: DataFrame) -> DataFrame:
    m = upper.withColumn("q", 1 - F.col("p")).withColumn("p", F.when((F.col("si") == 1) & (F.col("sj") == 2), F.col("p") + 0.1).otherwise(F.col("p")))
    outside = (F.col("p") < 0) | (F.col("p") > 1)
    return m.filter(outside | (F.abs(F.col("p") + F.col("q") - 1) > 1e-6)).select("event", "i", "j", F.when(outside, "range").otherwise("complement").alias("problem"))


@query(_MATRIX + _PACKED)
def packed_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and basis points of the upper triangle in row order."""
    return packed(matrix(spark, sf_dir))


@query(_MATRIX_ALL + _PACKED)
def packed_triangle_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(matrix(spark, sf_dir, TOP))


def packed(m: DataFrame) -> DataFrame:
    size = m.groupBy("event").agg(F.max("sj").alias("k"))
    return m.join(size, "event").select("event", F.expr("(si - 1) * (2 * k - si) div 2 + sj - si - 1").cast("long").alias("place"), F.round(F.col("p") * 10000).cast("long").alias("bps"))


@query(MATCHES + """, f AS (SELECT event_id, arg_max({'w': winner, 'l': loser}, (date, match_id)) AS fin FROM matches WHERE round_order = 7
  GROUP BY event_id), s AS (SELECT event_id, winner, arg_max(loser, (date, match_id)) AS beat FROM matches WHERE round_order = 6
  GROUP BY ALL)\nSELECT f.event_id, f.fin.w AS slot0, a.beat AS slot1, f.fin.l AS slot2, b.beat AS slot3 FROM f LEFT
  JOIN s a ON a.event_id = f.event_id AND a.winner = f.fin.w LEFT JOIN s b ON b.event_id = f.event_id AND b.winner = f.fin.l""")
def reconstruct_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots rebuilt backwards from the final: each finalist with whom it beat in the semi-final."""
    m = matches(spark, sf_dir)
    last = [F.desc("date"), F.desc("match_id")]
    final = keep_best(m.filter("round_order = 7"), ["event_id"], last).select("event_id", F.col("winner").alias("slot0"), F.col("loser").alias("slot2"))
    semi = keep_best(m.filter("round_order = 6"), ["event_id", "winner"], last).select("event_id", "winner", "loser")
    one = semi.select("event_id", F.col("winner").alias("slot0"), F.col("loser").alias("slot1"))
    two = semi.select("event_id", F.col("winner").alias("slot2"), F.col("loser").alias("slot3"))
    return final.join(one, ["event_id", "slot0"], "left").join(two, ["event_id", "slot2"], "left").select("event_id", "slot0", "slot1", "slot2", "slot3")


@query()
def reconstruct_draw_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded(matches(spark, sf_dir))


def expanded(m: DataFrame) -> DataFrame:
    """event_id, slot, player: the last round's match expanded back to the event's first round, each player with whom it beat
    in the round before; one without a match there entered with a bye, keeps the first of its two places and is not expanded
    further. Rounds that an event lacks are passed over."""
    m = staged(m.select("event_id", "date", "match_id", "round_order", "winner", "loser"))
    last = [F.desc("date"), F.desc("match_id")]
    present = m.groupBy("event_id").agg(F.max("round_order").alias("top"))
    final = keep_best(m.join(present, "event_id").filter("round_order = top"), ["event_id"], last)
    two = F.explode(F.array(F.struct(F.lit(0).alias("slot"), F.col("winner").alias("player")), F.struct(F.lit(1).alias("slot"), F.col("loser").alias("player"))))
    now = final.select("event_id", "top", F.lit(True).alias("live"), two.alias("x")).select("event_id", "top", "live", "x.*")
    won = keep_best(m, ["event_id", "round_order", "winner"], last).select("event_id", "round_order", F.col("winner").alias("player"), "loser")
    played = m.select("event_id", "round_order").distinct()
    for r in range(6, 0, -1):
        here = played.filter(F.col("round_order") == r).select("event_id", F.lit(True).alias("here"))
        before = now.join(here, "event_id", "left").join(won.filter(F.col("round_order") == r).drop("round_order"), ["event_id", "player"], "left")
        goes = F.coalesce("here", F.lit(False)) & (F.col("top") > r)
        more = F.col("live") & F.col("loser").isNotNull()
        kept = F.struct(F.when(goes, 2 * F.col("slot")).otherwise(F.col("slot")).alias("slot"), F.col("player"))
        beat = F.when(goes & more, F.struct((2 * F.col("slot") + 1).alias("slot"), F.col("loser").alias("player")))
        now = before.select("event_id", "top", F.when(goes, more).otherwise(F.col("live")).alias("live"), F.explode(F.array_compact(F.array(kept, beat))).alias("x")).select("event_id", "top", "live", "x.*")
    return now.select("event_id", "slot", "player")
