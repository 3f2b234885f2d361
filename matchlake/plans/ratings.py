"""Rating and serve walks, boards over them, and the point model."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from matchlake.functions import scalars as s
from matchlake.operators import ratings as r
from matchlake.operators.order import long_fold
from matchlake.operators.ratings import Rating
from matchlake.plans.registry import query
from matchlake.sources.adapters import MATCHES, ORDER, matches, players



def walk_sql(r: Rating) -> str:
    """The walk as one recursion whose row holds the state as lists: e, n, lp (overall, matches, last day) of each player,
    se, sn (ratings, matches) of each player and surface."""
    number = lambda x: f"CAST({x} AS DOUBLE)"
    blend = lambda n: f"{r.blend} * {n} / ({n} + {number(r.blend_half)})" if r.blend_half else str(r.blend)
    miss = lambda a, b: f"(1 - 1 / (1 + pow(10, -({a} - {b}) * ds / 400)))"
    boost = lambda x: f"CASE WHEN day - {x} > {r.layoff_days} THEN 1 + {r.layoff_boost} * least((day - {x}) / 365.0, 2.0) ELSE 1.0 END" if r.layoff_days else "1.0"
    own = lambda p: f"3 * {p} - 2 + si"
    skip = "walkover" if r.skip_walkovers else "FALSE"
    return MATCHES.replace("WITH qty", "WITH RECURSIVE qty", 1) + f""", ids AS (SELECT player, row_number() OVER (ORDER BY player) AS i FROM (SELECT DISTINCT player FROM pl)), cnt AS (SELECT count(*) AS k FROM ids),
o AS (SELECT m.*, a.i AS wi, b.i AS li, CASE surface WHEN 'Hard' THEN 0 WHEN 'Clay' THEN 1 ELSE 2 END AS si, row_number() OVER (PARTITION BY tour ORDER BY date, event_id, round_order, match_id) AS seq,
    CASE WHEN x.ioc = CAST(split_part(event_id, '-', 1) AS INTEGER) THEN {r.home} ELSE 0.0 END AS wh, CASE WHEN y.ioc = CAST(split_part(event_id, '-', 1) AS INTEGER) THEN {r.home} ELSE 0.0 END AS lh,
    m.tier_k * CASE WHEN completed THEN least(1 + {r.margin} * ln(1 + abs(w_games - l_games)), {r.cap}) WHEN walkover THEN 1.0 ELSE {r.retired} END AS wt, {skip} AS skipped, CASE WHEN best_of = 5 THEN {r.best_of_5} ELSE 1.0 END AS ds
  FROM matches m JOIN ids a ON a.player = m.winner JOIN ids b ON b.player = m.loser LEFT JOIN players x ON x.player = m.winner LEFT JOIN players y ON y.player = m.loser),
walk AS (
  SELECT tour, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS match_id, CAST(0 AS BIGINT) AS winner, CAST(0 AS BIGINT) AS loser, DATE '1970-01-01' AS date, '' AS surface, {", ".join(f"{number(0)} AS {c}" for c in ("w_elo", "l_elo", "w_selo", "l_selo", "w_belo", "l_belo", "stretch", "w_after", "l_after"))},
    CAST(0 AS BIGINT) AS w_n, CAST(0 AS BIGINT) AS l_n, FALSE AS counted, (SELECT list_transform(range(k), lambda x: {number(1500)}) FROM cnt) AS e, (SELECT list_transform(range(3 * k), lambda x: CAST(NULL AS DOUBLE)) FROM cnt) AS se,
    (SELECT list_transform(range(k), lambda x: CAST(0 AS BIGINT)) FROM cnt) AS n, (SELECT list_transform(range(3 * k), lambda x: CAST(0 AS BIGINT)) FROM cnt) AS sn, (SELECT list_transform(range(k), lambda x: CAST(NULL AS BIGINT)) FROM cnt) AS lp
  FROM (SELECT DISTINCT tour FROM o)
  UNION ALL
  SELECT tour, seq, match_id, winner, loser, date, surface, we, le, ws, ls, bw, bl, ds, CASE WHEN skipped THEN we ELSE we + dw END, CASE WHEN skipped THEN le ELSE le - dl END, CASE WHEN skipped THEN wn ELSE wn + 1 END, CASE WHEN skipped THEN ln_ ELSE ln_ + 1 END, NOT skipped,
    CASE WHEN skipped THEN e ELSE list_transform(e, lambda x, i: CASE WHEN i = wi THEN we + dw WHEN i = li THEN le - dl ELSE x END) END,
    CASE WHEN skipped THEN se ELSE list_transform(se, lambda x, i: CASE WHEN i = {own("wi")} THEN ws + dsw WHEN i = {own("li")} THEN ls - dsl
      WHEN {r.transfer} > 0 AND i BETWEEN 3 * wi - 2 AND 3 * wi THEN coalesce(x, we) + {r.transfer} * dsw WHEN {r.transfer} > 0 AND i BETWEEN 3 * li - 2 AND 3 * li THEN coalesce(x, le) - {r.transfer} * dsl ELSE x END) END,
    CASE WHEN skipped THEN n ELSE list_transform(n, lambda x, i: CASE WHEN i = wi OR i = li THEN x + 1 ELSE x END) END, CASE WHEN skipped THEN sn ELSE list_transform(sn, lambda x, i: CASE WHEN i = {own("wi")} OR i = {own("li")} THEN x + 1 ELSE x END) END,
    CASE WHEN skipped THEN lp ELSE list_transform(lp, lambda x, i: CASE WHEN i = wi OR i = li THEN day ELSE x END) END
  FROM (SELECT *, {r.k} / pow(wn + {r.offset}, {r.shape}) * wt * wb * eo AS dw, {r.k} / pow(ln_ + {r.offset}, {r.shape}) * wt * lb * eo AS dl,
      {r.surface_k} / pow(wsn + {r.surface_offset}, {r.surface_shape}) * wt * wb * es AS dsw, {r.surface_k} / pow(lsn + {r.surface_offset}, {r.surface_shape}) * wt * lb * es AS dsl
    FROM (SELECT *, (1 - {blend("wsn")}) * we + {blend("wsn")} * ws AS bw, (1 - {blend("lsn")}) * le + {blend("lsn")} * ls AS bl, {miss("(we + wh)", "(le + lh)")} AS eo, {miss("(ws + wh)", "(ls + lh)")} AS es, {boost("wl")} AS wb, {boost("ll")} AS lb
      FROM (SELECT o.tour, o.seq, o.match_id, o.winner, o.loser, o.date, CAST(o.day AS BIGINT) AS day, o.surface, o.wi, o.li, o.si, o.wt, o.wh, o.lh, o.ds, o.skipped, walk.e, walk.se, walk.n, walk.sn, walk.lp, walk.e[o.wi] AS we, walk.e[o.li] AS le, walk.n[o.wi] AS wn, walk.n[o.li] AS ln_,
          coalesce(walk.se[3 * o.wi - 2 + o.si], walk.e[o.wi]) AS ws, coalesce(walk.se[3 * o.li - 2 + o.si], walk.e[o.li]) AS ls, walk.sn[3 * o.wi - 2 + o.si] AS wsn, walk.sn[3 * o.li - 2 + o.si] AS lsn, walk.lp[o.wi] AS wl, walk.lp[o.li] AS ll
        FROM walk JOIN o ON o.tour = walk.tour AND o.seq = walk.seq + 1)))),
elo AS (SELECT * FROM walk WHERE seq > 0),
after AS (SELECT tour, seq, match_id, winner AS player, w_after AS elo, w_n AS n, date, surface FROM elo WHERE counted UNION ALL SELECT tour, seq, match_id, loser, l_after, l_n, date, surface FROM elo WHERE counted)
"""


_WALK = walk_sql(Rating())
#: Settings with every rule of the walk at work.
ALL_RULES = Rating(k=145, shape=0.21, surface_k=52, surface_shape=0.33, blend=0.63, margin=0.22, cap=2.0, transfer=0.27, blend_half=10, home=30, skip_walkovers=True, retired=0.72, layoff_days=60, layoff_boost=0.44, best_of_5=1.28)


#: Settings of the two tours; tours take turns in them.
TUNED, TUNED_SERVE = (r.ATP, r.WTA), (r.SERVE_ATP, r.SERVE_WTA)


def with_homes(spark: SparkSession, sf_dir: str, m: DataFrame) -> DataFrame:
    """Whether each side plays at home."""
    host = F.split("event_id", "-")[0].cast("int")
    for side, who in (("w", "winner"), ("l", "loser")):
        m = m.join(players(spark, sf_dir).select(F.col("player").alias(who), F.col("ioc").alias("_ioc")), who, "left").withColumn(f"{side}_home", F.coalesce((F.col("_ioc") == host).cast("int"), F.lit(0))).drop("_ioc")
    return m


def elo(spark: SparkSession, sf_dir: str, rating: Rating | tuple[Rating, ...] | None = None, m: DataFrame | None = None, states: bool = False, targets: DataFrame | None = None, ends: bool = False) -> DataFrame:
    """The rating walk over all matches, or over ``m``; with ``states`` also what it knows of both sides after each, with ``ends``
    also the last states of all players (``parted``). With ``targets``, matches to come, its rows are theirs: what it knows
    before each of them."""
    settings = rating if isinstance(rating, tuple) else (rating or Rating(),)
    m = matches(spark, sf_dir) if m is None else m
    m = with_homes(spark, sf_dir, m) if any(x.home for x in settings) else m.withColumns({"w_home": F.lit(0), "l_home": F.lit(0)})
    if targets is not None:
        none = {"w_games": F.lit(0), "l_games": F.lit(0), "completed": F.lit(False), "walkover": F.lit(False), "w_home": F.lit(0), "l_home": F.lit(0)}
        return long_fold(met(m, targets.withColumns(none)), "tour", [*ORDER, "played"], lambda: r.RatingWalk(*settings).foretold, r.ELO)
    if ends:
        return with_ends(m, r.rating_walk(*settings), r.ELO)
    fold = r.rating_history if states else r.rating_walk
    return long_fold(m, "tour", list(ORDER), fold(*settings), f"{r.ELO}, {r.STATES}" if states else r.ELO)


def with_ends(m: DataFrame, start: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """A walk's rows, and after them a row for each tour and player with the last state, in one pass."""
    width = len(schema.split(", "))
    return long_fold(m, "tour", list(ORDER), start, f"{schema}, {r.LEFT}", lambda tour, step: r.left(tour, step, width))


def parted(walk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A staged walk with ends as its rows, and tour, player, state of all players."""
    return walk.filter("match_id is not null").drop("state"), walk.filter("match_id is null").select("tour", F.col("winner").alias("player"), "state")


def met(m: DataFrame, targets: DataFrame) -> DataFrame:
    """Matches that were played and targets, told by ``played``; at the same place in the order a target comes first."""
    return m.withColumn("played", F.lit(True)).unionByName(targets.withColumn("played", F.lit(False)), allowMissingColumns=True)


def after(walk: DataFrame) -> DataFrame:
    """One row for each player and counted match with the rating after it."""
    walk = walk.filter("counted")
    both = F.explode(F.array(F.struct(F.col("winner").alias("player"), F.col("w_after").alias("elo"), F.col("w_n").alias("n")), F.struct(F.col("loser").alias("player"), F.col("l_after").alias("elo"), F.col("l_n").alias("n"))))
    return walk.select("tour", "match_id", "date", "surface", both.alias("x")).select("tour", "match_id", "date", "surface", "x.*")


@query(_WALK + "SELECT match_id, round(w_elo, 6) AS w_elo, round(l_elo, 6) AS l_elo, round(w_after, 6) AS w_after, round(l_after, 6) AS l_after FROM elo")
def elo_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elo(spark, sf_dir).select("match_id", *[F.round(c, 6).alias(c) for c in ("w_elo", "l_elo", "w_after", "l_after")])


@query(_WALK + """SELECT match_id, surface, round(w_selo, 6) AS w_selo, round(l_selo, 6) AS l_selo, round(1 / (1 + pow(10,
  -((w_elo + w_selo) / 2 - (l_elo + l_selo) / 2) / 400)), 6) AS p_blend FROM elo""")
def elo_surface_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elo(spark, sf_dir).select("match_id", "surface", *[F.round(c, 6).alias(c) for c in ("w_selo", "l_selo", "p_blend")])


@query(_WALK + """, last AS (SELECT tour, player, arg_max(elo, n) AS elo, max(n) AS matches, max(date) AS last_date FROM after GROUP BY ALL),
active AS (SELECT * FROM last WHERE last_date >= (SELECT max(date) FROM elo) - 550), board AS (SELECT *,
  row_number() OVER (PARTITION BY tour ORDER BY elo DESC, player) AS rank FROM active)
SELECT tour, rank, player, round(elo, 6) AS elo, matches, last_date FROM board WHERE rank <= 20""")
def elo_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best active players of each tour."""
    last = after(elo(spark, sf_dir)).groupBy("tour", "player").agg(F.max_by("elo", "n").alias("elo"), F.max("n").cast("long").alias("matches"), F.max("date").alias("last_date"))
    latest = last.agg(F.max("last_date").alias("latest"))
    active = last.join(F.broadcast(latest)).filter(F.col("last_date") >= F.date_sub("latest", 550))
    ranked = active.withColumn("rank", F.row_number().over(W.partitionBy("tour").orderBy(F.desc("elo"), "player"))).filter("rank <= 20")
    return ranked.select("tour", "rank", "player", F.round("elo", 6).alias("elo"), "matches", "last_date")


@query(_WALK + "SELECT tour, player, year(date) AS year, month(date) AS month, round(arg_min(elo, n), 6) AS elo FROM after GROUP BY ALL")
def elo_monthly_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rating after a match in each month. Rows are dealt by player before they are summed up: a walk's one task of a tour
    would hold nearly as many groups as rows."""
    monthly = after(elo(spark, sf_dir)).repartition("tour", "player").groupBy("tour", "player", F.year("date").alias("year"), F.month("date").alias("month")).agg(F.min_by("elo", "n").alias("elo"))
    return monthly.withColumn("elo", F.round("elo", 6))


@query(_WALK + """, last AS (SELECT tour, player, arg_max(elo, n) AS elo, max(date) AS asof FROM after GROUP BY ALL),
old AS (SELECT a.tour, a.player, arg_max(a.elo, a.n) AS elo FROM after a JOIN last l ON l.tour = a.tour AND l.player = a.player
  AND a.date <= l.asof - 90 GROUP BY ALL)
SELECT l.tour, l.player, round(coalesce(l.elo - o.elo, 0), 6) AS form FROM last l LEFT JOIN old o ON o.tour = l.tour AND o.player = l.player""")
def elo_form_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating now less the last one 90 days or more before: an as-of lookup inside the player's window."""
    rows = after(elo(spark, sf_dir)).withColumn("asof", F.max("date").over(W.partitionBy("tour", "player")))
    old = F.max_by("elo", F.when(F.col("date") <= F.date_sub("asof", 90), F.col("n")))
    return rows.groupBy("tour", "player").agg(F.round(F.coalesce(F.max_by("elo", "n") - old, F.lit(0.0)), 6).alias("form"))


@query(_WALK + """, h AS (SELECT tour, player, year(date) * 12 + month(date) AS m, arg_min(elo, n) AS elo FROM after GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY tour, player ORDER BY m DESC) AS place FROM h)
SELECT tour, player, count(*) AS points, round(arg_min(elo, place) - arg_max(elo, place), 6) AS delta FROM p WHERE place <= 13 GROUP BY tour, player
  HAVING count(*) >= 4""")
def movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change over the last 13 monthly points, of players with 4 or more."""
    month = (F.year("date") * 12 + F.month("date")).alias("m")
    monthly = after(elo(spark, sf_dir)).groupBy("tour", "player", month).agg(F.min_by("elo", "n").alias("elo"))
    last = monthly.withColumn("place", F.row_number().over(W.partitionBy("tour", "player").orderBy(F.desc("m")))).filter("place <= 13")
    return last.groupBy("tour", "player").agg(F.count("*").alias("points"), F.round(F.min_by("elo", "place") - F.max_by("elo", "place"), 6).alias("delta")).filter("points >= 4")


@query(walk_sql(ALL_RULES) + f""", sd AS (SELECT tour, seq, match_id, winner AS player, date, w_elo AS now FROM elo UNION ALL SELECT tour, seq, match_id, loser, date, l_elo FROM elo),
pv AS (SELECT s.*, (SELECT max(a.date) FROM after a WHERE a.tour = s.tour AND a.player = s.player AND a.seq < s.seq) AS prev FROM sd s),
fm AS (SELECT p.match_id, p.player, round(coalesce(p.now - arg_max(a.elo, a.seq), 0), 6) AS form FROM pv p LEFT JOIN after a ON a.tour = p.tour AND a.player = p.player AND a.seq < p.seq AND a.date <= p.date - {int(ALL_RULES.form_days)} AND a.date >= p.prev - {int(ALL_RULES.keep_days)} GROUP BY p.match_id, p.player, p.now)
SELECT e.match_id, round(w_elo, 6) AS w_elo, round(l_elo, 6) AS l_elo, round(w_selo, 6) AS w_selo, round(l_selo, 6) AS l_selo, round(w_belo, 6) AS w_belo, round(1 / (1 + pow(10, -(w_belo - l_belo) * stretch / 400)), 6) AS p_blend,
  round(w_after, 6) AS w_after, counted, f.form AS w_form, g.form AS l_form FROM elo e JOIN fm f ON f.match_id = e.match_id AND f.player = e.winner JOIN fm g ON g.match_id = e.match_id AND g.player = e.loser""")
def rating_walk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk with transfer between surfaces, adaptive blend, home bonus, skipped walkovers, weighted retirements, layoffs,
    long matches and form."""
    columns = ("w_elo", "l_elo", "w_selo", "l_selo", "w_belo", "p_blend", "w_after", "w_form", "l_form")
    return elo(spark, sf_dir, ALL_RULES).select("match_id", *[F.round(c, 6).alias(c) for c in columns], "counted")


def league(m: DataFrame) -> tuple[float, dict[str, float]]:
    """Serve points won in the league, and by surface."""
    served = m.filter("w_svpt is not null").groupBy("surface").agg(F.sum(F.col("w_won") + F.col("l_won")).alias("won"), F.sum(F.col("w_svpt") + F.col("l_svpt")).alias("n")).collect()  # a row a surface
    total = sum(x["n"] for x in served)
    return (sum(x["won"] for x in served) / total if total else 0.62), {x["surface"]: x["won"] / x["n"] for x in served}


def with_point_chance(df: DataFrame) -> DataFrame:
    """Add ``p_point``, the match's chance by points, from the sides' points won on serve (pa, pb) and best_of."""

    def priced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(p_point=r.point_match(frame["pa"].to_numpy(), frame["pb"].to_numpy(), frame["best_of"].to_numpy()))

    return df.mapInPandas(priced, T.StructType([*df.schema.fields, T.StructField("p_point", T.DoubleType())]))


def served(m: DataFrame) -> DataFrame:
    """Matches with serve counts as numbers, 0 where unknown."""
    counts = ["w_svpt", "w_won", "l_svpt", "l_won"]
    return m.withColumns({c: F.col(c).cast("double") for c in counts}).fillna(0.0, counts)


def serve(spark: SparkSession, sf_dir: str, settings: r.Serve | tuple[r.Serve, ...] | None = None, m: DataFrame | None = None, targets: DataFrame | None = None, ends: bool = False) -> DataFrame:
    """The serve walk, its league averages taken from the same matches, with the point model's chance ``p_point``; with
    ``targets``, matches to come, its rows are theirs: what it knows before each of them. With ``ends`` also the last states of
    all players (``parted``), and the chance is left to the caller."""
    settings = settings if isinstance(settings, tuple) else (settings or r.Serve(),)
    m = matches(spark, sf_dir) if m is None else m
    average, base = league(m)

    rows, order, told = served(m), list(ORDER), targets is not None
    if told:
        none = {"event": F.lit(""), **{c: F.lit(0.0) for c in ("w_svpt", "w_won", "l_svpt", "l_won")}}
        rows, order = met(rows, targets.withColumns(none)), [*order, "played"]

    def start():
        walk = r.ServeWalk(*settings, average=average, base=base)
        return walk.foretold if told else walk.step

    if ends:
        return with_ends(rows, start, r.SERVE)
    return with_point_chance(long_fold(rows, "tour", order, start, r.SERVE))


@query()
def serve_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serve and return skills by surface, venue effects and the point model's chance before each match; a test holds it to a
    plain restatement."""
    return serve(spark, sf_dir, r.Serve(venue_shrink=2000.0))


@query("""SELECT part.p_partkey, round(p, 6) AS p, round(pow(p, 4) * (1 + 4 * (1 - p) + 10 * (1 - p) * (1 - p)) + 20 * pow(p * (1 - p),
  3) * p * p / (1 - 2 * p * (1 - p)), 6) AS hold FROM part JOIN (SELECT p_partkey, 0.3 + (p_size % 50) / 100.0 AS p FROM part) USING (p_partkey)""")
def hold_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.lit(0.3) + (F.col("p_size") % 50) / 100.0
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.round(p, 6).alias("p"), F.round(s.hold_probability(p), 6).alias("hold"))


@query("""WITH x AS (SELECT p_partkey, 0.05 + (p_partkey % 90) / 100.0 AS q FROM part)
SELECT p_partkey, round(q * q * (3 - 2 * q), 6) AS best_of_3, round(q * q * q * (10 - 15 * q + 6 * q * q), 6) AS best_of_5 FROM x""")
def match_from_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.lit(0.05) + (F.col("p_partkey") % 90) / 100.0
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.round(s.match_from_set(q, F.lit(3)), 6).alias("best_of_3"), F.round(s.match_from_set(q, F.lit(5)), 6).alias("best_of_5"))


@query("""WITH x AS (SELECT p_partkey, 0.05 + (p_partkey % 90) / 100.0 AS q FROM part)
SELECT p_partkey, sets, lost, round(CASE sets WHEN 2 THEN CASE lost WHEN 0 THEN q * q ELSE 2 * q * q * (1 - q) END ELSE CASE lost
  WHEN 0 THEN q * q * q WHEN 1 THEN 3 * q * q * q * (1 - q) ELSE 6 * q * q * q * (1 - q) * (1 - q) END END, 6) AS p
FROM x, (VALUES (2, 0), (2, 1), (3, 0), (3, 1), (3, 2)) AS v(sets, lost)""")
def set_score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of each score in sets: binomial ways to lose sets before the last one is won."""
    q = F.lit(0.05) + (F.col("p_partkey") % 90) / 100.0
    scores = [(n, k) for n in (2, 3) for k in range(n)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("sets"), F.lit(k).alias("lost"), F.round(math.comb(n - 1 + k, k) * F.pow(q, n) * F.pow(1 - q, k), 6).alias("p")) for n, k in scores]))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", each.alias("x")).select("p_partkey", "x.*")


@query("""WITH RECURSIVE x AS (SELECT p_partkey, 0.05 + (p_partkey % 90) / 100.0 AS p FROM part),
b AS (SELECT p_partkey, p, 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi FROM x
  UNION ALL SELECT p_partkey, p, i + 1, CASE WHEN m * m * (3 - 2 * m) < p THEN m ELSE lo END, CASE WHEN m * m * (3 - 2 * m) < p THEN hi ELSE m END
  FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE i < 60))
SELECT p_partkey, round((lo + hi) / 2, 6) AS set_p FROM b WHERE i = 60""")
def set_from_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.lit(0.05) + (F.col("p_partkey") % 90) / 100.0
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.round(s.set_from_match(p, 3), 6).alias("set_p"))


@query()
def set_chance_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of a set for the distinct pairs of serve and return shares (two decimals), averaged over who serves first.

    The pairs are reduced to a grid before the dynamic program runs on it, all of a batch at once.
    """
    m = matches(spark, sf_dir).filter("w_svpt is not null")
    grid = m.select(F.round(F.col("w_won") / F.col("w_svpt"), 2).alias("a"), F.round(1 - F.col("l_won") / F.col("l_svpt"), 2).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, y = (frame[c].clip(*r.CLIP).to_numpy() for c in "ab")
            yield frame.assign(p=(r.set_chance(x, y) + 1 - r.set_chance(1 - y, 1 - x)) / 2)

    return grid.mapInPandas(run, "a double, b double, n bigint, p double")
