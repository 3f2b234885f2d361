"""Context of players before their matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.operators import context as c
from matchlake.plans.registry import query
from matchlake.sources.adapters import MATCHES, matches, player_long, players

_W = "PARTITION BY player ORDER BY date, event_id, round_order, match_id"


def sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_long(matches(spark, sf_dir))


@query(MATCHES + f"SELECT match_id, player, coalesce(day - lag(day) OVER ({_W}), 365) AS rest FROM pl")
def ctx_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir).select("match_id", "player", c.rest_days().alias("rest"))


@query(MATCHES + """SELECT match_id, player, CAST(sum(games_for + games_against) OVER (PARTITION BY player ORDER BY day RANGE BETWEEN 14 PRECEDING AND CURRENT ROW)
- sum(games_for + games_against) OVER (PARTITION BY player, day ORDER BY date, event_id, round_order, match_id ROWS BETWEEN CURRENT ROW
  AND UNBOUNDED FOLLOWING) AS BIGINT) AS workload FROM pl""")
def ctx_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir).select("match_id", "player", c.workload(14).alias("workload"))


@query(MATCHES + """, done AS (SELECT player, match_id, date, event_id, round_order, won, row_number() OVER w AS i FROM pl WHERE completed
  WINDOW w AS (PARTITION BY player ORDER BY date, event_id, round_order, match_id)),
pos AS (SELECT match_id, player, coalesce(count(*) FILTER (WHERE completed) OVER (PARTITION BY player ORDER BY date, event_id, round_order,
  match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM pl)
SELECT pos.match_id, pos.player, round(coalesce(avg(done.won), 0.5), 6) AS win_rate FROM pos LEFT
  JOIN done ON done.player = pos.player AND done.i <= pos.n AND done.i > pos.n - 10 GROUP BY pos.match_id, pos.player""")
def ctx_winrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = c.win_rate_bounded(sides(spark, sf_dir), 10)
    return rated.select("match_id", "player", F.round("win_rate", 6).alias("win_rate"))


@query(MATCHES + """SELECT match_id, player, CAST(coalesce(sum(won) OVER (PARTITION BY least(player, opponent), greatest(player, opponent), player ORDER BY date,
  event_id, round_order, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS h2h FROM pl""")
def ctx_h2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.head_to_head(sides(spark, sf_dir)).select("match_id", "player", "h2h")


@query(MATCHES + """SELECT match_id, player, surface, CAST(coalesce(sum(won) OVER (PARTITION BY least(player, opponent), greatest(player, opponent), player,
  surface ORDER BY date, event_id, round_order, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS h2h FROM pl""")
def ctx_h2h_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.head_to_head(sides(spark, sf_dir), "surface").select("match_id", "player", "surface", "h2h")


@query(MATCHES + """SELECT player, arg_max(surface, (date, event_id, round_order, match_id)) AS last_surface, arg_max(opponent, (date, event_id, round_order,
  match_id)) FILTER (WHERE svpt IS NOT NULL) AS last_with_stats,
max(date) AS last_date, count(*) AS n, round(max(p.age) + date_diff('day', max(date), DATE '2001-12-31') / 365.25, 6) AS age_asof, max(p.hand) AS hand
  FROM pl JOIN players p USING (player) GROUP BY player""")
def player_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest known values of each player."""
    at = F.struct("date", "event_id", "round_order", "match_id")
    rows = sides(spark, sf_dir).groupBy("player").agg(F.max_by("surface", at).alias("last_surface"), F.max_by("opponent", F.when(F.col("svpt").isNotNull(), at)).alias("last_with_stats"), F.max("date").alias("last_date"), F.count("*").alias("n"))
    joined = rows.join(players(spark, sf_dir).select("player", "age", "hand"), "player")
    age = F.round(F.col("age") + F.datediff(F.lit("2001-12-31"), "last_date") / 365.25, 6)
    return joined.select("player", "last_surface", "last_with_stats", "last_date", "n", age.alias("age_asof"), "hand")


@query(MATCHES + """, r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY date DESC, event_id DESC, round_order DESC, match_id DESC) AS place FROM pl)
SELECT player, place, opponent, won, date FROM r WHERE place <= 10""")
def recent_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc(x) for x in ("date", "event_id", "round_order", "match_id")]
    placed = sides(spark, sf_dir).withColumn("place", F.row_number().over(W.partitionBy("player").orderBy(*order)))
    return placed.filter("place <= 10").select("player", "place", "opponent", "won", "date")


@query(MATCHES + """, n AS (SELECT player, opponent, count(*) AS meetings, CAST(sum(won) AS BIGINT) AS wins FROM pl GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY meetings DESC, opponent) AS place FROM n) SELECT * FROM r WHERE place <= 8""")
def top_h2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = sides(spark, sf_dir).groupBy("player", "opponent").agg(F.count("*").alias("meetings"), F.sum("won").alias("wins"))
    return met.withColumn("place", F.row_number().over(W.partitionBy("player").orderBy(F.desc("meetings"), "opponent"))).filter("place <= 8")


@query(MATCHES + """SELECT CASE WHEN surface IS NULL THEN 'All' ELSE surface END AS surface, round(sum(sv_won) / sum(svpt), 6) AS serve,
  round(1 - sum(opp_won) / sum(opp_svpt), 6) AS ret, CAST(sum(svpt) AS BIGINT) AS points
FROM (SELECT surface, sv_won, svpt, opp_won, opp_svpt FROM pl UNION ALL SELECT NULL, sv_won, svpt, opp_won, opp_svpt FROM pl) GROUP BY surface""")
def serve_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points won on serve and return over all and by surface, in one rollup."""
    rolled = sides(spark, sf_dir).rollup("surface").agg(F.sum("sv_won").alias("w"), F.sum("svpt").alias("s"), F.sum("opp_won").alias("ow"), F.sum("opp_svpt").alias("os"))
    return rolled.select(F.coalesce("surface", F.lit("All")).alias("surface"), F.round(F.col("w") / F.col("s"), 6).alias("serve"), F.round(1 - F.col("ow") / F.col("os"), 6).alias("ret"), F.col("s").alias("points"))


@query(MATCHES + """, g AS (SELECT player, CAST(sum(sv_won) AS DOUBLE) AS a, CAST(sum(svpt - sv_won) AS DOUBLE) AS b, CAST(sum(opp_svpt - opp_won) AS DOUBLE) AS c,
  CAST(sum(svpt) AS BIGINT) AS svpt FROM pl GROUP BY player)
SELECT player, svpt, round(a / (a + b), 6) AS serve_share,
  round(-(a / (a + b + c) * ln(a / (a + b + c)) + b / (a + b + c) * ln(b / (a + b + c)) + c / (a + b + c) * ln(c / (a + b + c))) / ln(3),
  6) AS placement FROM g WHERE svpt >= 200""")
def style_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of grouped totals and the entropy of their split, for players with 200 served points."""
    from matchlake.functions.scalars import entropy

    g = sides(spark, sf_dir).groupBy("player").agg(F.sum("sv_won").cast("double").alias("a"), F.sum(F.col("svpt") - F.col("sv_won")).cast("double").alias("b"), F.sum(F.col("opp_svpt") - F.col("opp_won")).cast("double").alias("c"), F.sum("svpt").alias("svpt"))
    return g.filter("svpt >= 200").select("player", "svpt", F.round(F.col("a") / (F.col("a") + F.col("b")), 6).alias("serve_share"), F.round(entropy([F.col("a"), F.col("b"), F.col("c")]), 6).alias("placement"))
