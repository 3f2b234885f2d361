"""Published boards and the client's queries over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.operators.order import sequence
from matchlake.plans.metrics import _P, scored
from matchlake.plans.registry import query
from matchlake.sources.adapters import MATCHES, matches, player_long, players, table

_BOARD = MATCHES + """, act AS (SELECT player, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, max(date) AS last FROM pl
  GROUP BY player), pb AS (SELECT p.player, p.name, p.points, p.age, p.hand, a.n, a.wins, row_number() OVER (ORDER BY p.points DESC NULLS LAST,
  p.player) AS rank FROM players p JOIN act a USING (player))
"""


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players by ranking points, numbered without a task that sees them all."""
    acts = player_long(matches(spark, sf_dir)).groupBy("player").agg(F.count("*").alias("n"), F.sum("won").cast("long").alias("wins"))
    joined = players(spark, sf_dir).join(acts, "player").select("player", "name", "points", "age", "hand", "n", "wins")
    return sequence(joined, [F.coalesce(-F.col("points"), F.lit(1 << 40)), F.col("player")], "rank")


@query(_BOARD + "SELECT rank, player, name, points, age, hand, n, wins, round(wins / n, 6) AS share FROM pb")
def players_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board(spark, sf_dir).withColumn("share", F.round(F.col("wins") / F.col("n"), 6))


@query(_BOARD + "SELECT player, rank, age FROM pb WHERE age < 25 ORDER BY points DESC NULLS LAST, player LIMIT 100")
def rankings_age_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best under 25 (a top-k report)."""
    return board(spark, sf_dir).filter("age < 25").orderBy(F.desc_nulls_last("points"), "player").limit(100).select("player", "rank", "age")


@query(_BOARD + """SELECT player, row_number() OVER (ORDER BY points ASC NULLS LAST, player) AS up, row_number() OVER (ORDER BY points DESC NULLS LAST, player) AS down
  FROM pb""")
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.lit(1 << 40)
    up = sequence(board(spark, sf_dir).select("player", "points"), [F.coalesce("points", last), F.col("player")], "up")
    return sequence(up, [F.coalesce(-F.col("points"), last), F.col("player")], "down").select("player", "up", "down")


@query(_BOARD + """SELECT player, round((rank() OVER (ORDER BY points) - 1 + 0.5 * count(*) OVER (PARTITION BY points)) / count(*) OVER (), 6) AS pct,
  round(cume_dist() OVER (ORDER BY points), 6) AS at_most FROM pb WHERE points IS NOT NULL""")
def percentile_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-rank and inclusive percentiles; ranks come from counts of distinct values, not from all rows."""
    rows = board(spark, sf_dir).filter("points is not null")
    values = rows.groupBy("points").agg(F.count("*").alias("peers"))
    run = values.withColumns({"upto": F.sum("peers").over(W.orderBy("points")), "total": F.sum("peers").over(W.partitionBy())})
    placed = rows.select("player", "points").join(run, "points")
    return placed.select("player", F.round((F.col("upto") - 0.5 * F.col("peers")) / F.col("total"), 6).alias("pct"), F.round(F.col("upto") / F.col("total"), 6).alias("at_most"))


@query(_BOARD + """, q AS (SELECT unnest(['supplier', '1', '00000007', '#']) AS q)
SELECT q.q, player, CASE WHEN lower(name) = q THEN 4 WHEN starts_with(lower(name), q) THEN 3 WHEN contains(lower(name), '#' || q) THEN 2
  ELSE 1 END AS score FROM q JOIN pb ON contains(lower(name), q.q)""")
def search_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that hold a stated query: equal, prefix, behind a mark, anywhere."""
    name, q = F.lower("name"), F.col("q")
    asked = board(spark, sf_dir).withColumn("q", F.explode(F.array(*map(F.lit, ("supplier", "1", "00000007", "#")))))
    score = F.when(name == q, 4).when(F.startswith(name, q), 3).when(F.contains(name, F.concat(F.lit("#"), q)), 2).otherwise(1)
    return asked.filter(F.contains(name, q)).select("q", "player", score.alias("score"))


@query(_BOARD + """SELECT axis, n FROM (SELECT 'points' AS axis, count(points) AS n FROM pb UNION ALL SELECT 'age', count(age) FROM pb
  UNION ALL SELECT 'wins', count(nullif(wins, 0)) FROM pb UNION ALL SELECT 'none', 0) WHERE n >= 3""")
def axes_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = board(spark, sf_dir).agg(F.count("points").alias("points"), F.count("age").alias("age"), F.count(F.expr("nullif(wins, 0)")).alias("wins"), F.lit(0).cast("bigint").alias("none"))
    return counts.unpivot([], ["points", "age", "wins", "none"], "axis", "n").filter("n >= 3")


@query(_BOARD + """SELECT CAST(count(*) FILTER (WHERE points IS NOT NULL AND n > 0) AS BIGINT) AS shown,
  CAST(count(*) FILTER (WHERE points IS NULL) AS BIGINT) AS missing, round(corr(points, wins), 6) AS corr FROM pb""")
def plottable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board(spark, sf_dir).agg(F.count_if(F.col("points").isNotNull() & (F.col("n") > 0)).alias("shown"), F.count_if(F.col("points").isNull()).alias("missing"), F.round(F.corr(F.col("points").cast("double"), F.col("wins").cast("double")), 6).alias("corr"))


_FIX = _P + """, fx AS (SELECT match_id, date, surface, tier, round_order, winner, loser, floor(p * 1000 + 0.5) / 1000 AS p FROM ab)
"""


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed matches with the shipped probability (three decimals) and whether it was an upset by it."""
    rows = scored(spark, sf_dir).withColumn("p", F.floor(F.col("p") * 1000 + 0.5) / 1000)
    return rows.withColumn("upset", F.col("p") < 0.5)


@query(_FIX + ", l AS (SELECT * FROM fx ORDER BY date DESC, match_id DESC LIMIT 60) SELECT match_id, p, p < 0.5 AS upset FROM l")
def fixtures_upset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 60 results (a top-k report)."""
    return fixtures(spark, sf_dir).orderBy(F.desc("date"), F.desc("match_id")).limit(60).select("match_id", "p", "upset")


@query(_FIX + """SELECT surface, count(*) AS n, CAST(count(*) FILTER (WHERE p < 0.5) AS BIGINT) AS upsets, CAST(count(*) FILTER (WHERE p >= 0.5) AS BIGINT) AS called
  FROM fx GROUP BY surface""")
def result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures(spark, sf_dir).groupBy("surface").agg(F.count("*").alias("n"), F.count_if("upset").alias("upsets"), F.count_if(~F.col("upset")).alias("called"))


_WATCH = _FIX + """, wt AS (SELECT match_id, date, round(0.30 * (1 - 2 * abs(p - 0.5)) + 0.25 * (6 - tier) / 5.0 + 0.15 * round_order / 7.0 + 0.15 * CASE
  WHEN surface = 'Grass' THEN 1 ELSE 0 END + 0.15 * greatest(p, 1 - p), 6) AS score FROM fx)
"""


@query(_WATCH + "SELECT match_id, score, row_number() OVER (PARTITION BY date ORDER BY score DESC, match_id) AS rank FROM wt")
def watch_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five weighted factors, ranked within the day."""
    p = F.col("p")
    score = 0.30 * (1 - 2 * F.abs(p - 0.5)) + 0.25 * (6 - F.col("tier")) / 5.0 + 0.15 * F.col("round_order") / 7.0 + 0.15 * (F.col("surface") == "Grass").cast("int") + 0.15 * F.greatest(p, 1 - p)
    rows = fixtures(spark, sf_dir).select("match_id", "date", F.round(score, 6).alias("score"))
    return rows.select("match_id", "score", F.row_number().over(W.partitionBy("date").orderBy(F.desc("score"), "match_id")).alias("rank"))


@query(_FIX + """SELECT date, arg_min(match_id, (abs(p - 0.5), match_id)) AS closest, arg_max(match_id, (p, -match_id)) AS surest, count(*) AS n FROM fx GROUP BY date""")
def closest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures(spark, sf_dir).groupBy("date").agg(F.min_by("match_id", F.struct(F.abs(F.col("p") - 0.5), "match_id")).alias("closest"), F.max_by("match_id", F.struct("p", -F.col("match_id"))).alias("surest"), F.count("*").alias("n"))


@query(MATCHES + """SELECT event_id, array_to_string(list(CAST(match_id AS VARCHAR) ORDER BY date, -round_order, match_id), ',') AS matches
  FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY date, round_order DESC, match_id) AS i FROM matches) WHERE i <= 3 GROUP BY event_id""")
def upcoming_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three matches of each event by day, round depth and id."""
    m = matches(spark, sf_dir).withColumn("i", F.row_number().over(W.partitionBy("event_id").orderBy("date", F.desc("round_order"), "match_id"))).filter("i <= 3")
    return m.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "match_id"))), lambda x: x["match_id"].cast("string")), ",").alias("matches"))


@query(MATCHES + "SELECT event_id, match_id, row_number() OVER (PARTITION BY event_id ORDER BY date, round_order DESC, match_id) AS place FROM matches")
def upcoming_order_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of each event with its place by day, round depth and id."""
    place = F.row_number().over(W.partitionBy("event_id").orderBy("date", F.desc("round_order"), "match_id"))
    return matches(spark, sf_dir).select("event_id", "match_id", place.cast("long").alias("place"))


@query(MATCHES + """, s AS (SELECT match_id, event_id, least(winner, loser) AS a, greatest(winner, loser) AS b FROM matches
  WHERE match_id % 2 = 0), v AS (SELECT DISTINCT event_id, least(winner, loser) AS a, greatest(winner, loser) AS b FROM matches WHERE match_id % 2 = 1)
SELECT match_id FROM s ANTI JOIN v USING (event_id, a, b)""")
def exclude_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir).select("match_id", "event_id", F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b"))
    return m.filter("match_id % 2 = 0").join(m.filter("match_id % 2 = 1"), ["event_id", "a", "b"], "left_anti").select("match_id")


@query(_BOARD + "SELECT player, substr(sha256(name), 1, 16) || '.json' AS file, substr(sha256(name), 1, 1) AS shard FROM pb")
def profile_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable file names of profiles, from the first digits of a hash."""
    digest = F.sha2("name", 256)
    return board(spark, sf_dir).select("player", F.concat(F.substring(digest, 1, 16), F.lit(".json")).alias("file"), F.substring(digest, 1, 1).alias("shard"))


@query(MATCHES + """, t AS (SELECT event_id, min(date) AS start, max(date) AS finish, min(tier) AS tier FROM matches
  GROUP BY event_id), r AS (SELECT DATE '1998-06-01' AS now)
SELECT event_id, CASE WHEN finish < now THEN 'completed' WHEN start > now THEN 'upcoming' ELSE 'active' END AS status,
  row_number() OVER (ORDER BY CASE WHEN start <= now AND finish >= now THEN 0 WHEN start > now THEN 1 ELSE 2 END, finish DESC, tier, event_id) AS place
  FROM t, r""")
def tournament_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle of events at a stated day, and their order."""
    now = F.lit("1998-06-01").cast("date")
    t = matches(spark, sf_dir).groupBy("event_id").agg(F.min("date").alias("start"), F.max("date").alias("finish"), F.min("tier").alias("tier"))
    status = F.when(F.col("finish") < now, "completed").when(F.col("start") > now, "upcoming").otherwise("active")
    order = F.when(status == "active", 0).when(status == "upcoming", 1).otherwise(2)
    led = 1_000_000 * order - F.unix_date("finish")  # status first, then the latest
    return sequence(t.withColumn("status", status), [led, F.col("tier"), F.col("event_id")], "place").select("event_id", "status", "place")
