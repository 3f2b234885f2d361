"""The forecast log: first sightings, hourly snapshots, timelines and grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.operators.merge import keep_best
from matchlake.operators.order import near
from matchlake.plans.registry import query
from matchlake.sources.adapters import MATCHES, forecasts, matches


@query(MATCHES + "SELECT match, min(as_of) AS as_of, arg_min(p, (as_of, event_id)) AS p, arg_min(version, (as_of, event_id)) AS version FROM forecasts GROUP BY match")
def forecast_first_sighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forecast of each match; later ones never replace it."""
    at = F.struct("as_of", "event_id")
    return forecasts(spark, sf_dir).groupBy("match").agg(F.min("as_of").alias("as_of"), F.min_by("p", at).alias("p"), F.min_by("version", at).alias("version"))


@query(MATCHES + """SELECT match, date_trunc('hour', as_of) AS hour, arg_max(event_id, (as_of, event_id)) AS event_id, arg_max(p, (as_of, event_id)) AS p FROM forecasts
  GROUP BY ALL""")
def snapshot_hour_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot of each match and hour."""
    at = F.struct("as_of", "event_id")
    return forecasts(spark, sf_dir).groupBy("match", F.date_trunc("hour", "as_of").alias("hour")).agg(F.max_by("event_id", at).alias("event_id"), F.max_by("p", at).alias("p"))


@query(MATCHES + """, h AS (SELECT match, date_trunc('hour', as_of) AS hour, arg_max(p, (as_of, event_id)) AS p FROM forecasts GROUP BY ALL)
SELECT match, hour, p, round(p - first_value(p) OVER w, 6) AS from_first, round(coalesce(p - lag(p) OVER w, 0), 6) AS step FROM h
  WINDOW w AS (PARTITION BY match ORDER BY hour)""")
def forecast_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("match").orderBy("hour")
    rows = snapshot_hour_dedup(spark, sf_dir)
    return rows.select("match", "hour", "p", F.round(F.col("p") - F.first("p").over(w), 6).alias("from_first"), F.round(F.coalesce(F.col("p") - F.lag("p").over(w), F.lit(0.0)), 6).alias("step"))


_GRADE = MATCHES + """, fc AS (SELECT match_id AS id, least(winner, loser) AS a, greatest(winner, loser) AS b, date - CAST(match_id % 25 AS INTEGER) AS as_of, CASE
  WHEN match_id % 2 = 0 THEN event_id END AS event_id, 0.3 + (match_id % 40) / 100.0 AS p FROM matches WHERE match_id % 4 < 2),
c AS (SELECT fc.id, m.match_id, m.winner = fc.a AS a_won, m.event_id = fc.event_id AS same FROM fc
  JOIN matches m ON least(m.winner, m.loser) = fc.a AND greatest(m.winner, m.loser) = fc.b AND date_diff('day', fc.as_of, m.date) BETWEEN -1 AND 21
  AND NOT m.walkover),
s AS (SELECT *, max(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS any_same
  FROM c), u AS (SELECT id, count(*) AS n, min(match_id) AS match_id, bool_and(a_won) AS a_won FROM s WHERE any_same = 0 OR same GROUP BY id),
graded AS (SELECT fc.id, fc.as_of, fc.p, CASE WHEN u.n = 1 THEN u.match_id END AS match_id, CASE WHEN u.n = 1 THEN CASE WHEN u.a_won THEN fc.p
  ELSE 1 - fc.p END END AS p_winner FROM fc LEFT JOIN u USING (id))
"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts with the one result of their pair between a day before and 21 days after; several leave it pending.

    A result of the same event goes before others.
    """
    key = F.col("match_id")
    m = matches(spark, sf_dir).select("match_id", "winner", "date", "event_id", "walkover", F.least("winner", "loser").alias("a"), F.greatest("winner", "loser").alias("b"))
    fc = m.filter(key % 4 < 2).select(key.alias("id"), "a", "b", F.date_sub("date", (key % 25).cast("int")).alias("as_of"), F.when(key % 2 == 0, F.col("event_id")).alias("wanted"), (F.lit(0.3) + (key % 40) / 100.0).alias("p"))
    cand = near(fc.select("id", "a", "b", "as_of", "wanted"), m.filter("not walkover"), ["a", "b"], "as_of", "date", -1, 21)
    other = (~F.coalesce(F.col("event_id") == F.col("wanted"), F.lit(False))).alias("other")
    each = cand.groupBy("id", other).agg(F.count("*").alias("n"), F.min("match_id").alias("match_id"), F.min(F.col("winner") == F.col("a")).alias("a_won"))
    best = each.groupBy("id").agg(F.min_by(F.struct("n", "match_id", "a_won"), "other").alias("r"))
    sure = F.col("r.n") == 1
    return fc.join(best, "id", "left").select("id", "as_of", "p", F.when(sure, F.col("r.match_id")).alias("match_id"), F.when(sure, F.when(F.col("r.a_won"), F.col("p")).otherwise(1 - F.col("p"))).alias("p_winner"))


@query(_GRADE + "SELECT id, match_id, round(p_winner, 6) AS p_winner FROM graded")
def grade_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select("id", "match_id", F.round("p_winner", 6).alias("p_winner"))


@query(_GRADE + """SELECT year(as_of) AS year, month(as_of) AS month, count(*) AS logged, count(p_winner) AS graded, count(*) - count(p_winner) AS pending,
  round(avg((1 - p_winner) * (1 - p_winner)), 6) AS brier, CAST(count(*) FILTER (WHERE p_winner > 0.5) AS BIGINT) AS hits FROM graded GROUP BY ALL""")
def grade_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_winner")
    return graded(spark, sf_dir).groupBy(F.year("as_of").alias("year"), F.month("as_of").alias("month")).agg(F.count("*").alias("logged"), F.count(p).alias("graded"), (F.count("*") - F.count(p)).alias("pending"), F.round(F.avg((1 - p) * (1 - p)), 6).alias("brier"), F.count_if(p > 0.5).alias("hits"))


_CHAMPION = MATCHES + """, champ AS (SELECT event_id, arg_max(winner, (date, match_id)) AS champion FROM matches WHERE round_order = 7 GROUP BY event_id),
field AS (SELECT event_id, player, count(*) + 0.0 AS w FROM pl WHERE event_id IN (SELECT event_id FROM champ)
  GROUP BY ALL), odds AS (SELECT *, w / sum(w) OVER (PARTITION BY event_id) AS p FROM field)
"""


@query(_CHAMPION + """SELECT o.event_id, round(sum(pow(p - CASE WHEN o.player = c.champion THEN 1 ELSE 0 END, 2)), 6) AS brier, arg_max(o.player, (p,
  -o.player)) = max(c.champion) AS hit, count(*) AS field FROM odds o JOIN champ c ON c.event_id = o.event_id GROUP BY o.event_id""")
def champion_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared error of title odds over an event's field, and whether the favourite won."""
    m = matches(spark, sf_dir)
    champ = m.filter("round_order = 7").groupBy("event_id").agg(F.max_by("winner", F.struct("date", "match_id")).alias("champion"))
    field = m.select("event_id", F.explode(F.array("winner", "loser")).alias("player")).groupBy("event_id", "player").agg(F.count("*").cast("double").alias("w"))
    joined = field.join(champ, "event_id").withColumn("p", F.col("w") / F.sum("w").over(W.partitionBy("event_id")))
    miss = F.pow(F.col("p") - (F.col("player") == F.col("champion")).cast("int"), 2)
    return joined.groupBy("event_id").agg(F.round(F.sum(miss), 6).alias("brier"), (F.max_by("player", F.struct("p", -F.col("player"))) == F.max("champion")).alias("hit"), F.count("*").alias("field"))


@query(MATCHES + """, legacy AS (SELECT match, min(as_of) AS as_of FROM forecasts WHERE event_id % 2 = 0
  GROUP BY match), modern AS (SELECT user_id * 8 + event_id % 8 AS match, event_id, min(ts) AS as_of FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
c AS (SELECT l.match, m.event_id FROM legacy l JOIN modern m ON m.match = l.match + 1 AND m.as_of BETWEEN l.as_of - INTERVAL 6 HOUR
  AND l.as_of + INTERVAL 6 HOUR)
SELECT match, min(event_id) AS event_id FROM c GROUP BY match HAVING count(*) = 1""")
def legacy_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old keys that have exactly one new key near in time."""
    f = forecasts(spark, sf_dir)
    old = f.filter("event_id % 2 = 0").groupBy("match").agg(F.min("as_of").alias("old_at"))
    new = f.filter("event_id % 2 = 1").select((F.col("match") - 1).alias("match"), "event_id", "as_of")
    near = F.col("as_of").between(F.col("old_at") - F.expr("INTERVAL 6 HOUR"), F.col("old_at") + F.expr("INTERVAL 6 HOUR"))
    return old.join(new, "match").filter(near).groupBy("match").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query(MATCHES + """SELECT f.event_id, f.match, f.p FROM forecasts f WHERE NOT EXISTS (SELECT 1 FROM forecasts g
  WHERE g.event_id % 3 = 0 AND g.match = f.match AND date_trunc('hour', g.as_of) = date_trunc('hour', f.as_of))""")
def log_append_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts whose match and hour are not in the log yet: the rows that an idempotent append adds."""
    f = forecasts(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "as_of"))
    return f.join(f.filter("event_id % 3 = 0").select("match", "hour"), ["match", "hour"], "left_anti").select("event_id", "match", "p")
