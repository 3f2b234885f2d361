"""Scores of forecasts: levels, calibration, paired differences, segments, drift and receipts.

The probability of the winner is the share of the two sides' ranking points; the other arm is the equal-odds prior
shrunk toward it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.plans.features import with_bios
from matchlake.plans.registry import query
from matchlake.sources.adapters import MATCHES
from matchlake.sources.files import staged

_P = MATCHES + """, pr AS (SELECT m.match_id, m.date, m.year, m.tour, m.surface, m.tier, m.round_order, m.winner, m.loser, (coalesce(w.points,
  0) + 100.0) / (coalesce(w.points, 0) + coalesce(l.points, 0) + 200.0) AS p
  FROM matches m JOIN players w ON w.player = m.winner JOIN players l ON l.player = m.loser WHERE m.completed),
ab AS (SELECT *, 0.5 + (p - 0.5) * 0.6 AS q, ln(greatest(p, 1e-12)) AS lp, ln(greatest(0.5 + (p - 0.5) * 0.6, 1e-12)) AS lq FROM pr)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p and q of the winner of every completed match."""
    w, l = F.coalesce("w_points", F.lit(0)), F.coalesce("l_points", F.lit(0))
    rows = with_bios(spark, sf_dir).filter("completed").withColumn("p", (w + 100.0) / (w + l + 200.0))
    return rows.select("match_id", "date", "year", "tour", "surface", "tier", "round_order", "winner", "loser", "p", (0.5 + (F.col("p") - 0.5) * 0.6).alias("q"))


def log_loss(p: Column) -> Column:
    return -F.log(F.greatest(p, F.lit(1e-12)))


def accuracy(p: Column) -> Column:
    return F.when(p > 0.5, 1.0).when(p == 0.5, 0.5).otherwise(0.0)


@query(_P + """SELECT tour, count(*) AS n, round(avg(CASE WHEN p > 0.5 THEN 1.0 WHEN p = 0.5 THEN 0.5 ELSE 0.0 END), 6) AS acc, round(avg(-lp), 6) AS logloss,
  round(avg((1 - p) * (1 - p)), 6) AS brier FROM ab GROUP BY tour""")
def metrics_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    return scored(spark, sf_dir).groupBy("tour").agg(F.count("*").alias("n"), F.round(F.avg(accuracy(p)), 6).alias("acc"), F.round(F.avg(log_loss(p)), 6).alias("logloss"), F.round(F.avg((1 - p) * (1 - p)), 6).alias("brier"))


_EDGES = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]


@query(_P + """, s AS (SELECT CASE WHEN match_id % 2 = 0 THEN p ELSE 1 - p END AS f, CASE WHEN match_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS y FROM ab)
SELECT """ + " + ".join(f"(CASE WHEN f >= {e} THEN 1 ELSE 0 END)" for e in _EDGES) + " AS bin, count(*) AS n, round(avg(f), 6) AS mean_p, round(avg(y), 6) AS mean_y FROM s GROUP BY 1")
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten half-open bins by explicit edges; empty ones are left out."""
    even = F.col("match_id") % 2 == 0
    rows = scored(spark, sf_dir).select(F.when(even, F.col("p")).otherwise(1 - F.col("p")).alias("f"), F.when(even, 1.0).otherwise(0.0).alias("y"))
    place = sum([F.when(F.col("f") >= e, 1).otherwise(0) for e in _EDGES[1:]], F.when(F.col("f") >= _EDGES[0], 1).otherwise(0))
    return rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("mean_p"), F.round(F.avg("y"), 6).alias("mean_y"))


def paired() -> list[Column]:
    d = log_loss(F.col("p")) - log_loss(F.col("q"))
    se = F.stddev_samp(d) / F.sqrt(F.count("*"))
    return [F.count("*").alias("n"), F.round(F.avg(log_loss(F.col("p"))), 6).alias("model"), F.round(F.avg(log_loss(F.col("q"))), 6).alias("other"), F.round(F.avg(d), 6).alias("d"), F.round(se, 6).alias("se"), F.round(F.try_divide(F.avg(d), se), 4).alias("t")]


_PAIRED = "count(*) AS n, round(avg(-lp), 6) AS model, round(avg(-lq), 6) AS other, round(avg(lq - lp), 6) AS d, round(stddev_samp(lq - lp) / sqrt(count(*)), 6) AS se, round(avg(lq - lp) / nullif(stddev_samp(lq - lp) / sqrt(count(*)), 0), 4) AS t"


@query(_P + f"SELECT surface, {_PAIRED} FROM ab GROUP BY surface")
def paired_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("surface").agg(*paired())


@query(_P + f"SELECT year, {_PAIRED} FROM ab GROUP BY year")
def per_year_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("year").agg(*paired())


@query(_P + f""", seg AS (SELECT *, unnest(list_filter(['surface:' || surface, 'tier:' || CAST(tier AS VARCHAR), CASE WHEN greatest(p, 1 - p) >= 0.7 THEN 'favourite' END, CASE WHEN round_order >= 6 THEN 'late' END, CASE WHEN abs(p - q) > 0.1 THEN 'apart' END, 'month:' || CAST(month(date) AS VARCHAR)], lambda x: x IS NOT NULL)) AS segment FROM ab)
SELECT segment, {_PAIRED} FROM seg GROUP BY segment""")
def segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paired block for overlapping segments: labels are exploded, then grouped once."""
    p, q = F.col("p"), F.col("q")
    labels = F.array_compact(F.array(F.concat(F.lit("surface:"), "surface"), F.concat(F.lit("tier:"), F.col("tier").cast("string")), F.when(F.greatest(p, 1 - p) >= 0.7, "favourite"), F.when(F.col("round_order") >= 6, "late"), F.when(F.abs(p - q) > 0.1, "apart"), F.concat(F.lit("month:"), F.month("date").cast("string"))))
    return scored(spark, sf_dir).select("*", F.explode(labels).alias("segment")).groupBy("segment").agg(*paired())


@query(_P + """, w AS (SELECT CASE WHEN year < 1999 THEN 'tune' ELSE 'val' END AS part, count(*) AS n, avg(lq - lp) AS d, stddev_samp(lq - lp) / sqrt(count(*)) AS se
  FROM ab GROUP BY 1),
y AS (SELECT CASE WHEN year < 1999 THEN 'tune' ELSE 'val' END AS part, year, avg(lq - lp) AS d FROM ab GROUP BY ALL)
SELECT w.part, w.n, round(w.d, 6) AS d, round(w.se, 6) AS se, count(*) AS years, CAST(count(*) FILTER (WHERE y.d > 0) AS BIGINT) AS positive, CASE
  WHEN w.d > 2 * w.se AND count(*) FILTER (WHERE y.d > 0) * 2 > count(*) THEN 'PASS' ELSE 'REJECT' END AS verdict
FROM w JOIN y USING (part) GROUP BY w.part, w.n, w.d, w.se""")
def ab_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the arms by window with the years it holds in; sums by year are enough for both."""
    d = log_loss(F.col("p")) - log_loss(F.col("q"))
    part = F.when(F.col("year") < 1999, "tune").otherwise("val")
    years = scored(spark, sf_dir).withColumn("d", d).groupBy(part.alias("part"), "year").agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"))
    total = years.groupBy("part").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count("*").alias("years"), F.count_if(F.col("s") > 0).alias("positive"))
    mean = F.col("s") / F.col("n")
    se = F.sqrt((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1)) / F.sqrt("n")
    verdict = F.when((mean > 2 * se) & (F.col("positive") * 2 > F.col("years")), "PASS").otherwise("REJECT")
    return total.select("part", "n", F.round(mean, 6).alias("d"), F.round(se, 6).alias("se"), "years", "positive", verdict.alias("verdict"))


@query(MATCHES + """SELECT tour, count(*) AS n, round(avg(CASE WHEN coalesce(w.points, 0) > coalesce(l.points, 0) THEN 1.0 WHEN coalesce(w.points, 0) = coalesce(l.points,
  0) THEN 0.5 ELSE 0.0 END), 6) AS acc
FROM matches m JOIN players w ON w.player = m.winner JOIN players l ON l.player = m.loser GROUP BY tour""")
def rank_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, l = F.coalesce("w_points", F.lit(0)), F.coalesce("l_points", F.lit(0))
    return with_bios(spark, sf_dir).groupBy("tour").agg(F.count("*").alias("n"), F.round(F.avg(F.when(w > l, 1.0).when(w == l, 0.5).otherwise(0.0)), 6).alias("acc"))


@query(_P + """, r AS (SELECT * FROM ab WHERE date > (SELECT max(date) FROM ab) - 90), s AS (SELECT count(*) AS n, avg(-lp) AS loss,
  avg(-(p * ln(p) + (1 - p) * ln(1 - p))) AS entropy, stddev_samp(-lp + p * ln(p) + (1 - p) * ln(1 - p)) / sqrt(count(*)) AS se FROM r)
SELECT n, round(loss, 6) AS loss, round(entropy, 6) AS entropy, round(se, 6) AS se, (n >= 150 AND loss - entropy > 2.5 * se
  AND loss - entropy > 0.02) AS fires FROM s""")
def drift_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-loss above what the forecasts themselves expect, over the last 90 days."""
    p = F.col("p")
    expect = -(p * F.log(p) + (1 - p) * F.log(1 - p))
    rows = staged(scored(spark, sf_dir))
    last = rows.join(F.broadcast(rows.agg(F.max("date").alias("latest")))).filter(F.col("date") > F.date_sub("latest", 90))
    s = last.agg(F.count("*").alias("n"), F.avg(log_loss(p)).alias("loss"), F.avg(expect).alias("entropy"), (F.stddev_samp(log_loss(p) - expect) / F.sqrt(F.count("*"))).alias("se"))
    over = F.col("loss") - F.col("entropy")
    return s.select("n", F.round("loss", 6).alias("loss"), F.round("entropy", 6).alias("entropy"), F.round("se", 6).alias("se"), ((F.col("n") >= 150) & (over > 2.5 * F.col("se")) & (over > 0.02)).alias("fires"))


@query(_P + """, b AS (SELECT 'best' AS kind, match_id, round(p, 6) AS p FROM ab ORDER BY round(p, 6) DESC, match_id LIMIT 10), m AS (SELECT 'worst' AS kind,
  match_id, round(p, 6) AS p FROM ab ORDER BY round(p, 6), match_id LIMIT 10)
SELECT * FROM b UNION ALL SELECT * FROM m""")
def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best calls and the ten worst misses (a top-k report)."""
    rows = scored(spark, sf_dir).select("match_id", F.round("p", 6).alias("p"))
    best = rows.orderBy(F.desc("p"), "match_id").limit(10).select(F.lit("best").alias("kind"), "match_id", "p")
    return best.unionByName(rows.orderBy("p", "match_id").limit(10).select(F.lit("worst").alias("kind"), "match_id", "p"))


@query(_P + """SELECT month(date) AS month, round(avg(abs(p - q)), 6) AS mean, round(quantile_cont(abs(p - q), 0.95), 6) AS p95,
  CAST(count(*) FILTER (WHERE abs(p - q) > 0.05) AS BIGINT) AS over, count(DISTINCT winner) AS names FROM ab GROUP BY 1""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.abs(F.col("p") - F.col("q"))
    return scored(spark, sf_dir).groupBy(F.month("date").alias("month")).agg(F.round(F.avg(gap), 6).alias("mean"), F.round(F.percentile(gap, F.lit(0.95)), 6).alias("p95"), F.count_if(gap > 0.05).alias("over"), F.count_distinct("winner").alias("names"))


@query(_P + """, w AS (SELECT winner AS player, p, 1 AS won, date, match_id FROM ab UNION ALL SELECT loser, 1 - p, 0, date, match_id
  FROM ab), r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY date DESC, match_id DESC) AS i FROM w)
SELECT player, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, round(sum(p), 6) AS expected, round(sum(won) - sum(p), 6) AS delta FROM r
  WHERE i <= 10 GROUP BY player""")
def player_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins over the last ten decisions against what was forecast."""
    side = lambda k, p, w: F.struct(F.col(k).alias("player"), p.alias("p"), F.lit(w).alias("won"))
    both = scored(spark, sf_dir).select("date", "match_id", F.explode(F.array(side("winner", F.col("p"), 1), side("loser", 1 - F.col("p"), 0))).alias("x")).select("date", "match_id", "x.*")
    last = both.withColumn("i", F.row_number().over(W.partitionBy("player").orderBy(F.desc("date"), F.desc("match_id")))).filter("i <= 10")
    return last.groupBy("player").agg(F.count("*").alias("n"), F.sum("won").cast("long").alias("wins"), F.round(F.sum("p"), 6).alias("expected"), F.round(F.sum("won") - F.sum("p"), 6).alias("delta"))
