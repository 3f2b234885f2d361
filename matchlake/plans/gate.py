"""Data-quality invariants: every check is a query for its violations (check, key, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.functions.scalars import event_key
from matchlake.plans.registry import query
from matchlake.plans.sim import brackets, chance
from matchlake.operators.bracket import propagate
from matchlake.plans.track import snapshot_hour_dedup
from matchlake.sources.adapters import MATCHES, matches, player_long, players, table


def violations(rows: DataFrame, check: str, key: Column, when: Column, message: Column) -> DataFrame:
    """Rows for which ``when`` holds, as violations."""
    return rows.filter(when).select(F.lit(check).alias("check"), key.cast("string").alias("key"), message.cast("string").alias("message"))


@query(MATCHES + """SELECT 'games' AS "check", CAST(match_id AS VARCHAR) AS key,
  'completed with ' || CAST(w_games AS VARCHAR) || '-' || CAST(l_games AS VARCHAR) AS message FROM matches WHERE completed AND w_games <= l_games + 2
UNION ALL SELECT 'level', CAST(match_id AS VARCHAR), draw_level || ' in tier ' || CAST(tier AS VARCHAR) FROM matches
  WHERE draw_level = 'qual' AND tier = 1
UNION ALL SELECT 'served', CAST(match_id AS VARCHAR), 'won ' || CAST(w_won AS VARCHAR) FROM matches WHERE w_won > w_svpt OR l_won > l_svpt""")
def gate_match_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row checks in one scan: each row carries the list of what it violates."""
    m = matches(spark, sf_dir)
    text = lambda *x: F.concat(*[c if isinstance(c, Column) else F.lit(c) for c in x])
    checks = [
        ("games", F.col("completed") & (F.col("w_games") <= F.col("l_games") + 2), text("completed with ", F.col("w_games").cast("string"), "-", F.col("l_games").cast("string"))),
        ("level", (F.col("draw_level") == "qual") & (F.col("tier") == 1), text(F.col("draw_level"), " in tier ", F.col("tier").cast("string"))),
        ("served", (F.col("w_won") > F.col("w_svpt")) | (F.col("l_won") > F.col("l_svpt")), text("won ", F.col("w_won").cast("string"))),
    ]
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(name).alias("check"), message.alias("message"))) for name, when, message in checks]))
    return m.select("match_id", F.explode(found).alias("v")).select("v.check", F.col("match_id").cast("string").alias("key"), "v.message")


@query("""SELECT 'duplicate' AS "check", CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) AS key,
  CAST(count(*) AS VARCHAR) || ' rows' AS message FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def gate_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return violations(n, "duplicate", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")), F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" rows")))


@query("""SELECT 'orphan' AS "check", CAST(l_orderkey AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS message FROM lineitem l WHERE NOT EXISTS (SELECT 1
  FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P') GROUP BY l_orderkey""")
def gate_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    lost = table(spark, sf_dir, "lineitem").join(known, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return violations(lost, "orphan", F.col("l_orderkey"), F.lit(True), F.col("n"))


@query(MATCHES + """, n AS (SELECT year, count(*) AS n, CAST(count(w_svpt) AS DOUBLE) / count(*) AS share FROM matches
  GROUP BY year), c AS (SELECT *, lag(n) OVER (ORDER BY year) AS before FROM n)
SELECT 'volume' AS "check", CAST(year AS VARCHAR) AS key, CAST(n AS VARCHAR) || ' after ' || CAST(before AS VARCHAR) AS message FROM c
  WHERE n < 0.6 * before UNION ALL SELECT 'coverage', CAST(year AS VARCHAR), 'statistics' FROM c WHERE share < 0.888""")
def gate_source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = matches(spark, sf_dir).groupBy("year").agg(F.count("*").alias("n"), (F.count("w_svpt") / F.count("*")).alias("share"))
    c = n.withColumn("before", F.lag("n").over(W.orderBy("year")))  # one row a year
    volume = violations(c, "volume", F.col("year"), F.col("n") < 0.6 * F.col("before"), F.concat_ws(" after ", F.col("n").cast("string"), F.col("before").cast("string")))
    return volume.unionByName(violations(c, "coverage", F.col("year"), F.col("share") < 0.888, F.lit("statistics")))


@query(MATCHES + """, h AS (SELECT match, date_trunc('hour', as_of) AS hour, arg_max(p, (as_of, event_id)) AS p FROM forecasts
  GROUP BY ALL), s AS (SELECT *, lag(hour) OVER (PARTITION BY match ORDER BY hour) AS before, lag(p) OVER (PARTITION BY match ORDER BY hour) AS q
  FROM h)
SELECT 'order' AS "check", CAST(match AS VARCHAR) AS key, 'jump' AS message FROM s WHERE abs(p - q) > 0.9
  UNION ALL SELECT 'range', CAST(match AS VARCHAR), 'certain' FROM s WHERE p <= 0 OR p >= 0.999""")
def gate_forecast_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("match").orderBy("hour")
    s = snapshot_hour_dedup(spark, sf_dir).withColumn("q", F.lag("p").over(w))
    jump = violations(s, "order", F.col("match"), F.abs(F.col("p") - F.col("q")) > 0.9, F.lit("jump"))
    return jump.unionByName(violations(s, "range", F.col("match"), (F.col("p") <= 0) | (F.col("p") >= 0.999), F.lit("certain")))


@query()
def gate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact reach of whole fields: none is expected to be wrong; a test plants what this finds."""
    rows, rounds = brackets(spark, sf_dir)
    reach = propagate(rows, "event", rounds, chance()).filter("player is not null")
    return projection_problems(reach, rows.select("event", F.col("rounds").alias("round")).distinct())


def projection_problems(reach: DataFrame, last: DataFrame) -> DataFrame:
    """Reach that grows with the round, and titles that don't add up to one. last: the final round of each event."""
    step = reach.withColumn("before", F.lag("reach").over(W.partitionBy("event", "player").orderBy("round")))
    grows = violations(step, "monotone", F.concat_ws("/", F.col("event").cast("string"), F.col("player").cast("string")), F.col("reach") > F.col("before") + 1e-9, F.lit("grows"))
    title = reach.join(last, ["event", "round"]).groupBy("event").agg(F.sum("reach").alias("mass"))
    return grows.unionByName(violations(title, "mass", F.col("event"), F.abs(F.col("mass") - 1) > 1e-9, F.lit("title mass")))


@query(MATCHES + """, e AS (SELECT event_id, count(*) FILTER (WHERE round_order = 7) AS finals, count(*) AS n FROM matches
  GROUP BY event_id) SELECT 'finals' AS "check", event_id AS key, CAST(finals AS VARCHAR) || CASE WHEN n > 50 THEN '' ELSE ' [advisory]' END AS message
  FROM e WHERE finals <> 1""")
def gate_event_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without exactly one final; small events are advisory only."""
    e = matches(spark, sf_dir).groupBy("event_id").agg(F.count_if(F.col("round_order") == 7).alias("finals"), F.count("*").alias("n"))
    return violations(e, "finals", F.col("event_id"), F.col("finals") != 1, F.concat(F.col("finals").cast("string"), F.when(F.col("n") > 50, "").otherwise(" [advisory]")))


@query(MATCHES + """, n AS (SELECT event, tour, surface, count(*) AS n FROM matches GROUP BY ALL), t AS (SELECT event, tour, arg_max(surface, (n, surface)) AS surface
  FROM n GROUP BY ALL)
SELECT 'split' AS "check", a.event || '/' || b.event AS key, a.surface || ' and ' || b.surface AS message FROM t a
  JOIN t b ON substr(a.event, 1, 1) = substr(b.event, 1, 1) AND a.event < b.event AND a.surface <> b.surface""")
def gate_cross_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with like names whose main surfaces differ (one row an event and tour)."""
    n = matches(spark, sf_dir).groupBy("event", "tour", "surface").agg(F.count("*").alias("n"))
    t = n.groupBy("event", "tour").agg(F.max_by("surface", F.struct("n", "surface")).alias("surface")).withColumn("k", F.substring("event", 1, 1))
    both = t.alias("a").join(t.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.event") < F.col("b.event")))
    return violations(both, "split", F.concat_ws("/", "a.event", "b.event"), F.col("a.surface") != F.col("b.surface"), F.concat_ws(" and ", "a.surface", "b.surface"))


@query()
def gate_cross_tour_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over every season; the supplied tables name no event in two tours, so none are expected."""
    return surface_splits(matches(spark, sf_dir))


def surface_splits(m: DataFrame) -> DataFrame:
    """Events of the same whole name in two tours that overlap by two days or more, with different main surfaces."""
    n = m.groupBy("event_id", "event", "tour", "surface").agg(F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    t = n.groupBy("event_id", "event", "tour").agg(F.max_by("surface", F.struct("n", "surface")).alias("surface"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).withColumn("k", event_key(F.col("event")))
    both = t.alias("a").join(t.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.tour") < F.col("b.tour")) & (F.datediff(F.least("a.hi", "b.hi"), F.greatest("a.lo", "b.lo")) >= 2))
    return violations(both, "split", F.concat_ws("/", "a.event_id", F.col("a.tour").cast("string"), "b.event_id", F.col("b.tour").cast("string")), F.col("a.surface") != F.col("b.surface"), F.concat_ws(" and ", "a.surface", "b.surface"))


@query(MATCHES + """, want AS (SELECT event_id FROM matches GROUP BY event_id), ship AS (SELECT event_id FROM matches WHERE tier <= 4 AND match_id % 11 = 0
  GROUP BY event_id)
SELECT 'event' AS "check", w.event_id AS key, 'not shipped' AS message FROM want w LEFT JOIN ship s USING (event_id) WHERE s.event_id IS NULL""")
def gate_event_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unshipped(matches(spark, sf_dir))


@query(MATCHES + """, want AS (SELECT event_id FROM matches GROUP BY event_id), ship AS (SELECT event_id FROM matches WHERE tier <= 4 AND match_id % 11 = 0
  GROUP BY event_id)
SELECT 'event' AS "check", w.event_id AS key, 'not shipped' AS message FROM want w LEFT JOIN ship s USING (event_id) WHERE s.event_id IS NULL""")
def gate_event_coverage_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over every season."""
    return unshipped(matches(spark, sf_dir))


def unshipped(m: DataFrame) -> DataFrame:
    lost = m.select("event_id").distinct().exceptAll(m.filter("tier <= 4 and match_id % 11 = 0").select("event_id").distinct())
    return violations(lost, "event", F.col("event_id"), F.lit(True), F.lit("not shipped"))


@query(MATCHES + """, v AS (SELECT CASE WHEN completed AND w_games <= l_games + 2 THEN 'games' WHEN draw_level = 'qual' AND tier = 1 THEN 'level' END AS c, tour
  FROM matches)
SELECT c AS "check", tour, count(*) AS n, CASE WHEN c = 'games' THEN TRUE ELSE FALSE END AS blocks FROM v WHERE c IS NOT NULL GROUP BY ALL""")
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations counted by check and tour; advisory ones don't block."""
    c = F.when(F.col("completed") & (F.col("w_games") <= F.col("l_games") + 2), "games").when((F.col("draw_level") == "qual") & (F.col("tier") == 1), "level")
    return matches(spark, sf_dir).select(c.alias("check"), "tour").filter(F.col("check").isNotNull()).groupBy("check", "tour").agg(F.count("*").alias("n")).withColumn("blocks", F.col("check") == "games")
