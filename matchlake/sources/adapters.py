"""Match facts derived from the order tables: the order's two largest suppliers are winner and loser.

``MATCHES`` is the same derivation in SQL (common table expressions), for the oracles.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.functions import scalars as s
from matchlake.sources.files import staged

#: Chronological order of matches.
ORDER = ("date", "event_id", "round_order", "match_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FACTS: ContextVar[dict[tuple[str, str], DataFrame]] = ContextVar("facts", default={})


@contextmanager
def facts(spark: SparkSession, sf_dir: str) -> Iterator[None]:
    """Make the tables that many parts of a query derive (matches, players) once: they are written, and what is built inside
    reads them."""
    made = {(name, sf_dir): staged(make(spark, sf_dir)) for name, make in (("matches", matches), ("players", players))}
    before = _FACTS.set(made)
    try:
        yield
    finally:
        _FACTS.reset(before)


def pairings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, winner, loser, wq, lq: suppliers of each order by quantity, in one aggregation per order."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    totals = line.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    ranked = totals.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((-F.col("q")).alias("q"), F.col("l_suppkey").alias("p")))).alias("s"))
    first, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))  # filters on what follows may be moved before the size's
    return ranked.filter(F.size("s") > 1).select(F.col("l_orderkey").alias("match_id"), first["p"].alias("winner"), second["p"].alias("loser"), (-first["q"]).alias("wq"), (-second["q"]).alias("lq"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The match fact table: one winner-oriented row for each match."""
    if ("matches", sf_dir) in _FACTS.get():
        return _FACTS.get()["matches", sf_dir]
    return matches_with(spark, sf_dir)


def matches_with(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The match fact table with more columns of its pairing (wq, lq), so that no order is summed up again for them."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("date"), "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    key, wq, lq = F.col("match_id"), F.col("wq").cast("int"), F.col("lq").cast("int")
    rows = pairings(spark, sf_dir).join(orders, F.col("match_id") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    sets = F.concat(F.lit("6-"), (lq % 5).cast("string"), F.when(key % 7 == 0, F.lit(" 7-6(4)")).otherwise(F.concat(F.lit(" 6-"), ((wq + lq) % 5).cast("string"))))
    score = F.when(key % 53 == 0, F.lit(None)).when(key % 41 == 0, F.lit("W/O")).when(key % 23 == 0, F.concat(sets, F.lit(" RET"))).otherwise(sets)
    serve = key % 9 != 0
    rows = rows.select(
        "match_id", *more, "date", F.datediff("date", F.lit("1970-01-01")).alias("day"), F.year("date").alias("year"), "winner", "loser",
        F.col("n_regionkey").alias("tour"),
        F.when(F.col("o_orderstatus") == "F", "Hard").when(F.col("o_orderstatus") == "O", "Clay").otherwise("Grass").alias("surface"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("tier"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 5).otherwise(3).alias("best_of"),
        F.concat_ws("-", F.col("c_nationkey").cast("string"), F.year("date").cast("string")).alias("event_id"), F.col("n_name").alias("event"),
        (key % 7 + 1).cast("int").alias("round_order"), score.alias("score"),
        F.when(key % 10 < 7, "main").when(key % 10 < 9, "chall").otherwise("qual").alias("draw_level"),
        F.when(serve, 40 + wq).alias("w_svpt"), F.when(serve, 40 + lq).alias("l_svpt"),
        F.when(serve, F.floor((40 + wq) * 0.65)).cast("int").alias("w_won"), F.when(serve, F.floor((40 + lq) * 0.55)).cast("int").alias("l_won"),
    )
    parsed = rows.withColumn("parsed", s.parsed_score(F.col("score")))
    return parsed.select(*rows.columns, (F.lit(1.15) - 0.05 * F.col("tier")).alias("tier_k"), F.col("parsed.winner_games").alias("w_games"), F.col("parsed.loser_games").alias("l_games"), F.col("parsed.sets").alias("sets"), F.col("parsed.completed").alias("completed"), F.col("parsed.walkover").alias("walkover"))


def player_long(games: DataFrame) -> DataFrame:
    """Two rows for each match, one from each side."""
    def side(me: str, other: str, won: int) -> F.Column:
        p, o = me[0], other[0]
        return F.struct(F.col(me).alias("player"), F.col(other).alias("opponent"), F.lit(won).alias("won"), F.col(f"{p}_games").alias("games_for"), F.col(f"{o}_games").alias("games_against"), F.col(f"{p}_svpt").alias("svpt"), F.col(f"{p}_won").alias("sv_won"), F.col(f"{o}_svpt").alias("opp_svpt"), F.col(f"{o}_won").alias("opp_won"))

    both = games.withColumn("side", F.explode(F.array(side("winner", "loser", 1), side("loser", "winner", 0))))
    return both.select("match_id", "date", "day", "year", "tour", "surface", "tier", "tier_k", "best_of", "event_id", "event", "round_order", "draw_level", "completed", "walkover", "side.*")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """player, name, ioc, hand, ht, age, points of each supplier."""
    if ("players", sf_dir) in _FACTS.get():
        return _FACTS.get()["players", sf_dir]
    supplier = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return supplier.select(key.alias("player"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("ioc"), F.when(key % 7 == 0, "L").otherwise("R").alias("hand"), F.when(key % 11 == 0, F.lit(None)).otherwise(170 + key % 30).cast("int").alias("ht"), (18 + key % 20).cast("double").alias("age"), F.when(F.col("s_acctbal") > 0, F.floor("s_acctbal")).cast("int").alias("points"))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast log from events: match (user and hour of day), as_of, p, version."""
    e = table(spark, sf_dir, "events")
    value = F.abs(F.col("value"))
    return e.select("event_id", F.col("ts").cast("timestamp").alias("as_of"), (F.col("user_id") * 8 + F.col("event_id") % 8).alias("match"), F.col("user_id").alias("player"), F.round(value / (value + 50.0), 6).alias("p"), F.col("event_type").alias("version"), F.get_json_object("props", "$.k").cast("int").alias("k"))


MATCHES = """
WITH qty AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey, l_suppkey),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY q DESC, l_suppkey) AS rn FROM qty),
base AS (
  SELECT a.l_orderkey AS match_id, a.l_suppkey AS winner, b.l_suppkey AS loser, CAST(a.q AS INTEGER) AS wq, CAST(b.q AS INTEGER) AS lq,
    CAST(o.o_orderdate AS DATE) AS date, o.o_orderstatus AS st, o.o_orderpriority AS pr, c.c_nationkey AS nk, n.n_name AS event, n.n_regionkey AS tour
  FROM ranked a JOIN ranked b ON a.l_orderkey = b.l_orderkey AND a.rn = 1 AND b.rn = 2
  JOIN orders o ON o.o_orderkey = a.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey),
scored AS (
  SELECT *, '6-' || CAST(lq % 5 AS VARCHAR) || CASE WHEN match_id % 7 = 0 THEN ' 7-6(4)' ELSE ' 6-' || CAST((wq + lq) % 5 AS VARCHAR) END AS setss,
    lq % 5 AS g1, CASE WHEN match_id % 7 = 0 THEN 6 ELSE (wq + lq) % 5 END AS g2, CASE WHEN match_id % 7 = 0 THEN 7 ELSE 6 END AS h2,
    (match_id % 53 = 0 OR match_id % 41 = 0) AS walkover FROM base),
matches AS (
  SELECT match_id, date, date_diff('day', DATE '1970-01-01', date) AS day, year(date) AS year, winner, loser, tour,
    CASE st WHEN 'F' THEN 'Hard' WHEN 'O' THEN 'Clay' ELSE 'Grass' END AS surface, CAST(substr(pr, 1, 1) AS INTEGER) AS tier,
    CASE WHEN pr = '1-URGENT' THEN 5 ELSE 3 END AS best_of, CAST(nk AS VARCHAR) || '-' || CAST(year(date) AS VARCHAR) AS event_id, event,
    match_id % 7 + 1 AS round_order,
    CASE WHEN match_id % 53 = 0 THEN NULL WHEN match_id % 41 = 0 THEN 'W/O' WHEN match_id % 23 = 0 THEN setss || ' RET' ELSE setss END AS score,
    CASE WHEN match_id % 10 < 7 THEN 'main' WHEN match_id % 10 < 9 THEN 'chall' ELSE 'qual' END AS draw_level,
    CASE WHEN match_id % 9 <> 0 THEN 40 + wq END AS w_svpt, CASE WHEN match_id % 9 <> 0 THEN 40 + lq END AS l_svpt,
    CASE WHEN match_id % 9 <> 0 THEN CAST(floor((40 + wq) * CAST(0.65 AS DOUBLE)) AS INTEGER) END AS w_won,
    CASE WHEN match_id % 9 <> 0 THEN CAST(floor((40 + lq) * CAST(0.55 AS DOUBLE)) AS INTEGER) END AS l_won,
    CAST(1.15 AS DOUBLE) - CAST(0.05 AS DOUBLE) * CAST(substr(pr, 1, 1) AS INTEGER) AS tier_k,
    CASE WHEN walkover THEN 0 ELSE 6 + h2 END AS w_games, CASE WHEN walkover THEN 0 ELSE g1 + g2 END AS l_games, CASE WHEN walkover THEN 0 ELSE 2 END AS sets,
    (NOT walkover AND match_id % 23 <> 0) AS completed, walkover
  FROM scored),
pl AS (
  SELECT match_id, date, day, year, tour, surface, tier, tier_k, best_of, event_id, event, round_order, draw_level, completed, walkover, winner AS player, loser AS opponent, 1 AS won,
    w_games AS games_for, l_games AS games_against, w_svpt AS svpt, w_won AS sv_won, l_svpt AS opp_svpt, l_won AS opp_won FROM matches
  UNION ALL
  SELECT match_id, date, day, year, tour, surface, tier, tier_k, best_of, event_id, event, round_order, draw_level, completed, walkover, loser, winner, 0,
    l_games, w_games, l_svpt, l_won, w_svpt, w_won FROM matches),
players AS (
  SELECT s_suppkey AS player, s_name AS name, s_nationkey AS ioc, CASE WHEN s_suppkey % 7 = 0 THEN 'L' ELSE 'R' END AS hand,
    CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 170 + s_suppkey % 30 END AS ht, CAST(18 + s_suppkey % 20 AS DOUBLE) AS age,
    CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal) AS INTEGER) END AS points FROM supplier),
forecasts AS (
  SELECT event_id, ts AS as_of, user_id * 8 + event_id % 8 AS match, user_id AS player, round(abs(value) / (abs(value) + 50.0), 6) AS p, event_type AS version,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""
