"""The market ledger: pairs of markets, quotes, forecasts as of a quote, ranks, and the set that is scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions import levels as lv
from matchlake.functions.names import name_key
from matchlake.functions.scalars import event_letters
from matchlake.operators.merge import keep_best
from matchlake.plans.registry import query
from matchlake.sources.adapters import MATCHES, forecasts, matches, players, table

#: Hour of the scoring quote, how long before it quotes are fetched, what a settled book carries, widest spread.
ANCHOR_HOUR, LOOKBACK, EXTREME, SPREAD = 8, 4 * 3600, 0.99, 0.10
#: Days between a forecast and the match.
FORECAST_DAYS = (-1, 21)


_SNAPS = MATCHES + """, t AS (SELECT match_id AS ticker, winner AS player, date AS occ, CAST(date AS TIMESTAMP) + INTERVAL 1 HOUR * (match_id % 24) AS quote FROM matches
  WHERE match_id % 3 = 0),
l AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'match' ELSE 'match_snapshot' END AS type, user_id AS player,
  DATE '1992-01-01' + CAST(event_id * 37 % 2400 AS INTEGER) + INTERVAL 1 HOUR * (event_id % 24) AS as_of, round(abs(value) / (abs(value) + 50.0),
  6) AS p FROM events),
c AS (SELECT t.*, l.id, l.type, l.as_of, l.p FROM t JOIN l ON l.player = t.player % 50 AND date_diff('day', CAST(l.as_of AS DATE), t.occ) BETWEEN -1
  AND 21)
"""


def pick_forecast(tickers: DataFrame, log: DataFrame, on: list[str]) -> DataFrame:
    """ticker, id, p, aligned: of each ticker's forecasts the last hourly one up to the quote; without one the first
    sighting (of any kind, if no first sighting is there), which is not aligned.

    Candidates meet by key and by month of the day, so a key's whole history is not paired with each of its tickers.
    """
    lo, hi = FORECAST_DAYS
    month = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / 32).cast("int")
    dealt = tickers.withColumn("bin", F.explode(F.sequence(month(F.date_sub("occ", hi)), month(F.date_add("occ", -lo)))))
    cand = dealt.join(log.withColumn("bin", month(F.col("as_of").cast("date"))), [*on, "bin"]).filter(F.datediff("occ", F.col("as_of").cast("date")).between(lo, hi))
    aligned = (F.col("type") == "match_snapshot") & (F.col("as_of") <= F.col("quote"))
    row = F.struct("id", "p")
    at = F.struct("as_of", "id")
    best = cand.groupBy("ticker").agg(F.max_by(row, F.when(aligned, at)).alias("a"), F.min_by(row, F.when(F.col("type") == "match", at)).alias("m"), F.min_by(row, at).alias("any"))
    chosen = F.coalesce("a", "m", "any")
    return best.select("ticker", chosen["id"].alias("id"), chosen["p"].alias("p"), F.col("a").isNotNull().alias("aligned"))


@query(_SNAPS + """, k AS (SELECT ticker, arg_max({'id': id, 'p': p}, (as_of, id)) FILTER (WHERE type = 'match_snapshot' AND as_of <= quote) AS a, arg_min({'id': id,
  'p': p}, (as_of, id)) FILTER (WHERE type = 'match') AS m, arg_min({'id': id, 'p': p}, (as_of, id)) AS f FROM c GROUP BY ticker)
SELECT ticker, coalesce(a, m, f).id AS id, coalesce(a, m, f).p AS p, a IS NOT NULL AS aligned FROM k""")
def forecast_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts as of each ticker's quote, with the fallback to first sightings."""
    k = F.col("match_id")
    t = matches(spark, sf_dir).filter(k % 3 == 0).select(k.alias("ticker"), (F.col("winner") % 50).alias("player"), F.col("date").alias("occ"), (F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (k % 24).cast("int"))).alias("quote"))
    e = F.col("event_id")
    as_of = F.date_add(F.lit("1992-01-01").cast("date"), (e * 37 % 2400).cast("int")).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (e % 24).cast("int"))
    log = forecasts(spark, sf_dir).select(e.alias("id"), F.when(e % 4 == 0, "match").otherwise("match_snapshot").alias("type"), "player", as_of.alias("as_of"), "p")
    return pick_forecast(t, log, ["player"])


_OOS = MATCHES + """, oos AS (SELECT winner, loser, date, round(0.3 + match_id % 50 / 100.0, 6) AS p, match_id FROM matches
  WHERE completed AND date >= DATE '1995-01-01') """


@query(_OOS + """SELECT m.match_id, o.p FROM matches m LEFT JOIN (SELECT winner, loser, date, arg_max(p, match_id) AS p FROM oos
  GROUP BY ALL) o USING (winner, loser, date) WHERE m.match_id % 2 = 0""")
def oos_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample predictions by winner, loser and day; the last one of a key holds."""
    m = matches(spark, sf_dir)
    index = m.filter("completed and date >= '1995-01-01'").groupBy("winner", "loser", "date").agg(F.max_by(F.round(F.lit(0.3) + F.col("match_id") % 50 / 100.0, 6), "match_id").alias("p"))
    return m.filter("match_id % 2 = 0").join(index, ["winner", "loser", "date"], "left").select("match_id", "p")


_RANKS = MATCHES + """, live AS (SELECT * FROM (SELECT player, rank() OVER (ORDER BY points DESC, player) AS rank FROM players WHERE points IS NOT NULL)
  WHERE player % 3 > 0), res AS (SELECT match_id, winner, loser, CASE WHEN match_id % 4 > 0 THEN match_id % 90 + 1 END AS winner_rank, CASE
  WHEN match_id % 5 > 0 THEN match_id % 80 + 1 END AS loser_rank FROM matches) """


@query(_RANKS + """, b AS (SELECT match_id, winner AS player, winner_rank AS r FROM res WHERE match_id % 7 > 0 UNION ALL SELECT match_id, loser, loser_rank FROM res
  WHERE match_id % 7 > 0 UNION ALL SELECT match_id, winner, NULL FROM res WHERE match_id % 7 = 0)
SELECT b.match_id, b.player, CAST(coalesce(b.r, l.rank) AS BIGINT) AS rank, CASE WHEN b.r IS NOT NULL THEN 'results'
  WHEN l.rank IS NOT NULL THEN 'live' ELSE '' END AS source FROM b LEFT JOIN live l USING (player)""")
def rank_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks from the matched result, else from the live table, with their source."""
    k = F.col("match_id")
    ranked = players(spark, sf_dir).filter("points is not null")
    live = place(ranked, [-F.col("points"), F.col("player")]).filter("player % 3 > 0")
    sides = F.array(F.struct(F.col("winner").alias("player"), F.when((k % 4 > 0) & (k % 7 > 0), k % 90 + 1).alias("r")), F.when(k % 7 > 0, F.struct(F.col("loser").alias("player"), F.when(k % 5 > 0, k % 80 + 1).alias("r"))))
    both = matches(spark, sf_dir).select("match_id", F.explode(F.array_compact(sides)).alias("x")).select("match_id", "x.*")
    joined = both.join(live.select("player", "rank"), "player", "left")
    source = F.when(F.col("r").isNotNull(), "results").when(F.col("rank").isNotNull(), "live").otherwise("")
    return joined.select("match_id", "player", F.coalesce("r", "rank").cast("long").alias("rank"), source.alias("source"))


def place(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number rows in a total order led by a number, without a task that sees them all."""
    from matchlake.operators.order import sequence

    return sequence(rows, order, name)


@query(MATCHES + """, known AS (SELECT lower(regexp_replace(s_name, '#', ' ')) AS k, s_suppkey AS id FROM supplier
  WHERE s_suppkey % 2 = 0), tokens AS (SELECT array_to_string(list_sort(string_split(k, ' ')), ' ') AS k, min(id) AS id FROM known GROUP BY 1),
asked AS (SELECT s_suppkey AS player, CASE s_suppkey % 4 WHEN 0 THEN lower(regexp_replace(s_name, '#', ' ')) ELSE split_part(s_name, '#',
  2) || ' supplier' END AS k FROM supplier)
SELECT a.player, coalesce(k.id, t.id) AS id, CASE WHEN k.id IS NOT NULL THEN 'key' WHEN t.id IS NOT NULL THEN 'tokens' END AS how FROM asked a LEFT
  JOIN known k ON k.k = a.k LEFT JOIN tokens t ON t.k = array_to_string(list_sort(string_split(a.k, ' ')), ' ')""")
def live_rank_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players by name key, else by the same words in any order."""
    s = table(spark, sf_dir, "supplier")
    words = lambda k: F.array_join(F.array_sort(F.split(k, " ")), " ")
    plain = name_key(F.replace("s_name", F.lit("#"), F.lit(" ")))
    known = s.filter("s_suppkey % 2 = 0").select(plain.alias("k"), F.col("s_suppkey").alias("by_key"))
    tokens = known.groupBy(words(F.col("k")).alias("w")).agg(F.min("by_key").alias("by_words"))
    asked = s.select(F.col("s_suppkey").alias("player"), F.when(F.col("s_suppkey") % 4 == 0, plain).otherwise(name_key(F.concat(F.split_part("s_name", F.lit("#"), F.lit(2)), F.lit(" Supplier")))).alias("k"))
    joined = asked.join(known, "k", "left").withColumn("w", words(F.col("k"))).join(tokens, "w", "left")
    return joined.select("player", F.coalesce("by_key", "by_words").alias("id"), F.when(F.col("by_key").isNotNull(), "key").when(F.col("by_words").isNotNull(), "tokens").alias("how"))


_LEDGER = MATCHES + """, led AS (SELECT match_id AS ticker, tour, date AS result_date, CASE WHEN match_id % 11 = 0 THEN 'pending' ELSE 'matched' END AS match_status, CASE
  WHEN completed THEN 'completed' WHEN walkover THEN 'walkover' ELSE 'retired' END AS result_type,
  CASE WHEN match_id % 6 = 0 THEN 'last' ELSE 'candle' END AS price_kind, CASE WHEN match_id % 10 > 0 THEN 0.2 + match_id % 61 / 100.0 END AS p_model,
  CASE WHEN match_id % 9 > 0 THEN 0.2 + match_id % 59 / 100.0 END AS p_quote, match_id % 15 / 100.0 AS spread_max, match_id % 2 AS a_won,
  CASE WHEN match_id % 13 = 0 THEN 'live' ELSE 'live_aligned' END AS pred_source, CASE WHEN match_id % 4 = 0 THEN NULL WHEN match_id % 2 = 0 THEN 'no'
  WHEN match_id % 17 = 0 THEN 'no' ELSE 'yes' END AS settled_a,
  CAST(date AS TIMESTAMP) + INTERVAL 8 HOUR + INTERVAL 1 MINUTE * (match_id % 97 * 20 - 1500) AS price_ts, CASE WHEN match_id % 19 = 0 THEN 0.995
  ELSE 0.4 END AS mid_a, least(winner, loser) AS lo, greatest(winner, loser) AS hi FROM matches)
"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of one row a match with all states that rows can have."""
    k = F.col("match_id")
    minutes = F.make_dt_interval(F.lit(0), F.lit(ANCHOR_HOUR), (k % 97 * 20 - 1500).cast("int"))
    return matches(spark, sf_dir).select(
        k.alias("ticker"), "tour", F.col("date").alias("result_date"), F.when(k % 11 == 0, "pending").otherwise("matched").alias("match_status"), F.when(F.col("completed"), "completed").when(F.col("walkover"), "walkover").otherwise("retired").alias("result_type"),
        F.when(k % 6 == 0, "last").otherwise("candle").alias("price_kind"), F.when(k % 10 > 0, 0.2 + k % 61 / 100.0).alias("p_model"), F.when(k % 9 > 0, 0.2 + k % 59 / 100.0).alias("p_quote"), (k % 15 / 100.0).alias("spread_max"), (k % 2).alias("a_won"),
        F.when(k % 13 == 0, "live").otherwise("live_aligned").alias("pred_source"), F.when(k % 4 == 0, None).when(k % 2 == 0, "no").when(k % 17 == 0, "no").otherwise("yes").alias("settled_a"),
        (F.col("date").cast("timestamp_ntz") + minutes).alias("price_ts"), F.when(k % 19 == 0, 0.995).otherwise(0.4).alias("mid_a"), F.least("winner", "loser").alias("lo"), F.greatest("winner", "loser").alias("hi"))


def scored(rows: DataFrame, retired: bool = False) -> DataFrame:
    """Rows that are scored, with both probabilities seen from the winner: matched, completed (or retired), priced by a
    candle of narrow spread, forecast in line with the quote."""
    types = ["completed", "retired"] if retired else ["completed"]
    good = (F.col("match_status") == "matched") & F.col("result_type").isin(types) & (F.col("price_kind") == "candle") & F.col("p_model").isNotNull() & F.col("p_quote").isNotNull() & (F.col("spread_max") <= SPREAD) & ~F.col("pred_source").eqNullSafe("live")
    seen = lambda p: F.when(F.col("a_won") == 1, F.col(p)).otherwise(1 - F.col(p))
    return rows.filter(good).withColumns({"p_model_w": seen("p_model"), "p_quote_w": seen("p_quote")})


_SCORED = "match_status = 'matched' AND result_type = 'completed' AND price_kind = 'candle' AND p_model IS NOT NULL AND p_quote IS NOT NULL"


@query(_LEDGER + f"SELECT ticker, round(CASE WHEN a_won = 1 THEN p_model ELSE 1 - p_model END, 6) AS p_model_w, round(CASE WHEN a_won = 1 THEN p_quote ELSE 1 - p_quote END, 6) AS p_quote_w FROM led WHERE {_SCORED} AND spread_max <= 0.10 AND pred_source <> 'live'")
def ledger_scored_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(ledger(spark, sf_dir)).select("ticker", F.round("p_model_w", 6).alias("p_model_w"), F.round("p_quote_w", 6).alias("p_quote_w"))


def scoring_quote_ok(day: str = "result_date", at: str = "price_ts", mid: str = "mid_a") -> Column:
    """A quote of the morning of the result's day: not after 08:00, and if from before the fetched hours, not a settled book."""
    anchor = F.col(day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(ANCHOR_HOUR))
    stale = F.col(at) <= anchor - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(LOOKBACK).cast("decimal(18,6)"))
    return (F.col("price_kind") == "candle") & (F.col("match_status") == "matched") & (F.col(at) <= anchor) & ~(stale & ~F.col(mid).between(1 - EXTREME + 1e-12, EXTREME - 1e-12))


@query(_LEDGER + """SELECT ticker, price_kind = 'candle' AND match_status = 'matched' AND price_ts <= CAST(result_date AS TIMESTAMP) + INTERVAL 8 HOUR
  AND NOT (price_ts <= CAST(result_date AS TIMESTAMP) + INTERVAL 4 HOUR AND NOT (mid_a > 0.01 AND mid_a < 0.99)) AS ok FROM led""")
def scoring_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).select("ticker", scoring_quote_ok().alias("ok"))


@query(_LEDGER + f""", s AS (SELECT *, row_number() OVER (PARTITION BY lo, hi, result_date ORDER BY ticker) AS nth FROM led WHERE {_SCORED})
SELECT 'anchor' AS "check", CAST(ticker AS VARCHAR) AS key, 'quoted after its anchor' AS message FROM s WHERE price_ts > CAST(result_date AS TIMESTAMP) + INTERVAL 8 HOUR
UNION ALL SELECT 'carry', CAST(ticker AS VARCHAR), 'settled book' FROM s WHERE price_ts <= CAST(result_date AS TIMESTAMP) + INTERVAL 4 HOUR AND NOT (mid_a > 0.01 AND mid_a < 0.99)
UNION ALL SELECT 'settlement', CAST(ticker AS VARCHAR), 'contradicts its result' FROM s WHERE settled_a IS NOT NULL AND (settled_a = 'yes') <> (a_won = 1)
UNION ALL SELECT 'twice', CAST(ticker AS VARCHAR), 'result scored before' FROM s WHERE nth > 1""")
def gate_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with scored rows: quotes after the anchor, settled books, contradicted or doubled results; one scan."""
    from pyspark.sql import Window as W

    rows = ledger(spark, sf_dir).filter("match_status = 'matched' and result_type = 'completed' and price_kind = 'candle' and p_model is not null and p_quote is not null")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("lo", "hi", "result_date").orderBy("ticker")))
    anchor = F.col("result_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(ANCHOR_HOUR))
    stale = F.col("price_ts") <= F.col("result_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(ANCHOR_HOUR - LOOKBACK // 3600))
    checks = {
        ("anchor", "quoted after its anchor"): F.col("price_ts") > anchor,
        ("carry", "settled book"): stale & ~((F.col("mid_a") > 1 - EXTREME) & (F.col("mid_a") < EXTREME)),
        ("settlement", "contradicts its result"): F.col("settled_a").isNotNull() & ((F.col("settled_a") == "yes") != (F.col("a_won") == 1)),
        ("twice", "result scored before"): F.col("nth") > 1,
    }
    found = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(name).alias("check"), F.lit(message).alias("message"))) for (name, message), when in checks.items()]))
    return rows.select(F.col("ticker").cast("string").alias("key"), F.explode(found).alias("v")).select("v.check", "key", "v.message")


@query("""WITH m AS (SELECT DISTINCT o_custkey AS event, o_orderkey AS ticker, CASE WHEN o_orderkey % 13 = 0 THEN 'A/B' WHEN o_orderkey % 17 = 0 THEN ' '
  ELSE 'Name ' || (o_orderkey % 40) END AS name FROM orders WHERE o_orderkey % 3 = 0),
g AS (SELECT event, count(*) AS n, bool_or(contains(name, '/') OR trim(name) = '') AS bad, count(DISTINCT lower(name)) AS names,
  min({'k': lower(name), 't': ticker}) AS a, max({'k': lower(name), 't': ticker}) AS b FROM m GROUP BY event)
SELECT event, CASE WHEN n <> 2 THEN CAST(n AS VARCHAR) || ' markets' WHEN bad THEN 'names' WHEN names < 2 THEN 'one player' END AS skipped, CASE
  WHEN n = 2 AND NOT bad AND names = 2 THEN a.t END AS a, CASE WHEN n = 2 AND NOT bad AND names = 2 THEN b.t END AS b FROM g""")
def market_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of exactly two markets for two players, in order of their keys; all others with the reason."""
    k = F.col("o_orderkey")
    name = F.when(k % 13 == 0, "A/B").when(k % 17 == 0, " ").otherwise(F.concat(F.lit("Name "), (k % 40).cast("string")))
    m = table(spark, sf_dir, "orders").filter(k % 3 == 0).select(F.col("o_custkey").alias("event"), k.alias("ticker"), name.alias("name")).distinct()
    entry = F.struct(name_key(F.col("name")).alias("k"), F.col("ticker").alias("t"))
    g = m.groupBy("event").agg(F.count("*").alias("n"), F.max(F.col("name").contains("/") | (F.trim("name") == "")).alias("bad"), F.count_distinct(name_key(F.col("name"))).alias("names"), F.min(entry).alias("x"), F.max(entry).alias("y"))
    skipped = F.when(F.col("n") != 2, F.concat(F.col("n").cast("string"), F.lit(" markets"))).when(F.col("bad"), "names").when(F.col("names") < 2, "one player")
    good = skipped.isNull()
    return g.select("event", skipped.alias("skipped"), F.when(good, F.col("x.t")).alias("a"), F.when(good, F.col("y.t")).alias("b"))


_ARMS = MATCHES + """, a AS (SELECT match_id AS k, 0.3 + match_id % 50 / 100.0 AS p FROM matches WHERE match_id % 7 > 0), b AS (SELECT match_id AS k,
  0.3 + match_id % 47 / 100.0 AS p FROM matches WHERE match_id % 5 > 0) """


@query(_ARMS + """SELECT k, round(a.p, 6) AS base, round(b.p, 6) AS arm, CASE WHEN b.p IS NULL THEN 'base only' WHEN a.p IS NULL THEN 'arm only' ELSE 'both' END AS side
  FROM a FULL JOIN b USING (k)""")
def aligned_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two experiments paired by unique keys, with what either has alone; repeated keys are an error."""
    k = F.col("match_id")
    m = matches(spark, sf_dir)
    return align(m.filter(k % 7 > 0).select(k.alias("k"), (0.3 + k % 50 / 100.0).alias("p")), m.filter(k % 5 > 0).select(k.alias("k"), (0.3 + k % 47 / 100.0).alias("p")), "k")


def align(base: DataFrame, arm: DataFrame, key: str) -> DataFrame:
    one = lambda d, n: d.groupBy(key).agg(F.when(F.count("*") > 1, F.raise_error(F.lit("repeated key"))).otherwise(F.first("p")).alias(n))
    joined = one(base, "base").join(one(arm, "arm"), key, "full")
    side = F.when(F.col("arm").isNull(), "base only").when(F.col("base").isNull(), "arm only").otherwise("both")
    return joined.select(key, F.round("base", 6).alias("base"), F.round("arm", 6).alias("arm"), side.alias("side"))


@query(_ARMS + "SELECT k, 'base' AS only FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT k, 'arm' FROM b WHERE k NOT IN (SELECT k FROM a)")
def symmetric_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("match_id")
    a, b = (matches(spark, sf_dir).filter(k % n > 0).select(k.alias("k")) for n in (7, 5))
    return a.subtract(b).withColumn("only", F.lit("base")).unionByName(b.subtract(a).withColumn("only", F.lit("arm")))


_LOCAL = MATCHES + """, fresh AS (SELECT match_id, winner, loser, CASE WHEN match_id % 3 = 0 THEN tier END AS rank, score FROM matches
  WHERE match_id % 2 = 0), near AS (SELECT winner, loser, arg_max({'r': CASE WHEN match_id % 5 > 0 THEN tier + 10 END, 's': score}, match_id) AS x
  FROM matches WHERE match_id % 2 = 1 GROUP BY ALL),
far AS (SELECT winner, loser, arg_max(tier + 20, match_id) AS r FROM matches WHERE match_id % 4 = 0 GROUP BY ALL)
"""


@query(_LOCAL + """SELECT f.match_id, CAST(coalesce(f.rank, n.x.r, a.r) AS INTEGER) AS rank, CASE WHEN contains(n.x.s, 'RET') AND (starts_with(split_part(n.x.s, ' RET',
  1), f.score) OR starts_with(f.score, split_part(n.x.s, ' RET', 1))) THEN n.x.s ELSE f.score END AS score
FROM fresh f LEFT JOIN near n USING (winner, loser) LEFT JOIN far a USING (winner, loser)""")
def enrich_from_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values from local copies of the same pair in order of files; a retirement's score only where the sets agree."""
    m, k = matches(spark, sf_dir), F.col("match_id")
    fresh = m.filter(k % 2 == 0).select("match_id", "winner", "loser", F.when(k % 3 == 0, F.col("tier")).alias("rank"), "score")
    near = m.filter(k % 2 == 1).groupBy("winner", "loser").agg(F.max_by(F.struct(F.when(k % 5 > 0, F.col("tier") + 10).alias("r"), F.col("score").alias("s")), "match_id").alias("n"))
    far = m.filter(k % 4 == 0).groupBy("winner", "loser").agg(F.max_by(F.col("tier") + 20, "match_id").alias("a"))
    joined = fresh.join(near, ["winner", "loser"], "left").join(far, ["winner", "loser"], "left")
    bare = F.split_part("n.s", F.lit(" RET"), F.lit(1))
    same = F.coalesce(F.col("n.s").contains("RET") & (F.startswith(bare, F.col("score")) | F.startswith(F.col("score"), bare)), F.lit(False))
    return joined.select("match_id", F.coalesce("rank", "n.r", "a").alias("rank"), F.when(same, F.col("n.s")).otherwise(F.col("score")).alias("score"))


@query(MATCHES + """, nm AS (SELECT DISTINCT event || CASE WHEN match_id % 3 = 0 THEN ' Open' ELSE '' END AS name, event_id, CASE match_id % 50
  WHEN 0 THEN 'ATP 500 series' WHEN 1 THEN 'mystery' ELSE 'ATP 250' END AS raw FROM matches
  WHERE match_id % 50 < 1 OR match_id % 50 = 1 OR match_id % 50 > 40)
SELECT event_id, CASE WHEN max(raw) = 'ATP 500 series' THEN 'ATP 500' ELSE 'ATP 250' END AS level FROM (SELECT event_id, raw FROM nm
  WHERE raw <> 'mystery') GROUP BY event_id HAVING count(DISTINCT raw) = 1""")
def categories_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers cached under names, by the id behind the names, where all names of an id agree."""
    k = F.col("match_id") % 50
    rows = matches(spark, sf_dir).filter((k < 2) | (k > 40)).select("event_id", F.when(k == 0, "ATP 500 series").when(k == 1, "mystery").otherwise("ATP 250").alias("raw"))
    levels = rows.select("event_id", lv.normalize_level(F.col("raw"), F.lit("atp")).alias("level")).filter("level is not null")
    return levels.groupBy("event_id").agg(F.count_distinct("level").alias("n"), F.min("level").alias("level")).filter("n = 1").drop("n")


_CASCADE_ALL = MATCHES + """, t AS (SELECT match_id AS ticker, least(winner, loser) AS lo, greatest(winner, loser) AS hi, date + CAST(match_id % 9 AS INTEGER) - 2 AS occ,
  round_order AS r, CASE WHEN match_id % 4 > 0 THEN event ELSE NULL END AS tournament FROM matches WHERE match_id % 3 = 0),
claimed AS (SELECT match_id, match_id + 3 AS by FROM matches WHERE match_id % 10 = 0),
c AS (SELECT t.*, m.match_id, date_diff('day', m.date, t.occ) AS gap, m.round_order = t.r AS same_round, substr(regexp_replace(lower(m.event),
  '[^a-z]', '', 'g'), 1, 18) AS ek, substr(regexp_replace(lower(t.tournament), '[^a-z]', '', 'g'), 1, 18) AS rk
  FROM t JOIN matches m ON least(m.winner, m.loser) = t.lo AND greatest(m.winner, m.loser) = t.hi AND date_diff('day', m.date, t.occ) BETWEEN -8
  AND 21 LEFT JOIN claimed k ON k.match_id = m.match_id WHERE k.by IS NULL OR k.by = t.ticker),
v AS (SELECT *, coalesce(contains(ek, rk) OR contains(rk, ek), FALSE) AS agrees FROM c), f AS (SELECT * FROM v
  WHERE rk IS NULL OR gap <= 3 OR agrees),
e AS (SELECT *, bool_or(agrees) OVER (PARTITION BY ticker) AS any_agrees FROM f), e2 AS (SELECT * FROM e
  WHERE NOT any_agrees OR agrees), r1 AS (SELECT *, bool_or(same_round) OVER (PARTITION BY ticker) AS any_round FROM e2), r2 AS (SELECT * FROM r1
  WHERE NOT any_round OR same_round),
g AS (SELECT *, min(abs(gap)) OVER (PARTITION BY ticker) AS least_gap FROM r2), h AS (SELECT ticker, count(*) AS n, min(match_id) AS match_id FROM g
  WHERE abs(gap) = least_gap GROUP BY ticker)
"""


@query(_CASCADE_ALL + """SELECT t.ticker, CASE WHEN h.n = 1 THEN h.match_id END AS match_id, CASE WHEN h.n IS NULL THEN 'pending' WHEN h.n = 1 THEN 'matched'
  ELSE 'ambiguous' END AS status FROM t LEFT JOIN h USING (ticker)""")
def ledger_join_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a pair within -8 to 21 days that no other ticker claims and, when far off, of the named tournament; then
    those of that tournament, of that round and the nearest, as far as any is; a tie stays open."""
    m = matches(spark, sf_dir)
    k = F.col("match_id")
    t = m.filter(k % 3 == 0).select(k.alias("ticker"), F.least("winner", "loser").alias("lo"), F.greatest("winner", "loser").alias("hi"), F.date_add("date", (k % 9 - 2).cast("int")).alias("occ"), F.col("round_order").alias("r"), event_letters(F.when(k % 4 > 0, F.col("event"))).alias("rk"))
    month = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / 32).cast("int")
    results = m.select(k.alias("match_id"), "date", "round_order", event_letters(F.col("event")).alias("ek"), F.least("winner", "loser").alias("lo"), F.greatest("winner", "loser").alias("hi"), month("date").alias("bin"), F.when(k % 10 == 0, k + 3).alias("by"))
    dealt = t.withColumn("bin", F.explode(F.sequence(month(F.date_sub("occ", 21)), month(F.date_add("occ", 8)))))
    gap = F.datediff("occ", "date")
    free = F.col("by").isNull() | (F.col("by") == F.col("ticker"))
    agrees = F.coalesce(F.col("ek").contains(F.col("rk")) | F.col("rk").contains(F.col("ek")), F.lit(False))
    cand = dealt.join(results, ["lo", "hi", "bin"]).filter(gap.between(-8, 21) & free).filter(F.col("rk").isNull() | (gap <= 3) | agrees)
    rank = F.struct((~agrees).alias("elsewhere"), (F.col("round_order") != F.col("r")).alias("other"), F.abs(gap).alias("gap"))
    grouped = cand.groupBy("ticker", rank.alias("rank")).agg(F.count("*").alias("n"), F.min("match_id").alias("match_id"))
    best = grouped.groupBy("ticker").agg(F.min(F.struct("rank", "n", "match_id")).alias("b"))
    status = F.when(F.col("b").isNull(), "pending").when(F.col("b.n") == 1, "matched").otherwise("ambiguous")
    return t.select("ticker").join(best, "ticker", "left").select("ticker", F.when(F.col("b.n") == 1, F.col("b.match_id")).alias("match_id"), status.alias("status"))
