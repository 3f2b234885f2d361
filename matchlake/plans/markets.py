"""Market odds, stakes, quotes and the market ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions import scalars as s
from matchlake.operators.merge import keep_best, upsert
from matchlake.operators.order import near
from matchlake.plans.metrics import log_loss, scored
from matchlake.plans.registry import query
from matchlake.plans.metrics import _P
from matchlake.sources.adapters import MATCHES, forecasts, matches
from matchlake.sources.files import staged

_ODDS = MATCHES + """, odds AS (SELECT match_id, winner AS w_key, loser AS l_key, date + CAST(match_id % 6 AS INTEGER) AS date,
  CASE WHEN match_id % 3 <> 0 THEN 1.2 + (wq % 30) / 10.0 END AS odds_w_ps, CASE WHEN match_id % 3 <> 0
  AND match_id % 8 <> 1 THEN 1.2 + (lq % 30) / 10.0 END AS odds_l_ps,
  CASE WHEN match_id % 4 <> 0 THEN 1.25 + (wq % 30) / 10.0 END AS odds_w_b365, CASE
  WHEN match_id % 4 <> 0 THEN 1.25 + (lq % 30) / 10.0 END AS odds_l_b365,
  1.3 + (wq % 30) / 10.0 AS odds_w_avg, 1.3 + (lq % 30) / 10.0 AS odds_l_avg FROM (SELECT m.match_id, m.winner, m.loser, m.date, b.wq, b.lq
  FROM matches m JOIN base b USING (match_id))),
coalesced AS (SELECT match_id, w_key, l_key, date, CASE WHEN odds_w_ps IS NOT NULL AND odds_l_ps IS NOT NULL THEN 'ps' WHEN odds_w_b365 IS NOT NULL
  AND odds_l_b365 IS NOT NULL THEN 'b365' ELSE 'avg' END AS book,
  CASE WHEN odds_w_ps IS NOT NULL AND odds_l_ps IS NOT NULL THEN odds_w_ps WHEN odds_w_b365 IS NOT NULL THEN odds_w_b365
  ELSE odds_w_avg END AS odds_w,
  CASE WHEN odds_w_ps IS NOT NULL AND odds_l_ps IS NOT NULL THEN odds_l_ps WHEN odds_l_b365 IS NOT NULL THEN odds_l_b365 ELSE odds_l_avg END AS odds_l
  FROM odds)
"""


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal odds of three books, dated up to five days after the match."""
    key = F.col("match_id")
    games = matches(spark, sf_dir).select("match_id", "winner", "loser", "date")
    from matchlake.sources.adapters import pairings

    q = pairings(spark, sf_dir).select("match_id", F.col("wq").cast("int").alias("wq"), F.col("lq").cast("int").alias("lq"))
    at = lambda base, x: base + (F.col(x) % 30) / 10.0
    return games.join(q, "match_id").select(
        "match_id", F.col("winner").alias("w_key"), F.col("loser").alias("l_key"), F.date_add("date", (key % 6).cast("int")).alias("date"),
        F.when(key % 3 != 0, at(1.2, "wq")).alias("odds_w_ps"), F.when((key % 3 != 0) & (key % 8 != 1), at(1.2, "lq")).alias("odds_l_ps"),
        F.when(key % 4 != 0, at(1.25, "wq")).alias("odds_w_b365"), F.when(key % 4 != 0, at(1.25, "lq")).alias("odds_l_b365"), at(1.3, "wq").alias("odds_w_avg"), at(1.3, "lq").alias("odds_l_avg"))


def best_book(rows: DataFrame) -> DataFrame:
    """The first book, in order of preference, that has both legs."""
    legs = [F.when(F.col(f"odds_w_{b}").isNotNull() & F.col(f"odds_l_{b}").isNotNull(), F.struct(F.lit(b).alias("book"), F.col(f"odds_w_{b}").alias("odds_w"), F.col(f"odds_l_{b}").alias("odds_l"))) for b in ("ps", "b365", "avg")]
    return rows.withColumn("o", F.coalesce(*legs)).filter("o is not null").select("match_id", "w_key", "l_key", "date", "o.*")


@query(_ODDS + """SELECT match_id, book, round(odds_w, 6) AS odds_w, round(odds_l, 6) AS odds_l, round((1 / odds_w) / (1 / odds_w + 1 / odds_l), 6) AS p FROM coalesced""")
def odds_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_book(odds(spark, sf_dir)).select("match_id", "book", F.round("odds_w", 6).alias("odds_w"), F.round("odds_l", 6).alias("odds_l"), F.round(s.market_probability(F.col("odds_w"), F.col("odds_l")), 6).alias("p"))


_BAND = _ODDS + """, banded AS (SELECT m.match_id, m.date, c.match_id AS odds_id, c.book, c.odds_w, c.odds_l, row_number() OVER (PARTITION BY m.date, m.winner,
  m.loser ORDER BY abs(date_diff('day', m.date, c.date)), c.match_id, m.match_id) AS i
  FROM matches m JOIN coalesced c ON c.w_key = m.winner AND c.l_key = m.loser AND abs(date_diff('day', m.date, c.date)) <= 4 WHERE m.completed),
priced AS (SELECT b.*, (1 / odds_w) / (1 / odds_w + 1 / odds_l) AS mkt, (coalesce(w.points, 0) + 100.0) / (coalesce(w.points, 0) + coalesce(l.points,
  0) + 200.0) AS p
  FROM banded b JOIN matches m USING (match_id) JOIN players w ON w.player = m.winner JOIN players l ON l.player = m.loser WHERE i = 1)
"""


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored matches with the nearest odds of the same players within four days."""
    o = best_book(odds(spark, sf_dir)).select(F.col("match_id").alias("odds_id"), F.col("w_key").alias("winner"), F.col("l_key").alias("loser"), F.col("date").alias("odds_date"), "book", "odds_w", "odds_l")
    gap = F.abs(F.datediff("date", "odds_date"))
    met = near(scored(spark, sf_dir), o, ["winner", "loser"], "date", "odds_date", -4, 4)
    one = keep_best(met, ["date", "winner", "loser"], [gap, F.col("odds_id"), F.col("match_id")])
    return one.withColumn("mkt", s.market_probability(F.col("odds_w"), F.col("odds_l")))


@query(_BAND + "SELECT match_id, odds_id, book, round(mkt, 6) AS mkt, round(p, 6) AS p FROM priced")
def odds_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select("match_id", "odds_id", "book", F.round("mkt", 6).alias("mkt"), F.round("p", 6).alias("p"))


@query(_BAND + """SELECT book, CAST(count(*) FILTER (WHERE abs(p - mkt) > 0.05) AS BIGINT) AS bets, round(sum(CASE WHEN p - mkt > 0.05 THEN odds_w - 1
  WHEN mkt - p > 0.05 THEN -1.0 ELSE 0.0 END), 6) AS pnl FROM priced GROUP BY book""")
def flat_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit on the side with an edge over five points."""
    edge = F.col("p") - F.col("mkt")
    return priced(spark, sf_dir).groupBy("book").agg(F.count_if(F.abs(edge) > 0.05).alias("bets"), F.round(F.sum(F.when(edge > 0.05, F.col("odds_w") - 1).when(edge < -0.05, -1.0).otherwise(0.0)), 6).alias("pnl"))


@query(_BAND + """, k AS (SELECT book, least(greatest((p * odds_w - 1) / (odds_w - 1), 0), 0.25) AS fw, least(greatest(((1 - p) * odds_l - 1) / (odds_l - 1), 0),
  0.25) AS fl, odds_w FROM priced)
SELECT book, round(sum(fw + fl), 6) AS staked, round(sum(fw * (odds_w - 1) - fl), 6) AS pnl FROM k GROUP BY book""")
def kelly_roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kelly stakes on both sides, capped at a quarter."""
    def stake(p: Column, odds_: str) -> Column:
        return F.least(F.greatest((p * F.col(odds_) - 1) / (F.col(odds_) - 1), F.lit(0.0)), F.lit(0.25))

    rows = priced(spark, sf_dir).select("book", "odds_w", stake(F.col("p"), "odds_w").alias("fw"), stake(1 - F.col("p"), "odds_l").alias("fl"))
    return rows.groupBy("book").agg(F.round(F.sum(F.col("fw") + F.col("fl")), 6).alias("staked"), F.round(F.sum(F.col("fw") * (F.col("odds_w") - 1) - F.col("fl")), 6).alias("pnl"))


@query(_ODDS + """, n AS (SELECT year(date) AS year, book, count(*) AS n FROM coalesced GROUP BY ALL) SELECT year, arg_max(book, (n, book)) AS main,
  CAST(sum(n) AS BIGINT) AS n, count(*) AS books FROM n GROUP BY year""")
def source_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = best_book(odds(spark, sf_dir)).groupBy(F.year("date").alias("year"), "book").agg(F.count("*").alias("n"))
    return n.groupBy("year").agg(F.max_by("book", F.struct("n", "book")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("books"))


@query(_BAND + """, r AS (SELECT * FROM priced WHERE date > (SELECT max(date) FROM priced) - 90) SELECT count(*) AS n, round(avg(-ln(p)), 6) AS model,
  round(avg(-ln(mkt)), 6) AS market, round(avg(ln(mkt) - ln(p)), 6) AS d FROM r""")
def recent_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(priced(spark, sf_dir).select("date", "p", "mkt"))
    last = rows.join(F.broadcast(rows.agg(F.max("date").alias("latest")))).filter(F.col("date") > F.date_sub("latest", 90))
    model, market = log_loss(F.col("p")), log_loss(F.col("mkt"))
    return last.agg(F.count("*").alias("n"), F.round(F.avg(model), 6).alias("model"), F.round(F.avg(market), 6).alias("market"), F.round(F.avg(model - market), 6).alias("d"))


@query("""WITH o AS (SELECT o_orderkey AS ticker, o_totalprice AS price, CAST(o_orderdate AS DATE) AS opened, o_orderstatus = 'F' AS settled, CASE
  WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS result FROM orders WHERE o_orderkey % 4 < 3),
n AS (SELECT o_orderkey AS ticker, o_totalprice + 1 AS price, CAST(o_orderdate AS DATE) + 1 AS opened, o_orderkey % 5 = 0 AS settled,
  o_orderpriority AS result FROM orders WHERE o_orderkey % 4 > 0)
SELECT coalesce(o.ticker, n.ticker) AS ticker, round(CASE WHEN coalesce(o.settled, FALSE) THEN o.price ELSE coalesce(n.price, o.price) END,
  6) AS price, coalesce(o.opened, n.opened) AS opened, coalesce(o.result, n.result) AS result, coalesce(o.settled, FALSE) OR coalesce(n.settled,
  FALSE) AS settled
FROM o FULL JOIN n ON o.ticker = n.ticker""")
def ledger_upsert_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge by ticker: opening day and result keep their first value, the price follows until the market is settled."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    old = o.filter(key % 4 < 3).select(key.alias("ticker"), F.col("o_totalprice").alias("price"), day.alias("opened"), (F.col("o_orderstatus") == "F").alias("settled"), F.when(key % 3 == 0, F.col("o_orderstatus")).alias("result"))
    new = o.filter(key % 4 > 0).select(key.alias("ticker"), (F.col("o_totalprice") + 1).alias("price"), F.date_add(day, 1).alias("opened"), (key % 5 == 0).alias("settled"), F.col("o_orderpriority").alias("result"))
    merged = upsert(old, new, "ticker", ["opened", "result"], ["price"], "settled")
    return merged.select("ticker", F.round("price", 6).alias("price"), "opened", "result", "settled")


@query(MATCHES + """, c AS (SELECT user_id, ts, value, event_id FROM events), q AS (SELECT user_id, CAST(ts AS DATE) AS day, max(event_id) AS last_id FROM events
  GROUP BY ALL)
SELECT q.user_id, q.day, arg_max(c.event_id, (c.ts, c.event_id)) AS quote_id, round(arg_max(c.value, (c.ts, c.event_id)), 6) AS value,
  count(*) AS candles FROM q JOIN c ON c.user_id = q.user_id AND c.ts <= CAST(q.day AS TIMESTAMP) + INTERVAL 8 HOUR
  AND c.ts > CAST(q.day AS TIMESTAMP) - INTERVAL 40 HOUR GROUP BY q.user_id, q.day""")
def quote_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user and day the last quote up to 08:00, not older than two days.

    Quotes are dealt to the days whose cutoff they can serve (at most three), so the as-of join is one grouping.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", "value")
    asked = e.select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    first = F.when(F.hour("ts") < 8, F.col("ts").cast("date")).when((F.hour("ts") == 8) & (F.minute("ts") == 0) & (F.second("ts") == 0), F.col("ts").cast("date")).otherwise(F.date_add(F.col("ts").cast("date"), 1))
    serves = e.withColumn("day", F.explode(F.sequence(F.date_sub(first, 1), F.date_add(first, 2))))
    cutoff = F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 8 HOUR")
    valid = serves.filter((F.col("ts") <= cutoff) & (F.col("ts") > cutoff - F.expr("INTERVAL 48 HOUR")))
    last = valid.groupBy("user_id", "day").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("quote_id"), F.round(F.max_by("value", F.struct("ts", "event_id")), 6).alias("value"), F.count("*").alias("candles"))
    return asked.join(last, ["user_id", "day"]).select("user_id", "day", "quote_id", "value", "candles")


@query("""SELECT vec_id, round(a / nullif(a + b, 0), 5) AS p FROM (SELECT vec_id, abs(CAST(embedding[1] AS DOUBLE)) AS a, abs(CAST(embedding[2] AS DOUBLE)) AS b
  FROM embeddings)""")
def devig(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.abs(F.col("embedding")[i].cast("double")) for i in (0, 1))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.round(F.when(a + b != 0, s.devig(a, b)), 5).alias("p"))


_CLAIMS = MATCHES + """, claims AS (SELECT match_id AS ticker, winner, loser, date, match_id - match_id % 3 AS claimed, abs(match_id % 7 - 3) AS gap FROM matches)
"""


@query(_CLAIMS + "SELECT ticker, claimed, row_number() OVER (PARTITION BY claimed ORDER BY gap, ticker) > 1 AS healed FROM claims")
def healed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several tickers that claim one result only the closest keeps it."""
    from pyspark.sql import Window as W

    key = F.col("match_id")
    rows = matches(spark, sf_dir).select(key.alias("ticker"), (key - key % 3).alias("claimed"), F.abs(key % 7 - 3).alias("gap"))
    return rows.select("ticker", "claimed", (F.row_number().over(W.partitionBy("claimed").orderBy("gap", "ticker")) > 1).alias("healed"))


_CASCADE = MATCHES + """, t AS (SELECT match_id AS ticker, least(winner, loser) AS lo, greatest(winner, loser) AS hi, date + CAST(match_id % 5 AS INTEGER) - 2 AS occ,
  round_order FROM matches WHERE match_id % 3 = 0),
cand AS (SELECT t.ticker, m.match_id, m.round_order = t.round_order AS same_round, abs(date_diff('day', t.occ, m.date)) AS gap FROM t
  JOIN matches m ON least(m.winner, m.loser) = t.lo AND greatest(m.winner, m.loser) = t.hi AND date_diff('day', t.occ, m.date) BETWEEN -8 AND 21),
r AS (SELECT *, max(CAST(same_round AS INTEGER)) OVER (PARTITION BY ticker) AS any_round FROM cand), f AS (SELECT * FROM r
  WHERE any_round = 0 OR same_round), g AS (SELECT *, min(gap) OVER (PARTITION BY ticker) AS least_gap FROM f),
h AS (SELECT ticker, count(*) AS n, min(match_id) AS match_id FROM g WHERE gap = least_gap GROUP BY ticker)
"""


@query(_CASCADE + """SELECT t.ticker, CASE WHEN h.n = 1 THEN h.match_id END AS match_id, CASE WHEN h.n IS NULL THEN 'pending' WHEN h.n = 1 THEN 'matched'
  ELSE 'ambiguous' END AS status FROM t LEFT JOIN h USING (ticker)""")
def ledger_join_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a pair within -8 to 21 days: same round if any has it, then the nearest; a tie stays open.

    The reductions are maxima of one aggregation: candidates are ordered by (round, nearness) and the best are counted.
    """
    m = matches(spark, sf_dir).select("match_id", "date", "round_order", F.least("winner", "loser").alias("lo"), F.greatest("winner", "loser").alias("hi"))
    t = m.filter("match_id % 3 = 0").select(F.col("match_id").alias("ticker"), "lo", "hi", F.date_add("date", (F.col("match_id") % 5 - 2).cast("int")).alias("occ"), F.col("round_order").alias("r"))
    days = F.datediff("date", "occ")
    cand = near(t, m, ["lo", "hi"], "occ", "date", -8, 21)
    rank = F.struct((F.col("round_order") != F.col("r")).alias("other"), F.abs(days).alias("gap"))
    grouped = cand.groupBy("ticker", rank.alias("rank")).agg(F.count("*").alias("n"), F.min("match_id").alias("match_id"))
    best = grouped.groupBy("ticker").agg(F.min(F.struct("rank", "n", "match_id")).alias("b"))
    status = F.when(F.col("b").isNull(), "pending").when(F.col("b.n") == 1, "matched").otherwise("ambiguous")
    return t.select("ticker").join(best, "ticker", "left").select("ticker", F.when(F.col("b.n") == 1, F.col("b.match_id")).alias("match_id"), status.alias("status"))


@query(_CASCADE + """SELECT CASE WHEN h.n IS NULL THEN 'pending' WHEN h.n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, count(*) AS n, min(t.occ) AS first,
  max(t.occ) AS last FROM t LEFT JOIN h USING (ticker) GROUP BY 1""")
def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = matches(spark, sf_dir).select(F.col("match_id").alias("ticker"), F.date_add("date", (F.col("match_id") % 5 - 2).cast("int")).alias("occ"))
    return ledger_join_cascade(spark, sf_dir).join(when, "ticker").groupBy("status").agg(F.count("*").alias("n"), F.min("occ").alias("first"), F.max("occ").alias("last"))
