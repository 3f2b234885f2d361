"""Scoreboards made of matches as nested JSON, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.operators.merge import keep_best
from matchlake.plans.registry import query
from matchlake.sources import scoreboard as sb
from matchlake.sources.adapters import MATCHES, matches

_BOARD = MATCHES + """, cp AS (SELECT event_id AS feed_id, event, match_id, round_order, draw_level, date, match_id % 4 > 0 AS completed, CASE match_id % 8
  WHEN 0 THEN 'pre' WHEN 4 THEN 'in' ELSE 'post' END AS state,
    'P' || winner AS w, CASE WHEN match_id % 37 = 0 THEN NULL ELSE 'P' || loser END AS l, w_games, l_games FROM matches WHERE draw_level = 'main'),
nn AS (SELECT feed_id, max(2 * c * CAST(pow(2, round_order - 1) AS BIGINT)) AS need FROM (SELECT feed_id, round_order, count(*) AS c FROM cp
  WHERE round_order <= 4 GROUP BY ALL) GROUP BY ALL),
coded AS (SELECT cp.*, CASE WHEN round_order = 5 THEN 'QF' WHEN round_order = 6 THEN 'SF' WHEN round_order = 7 THEN 'F'
  ELSE CASE draw >> (round_order - 1) WHEN 8 THEN 'QF' WHEN 4 THEN 'SF' WHEN 2 THEN 'F'
  ELSE 'R' || CAST(draw >> (round_order - 1) AS VARCHAR) END END AS round
  FROM cp LEFT JOIN (SELECT feed_id, CAST(pow(2, ceil(log2(need))) AS INTEGER) AS draw FROM nn) USING (feed_id) WHERE match_id % 31 > 0)
"""


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON event for each event of the match table."""
    m, k, r = matches(spark, sf_dir), F.col("match_id"), F.col("round_order")
    label = F.when(k % 31 == 0, "Qualifying 1st Round").when(r <= 4, F.concat(F.lit("Round "), r.cast("string"))).when(r == 5, "Quarterfinal").when(r == 6, "Semifinal").otherwise("Final")
    stamp = F.date_format("date", "yyyy-MM-dd'T'10:00'Z'")

    def side(won: bool, name: F.Column, games: str) -> F.Column:
        return F.struct(F.lit(won).alias("winner"), F.struct(name.alias("displayName")).alias("athlete"), F.array(F.struct(F.col(games).cast("double").alias("value"))).alias("linescores"))

    sides = F.array(side(True, F.concat(F.lit("P"), "winner"), "w_games"), side(False, F.when(k % 37 == 0, " TBD").otherwise(F.concat(F.lit("P"), "loser")), "l_games"))
    state = F.struct(F.struct((k % 4 > 0).alias("completed"), F.when(k % 8 == 0, "pre").when(k % 8 == 4, "in").otherwise("post").alias("state")).alias("type"))
    one = F.struct(stamp.alias("date"), state.alias("status"), F.struct(r.cast("string").alias("id"), label.alias("displayName")).alias("round"), sides.alias("competitors"))
    slug = F.when(F.col("draw_level") == "main", "mens-singles").when(F.col("draw_level") == "chall", "womens-singles").otherwise("mens-doubles")
    groups = m.groupBy("event_id", "event", slug.alias("slug")).agg(F.min(stamp).alias("first"), F.max(stamp).alias("last"), F.collect_list(one).alias("competitions"))
    grouping = F.struct(F.struct("slug").alias("grouping"), "competitions")
    e = groups.groupBy("event_id", "event").agg(F.min("first").alias("date"), F.max("last").alias("endDate"), F.collect_list(grouping).alias("groupings"))
    short = F.when(F.length("event") > 6, F.concat_ws(" ", "event", "event_id"))
    return e.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.concat_ws(" ", "event", "event_id").alias("name"), short.alias("shortName"), "date", "endDate", "groupings")).alias("payload"))


@query(_BOARD + """SELECT DISTINCT feed_id, event || ' ' || feed_id AS event, CAST(date AS VARCHAR) AS date, round, w AS winner, l AS loser,
  CAST(w_games AS VARCHAR) || '-' || CAST(l_games AS VARCHAR) AS score FROM coded
  WHERE completed AND l IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feed_id, w, l, score ORDER BY date, round) = 1""")
def scoreboard_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed main-draw singles; a repeated result has the date and round of its earliest row."""
    return sb.results(boards(spark, sf_dir), "mens")


@query(_BOARD + """SELECT feed_id, round, count(*) AS n, min(w) AS first FROM (SELECT feed_id, w, l, arg_min(round, (date, round)) AS round FROM coded
  WHERE NOT completed AND state IN ('pre', 'in') AND l IS NOT NULL GROUP BY ALL) GROUP BY ALL""")
def scoreboard_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled and running matches by event and round."""
    return sb.upcoming(boards(spark, sf_dir), "mens").groupBy("feed_id", "round").agg(F.count("*").alias("n"), F.min("a").alias("first"))


@query(_BOARD + """, s AS (SELECT feed_id, w AS p, FALSE AS lost FROM coded UNION ALL SELECT feed_id, l, completed FROM coded WHERE l IS NOT NULL)
SELECT feed_id, array_to_string(list_sort(list_distinct(list(p))), ',') AS field,
  coalesce(array_to_string(list_sort(list_distinct(list(p) FILTER (WHERE lost))), ','), '') AS eliminated FROM s GROUP BY feed_id
  HAVING count(DISTINCT p) >= 8""")
def scoreboard_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sb.fields(boards(spark, sf_dir), "mens").select("feed_id", F.array_join("field", ",").alias("field"), F.array_join("eliminated", ",").alias("eliminated"))


@query(MATCHES + """SELECT event || ' ' || event_id AS event, event_id AS feed_id, CAST(min(date) AS VARCHAR) AS start, CAST(max(date) AS VARCHAR) AS finish FROM matches
  GROUP BY event, event_id""")
def scoreboard_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and dates of all events, whatever their groupings."""
    return sb.meta(boards(spark, sf_dir))


@query(MATCHES + "SELECT event_id AS id, min(date_diff('day', DATE '1992-01-01', date) // 14) AS w FROM matches GROUP BY event_id")
def scoreboard_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day windows of a fortnight that repeat events: each event once, as the first window has it."""
    m = matches(spark, sf_dir)
    window = F.floor(F.datediff("date", F.lit("1992-01-01").cast("date")) / 14).cast("long")
    payload = F.to_json(F.struct(F.col("event_id").alias("id"), window.alias("window")))
    once = sb.distinct_events(m.select(window.alias("window"), payload.alias("payload")).distinct(), "window")
    return once.select("id", F.get_json_object("payload", "$.window").cast("long").alias("w"))


_UP = MATCHES + """, feed AS (SELECT CASE WHEN match_id % 3 > 0 THEN event_id END AS id, event || ' Open' AS event, winner AS a, loser AS b, match_id, 0 AS src
  FROM matches WHERE match_id % 4 = 0),
draws AS (SELECT event_id AS id, event || ' Open' AS event, loser AS a, winner AS b, match_id, 1 AS src FROM matches
  WHERE round_order = 1 AND match_id % 8 < 6),
twin AS (SELECT *, coalesce(id, event) AS ev, least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT * FROM feed UNION ALL SELECT * FROM draws))
"""


def feed_and_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, k = matches(spark, sf_dir), F.col("match_id")
    name = F.concat(F.col("event"), F.lit(" Open")).alias("event")
    feed = m.filter(k % 4 == 0).select(F.when(k % 3 > 0, F.col("event_id")).alias("id"), name, F.col("winner").alias("a"), F.col("loser").alias("b"), "match_id", F.lit(0).alias("src"))
    draws = m.filter((F.col("round_order") == 1) & (k % 8 < 6)).select(F.col("event_id").alias("id"), name, F.col("loser").alias("a"), F.col("winner").alias("b"), "match_id", F.lit(1).alias("src"))
    return feed.unionByName(draws)


@query(_UP + "SELECT ev, lo, hi, arg_min(match_id, (src, match_id)) AS match_id, min(src) AS src FROM twin GROUP BY ev, lo, hi")
def upcoming_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed and the first rounds of released draws: each event (by id, else by name) and pair once, the feed first."""
    rows = feed_and_draws(spark, sf_dir).select(F.coalesce("id", "event").alias("ev"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "match_id", "src")
    return keep_best(rows, ["ev", "lo", "hi"], [F.col("src"), F.col("match_id")])


@query(_UP + """, u AS (SELECT ev, event, arg_min(a, (src, match_id)) AS a, arg_min(b, (src, match_id)) AS b, arg_min(match_id, (src, match_id)) AS match_id FROM twin
  GROUP BY ev, event, lo, hi)
SELECT u.match_id, x.name AS player_a, y.name AS player_b, round(1 / (1 + pow(10, -(x.points - y.points) / 4000.0)), 6) AS p FROM u
  JOIN players x ON x.player = u.a AND x.points IS NOT NULL JOIN players y ON y.player = u.b AND y.points IS NOT NULL WHERE u.a <> u.b""")
def upcoming_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled matches of known, different players, priced; others are dropped."""
    from matchlake.sources.adapters import players

    rows = feed_and_draws(spark, sf_dir).withColumns({"ev": F.coalesce("id", "event"), "lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    once = keep_best(rows, ["ev", "event", "lo", "hi"], [F.col("src"), F.col("match_id")])
    rated = players(spark, sf_dir).filter("points is not null").select("player", "name", "points")
    x, y = (rated.select(F.col("player").alias(k), F.col("name").alias(f"player_{k}"), F.col("points").alias(f"points_{k}")) for k in "ab")
    joined = once.filter("a <> b").join(x, "a").join(y, "b")
    chance = 1 / (1 + F.pow(F.lit(10.0), -(F.col("points_a") - F.col("points_b")) / 4000.0))
    return joined.select("match_id", "player_a", "player_b", F.round(chance, 6).alias("p"))


_DRAWS = MATCHES + """, cur AS (SELECT event_id AS key, CASE WHEN match_id % 2 = 0 THEN event_id END AS feed_id, 'official' AS source, match_id FROM matches
  WHERE round_order = 7 AND year < 1996),
old AS (SELECT event AS key, CASE WHEN match_id % 3 = 0 THEN event_id END AS feed_id, 'wiki' AS source, match_id FROM matches
  WHERE round_order = 7 AND year = 1996),
allr AS (SELECT coalesce(feed_id, key) AS key, source, match_id FROM (SELECT * FROM cur UNION ALL SELECT * FROM old))
"""


@query(_DRAWS + "SELECT key, arg_max(source, match_id) AS source, max(match_id) AS match_id FROM allr GROUP BY key")
def draws_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the current and the old cache under their id where they have one, else under their old key; later ones hold."""
    final, k = matches(spark, sf_dir).filter("round_order = 7"), F.col("match_id")
    now = final.filter("year < 1996").select(F.col("event_id").alias("key"), F.when(k % 2 == 0, F.col("event_id")).alias("feed_id"), F.lit("official").alias("source"), "match_id")
    old = final.filter("year = 1996").select(F.col("event").alias("key"), F.when(k % 3 == 0, F.col("event_id")).alias("feed_id"), F.lit("wiki").alias("source"), "match_id")
    rows = now.unionByName(old).select(F.coalesce("feed_id", "key").alias("key"), "source", "match_id")
    return rows.groupBy("key").agg(F.max_by("source", "match_id").alias("source"), F.max("match_id").alias("match_id"))
