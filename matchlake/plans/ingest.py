"""Scans, normalisation, merging of sources, repair and backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.functions import scalars as s
from matchlake.functions.names import name_key
from matchlake.operators.merge import fill_if_unique, keep_best, mode_by
from matchlake.operators.order import sequence
from matchlake.plans.registry import query
from matchlake.sources.adapters import MATCHES, matches, player_long, players, table


@query(MATCHES + "SELECT match_id, score, w_games, l_games, sets, completed, walkover, w_games - l_games AS game_diff FROM matches")
def parse_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("match_id", "score", "w_games", "l_games", "sets", "completed", "walkover", (F.col("w_games") - F.col("l_games")).alias("game_diff"))


@query(MATCHES + """SELECT match_id, CASE WHEN walkover THEN ''
  ELSE '6-' || CAST(g1 AS VARCHAR) || ',' || CAST(h2 AS VARCHAR) || '-' || CAST(g2 AS VARCHAR) END AS score_key FROM scored""")
def score_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("match_id", s.score_key(F.col("score")).alias("score_key"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM orders")
def parse_dates_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    text = F.when(key % 5 == 0, F.date_format(day, "yyyyMMdd")).when(key % 5 == 1, F.date_format(day, "yyyy/M/d")).when(key % 5 == 2, F.date_format(day, "yyyy-MM-dd")).when(key % 5 == 3, F.date_format(day, "yyyy/MM/dd")).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "orders").select(key.alias("k"), s.parse_date(text).alias("date"))


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(split_part(text, ' ', 1), chr(10), ' '))), '[-.''`]', ' ', 'g'), '\\s+',
  ' ', 'g')) AS name_key
FROM documents""")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.translate(F.split_part(F.col("text"), F.lit(" "), F.lit(1)), "\n", " ")
    return table(spark, sf_dir, "documents").select("doc_id", name_key(first).alias("name_key"))


@query("""WITH n AS (SELECT p_partkey, string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[-.''`]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS w
  FROM part)
SELECT p_partkey, CASE WHEN len(w[len(w)]) = 1 THEN array_to_string(w[1:greatest(len(w) - 1, 1)], ' ') || ' ' || w[len(w)]
  WHEN len(w) > 1 THEN array_to_string(w[2:], ' ') || ' ' || substr(w[1], 1, 1) ELSE w[1] || ' ' || substr(w[1], 1, 1) END AS surname_key FROM n""")
def surname_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", s.surname_key(F.col("p_name")).alias("surname_key"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(p_name || '  ' || p_type, '\\s+', ' ', 'g'))) AS event_key, substr(regexp_replace(lower(p_name || p_type),
  '[^a-z]', '', 'g'), 1, 18) AS letters FROM part""")
def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", s.event_key(F.concat_ws("  ", "p_name", "p_type")).alias("event_key"), s.event_letters(F.concat("p_name", "p_type")).alias("letters"))


_SOURCES = MATCHES + """, copies AS (
  SELECT match_id, winner, loser, date, CASE WHEN match_id % 5 = 0 THEN '' ELSE CAST(round_order AS VARCHAR) END AS round, score, 0 AS src,
  FALSE AS has_stats, CAST(NULL AS VARCHAR) AS event_id FROM matches
  UNION ALL SELECT match_id, winner, loser, date, CAST(round_order AS VARCHAR), score, 1, TRUE, CAST(NULL AS VARCHAR) FROM matches
  WHERE match_id % 2 = 0
  UNION ALL SELECT match_id, winner, loser, date + CAST(match_id % 2 AS INTEGER), CAST(round_order AS VARCHAR), score, 3, FALSE, event_id FROM matches
  WHERE match_id % 3 = 0)
"""


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three sources for the same matches: all without statistics and some rounds; half with; a third with ids."""
    m = matches(spark, sf_dir)
    own = ("match_id", "winner", "loser")
    round_ = F.col("round_order").cast("string")
    none = F.lit(None).cast("string").alias("event_id")
    base = m.select(*own, "date", F.when(F.col("match_id") % 5 == 0, "").otherwise(round_).alias("round"), "score", F.lit(0).alias("src"), F.lit(False).alias("has_stats"), none)
    stats = m.filter("match_id % 2 = 0").select(*own, "date", round_.alias("round"), "score", F.lit(1).alias("src"), F.lit(True).alias("has_stats"), none)
    live = m.filter("match_id % 3 = 0").select(*own, F.date_add("date", (F.col("match_id") % 2).cast("int")).alias("date"), round_.alias("round"), "score", F.lit(3).alias("src"), F.lit(False).alias("has_stats"), "event_id")
    return base.unionByName(stats).unionByName(live)


@query(_SOURCES + """SELECT src, count(*) AS n, count(event_id) AS with_id, CAST(count(*) FILTER (WHERE has_stats) AS BIGINT) AS with_stats, min(date) AS first,
  max(date) AS last FROM copies GROUP BY src""")
def scan_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(spark, sf_dir).groupBy("src").agg(F.count("*").alias("n"), F.count("event_id").alias("with_id"), F.count_if("has_stats").alias("with_stats"), F.min("date").alias("first"), F.max("date").alias("last"))


_RESOLVED = _SOURCES + """, keyed AS (SELECT *, CAST(winner AS VARCHAR) || '|' || CAST(loser AS VARCHAR) || '|' || CAST(year(date) AS VARCHAR) || '|' || coalesce(score,
  '') AS k FROM copies),
known AS (SELECT k, min(nullif(round, '')) AS lo, max(nullif(round, '')) AS hi, min(event_id) AS ilo, max(event_id) AS ihi FROM keyed GROUP BY k),
resolved AS (SELECT c.*, coalesce(nullif(c.round, ''), CASE WHEN n.lo = n.hi THEN n.lo END) AS round2, coalesce(c.event_id, CASE
  WHEN n.ilo = n.ihi THEN n.ilo END) AS id2 FROM keyed c JOIN known n USING (k))
"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies with blank rounds and missing ids taken from the one known value of their key."""
    key = F.concat_ws("|", F.col("winner").cast("string"), F.col("loser").cast("string"), F.year("date").cast("string"), F.coalesce("score", F.lit("")))
    rows = copies(spark, sf_dir).withColumn("k", key).withColumn("known", F.expr("nullif(round, '')"))
    return fill_if_unique(fill_if_unique(rows, "known", ["k"], "round2"), "event_id", ["k"], "id2").drop("known")


@query(_RESOLVED + "SELECT match_id, src, round, round2 FROM resolved")
def blank_round_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("match_id", "src", "round", "round2")


@query(_RESOLVED + "SELECT match_id, src, event_id, id2 FROM resolved")
def id_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("match_id", "src", "event_id", "id2")


@query(_RESOLVED + """, one AS (SELECT *, row_number() OVER (PARTITION BY k, coalesce(round2, '') ORDER BY has_stats DESC, src, match_id) AS a FROM resolved),
two AS (SELECT *, row_number() OVER (PARTITION BY winner, loser, date, coalesce(round2, '') ORDER BY has_stats DESC, src, match_id) AS b FROM one
  WHERE a = 1)
SELECT match_id, winner, loser, date, coalesce(round2, '') AS round, src, has_stats, id2 AS event_id FROM two WHERE b = 1""")
def dedup_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolved(spark, sf_dir).withColumn("round", F.coalesce("round2", F.lit("")))
    best = [F.desc("has_stats"), F.asc("src"), F.asc("match_id")]
    kept = keep_best(keep_best(rows, ["k", "round"], best), ["winner", "loser", "date", "round"], best)
    return kept.select("match_id", "winner", "loser", "date", "round", "src", "has_stats", F.col("id2").alias("event_id"))


@query(_SOURCES + """, spelled AS (SELECT src, CASE WHEN (match_id + src) % 3 = 0 THEN 'PLAYER-' || CAST(winner AS VARCHAR)
  WHEN (match_id + src) % 3 = 1 THEN 'Player ' || CAST(winner AS VARCHAR) ELSE 'player ' || CAST(winner AS VARCHAR) END AS name FROM copies),
counted AS (SELECT lower(replace(name, '-', ' ')) AS k, name, src, count(*) AS n FROM spelled GROUP BY ALL)
SELECT k AS name_key, arg_min(name, (src, -n, name)) AS canonical, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY k""")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, pick = F.col("winner").cast("string"), (F.col("match_id") + F.col("src")) % 3
    name = F.when(pick == 0, F.concat(F.lit("PLAYER-"), id_)).when(pick == 1, F.concat(F.lit("Player "), id_)).otherwise(F.concat(F.lit("player "), id_))
    counted = copies(spark, sf_dir).select(s.name_key(name).alias("name_key"), name.alias("name"), "src").groupBy("name_key", "name", "src").agg(F.count("*").alias("n"))
    return counted.groupBy("name_key").agg(F.min_by("name", F.struct("src", (-F.col("n")).alias("m"), "name")).alias("canonical"), F.sum("n").alias("n"))


@query(MATCHES + """, seen AS (SELECT pl.player, CASE WHEN pl.match_id % 3 = 0 THEN p.hand END AS hand, CASE WHEN pl.match_id % 4 = 1 THEN p.ht END AS ht, won, date,
  event_id, round_order, match_id FROM pl JOIN players p USING (player))
SELECT player, arg_min(hand, (1 - won, date, event_id, round_order, match_id)) FILTER (WHERE hand IS NOT NULL) AS hand, arg_min(ht, (1 - won, date,
  event_id, round_order, match_id)) FILTER (WHERE ht IS NOT NULL) AS ht FROM seen GROUP BY player""")
def backfill_bios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known value of each player, winner's rows first."""
    rows = player_long(matches(spark, sf_dir)).join(players(spark, sf_dir), "player")
    order = F.struct((1 - F.col("won")).alias("side"), "date", "event_id", "round_order", "match_id")
    seen = rows.select("player", F.when(F.col("match_id") % 3 == 0, F.col("hand")).alias("hand"), F.when(F.col("match_id") % 4 == 1, F.col("ht")).alias("ht"), order.alias("at"))
    return seen.groupBy("player").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in ("hand", "ht")])


@query(MATCHES + """, n AS (SELECT event_id, surface, count(*) AS n FROM matches GROUP BY ALL) SELECT event_id, arg_min(surface, (-n, surface)) AS surface FROM n
  GROUP BY event_id""")
def backfill_event_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mode_by(matches(spark, sf_dir), ["event_id"], "surface")


@query(MATCHES + """SELECT match_id, coalesce(CASE WHEN match_id % 3 = 0 THEN surface END, CASE WHEN match_id % 3 = 1 AND event < 'J' THEN 'Hard' END, CASE
  WHEN month(date) IN (4, 5) THEN 'Clay' WHEN month(date) IN (6, 7) THEN 'Grass' ELSE 'Hard' END) AS surface,
CASE WHEN match_id % 3 = 0 THEN 'archive' WHEN match_id % 3 = 1 AND event < 'J' THEN 'cache' ELSE 'month' END AS source FROM matches""")
def surface_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = F.when(F.col("match_id") % 3 == 0, F.col("surface"))
    cached = F.when((F.col("match_id") % 3 == 1) & (F.col("event") < "J"), F.lit("Hard"))
    month = F.when(F.month("date").isin(4, 5), "Clay").when(F.month("date").isin(6, 7), "Grass").otherwise("Hard")
    source = F.when(archive.isNotNull(), "archive").when(cached.isNotNull(), "cache").otherwise("month")
    return matches(spark, sf_dir).select("match_id", F.coalesce(archive, cached, month).alias("surface"), source.alias("source"))


@query(MATCHES + "SELECT tier, round(0.89 + (tier_k - 0.9) / (1.1 - 0.9) * (0.91 - 0.89), 6) AS tier_k, count(*) AS n FROM matches GROUP BY ALL")
def tier_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier weights rescaled between a tour's two anchors."""
    low, high = 0.89, 0.91
    scaled = F.round(low + (F.col("tier_k") - 0.9) / (1.1 - 0.9) * (high - low), 6)
    return matches(spark, sf_dir).groupBy("tier", scaled.alias("tier_k")).agg(F.count("*").alias("n"))


@query(MATCHES + """SELECT match_id, CASE WHEN match_id % 4 = 0 THEN draw_level WHEN tier IN (4, 5) THEN 'chall' WHEN round_order < 2 THEN 'qual'
  ELSE 'main' END AS draw_level FROM matches""")
def draw_level_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("match_id") % 4 == 0, F.col("draw_level"))
    content = F.when(F.col("tier").isin(4, 5), "chall").when(F.col("round_order") < 2, "qual")
    return matches(spark, sf_dir).select("match_id", F.coalesce(stamp, content, F.lit("main")).alias("draw_level"))


@query(MATCHES + "SELECT match_id, date FROM matches WHERE date <= DATE '2001-03-01' + 60")
def impossible_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to 60 days past a given reference day; no clock is read."""
    return matches(spark, sf_dir).filter(F.col("date") <= F.date_add(F.lit("2001-03-01").cast("date"), 60)).select("match_id", "date")


@query(MATCHES + """SELECT draw_level, tour, count(*) AS n, CAST(count(*) FILTER (WHERE draw_level = 'main' AND NOT (tour = 1 AND tier = 5)) AS BIGINT) AS kept,
  CAST(count(*) FILTER (WHERE draw_level <> 'main' OR (tour = 1 AND tier = 5)) AS BIGINT) AS excluded FROM matches GROUP BY ALL""")
def policy_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    admitted = (F.col("draw_level") == "main") & ~((F.col("tour") == 1) & (F.col("tier") == 5))
    return matches(spark, sf_dir).groupBy("draw_level", "tour").agg(F.count("*").alias("n"), F.count_if(admitted).alias("kept"), F.count_if(~admitted).alias("excluded"))


@query(_SOURCES + """, e AS (SELECT *, coalesce(score, '') AS sc, count(*) OVER w AS rows_, count(DISTINCT src) OVER w AS srcs, count(event_id) OVER w AS ids,
  max(event_id) OVER w AS the_id, max(CASE WHEN event_id IS NOT NULL THEN round END) OVER w AS the_round
  FROM copies WINDOW w AS (PARTITION BY winner, loser, date, coalesce(score, '')))
SELECT match_id, src, CASE WHEN ids = 1 AND rows_ = srcs THEN the_id ELSE event_id END AS event_id, CASE WHEN ids = 1 AND rows_ = srcs THEN the_round
  ELSE round END AS round FROM e""")
def exact_live_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a bucket of equal players, day and score with one row a source and one live row, that row's id and round hold."""
    w = W.partitionBy("winner", "loser", "date", F.coalesce("score", F.lit("")))
    known = F.col("event_id").isNotNull()
    rows = copies(spark, sf_dir).withColumns({"alone": F.size(F.collect_set("src").over(w)) == F.count("*").over(w), "ids": F.count("event_id").over(w), "the_id": F.max("event_id").over(w), "the_round": F.max(F.when(known, F.col("round"))).over(w)})
    sure = F.col("alone") & (F.col("ids") == 1)
    return rows.select("match_id", "src", F.when(sure, F.col("the_id")).otherwise(F.col("event_id")).alias("event_id"), F.when(sure, F.col("the_round")).otherwise(F.col("round")).alias("round"))


_FINALS = MATCHES + """, f AS (SELECT match_id, winner, loser, event, CASE WHEN match_id % 3 = 0 THEN date + 3650 ELSE date END AS date FROM matches WHERE round_order = 7),
semis AS (SELECT winner, event, date FROM matches WHERE round_order = 6),
cand AS (SELECT DISTINCT f.match_id, year(a.date) AS y FROM f JOIN semis a ON a.event = f.event AND a.winner = f.winner
  JOIN semis b ON b.event = f.event AND b.winner = f.loser AND year(a.date) = year(b.date)
  WHERE f.date > DATE '2002-01-01')
"""


@query(_FINALS + """SELECT f.match_id, f.date, CASE WHEN count(c.y) = 1 THEN min(c.y) END AS year FROM f LEFT JOIN cand c USING (match_id)
  WHERE f.date > DATE '2002-01-01' GROUP BY f.match_id, f.date""")
def final_year_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year of a final dated too late, where its two players won semi-finals of that event in one season only."""
    m = matches(spark, sf_dir)
    late = F.lit("2002-01-01").cast("date")
    finals = m.filter("round_order = 7").select("match_id", "winner", "loser", "event", F.when(F.col("match_id") % 3 == 0, F.date_add("date", 3650)).otherwise(F.col("date")).alias("date")).filter(F.col("date") > late)
    semis = m.filter("round_order = 6").select("event", "winner", "year").distinct()
    first = finals.select("match_id", "event", "winner", "loser").join(semis, ["event", "winner"])
    both = first.join(semis.withColumnRenamed("winner", "loser"), ["event", "loser", "year"]).groupBy("match_id").agg(F.countDistinct("year").alias("n"), F.min("year").alias("y"))
    return finals.join(both, "match_id", "left").select("match_id", "date", F.when(F.col("n") == 1, F.col("y")).alias("year"))


@query(MATCHES + "SELECT match_id, row_number() OVER (ORDER BY date, event_id, round_order, match_id) AS seq FROM matches")
def chronological_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.unix_date("date"), F.col("event_id"), F.col("round_order"), F.col("match_id")]
    return sequence(matches(spark, sf_dir).select("match_id", "date", "event_id", "round_order"), order).select("match_id", "seq")


@query(MATCHES + """, y AS (SELECT year, count(*) AS n FROM matches WHERE year < 2001 OR match_id % 3 = 0 GROUP BY year),
m AS (SELECT list_sort(list(n))[len(list(n)) // 2 + 1] AS mid FROM (SELECT n FROM y WHERE year <> 2020 ORDER BY year DESC LIMIT 12))
SELECT year, n, mid AS median FROM y, m WHERE n < 0.6 * mid""")
def thin_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons with less than 0.6 of the upper median of the last twelve."""
    years = matches(spark, sf_dir).filter("year < 2001 or match_id % 3 = 0").groupBy("year").agg(F.count("*").alias("n"))
    last = years.filter("year <> 2020").orderBy(F.desc("year")).limit(12)
    middle = last.agg(F.array_sort(F.collect_list("n")).alias("a")).select(F.col("a")[F.expr("size(a) div 2")].alias("median"))
    return years.join(F.broadcast(middle)).filter(F.col("n") < 0.6 * F.col("median"))


@query(MATCHES + """SELECT count(*) AS matches, min(date) AS first, max(date) AS last, (SELECT count(DISTINCT player)
  FROM pl) AS players, round(avg(CASE WHEN completed THEN 1.0 ELSE 0.0 END), 6) AS completed,
round(avg(CASE WHEN w_svpt IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS with_stats, CAST(count(*) FILTER (WHERE surface = 'Hard') AS BIGINT) AS hard,
  CAST(count(*) FILTER (WHERE surface = 'Clay') AS BIGINT) AS clay FROM matches""")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    both = m.select("*", F.explode(F.array("winner", "loser")).alias("player"), F.lit(0.5).alias("half"))
    flag = lambda c: F.round(F.sum(F.when(c, 0.5).otherwise(0.0)) / F.sum("half"), 6)
    return both.agg((F.count("*") / 2).cast("long").alias("matches"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("player").alias("players"), flag(F.col("completed")).alias("completed"), flag(F.col("w_svpt").isNotNull()).alias("with_stats"), (F.count_if(F.col("surface") == "Hard") / 2).cast("long").alias("hard"), (F.count_if(F.col("surface") == "Clay") / 2).cast("long").alias("clay"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title,
  CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<a[ >]')) AS BIGINT) AS links,
trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<p[^>]*>(.*?)</p>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS lead FROM pages""")
def html_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.regexp_extract("html", r"(?s)<p[^>]*>(.*?)</p>", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"),
        F.regexp_count("html", F.lit("<a[ >]")).cast("long").alias("links"), F.trim(F.regexp_replace(F.regexp_replace(lead, "<[^>]*>", ""), r"\s+", " ")).alias("lead"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, list({'id': event_id, 'type': event_type, 'done': event_id % 4 <> 0} ORDER BY event_id) AS games
  FROM events GROUP BY ALL)
SELECT user_id, day, g.id AS id, g.type AS type FROM (SELECT user_id, day, unnest(games) AS g FROM b) WHERE g.done""")
def scoreboard_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested scoreboards as JSON text, read back and exploded to finished games."""
    e = table(spark, sf_dir, "events")
    game = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), (F.col("event_id") % 4 != 0).alias("done"))
    boards = e.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.to_json(F.struct(F.collect_list(game).alias("games"))).alias("payload"))
    games = boards.select("user_id", "day", F.explode(F.from_json("payload", "games array<struct<id bigint, type string, done boolean>>")["games"]).alias("g"))
    return games.filter("g.done").select("user_id", "day", "g.id", "g.type")
