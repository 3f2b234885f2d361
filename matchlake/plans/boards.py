"""The client's queries over published boards, published products, and the checks of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.functions import levels as lv
from matchlake.functions import scalars as s
from matchlake.functions.names import name_key
from matchlake.operators.context import dealt
from matchlake.plans.gate import violations
from matchlake.plans.products import fixtures
from matchlake.plans.registry import query
from matchlake.plans.sim import TOP, matrix
from matchlake.sources.adapters import MATCHES, matches, player_long, players, table
from matchlake.sources.files import read_jsonl, scratch, staged

_PL = """WITH field AS (SELECT s_nationkey AS event, s_suppkey AS player, s_name AS name, CAST(s_acctbal AS DOUBLE) AS rating,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS seed FROM supplier) """


@query(_PL + """, ask AS (SELECT a.event, a.player AS i, b.player AS j, a.seed AS si, b.seed AS sj, a.rating AS ri, CASE WHEN b.player % 6 > 0 THEN b.rating END AS rj
  FROM field a JOIN field b ON a.event = b.event AND a.player < b.player)
SELECT event, i, j, CASE WHEN si <= 3 AND sj <= 3 THEN round(1 / (1 + pow(10, -(ri - rj0) / 4000)), 6) WHEN rj IS NOT NULL THEN round(1 / (1 + pow(10,
  -(ri - rj) / 400)), 6) END AS p, CASE WHEN si <= 3 AND sj <= 3 THEN 'matrix' WHEN rj IS NOT NULL THEN 'rating' END AS source
FROM (SELECT ask.*, f.rating AS rj0 FROM ask JOIN field f ON f.event = ask.event AND f.player = ask.j)""")
def win_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of pairs: a cell of the published matrix, else the logistic of both ratings, else none."""
    f = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("event"), F.col("s_suppkey").alias("player"), F.col("s_acctbal").cast("double").alias("rating"))
    x, y = (f.select("event", F.col("player").alias(k), F.col("rating").alias(f"r{k}")) for k in "ij")
    asked = x.join(y, "event").filter("i < j")  # pairs of one nation are what is asked for
    upper = matrix(spark, sf_dir, 3).select("event", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.when(F.col("i") < F.col("j"), F.col("p")).otherwise(1 - F.col("p")).alias("cell"))
    rated = F.when(F.col("j") % 6 > 0, s.expected_score(F.col("ri"), F.col("rj")))
    joined = asked.join(upper, ["event", "i", "j"], "left")
    source = F.when(F.col("cell").isNotNull(), "matrix").when(rated.isNotNull(), "rating")
    return joined.select("event", "i", "j", F.round(F.coalesce("cell", rated), 6).alias("p"), source.alias("source"))


@query("SELECT s_suppkey AS asked, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS name FROM supplier")
def roster_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roster spellings of names from elsewhere, by name key."""
    p = table(spark, sf_dir, "supplier")
    roster = p.filter("s_suppkey % 3 > 0").select(name_key(F.col("s_name")).alias("k"), F.col("s_name").alias("name"))
    asked = p.select(F.col("s_suppkey").alias("asked"), name_key(F.concat(F.lit(" "), F.upper("s_name"))).alias("k"))
    return asked.join(roster, "k", "left").select("asked", "name")


@query("SELECT s_suppkey AS player, s_name AS name FROM supplier WHERE contains(lower(s_name), '00000') AND contains(lower(s_name), '7')")
def ranking_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose name holds every word of a search."""
    low = F.lower("s_name")
    return table(spark, sf_dir, "supplier").filter(low.contains("00000") & low.contains("7")).select(F.col("s_suppkey").alias("player"), F.col("s_name").alias("name"))


_EV = MATCHES + """, e AS (SELECT event_id, event, year, min(date) AS start, max(date) AS finish, CASE min(tier) WHEN 1 THEN 'Grand Slam' WHEN 2 THEN 'ATP Finals'
  WHEN 3 THEN 'Masters 1000' WHEN 4 THEN 'ATP 500' ELSE 'ATP 250' END AS level FROM matches GROUP BY ALL),
st AS (SELECT *, CASE WHEN finish < DATE '1998-06-01' THEN 'completed' WHEN start > DATE '1998-06-01' THEN 'upcoming' ELSE 'live' END AS status,
  CASE level WHEN 'Grand Slam' THEN 0 WHEN 'ATP Finals' THEN 1 WHEN 'Masters 1000' THEN 2 WHEN 'ATP 500' THEN 3 ELSE 4 END AS rank FROM e)
"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a tier and their status on a stated day."""
    now, tier = F.lit("1998-06-01").cast("date"), F.min("tier")
    level = F.when(tier == 1, "Grand Slam").when(tier == 2, "ATP Finals").when(tier == 3, "Masters 1000").when(tier == 4, "ATP 500").otherwise("ATP 250")
    e = matches(spark, sf_dir).groupBy("event_id", "event", "year").agg(F.min("date").alias("start"), F.max("date").alias("finish"), level.alias("level"))
    status = F.when(F.col("finish") < now, "completed").when(F.col("start") > now, "upcoming").otherwise("live")
    return e.withColumns({"status": status, "rank": lv.tournament_tier(F.col("level"), F.col("event"))["rank"]})


@query(_EV + "SELECT status, arg_min(event_id, (rank, finish, event_id)) AS hero FROM st WHERE status <> 'completed' AND rank <= 2 GROUP BY status")
def hero_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most prestigious event of each current cohort that owns the first place."""
    rows = cards(spark, sf_dir).filter("status <> 'completed' and rank <= 2")
    return rows.groupBy("status").agg(F.min_by("event_id", F.struct("rank", "finish", "event_id")).alias("hero"))


@query(_EV + "SELECT event_id, row_number() OVER (PARTITION BY status ORDER BY rank, finish DESC, event_id) AS place, status FROM st")
def tournament_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each status by prestige, then recency."""
    order = W.partitionBy("status").orderBy("rank", F.desc("finish"), "event_id")
    return cards(spark, sf_dir).select("event_id", F.row_number().over(order).alias("place"), "status")


@query(MATCHES + "SELECT match_id, event_id FROM matches WHERE surface = 'Clay' AND contains(lower(event), 'a') AND date > DATE '1997-01-01'")
def upcoming_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).filter((F.col("surface") == "Clay") & F.lower("event").contains("a") & (F.col("date") > "1997-01-01")).select("match_id", "event_id")


@query(MATCHES + """, o AS (SELECT event_id, match_id, date FROM matches WHERE year = 1997), g AS (SELECT event_id, min({'d': date, 'm': match_id}) AS first,
  array_to_string(list(match_id ORDER BY date, match_id), ',') AS matches FROM o
  GROUP BY event_id) SELECT event_id, matches, row_number() OVER (ORDER BY first.d, first.m) AS place FROM g""")
def upcoming_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A season's schedule grouped by event, groups and matches in the order of the schedule."""
    from matchlake.operators.order import sequence

    row = F.struct("date", "match_id")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["match_id"].cast("string")), ",")
    g = matches(spark, sf_dir).filter("year = 1997").groupBy("event_id").agg(F.min(row).alias("first"), listed.alias("matches"))
    rows = g.select("event_id", "matches", F.col("first.date").alias("d"), F.col("first.match_id").alias("m"))
    return sequence(rows, [F.unix_date("d"), F.col("m")], "place").select("event_id", "matches", "place")


@query(MATCHES + """, pr AS (SELECT m.match_id, floor((coalesce(w.points, 0) + 100.0) / (coalesce(w.points, 0) + coalesce(l.points, 0) + 200.0) * 1000 + 0.5) / 1000 AS p
  FROM matches m JOIN players w ON w.player = m.winner JOIN players l ON l.player = m.loser WHERE m.completed)
SELECT match_id, 'all' AS filter FROM pr UNION ALL SELECT match_id, CASE WHEN p < 0.5 THEN 'upsets' ELSE 'called' END FROM pr""")
def results_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results under each filter that shows them."""
    kinds = F.array(F.lit("all"), F.when(F.col("upset"), "upsets").otherwise("called"))
    return fixtures(spark, sf_dir).select("match_id", F.explode(kinds).alias("filter"))


@query(_PL + f""", top AS (SELECT * FROM field WHERE seed <= {TOP}), k AS (SELECT event, count(*) AS n FROM top GROUP BY event),
t AS (SELECT a.event, a.seed AS i, b.seed AS j, round(1 / (1 + pow(10, -(a.rating - b.rating) / 4000)), 6) AS v, n FROM top a JOIN top b ON a.event = b.event AND a.seed < b.seed JOIN k ON k.event = a.event)
SELECT event, i, j, CAST((i - 1) * (2 * n - i) // 2 + j - i - 1 AS BIGINT) AS place, v AS forward, round(-v, 6) AS backward FROM t""")
def matrix_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed evidence looked up by the place of its pair in the triangle, from either side: turned round, its sign changes."""
    upper = staged(matrix(spark, sf_dir, TOP))
    size = upper.groupBy("event").agg(F.max("sj").alias("n"))
    place = F.expr("(si - 1) * (2 * n - si) div 2 + sj - si - 1").cast("long")
    packed = upper.join(size, "event").select("event", place.alias("place"), F.round("p", 6).alias("v"))
    asked = upper.select("event", F.col("si").alias("i"), F.col("sj").alias("j"), "si", "sj").join(size, "event").withColumn("place", place)
    return asked.join(packed, ["event", "place"]).select("event", "i", "j", "place", F.col("v").alias("forward"), oriented_evidence(F.col("v"), F.lit(True)).alias("backward"))


def oriented_evidence(value: F.Column, flip: F.Column) -> F.Column:
    """Signed evidence from the other side."""
    return F.when(flip, -value).otherwise(value)


@query(MATCHES + """, v AS (SELECT player, sum(games_for) AS g, sum(won) AS w FROM pl GROUP BY player), a AS (SELECT player, 'games' AS axis, CAST(g AS DOUBLE) AS x
  FROM v UNION ALL SELECT player, 'wins', CAST(w AS DOUBLE) FROM v)
SELECT player, axis, round((rank() OVER (PARTITION BY axis ORDER BY x) - 1 + 0.5 * count(*) OVER (PARTITION BY axis,
  x)) / count(*) OVER (PARTITION BY axis), 6) AS percentile FROM a""")
def radar_scalers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-rank percentile of every player on every axis, from counts of distinct values."""
    v = player_long(matches(spark, sf_dir)).groupBy("player").agg(F.sum("games_for").cast("double").alias("games"), F.sum("won").cast("double").alias("wins"))
    a = v.unpivot("player", ["games", "wins"], "axis", "x")
    values = a.groupBy("axis", "x").agg(F.count("*").alias("peers"))
    run = values.withColumns({"upto": F.sum("peers").over(W.partitionBy("axis").orderBy("x")), "total": F.sum("peers").over(W.partitionBy("axis"))})
    return a.join(run, ["axis", "x"]).select("player", "axis", F.round((F.col("upto") - 0.5 * F.col("peers")) / F.col("total"), 6).alias("percentile"))


@query(MATCHES + "SELECT lower(trim(event)) AS event, event_id, player, max(round_order) AS reach FROM pl WHERE year = 1998 GROUP BY ALL")
def reach_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each player of a season's events came, under the event's name."""
    rows = matches(spark, sf_dir).filter("year = 1998").select("event", "event_id", "round_order", F.explode(F.array("winner", "loser")).alias("player"))
    return rows.groupBy(s.event_key(F.col("event")).alias("event"), "event_id", "player").agg(F.max("round_order").alias("reach"))


@query(MATCHES + """, r AS (SELECT player, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, max(date) AS last, array_to_string(list(CASE WHEN won = 1 THEN 'W'
  ELSE 'L' END ORDER BY date DESC, match_id DESC)[1:5], '') AS form FROM pl GROUP BY player)
SELECT p.player, p.name, r.n, r.wins, r.last, r.form, substr(sha256(p.name), 1, 16) || '.json' AS file FROM players p JOIN r USING (player)""")
def profile_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dossier a player, with the file it goes to; recent form from a window of five rows."""
    rows = player_long(matches(spark, sf_dir))
    totals = rows.groupBy("player").agg(F.count("*").alias("n"), F.sum("won").cast("long").alias("wins"), F.max("date").alias("last"))
    recent = rows.withColumn("i", F.row_number().over(W.partitionBy("player").orderBy(F.desc("date"), F.desc("match_id")))).filter("i <= 5")
    form = recent.groupBy("player").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "won"))), lambda x: F.when(x["won"] == 1, "W").otherwise("L")), "").alias("form"))
    p = players(spark, sf_dir).select("player", "name", F.concat(F.substring(F.sha2("name", 256), 1, 16), F.lit(".json")).alias("file"))
    return p.join(totals, "player").join(form, "player").select("player", "name", "n", "wins", "last", "form", "file")


@query(MATCHES + """SELECT tour, count(*) AS matches, CAST(count(*) FILTER (WHERE draw_level = 'main') AS BIGINT) AS main, (SELECT count(DISTINCT player) FROM pl q
  WHERE q.tour = m.tour) AS players, max(date) AS data_to, CAST(count(*) FILTER (WHERE tour = 1 AND tier = 5) AS BIGINT) AS excluded FROM matches m
  GROUP BY tour""")
def build_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, players and what policy excludes, by tour."""
    m = matches(spark, sf_dir)
    who = m.select("tour", F.explode(F.array("winner", "loser")).alias("player")).groupBy("tour").agg(F.count_distinct("player").alias("players"))
    counts = m.groupBy("tour").agg(F.count("*").alias("matches"), F.count_if(F.col("draw_level") == "main").alias("main"), F.max("date").alias("data_to"), F.count_if((F.col("tour") == 1) & (F.col("tier") == 5)).alias("excluded"))
    return counts.join(who, "tour")


@query(MATCHES + """SELECT tour, date_diff('day', max(date), DATE '2002-01-01') AS age, date_diff('day', max(date) FILTER (WHERE w_svpt IS NOT NULL),
  DATE '2002-01-01') AS stats_age, round(avg(CASE WHEN w_svpt IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage,
  CAST(count(*) FILTER (WHERE date > DATE '1998-07-01') AS BIGINT) AS future FROM matches GROUP BY tour""")
def tour_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages of results and statistics, coverage, and rows after a stated day."""
    now = F.lit("2002-01-01").cast("date")
    stats = F.col("w_svpt").isNotNull()
    return matches(spark, sf_dir).groupBy("tour").agg(F.datediff(now, F.max("date")).cast("long").alias("age"), F.datediff(now, F.max(F.when(stats, F.col("date")))).cast("long").alias("stats_age"), F.round(F.avg(stats.cast("int")), 6).alias("coverage"), F.count_if(F.col("date") > "1998-07-01").alias("future"))


_WEIGHTS = {"closeness": 0.30, "quality": 0.25, "stakes": 0.15, "leverage": 0.15, "style": 0.15}
_WATCHED = MATCHES + """, f AS (SELECT match_id, date, 100 - match_id % 50 AS closeness, match_id % 101 AS quality, match_id % 90 AS stakes, CASE
  WHEN match_id % 3 = 0 THEN NULL ELSE match_id % 80 END AS leverage, CASE WHEN match_id % 4 = 0 THEN NULL ELSE match_id % 70 END AS style
  FROM matches),
s AS (SELECT *, round(0.30 * closeness + 0.25 * quality + 0.15 * stakes + 0.15 * coalesce(leverage, 0) + 0.15 * coalesce(style, 0), 4) AS true_score,
  3 + (leverage IS NOT NULL)::INT + (style IS NOT NULL)::INT AS true_cover FROM f),
w AS (SELECT *, CASE WHEN match_id % 17 = 0 THEN true_score + 1 ELSE true_score END AS score, CASE WHEN match_id % 23 = 0 THEN 5
  ELSE true_cover END AS coverage FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, match_id) + CASE
  WHEN match_id % 29 = 0 THEN 1 ELSE 0 END AS rank FROM w)
"""


def watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published watch board with scores and coverage, some of them damaged."""
    k = F.col("match_id")
    f = staged(matches(spark, sf_dir).select("match_id", "date")).select(k, "date", (100 - k % 50).alias("closeness"), (k % 101).alias("quality"), (k % 90).alias("stakes"), F.when(k % 3 > 0, k % 80).alias("leverage"), F.when(k % 4 > 0, k % 70).alias("style"))
    score, cover = weighted()
    return f.withColumns({"score": F.when(k % 17 == 0, score + 1).otherwise(score), "coverage": F.when(k % 23 == 0, 5).otherwise(cover)})


def ranked(rows: DataFrame) -> DataFrame:
    """date and rank of a staged watch board, some of them damaged; days are dealt to tasks of about as many rows whatever the table."""
    k = F.col("match_id")
    place = F.row_number().over(W.partitionBy("date").orderBy(F.desc("score"), "match_id"))
    return dealt(rows.select("date", "score", k), rows.count(), "date").select("date", (place + F.when(k % 29 == 0, 1).otherwise(0)).alias("rank"))


def weighted() -> tuple[F.Column, F.Column]:
    """Weighted score of the factors that are there, and their number."""
    terms = [w * F.coalesce(F.col(c), F.lit(0)) for c, w in _WEIGHTS.items()]
    there = [F.col(c).isNotNull().cast("int") for c in _WEIGHTS]
    return F.round(sum(terms[1:], terms[0]), 4), sum(there[1:], there[0])


@query(_WATCHED + """SELECT 'score' AS "check", CAST(match_id AS VARCHAR) AS key, 'disagrees with its factors' AS message FROM r WHERE abs(score - true_score) > 0.11
  UNION ALL SELECT 'coverage', CAST(match_id AS VARCHAR), 'disagrees with its factors' FROM r WHERE coverage <> true_cover
UNION ALL SELECT 'ranks', CAST(date AS VARCHAR), 'not contiguous' FROM r GROUP BY date
  HAVING max(rank) <> count(*) OR count(DISTINCT rank) <> count(*) OR min(rank) <> 1""")
def gate_watch_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and coverage recomputed from their factors; ranks of a day without gaps."""
    rows = watched(spark, sf_dir)
    score, cover = weighted()
    key = F.col("match_id")
    day = ranked(rows).groupBy("date").agg(F.count("*").alias("n"), F.max("rank").alias("hi"), F.min("rank").alias("lo"), F.count_distinct("rank").alias("ranks"))
    out = violations(rows, "score", key, F.abs(F.col("score") - score) > 0.11, F.lit("disagrees with its factors"))
    out = out.unionByName(violations(rows, "coverage", key, F.col("coverage") != cover, F.lit("disagrees with its factors")))
    return out.unionByName(violations(day, "ranks", F.col("date"), (F.col("hi") != F.col("n")) | (F.col("ranks") != F.col("n")) | (F.col("lo") != 1), F.lit("not contiguous")))


_PERF = MATCHES + """, d AS (SELECT player, match_id, won, 0.2 + match_id % 60 / 100.0 AS p FROM pl
  WHERE NOT walkover), s AS (SELECT player, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, sum(p) AS expected FROM d GROUP BY player),
pub AS (SELECT player, n, CASE WHEN player % 7 = 3 THEN n + 1 ELSE wins END AS wins, round(expected, 6) AS expected, round(wins - expected + CASE
  WHEN player % 5 = 2 THEN 0.5 ELSE 0 END, 6) AS delta FROM s)
"""


@query(_PERF + """SELECT 'summary' AS "check", CAST(player AS VARCHAR) AS key, 'inconsistent' AS message FROM pub
  WHERE wins > n OR expected > n OR abs(delta - (wins - expected)) > 0.002
UNION ALL SELECT 'evidence', CAST(p.player AS VARCHAR), 'wins differ from decisions' FROM pub p JOIN s ON s.player = p.player WHERE p.wins <> s.wins""")
def gate_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published performance against itself and against its decisions; some players' summaries are damaged here."""
    d = player_long(matches(spark, sf_dir)).filter("not walkover").withColumn("p", 0.2 + F.col("match_id") % 60 / 100.0)
    own = d.groupBy("player").agg(F.count("*").alias("n"), F.sum("won").cast("long").alias("true_wins"), F.sum("p").alias("sum"))
    k = F.col("player")
    pub = own.select("player", "n", "true_wins", F.when(k % 7 == 3, F.col("n") + 1).otherwise(F.col("true_wins")).alias("wins"), F.round("sum", 6).alias("expected"), F.round(F.col("true_wins") - F.col("sum") + F.when(k % 5 == 2, 0.5).otherwise(0.0), 6).alias("delta"))
    bad = (F.col("wins") > F.col("n")) | (F.col("expected") > F.col("n")) | (F.abs(F.col("delta") - (F.col("wins") - F.col("expected"))) > 0.002)
    return violations(pub, "summary", k, bad, F.lit("inconsistent")).unionByName(violations(pub, "evidence", k, F.col("wins") != F.col("true_wins"), F.lit("wins differ from decisions")))


def method(spark: SparkSession) -> DataFrame:
    """The effective settings of both tours as rows (tour, section, name, value)."""
    from dataclasses import asdict

    from matchlake.operators import ratings as r
    from matchlake.operators.training import Protocol
    from matchlake.plans.features import EVEN, SIGNED

    rows = [(tour, section, name, float(value)) for tour, parts in (("atp", (("elo", r.ATP), ("serve", r.SERVE_ATP))), ("wta", (("elo", r.WTA), ("serve", r.SERVE_WTA)))) for section, part in parts for name, value in asdict(part).items()]
    rows += [(tour, "combiner", name, float(value)) for tour in ("atp", "wta") for name, value in (("bags", Protocol().bags), ("trees", Protocol().trees), ("features", len(SIGNED) + len(EVEN)))]
    return spark.createDataFrame(rows, "tour string, section string, name string, value double")


@query("""SELECT * FROM (VALUES ('atp', 'elo', 'blend', 0.63::DOUBLE), ('atp', 'elo', 'transfer', 0.27), ('atp', 'serve', 'half_life', 200), ('atp', 'combiner',
  'features', 42), ('wta', 'elo', 'blend', 0.62), ('wta', 'elo', 'transfer', 0.17), ('wta', 'serve', 'half_life', 200), ('wta', 'combiner', 'features',
  42)) AS v(tour, section, name, value)""")
def method_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some of the published settings."""
    return method(spark).filter("name in ('blend', 'transfer', 'half_life', 'features')")


def method_problems(rows: DataFrame, features: int) -> DataFrame:
    """Sections that are missing, settings out of range, and a number of features that is not the model's."""
    key = F.concat_ws("/", "tour", "section", "name")
    name, v = F.col("name"), F.col("value")
    bad = ((name == "blend") & ~v.between(0, 1)) | ((name == "cap") & (v < 1)) | (name.isin("k", "surface_k", "half_life") & (v <= 0)) | ((name == "bags") & (v < 1)) | ((name == "features") & (v != features))
    sections = rows.groupBy("tour").agg(F.collect_set("section").alias("have")).withColumn("lost", F.explode(F.array_except(F.array(*[F.lit(x) for x in ("elo", "serve", "combiner")]), "have")))
    return violations(rows, "range", key, bad, v).unionByName(violations(sections, "section", F.concat_ws("/", "tour", "lost"), F.lit(True), F.lit("missing")))


@query("""SELECT * FROM (VALUES ('range', 'atp/elo/blend', '1.5'), ('range', 'wta/combiner/features', '41.0'), ('section', 'wta/serve',
  'missing')) AS v("check", key, message)""")
def gate_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published settings with a blend beyond 1, a lost section and a wrong number of features: each is found."""
    name = F.col("name")
    value = F.when((F.col("tour") == "atp") & (name == "blend"), 1.5).when((F.col("tour") == "wta") & (name == "features"), 41.0).otherwise(F.col("value"))
    return method_problems(method(spark).withColumn("value", value).filter("not (tour = 'wta' and section = 'serve')"), 42)


_SHARDS = _PL + """, t AS (SELECT event, player, name, seed, substr(sha256(name), 1, 16) AS file
  FROM field), i AS (SELECT event, player, file, CASE WHEN player % 9 = 4 THEN seed + 1 ELSE seed END AS place FROM t
  WHERE player % 11 > 0), sh AS (SELECT event, player, file, seed FROM t WHERE player % 13 > 0) """


@query(_SHARDS + """SELECT 'file' AS "check", CAST(i.player AS VARCHAR) AS key, 'no shard' AS message FROM i LEFT JOIN sh USING (player) WHERE sh.player IS NULL
  UNION ALL SELECT 'stale', CAST(sh.player AS VARCHAR), 'not in the index' FROM sh LEFT JOIN i USING (player) WHERE i.player IS NULL
UNION ALL SELECT 'order', CAST(i.player AS VARCHAR), 'index and board disagree' FROM i JOIN t USING (player) WHERE i.place <> t.seed""")
def gate_profile_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of profiles against its shards and the board: missing, stale and misplaced entries."""
    s_ = table(spark, sf_dir, "supplier")
    board = s_.select(F.col("s_suppkey").alias("player"), F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("seed"))
    k = F.col("player")
    index = board.filter(k % 11 > 0).select(k, F.when(k % 9 == 4, F.col("seed") + 1).otherwise(F.col("seed")).alias("place"))
    shards = board.filter(k % 13 > 0).select(k, F.lit(True).alias("shard"))
    both = index.join(shards, "player", "full").join(board, "player")
    out = violations(both, "file", k, F.col("place").isNotNull() & F.col("shard").isNull(), F.lit("no shard"))
    out = out.unionByName(violations(both, "stale", k, F.col("place").isNull(), F.lit("not in the index")))
    return out.unionByName(violations(both, "order", k, F.col("place") != F.col("seed"), F.lit("index and board disagree")))


@query(_PL + """, m AS (SELECT event, seed % 3 AS surface, player, CASE WHEN player % 10 = 1 THEN 'old' ELSE 'g1' END AS generation, seed
  FROM field), r AS (SELECT event, surface, count(*) AS n, count(DISTINCT generation) AS gens, bool_or(generation <> 'g1') AS stale FROM m GROUP BY ALL)
SELECT 'generation' AS "check", event || '/' || surface AS key, 'not the index''s' AS message FROM r WHERE stale
  UNION ALL SELECT 'surfaces', CAST(event AS VARCHAR), CAST(count(*) AS VARCHAR) || ' of 3' FROM r GROUP BY event HAVING count(*) <> 3""")
def gate_matrix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of another generation than the index, and events that lack a surface."""
    f = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("event"), F.col("s_suppkey").alias("player"), F.row_number().over(W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("seed"))
    r = f.groupBy("event", (F.col("seed") % 3).alias("surface")).agg(F.max(F.col("player") % 10 == 1).alias("stale"))
    n = r.groupBy("event").agg(F.count("*").alias("n"))
    out = violations(r, "generation", F.concat_ws("/", F.col("event").cast("string"), F.col("surface").cast("string")), F.col("stale"), F.lit("not the index's"))
    return out.unionByName(violations(n, "surfaces", F.col("event"), F.col("n") != 3, F.concat(F.col("n").cast("string"), F.lit(" of 3"))))


@query(MATCHES + """, e AS (SELECT match_id, unnest([{'g': 'ratings', 'v': match_id % 40 - 20}, {'g': 'serve', 'v': match_id % 30 - 15}, {'g': 'rest',
  'v': match_id % 11 - 5}]) AS x FROM matches), o AS (SELECT match_id, x.g AS g, x.v AS v,
  row_number() OVER (PARTITION BY match_id ORDER BY abs(x.v) DESC, x.g) AS rank, row_number() OVER (PARTITION BY match_id ORDER BY x.g) AS shown FROM e)
SELECT 'order' AS "check", CAST(match_id AS VARCHAR) AS key, 'not by size' AS message FROM o WHERE match_id % 5 = 0 GROUP BY match_id
  HAVING bool_or(rank <> shown) UNION ALL SELECT 'signals', CAST(match_id AS VARCHAR), '2 of 3' FROM matches WHERE match_id % 6 = 0""")
def gate_prediction_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published evidence that lost a signal or is not ordered by size; every fifth and sixth match's is damaged here."""
    k = F.col("match_id")
    signal = lambda g, v: F.struct(F.lit(g).alias("g"), v.alias("v"))
    all_ = F.array(signal("ratings", k % 40 - 20), signal("serve", k % 30 - 15), signal("rest", k % 11 - 5))
    by_size = F.transform(F.array_sort(F.transform(all_, lambda x: F.struct((-F.abs(x["v"])).alias("s"), x["g"].alias("g"), x["v"].alias("v")))), lambda x: F.struct(x["g"].alias("g"), x["v"].alias("v")))
    by_name = F.array_sort(all_)
    shown = F.when(k % 5 == 0, by_name).otherwise(by_size)
    rows = matches(spark, sf_dir).select(k, shown.alias("shown"), by_size.alias("want"), F.when(k % 6 == 0, 2).otherwise(3).alias("n"))
    names = lambda c: F.transform(c, lambda x: x["g"])
    return violations(rows, "order", k, names("shown") != names("want"), F.lit("not by size")).unionByName(violations(rows, "signals", k, F.col("n") != 3, F.concat(F.col("n").cast("string"), F.lit(" of 3"))))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 10 = 3 THEN 'corrupt' WHEN p_partkey % 10 = 7 THEN 'unsafe number' END AS problem
  FROM part WHERE p_partkey % 10 IN (3, 7)""")
def gate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published files read back: lines that don't parse, and numbers that no client reads."""
    k = F.col("p_partkey")
    line = F.concat(F.lit('{"key":"'), k.cast("string"), F.lit('","v":'), F.when(k % 10 == 3, '"broken').when(k % 10 == 7, "1e999}").otherwise("0.5}"))
    path = scratch(spark)
    table(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    read = staged(read_jsonl(spark, path, "key string, v double"))
    key = F.coalesce("key", F.regexp_extract("_corrupt", r'"key":"(\d+)"', 1))
    bad = F.when(F.col("_corrupt").isNotNull(), "corrupt").when(F.isnan("v") | F.col("v").isin(float("inf"), float("-inf")), "unsafe number")
    return read.select(key.alias("key"), bad.alias("problem")).filter("problem is not null")


@query(MATCHES + """, old AS (SELECT match_id AS k, 'old' AS src, draw_level FROM matches WHERE match_id % 4 < 3), new AS (SELECT match_id AS k, 'new' AS src, draw_level
  FROM matches WHERE match_id % 4 > 1), u AS (SELECT k, draw_level, max(src = 'new') AS fresh FROM (SELECT * FROM old UNION ALL SELECT * FROM new)
  GROUP BY ALL)
SELECT draw_level <> 'main' AS lower, count(*) AS n, CAST(count(*) FILTER (WHERE fresh) AS BIGINT) AS fresh FROM u GROUP BY 1""")
def year_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows merged over those on file by source key, keeping the last, split by level: written as partitions, read back."""
    m = matches(spark, sf_dir).select(F.col("match_id").alias("k"), "draw_level")
    old, new = m.filter("k % 4 < 3").withColumn("fresh", F.lit(False)), m.filter("k % 4 > 1").withColumn("fresh", F.lit(True))
    last = old.unionByName(new).groupBy("k", "draw_level").agg(F.max("fresh").alias("fresh"))
    path = scratch(spark)
    last.withColumn("lower", F.col("draw_level") != "main").write.partitionBy("lower").parquet(path)
    return spark.read.schema("k bigint, draw_level string, fresh boolean, lower boolean").parquet(path).groupBy("lower").agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh"))


@query("SELECT * FROM (VALUES ('good', TRUE, ''), ('lost column', FALSE, 'score'), ('empty', FALSE, 'date,player,score')) AS v(payload, admitted, missing)")
def payload_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV payloads are admitted if they have the required columns."""
    required = ["date", "player", "score"]
    rows = spark.createDataFrame([("good", "player,date,score,extra\n1,2,3,4"), ("lost column", "date,player\n1,2"), ("empty", "")], "payload string, text string")
    have = F.split(F.split_part("text", F.lit("\n"), F.lit(1)), ",")
    lost = F.array_except(F.array(*[F.lit(c) for c in required]), have)
    return rows.select("payload", (F.size(lost) == 0).alias("admitted"), F.array_join(lost, ",").alias("missing"))


@query(MATCHES + """SELECT tour, count(*) AS rows, max(date) AS data_to, bit_xor(hash) AS fingerprint FROM (SELECT tour, date, match_id * 31 + winner * 17 + loser AS hash
  FROM matches) GROUP BY tour""")
def health_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary and fingerprint of a tour's input, for reuse within a run."""
    h = F.col("match_id") * 31 + F.col("winner") * 17 + F.col("loser")
    return matches(spark, sf_dir).groupBy("tour").agg(F.count("*").alias("rows"), F.max("date").alias("data_to"), F.bit_xor(h).alias("fingerprint"))


@query(MATCHES + """, l AS (SELECT match_id, 0.2 + match_id % 61 / 100.0 AS p, 0.2 + match_id % 59 / 100.0 AS q, surface, tier FROM matches
  WHERE completed), e AS (SELECT 'all' AS segment, p, q FROM l UNION ALL SELECT 'surface ' || surface, p, q FROM l
  UNION ALL SELECT 'tier ' || tier, p, q FROM l)
SELECT segment, count(*) AS n, round(avg(-ln(p)), 6) AS model, round(avg(-ln(q)), 6) AS market, round(avg(ln(p) - ln(q)), 6) AS gain,
  round(avg((1 - q) * (1 - q) - (1 - p) * (1 - p)), 6) AS brier_gain FROM e GROUP BY segment""")
def scorecard_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model against market over all and by overlapping segments, in one grouping."""
    k = F.col("match_id")
    rows = matches(spark, sf_dir).filter("completed").select((0.2 + k % 61 / 100.0).alias("p"), (0.2 + k % 59 / 100.0).alias("q"), F.explode(F.array(F.lit("all"), F.concat(F.lit("surface "), "surface"), F.concat(F.lit("tier "), F.col("tier").cast("string")))).alias("segment"))
    p, q = F.col("p"), F.col("q")
    r = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return rows.groupBy("segment").agg(F.count("*").alias("n"), r(-F.log(p), "model"), r(-F.log(q), "market"), r(F.log(p) - F.log(q), "gain"), r((1 - q) * (1 - q) - (1 - p) * (1 - p), "brier_gain"))


@query(MATCHES + """, up AS (SELECT match_id, event_id, least(winner, loser) AS lo, greatest(winner, loser) AS hi, round_order, match_id % 4 AS g
  FROM matches), sc AS (SELECT event_id, least(winner, loser) AS lo, greatest(winner, loser) AS hi, round_order, max(match_id % 100 / 100.0) AS leverage
  FROM matches WHERE match_id % 3 = 0 GROUP BY ALL)
SELECT up.match_id, CASE WHEN g > 0 THEN round(sc.leverage, 6) END AS leverage FROM up LEFT JOIN sc USING (event_id, lo, hi, round_order)""")
def scenario_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leverage joined to the schedule by event, pair and round, for rows of the same generation only."""
    k = F.col("match_id")
    m = matches(spark, sf_dir).select(k, "event_id", F.least("winner", "loser").alias("lo"), F.greatest("winner", "loser").alias("hi"), "round_order")
    keys = ["event_id", "lo", "hi", "round_order"]
    sc = m.filter(k % 3 == 0).groupBy(*keys).agg(F.max(k % 100 / 100.0).alias("leverage"))
    return m.join(sc, keys, "left").select("match_id", F.when(k % 4 > 0, F.round("leverage", 6)).alias("leverage"))
