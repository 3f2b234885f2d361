"""Venues, tiers, draw sizes, rounds and market rules. Cities are the nations' names and the second words of those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions import levels as lv
from matchlake.functions import scalars as s
from matchlake.operators import venues as v
from matchlake.plans.registry import query
from matchlake.sources.adapters import MATCHES, matches, table

_CITY = """, city AS (SELECT lower(n_name) AS key, n_nationkey AS ioc, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey * 37.5 END AS elevation,
    CASE n_nationkey % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Tokyo' WHEN 2 THEN 'Europe/Paris' END AS zone FROM nation
  UNION ALL SELECT split_part(lower(n_name), ' ', 2), n_nationkey + 100, 5.5, NULL FROM nation WHERE contains(n_name, ' ')),
named AS (SELECT match_id, year, CASE WHEN tour % 2 = 0 THEN 'atp' ELSE 'wta' END AS tour, CASE match_id % 7 WHEN 0 THEN event
  WHEN 1 THEN 'Grand Prix de ' || event || ' 2'
    WHEN 2 THEN event || ' Open #2' WHEN 3 THEN 'Davis Cup WG: ' || substr(event, 1, 3) || ' vs BRA' WHEN 4 THEN 'Nowhere Classic 40K'
  WHEN 5 THEN lower(event) || ', 125k 3'
    ELSE 'Fed Cup: ' || substr(event, 1, 3) || ' vs BRA' END AS name FROM matches),
normed AS (SELECT *, trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')),
  '( \\d+k?)+$', '')) AS norm FROM named),
hit AS (SELECT n.norm, arg_max({'key': key, 'ioc': ioc, 'elevation': elevation, 'zone': zone}, (length(key), key)) AS c
  FROM (SELECT DISTINCT norm FROM normed) n JOIN city ON contains(' ' || n.norm || ' ', ' ' || key || ' ') GROUP BY n.norm),
placed AS (SELECT n.*, h.c.key AS key, h.c.ioc AS ioc, h.c.elevation AS elevation, h.c.zone AS zone FROM normed n LEFT JOIN hit h USING (norm))
"""


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    zone = F.when(k % 4 == 0, "America/New_York").when(k % 4 == 1, "Asia/Tokyo").when(k % 4 == 2, "Europe/Paris")
    whole = n.select(F.lower("n_name").alias("key"), k.alias("ioc"), F.when(k % 3 > 0, k * 37.5).alias("elevation"), zone.alias("zone"))
    second = n.filter(F.col("n_name").contains(" ")).select(F.split_part(F.lower("n_name"), F.lit(" "), F.lit(2)).alias("key"), (k + 100).alias("ioc"), F.lit(5.5).alias("elevation"), F.lit(None).cast("string").alias("zone"))
    return whole.unionByName(second)


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches under event names of several kinds."""
    k, e = F.col("match_id") % 7, F.col("event")
    name = (
        F.when(k == 0, e).when(k == 1, F.concat(F.lit("Grand Prix de "), e, F.lit(" 2"))).when(k == 2, F.concat(e, F.lit(" Open #2")))
        .when(k == 3, F.concat(F.lit("Davis Cup WG: "), F.substring(e, 1, 3), F.lit(" vs BRA"))).when(k == 4, "Nowhere Classic 40K")
        .when(k == 5, F.concat(F.lower(e), F.lit(", 125k 3"))).otherwise(F.concat(F.lit("Fed Cup: "), F.substring(e, 1, 3), F.lit(" vs BRA")))
    )
    return matches(spark, sf_dir).select("match_id", "year", F.when(F.col("tour") % 2 == 0, "atp").otherwise("wta").alias("tour"), name.alias("name"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.with_city(named(spark, sf_dir), "name", cities(spark, sf_dir))


@query(MATCHES + _CITY + "SELECT match_id, norm, key AS city_key FROM placed")
def venue_city_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised event names and the longest city name that they hold."""
    return placed(spark, sf_dir).select("match_id", "norm", F.col("key").alias("city_key"))


@query(MATCHES + _CITY + """SELECT match_id, CASE WHEN match_id % 7 = 3 THEN regexp_extract(name, '([A-Z]{3}) vs', 1) WHEN match_id % 7 = 6 THEN NULL
  WHEN norm = 'brazil' AND tour = 'atp' THEN 'RIO' WHEN norm = 'china' THEN CASE year WHEN 1994 THEN 'PEK' WHEN 1996 THEN 'SHA' END
  ELSE CAST(ioc AS VARCHAR) END AS host FROM placed""")
def venue_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host nations: of cup ties the first nation, by tour, by year, else by city."""
    rule = v.host(F.col("name"), F.col("norm"), F.col("year"), F.col("tour"), F.col("ioc").cast("string"), {("brazil", "atp"): "RIO"}, {"china": {1994: "PEK", 1996: "SHA"}})
    return placed(spark, sf_dir).select("match_id", rule.alias("host"))


@query(MATCHES + _CITY + "SELECT match_id, elevation AS altitude FROM placed")
def venue_altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("match_id", F.col("elevation").alias("altitude"))


_STAMP = """CASE event_id % 9 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN 'to be announced' WHEN 2 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END"""


@query(MATCHES + _CITY + f""", st AS (SELECT event_id, ts, {_STAMP} AS stamp, zone FROM events LEFT JOIN (SELECT ioc, zone FROM city WHERE ioc < 100) ON ioc = user_id % 25)
SELECT event_id, CASE WHEN zone IS NOT NULL AND event_id % 9 > 2 THEN strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE zone, '%Y-%m-%d') ELSE substr(coalesce(stamp, ''), 1, 10) END AS day FROM st""")
def venue_local_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days at the venue of times in UTC; naive, missing and malformed times keep their first ten characters."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 9
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = F.when(k == 0, text).when(k == 1, "to be announced").when(k == 2, None).otherwise(F.concat(text, F.lit("Z")))
    zones = cities(spark, sf_dir).filter("ioc < 100").select("ioc", "zone")
    joined = e.join(zones, F.col("user_id") % 25 == F.col("ioc"), "left")
    return joined.select("event_id", v.local_date(stamp, F.col("zone")).alias("day"))


#: Tiers as several sources write them.
DIALECTS = ["G", "Grand  Slam", "F", "ATP Tour Finals", "O", "Olympic Games", "D", "BJK Cup", "United Cup", "C", "Challenger Tour", "M", "ATP Tour Masters 1000", "ATP 500 series", "250", "WTA 125", "125", "A", "Q", "atp tour", "WTA Tour", "mystery", "  ", "nan"]
_WORDS = "[" + ", ".join(f"'{x}'" for x in DIALECTS) + "]"


def _level_sql(value: str) -> str:
    low = f"lower(trim(regexp_replace(coalesce({value}, ''), '\\s+', ' ', 'g')))"
    return f"""(SELECT CASE WHEN list_contains(CASE tour WHEN 'atp' THEN ['Masters 1000', 'ATP 500', 'ATP 250', 'ATP Tour'] ELSE ['WTA 1000', 'WTA 500', 'WTA 250', 'WTA 125', 'WTA Tour'] END
      || ['Grand Slam', 'Tour Finals', 'Olympics', 'Davis/BJK Cup', 'United Cup', 'Challenger'], x) THEN x END FROM (SELECT CASE WHEN {low} IN ('', 'nan', 'none') THEN NULL
    WHEN {low} = 'g' OR contains({low}, 'grand slam') THEN 'Grand Slam' WHEN {low} = 'f' OR contains({low}, 'tour finals') THEN 'Tour Finals' WHEN {low} = 'o' OR contains({low}, 'olympic') THEN 'Olympics'
    WHEN {low} = 'd' OR contains({low}, 'bjk') THEN 'Davis/BJK Cup' WHEN contains({low}, 'united cup') THEN 'United Cup' WHEN {low} = 'c' OR contains({low}, 'challenger') THEN 'Challenger'
    WHEN {low} = 'm' OR contains({low}, 'masters') OR contains({low}, '1000') THEN CASE tour WHEN 'atp' THEN 'Masters 1000' ELSE 'WTA 1000' END
    WHEN regexp_matches({low}, '(500|250|125)') THEN upper(tour) || ' ' || regexp_extract({low}, '(500|250|125)', 1) WHEN {low} IN ('a', 'q', tour || ' tour') THEN upper(tour) || ' Tour' END AS x))"""


def dialect(shift: int) -> Column:
    """A tier in some dialect, null now and then."""
    return F.when((F.col("match_id") + shift) % 5 > 0, F.element_at(F.array(*[F.lit(x) for x in DIALECTS]), ((F.col("match_id") * (shift + 1)) % len(DIALECTS) + 1).cast("int")))


def _dialect_sql(shift: int) -> str:
    return f"CASE WHEN (match_id + {shift}) % 5 > 0 THEN {_WORDS}[match_id * {shift + 1} % {len(DIALECTS)} + 1] END"


_TOURED = MATCHES + ", t AS (SELECT match_id, event, CASE WHEN tour % 2 = 0 THEN 'atp' ELSE 'wta' END AS tour, " + ", ".join(f"{_dialect_sql(i)} AS v{i}" for i in range(4)) + " FROM matches)"


def toured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark, sf_dir).select("match_id", "event", F.when(F.col("tour") % 2 == 0, "atp").otherwise("wta").alias("tour"), *[dialect(i).alias(f"v{i}") for i in range(4)])


@query(_TOURED + f" SELECT match_id, {_level_sql('v0')} AS level FROM t")
def level_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toured(spark, sf_dir).select("match_id", lv.normalize_level(F.col("v0"), F.col("tour")).alias("level"))


@query(_TOURED + f""", n AS (SELECT match_id, upper(tour) || ' Tour' AS g, {_level_sql('v0')} AS a, {_level_sql('v1')} AS b, {_level_sql('v2')} AS c, {_level_sql('v3')} AS d FROM t)
SELECT match_id, coalesce(nullif(a, g), nullif(b, g), nullif(c, g), nullif(d, g), g) AS level FROM n""")
def level_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of four sources that names a tier: archive, category by id, category by name, curated."""
    return toured(spark, sf_dir).select("match_id", lv.resolve_level([F.col(f"v{i}") for i in range(4)], F.col("tour")).alias("level"))


@query(_TOURED + """ SELECT match_id, CASE WHEN contains(lower(l), 'grand') OR event = 'US Open' THEN 0 WHEN contains(lower(l), 'final') THEN 1 WHEN contains(l,
  '1000') OR contains(lower(l), 'olympic') THEN 2 WHEN l LIKE '%500' THEN 3 WHEN l LIKE '%250' THEN 4
  WHEN contains(lower(l), 'cup') THEN 5 WHEN l LIKE '%125' THEN 6 ELSE 7 END AS rank,
  CASE WHEN contains(lower(l), 'grand') THEN 'GS' WHEN contains(lower(l), 'final') THEN 'Finals' WHEN contains(l, '1000') THEN '1000'
  WHEN contains(lower(l), 'olympic') THEN 'Oly' WHEN l LIKE '%500' THEN '500' WHEN l LIKE '%250' THEN '250'
  WHEN contains(lower(l), 'cup') THEN 'Cup' WHEN l LIKE '%125' THEN '125' ELSE 'Tour' END AS short,
  CASE WHEN contains(lower(l), 'grand') THEN 'Grand Slam' WHEN contains(lower(l), 'final') OR contains(l, '1000') THEN l WHEN contains(lower(l),
  'olympic') THEN 'Olympics' WHEN l LIKE '%500' OR l LIKE '%250' OR contains(lower(l), 'cup') OR l LIKE '%125' THEN l
  WHEN l <> '' AND lower(l) <> 'q' THEN l ELSE 'Tour' END AS full FROM (SELECT match_id, event, coalesce(v0, '') AS l FROM t)""")
def level_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = lv.tournament_tier(F.col("v0"), F.col("event"))
    return toured(spark, sf_dir).select("match_id", tier.alias("t")).select("match_id", "t.*")


_SIZES = MATCHES + """, n AS (SELECT event_id, draw_level, max(2 * c * CAST(pow(2, round_order - 1) AS BIGINT)) AS need
  FROM (SELECT event_id, draw_level, round_order, count(*) AS c FROM matches WHERE round_order <= 4 GROUP BY ALL) GROUP BY ALL),
sizes AS (SELECT event_id, draw_level, CAST(pow(2, ceil(log2(need))) AS INTEGER) AS draw FROM n)
"""


def sizes(m: DataFrame) -> DataFrame:
    per_round = [F.count_if(F.col("round_order") == r) for r in range(1, 5)]
    return m.groupBy("event_id", "draw_level").agg(lv.bracket_size(per_round).alias("draw"))


@query(_SIZES + "SELECT event_id, draw_level, draw FROM sizes")
def draw_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that the first four rounds of each draw need."""
    return sizes(matches(spark, sf_dir).filter("round_order <= 4"))


@query(_SIZES + """SELECT match_id, CASE WHEN match_id % 31 = 0 THEN NULL WHEN round_order <= 4 THEN CASE draw >> (round_order - 1) WHEN 8 THEN 'QF' WHEN 4 THEN 'SF'
  WHEN 2 THEN 'F' ELSE 'R' || CAST(draw >> (round_order - 1) AS VARCHAR) END
  WHEN round_order = 5 THEN 'QF' WHEN round_order = 6 THEN 'SF' ELSE 'F' END AS code FROM matches LEFT JOIN sizes USING (event_id, draw_level)""")
def round_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds by draw size and label; qualifying has none."""
    m, r = matches(spark, sf_dir), F.col("round_order")
    label = F.when(F.col("match_id") % 31 == 0, "Qualifying 1st Round").when(r <= 4, F.concat(F.lit("Round "), r.cast("string"))).when(r == 5, "Quarterfinal").when(r == 6, "Semifinals").otherwise("Final")
    joined = m.join(sizes(m.filter("round_order <= 4")), ["event_id", "draw_level"], "left")
    return joined.select("match_id", lv.round_code(r, label, F.coalesce("draw", F.lit(0))).alias("code"))


@query("SELECT p_partkey, CAST(floor(250 / pow(p_size + 5, 0.4) * 10 + 0.5) / 10 AS DOUBLE) AS k FROM part")
def k_by_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", lv.k_at(F.lit(s.K), F.lit(s.K_OFFSET), F.lit(s.K_SHAPE), F.col("p_size")).alias("k"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN NULL WHEN p_partkey % 6 = 4 THEN NULL ELSE p_name END AS tournament,
  CASE WHEN p_partkey % 6 = 5 THEN NULL ELSE ['SF', 'R16', NULL, 'QF', 'F'][p_partkey % 6 + 1] END AS round FROM part""")
def market_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tournament and round out of rules in prose."""
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    mark = "If X wins the" + lv.RULES_MARK
    text = (
        F.when(k == 0, F.concat(F.lit(mark + "2026 "), name, F.lit(" Women's Singles Semifinal after a ball has been played, then Yes.")))
        .when(k == 1, F.concat(F.lit(mark + "2026 "), name, F.lit(" Men Singles Round of 16, then Yes.")))
        .when(k == 2, F.concat(F.lit(mark), name, F.lit(". Nothing else counts, nor a final.")))
        .when(k == 3, F.concat(F.lit(mark + "2025"), name, F.lit(" quarterfinal after a ball has been played")))
        .when(k == 4, F.lit(mark + "2026 Womens Singles Final."))
        .otherwise(F.concat(F.lit("No rules for "), name))
    )
    return table(spark, sf_dir, "part").select("p_partkey", lv.parse_rules(text).alias("r")).select("p_partkey", "r.*")


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 6 AS e, o_orderkey % 6 AS k FROM orders),
x AS (SELECT *, CASE WHEN k < 5 AND year(CASE WHEN k = 3 THEN e ELSE d END) = 1996 THEN k END AS dialect,
  CASE WHEN k <> 3 THEN CAST(d AS DATE) WHEN day(d) <= day(last_day(e)) THEN make_date(year(e), month(e), day(d)) END AS first FROM o)
SELECT o_orderkey, CASE WHEN dialect IS NOT NULL THEN first END AS start,
  CASE WHEN dialect IS NULL OR first IS NULL THEN NULL WHEN dialect IN (2, 3) THEN CAST(e AS DATE) ELSE make_date(year(d), month(e), day(e)) END AS finish FROM x""")
def date_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar ranges of 1996 in four dialects. Across months or years a dialect may say something else than was meant: only
    the one that names the month first turns it."""
    d = F.col("o_orderdate").cast("date")
    end, k = F.date_add(d, 6), F.col("o_orderkey") % 6
    f = lambda x, p: F.date_format(x, p)
    text = (
        F.when(k == 0, F.concat_ws("", f(d, "d MMMM"), F.lit(" — "), f(end, "d MMMM, "), f(d, "yyyy")))
        .when(k == 1, F.concat_ws("", F.upper(f(d, "MMMM d")), F.lit(" - "), f(end, "MMMM d, "), f(d, "yyyy")))
        .when(k == 2, F.concat_ws("", f(d, "MMMM d"), F.lit("-"), f(end, "d "), f(d, "yyyy")))
        .when(k == 3, F.concat_ws("", f(d, "d"), F.lit(" – "), f(end, "d MMMM yyyy")))
        .when(k == 4, F.concat_ws("", F.lit("Draw\nof the week\n"), f(d, "d MMMM"), F.lit(" - "), f(end, "d MMMM "), f(d, "yyyy"), F.lit("\nPrize money")))
        .otherwise(F.concat_ws("", F.lit("the "), f(d, "d MMMM yyyy")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", lv.parse_date_span(text, 1996).alias("s")).select("o_orderkey", "s.*")


@query("""WITH f AS (SELECT o_custkey AS event, CASE o_orderkey % 5 WHEN 0 THEN 'Qualifier ' || o_orderkey WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN ' TBD'
  ELSE o_clerk END ELSE o_clerk END AS x FROM (SELECT o_custkey, o_orderkey, o_orderpriority AS o_clerk FROM orders))
SELECT event, count(*) AS n, CAST(count(*) FILTER (WHERE NOT (starts_with(x, 'Qualifier') OR x = ' TBD')) AS BIGINT) AS real,
  2 * count(*) FILTER (WHERE NOT (starts_with(x, 'Qualifier') OR x = ' TBD')) >= count(*) AS meaningful FROM f GROUP BY event""")
def meaningful_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of which half at least are names, not placeholders."""
    k, who = F.col("o_orderkey"), F.col("o_orderpriority")
    x = F.when(k % 5 == 0, F.concat(F.lit("Qualifier "), k.cast("string"))).when((k % 5 == 1) & (F.col("o_custkey") % 2 == 0), " TBD").otherwise(who)
    real = F.count_if(lv.is_real(x))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("event")).agg(F.count("*").alias("n"), real.alias("real"), (2 * real >= F.count("*")).alias("meaningful"))
