"""Tables read out of pages, articles, printed draws and CSV files that are made from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.operators.bracket import seed_order
from matchlake.plans.registry import query
from matchlake.sources import printed
from matchlake.sources import tables as t
from matchlake.sources.adapters import MATCHES, matches, players, table
from matchlake.sources.files import scratch

_PAGES = MATCHES + """, r AS (SELECT ioc AS page_id, row_number() OVER (PARTITION BY ioc ORDER BY points DESC NULLS LAST, player) AS rank, name, points, player
  FROM players) """


def ranking_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each nation: rows of eight cells, some broken, another table inside a cell and one beside it."""
    p = players(spark, sf_dir).withColumn("rank", F.row_number().over(W.partitionBy("ioc").orderBy(F.desc_nulls_last("points"), "player")))
    thousands = F.when(F.col("points").isNotNull(), F.format_number("points", 0)).otherwise("-")
    delta = F.when(F.col("player") % 3 == 0, F.concat(F.lit("+"), (F.col("player") % 7).cast("string"))).when(F.col("player") % 3 == 1, "&nbsp;").otherwise("new")
    cells = F.array(F.col("rank").cast("string"), F.lit("<table id='x'><tr><td>9</td></tr></table>"), F.lit("up"), F.concat(F.lit("<b>"), "name", F.lit("</b>&nbsp;")), F.lit("a"), F.lit("b"), thousands, delta)
    row = F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("html")))), lambda x: x["html"]), "\n")
    page = F.concat(F.lit("<html><table><tr><td>1</td><td>2</td></tr></table><table id='u868'><tr><th>Rank</th></tr><tr><td>1</td><td>short</td></tr>"), body, F.lit("</table></html>"))
    return p.groupBy(F.col("ioc").alias("page_id")).agg(page.alias("html"))


@query(_PAGES + "SELECT page_id, rank, name, points, CASE WHEN player % 3 = 0 THEN player % 7 END AS delta FROM r WHERE points IS NOT NULL")
def rankings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank, name, points and change out of nested HTML; broken rows fail the digit gates."""
    return t.rankings(ranking_pages(spark, sf_dir))


_SEATS = ", ".join(f"({i}, {x})" for i, x in enumerate(seed_order(4)))
_FIELD = f""", f AS (SELECT s_nationkey AS event, s_name AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS seed FROM supplier),
seats AS (SELECT e.event, v.slot, v.seed, f.name FROM (SELECT DISTINCT event FROM f) e CROSS JOIN (VALUES {_SEATS}) v(slot, seed) LEFT JOIN f ON f.event = e.event AND f.seed = v.seed),
shown AS (SELECT event, slot, seed, CASE WHEN seed % 5 = 3 THEN 'Qualifier' ELSE name END AS name FROM seats)"""


def seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event, slot, seed, name: draws of sixteen places; every fifth seed is a qualifier, missing players are byes."""
    f = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("event"), F.col("s_name").alias("name"), F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("seed"))
    order = spark.createDataFrame(list(enumerate(seed_order(4))), "slot int, seed int")
    placed = f.select("event").distinct().join(F.broadcast(order)).join(f, ["event", "seed"], "left")  # sixteen places each
    return placed.select("event", "slot", "seed", F.when(F.col("seed") % 5 == 3, "Qualifier").otherwise(F.col("name")).alias("name"))


def _lines(rows: DataFrame, line: F.Column, text: F.Column) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("slot", line.alias("line")))), lambda x: x["line"])
    return rows.groupBy("event").agg(lines.alias("lines")).select("event", text.alias("text"))


@query(MATCHES + _FIELD + """, p AS (SELECT *, max(name) OVER (PARTITION BY event, slot // 2) IS NULL AS bare
  FROM shown), q AS (SELECT *, sum(CASE WHEN name = 'Qualifier' THEN 1 ELSE 0 END) OVER (PARTITION BY event ORDER BY slot) AS nth FROM p)
SELECT event, slot, CASE WHEN name = 'Qualifier' THEN 'Qualifier ' || nth WHEN bare AND slot % 2 = 0 THEN 'Bye ' || slot ELSE name END AS player, CASE
  WHEN (name IS NOT NULL OR bare AND slot % 2 = 0) AND seed <= 4 THEN seed END AS seed, 5 AS best_of FROM q""")
def draw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws out of bracket templates: two sections of eight leaves, links, flags, byes in the second round."""
    i = F.col("slot") % 8 + 1
    bare = F.max("name").over(W.partitionBy("event", F.floor(F.col("slot") / 2))).isNull()
    rows = seats(spark, sf_dir).withColumn("bare", bare)
    team = F.when(F.col("name").isNotNull(), F.concat(F.lit("|RD1-team"), F.lpad(i.cast("string"), 2, "0"), F.lit("={{flagicon|USA}} "), F.when(F.col("name") == "Qualifier", F.col("name")).otherwise(F.concat(F.lit("[[Page of "), "name", F.lit("|"), "name", F.lit("]]"))), F.lit("\n")))
    seed = F.when(F.col("seed") <= 4, F.concat(F.lit("|RD1-seed"), i.cast("string"), F.lit("="), F.col("seed").cast("string"), F.lit("\n")))
    bye = F.when(F.col("bare") & (F.col("slot") % 2 == 0), F.concat(F.lit("|RD2-team"), (F.floor((i + 1) / 2)).cast("string"), F.lit("='''Bye "), F.col("slot").cast("string"), F.lit("'''\n")))
    section = lambda a: F.concat(F.lit("{{8TeamBracket-Compact-Tennis5\n"), F.array_join(F.slice("lines", a, 8), ""), F.lit("}}\n"))
    text = F.concat(F.lit("Intro {{4TeamBracket-Tennis3 |RD1-team1=nobody}}\n"), section(1), F.lit("and\n"), section(9))
    return t.draw_article(_lines(rows, F.concat_ws("", team, seed, bye), text), "event", "text")


@query(MATCHES + _FIELD + """, q AS (SELECT *, sum(CASE WHEN name = 'Qualifier' THEN 1 ELSE 0 END) OVER (PARTITION BY event ORDER BY slot) AS nth FROM shown)
SELECT event, slot, CASE WHEN name = 'Qualifier' THEN 'Qualifier ' || nth ELSE name END AS player, CASE WHEN name IS NOT NULL
  AND seed <= 4 THEN seed END AS seed FROM q""")
def printed_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws out of numbered lines with a false start, notes behind and placeholders in several spellings."""
    name = F.when(F.col("name") == "Qualifier", F.when(F.col("slot") % 2 == 0, "Qualifier / Lucky Loser").otherwise("QUALIFIER")).otherwise(F.coalesce("name", F.lit("Bye")))
    line = F.concat(F.lit(" "), (F.col("slot") + 1).cast("string"), F.lit(". "), name, F.when(F.col("seed") <= 4, F.concat(F.lit(" ["), F.col("seed").cast("string"), F.lit("]"))).otherwise(""))
    text = F.concat(F.lit("Main draw\n1. Somebody\n2. Else\nWeek of 3\n7. Odd\n"), F.array_join("lines", "\n"), F.lit("\nSeeds\n1. First\n18. Last\n"))
    return printed.printed_draws(_lines(seats(spark, sf_dir), line, text), "event", "text")


@query(MATCHES + """SELECT CAST(m.match_id AS BIGINT) AS match_id, m.date, m.surface, m.best_of, 'supplier#' || lpad(CAST(m.winner AS VARCHAR), 9, '0') || ' s' AS w_key,
  CASE WHEN m.match_id % 3 > 0 THEN 1.2 + (b.wq % 30) / 10.0 END AS odds_w_ps, CASE
  WHEN m.match_id % 3 > 0 THEN 1.2 + (b.lq % 30) / 10.0 END AS odds_l_ps
FROM matches m JOIN base b USING (match_id) WHERE m.match_id % 29 > 0 AND m.year IN (1994, 1997)""")
def odds_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odds written as CSV and read back: names as keys, bad numbers null, rows without names or outside the years dropped."""
    from matchlake.sources.adapters import matches_with

    m = matches_with(spark, sf_dir, "wq", "lq").withColumns({c: F.col(c).cast("int") for c in ("wq", "lq")})
    who = lambda c: F.concat(F.lit("Supplier#"), F.lpad(F.col(c).cast("string"), 9, "0"))
    odds = lambda c: F.when(F.col("match_id") % 3 > 0, (1.2 + (F.col(c) % 30) / 10.0).cast("string")).otherwise("-")
    raw = m.select(
        "match_id", F.col("date").cast("string").alias("Date"), F.col("surface").alias("Surface"), F.when(F.col("best_of") == 5, "5").alias("Best of"),
        F.when(F.col("match_id") % 29 > 0, who("winner")).alias("Winner"), who("loser").alias("Loser"), odds("wq").alias("PSW"), odds("lq").alias("PSL"))
    path = scratch(spark)
    raw.withColumn("Surface", F.concat_ws("|", "Surface", F.col("match_id").cast("string"))).drop("match_id").write.option("header", True).csv(path)
    found = t.read_odds(spark, path, [1994, 1997]).withColumn("s", F.split("surface", "[|]"))
    return found.select(F.col("s")[1].cast("long").alias("match_id"), "date", F.col("s")[0].alias("surface"), "best_of", "w_key", F.round("odds_w_ps", 6).alias("odds_w_ps"), F.round("odds_l_ps", 6).alias("odds_l_ps"))


@query(MATCHES + """SELECT CAST(match_id AS VARCHAR) AS ticker, CASE WHEN match_id % 4 = 0 THEN '' ELSE surface END AS status, CASE
  WHEN match_id % 5 > 0 THEN match_id % 100 / 100.0 END AS p_model, CAST(NULL AS DOUBLE) AS p_quote FROM matches""")
def ledger_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of text columns with casts that give null for what is no number, and a missing one, which is empty."""
    k = F.col("match_id")
    rows = matches(spark, sf_dir).select(k.cast("string").alias("ticker"), F.when(k % 4 > 0, F.col("surface")).alias("status"), F.when(k % 5 > 0, (k % 100 / 100.0).cast("string")).otherwise("n/a").alias("p_model"), F.lit("").alias("p_quote"))
    path, columns = scratch(spark), ["ticker", "status", "p_model", "p_quote"]
    rows.write.option("header", True).csv(path)
    both = t.read_ledger(spark, path, columns[2:], columns).unionByName(t.read_ledger(spark, path + "-missing", columns[2:], columns))
    return both


@query(MATCHES + """, s AS (SELECT match_id, match_id % 5 AS k, w_svpt AS ws, l_svpt AS ls, w_won AS ww, l_won AS lw FROM matches WHERE w_svpt IS NOT NULL)
SELECT match_id, CAST(CASE WHEN match_id % 2 = 0 THEN ws ELSE ls END AS DOUBLE) AS w_svpt, CAST(CASE WHEN match_id % 2 = 0 THEN ws // 2
  ELSE ls // 2 END AS DOUBLE) AS w_first_in, CAST(CASE WHEN match_id % 2 = 0 THEN ww - ws // 4 ELSE lw - ls // 4 END AS DOUBLE) AS w_second_won
FROM s WHERE k NOT IN (3, 4) AND ww - ws // 4 <= ws - ws // 2 AND lw - ls // 4 <= ls - ls // 2""")
def stats_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serve statistics of an API: matches without a winner and rows that contradict themselves are dropped."""
    m = matches(spark, sf_dir).filter("w_svpt is not null")
    k, odd = F.col("match_id"), F.col("match_id") % 2 == 1
    half = lambda c, n: F.floor(F.col(c) / n).cast("string")
    value = {"totservplayed": lambda x: F.col(f"{x}_svpt").cast("string"), "ptsplayed1stserv": lambda x: half(f"{x}_svpt", 2), "ptswon1stserv": lambda x: F.when(k % 5 == 4, F.lit("9999")).otherwise(half(f"{x}_svpt", 4)), "ptstotwonserv": lambda x: F.col(f"{x}_won").cast("string")}
    fields = [F.struct(F.lit(f + s).alias("k"), v(x).alias("v")) for f, v in value.items() for s, x in (("a", "w"), ("b", "l"))]
    won = F.when(k % 5 == 3, "1").when(odd, "3").otherwise("2")
    payload = F.map_from_entries(F.array(F.struct(F.lit("Winner").alias("k"), won.alias("v")), *fields))
    found = m.select("match_id", t.stats_rows(payload).alias("s")).filter("s is not null")
    return found.select("match_id", F.col("s.w.svpt").alias("w_svpt"), F.col("s.w.first_in").alias("w_first_in"), F.col("s.w.second_won").alias("w_second_won"))
