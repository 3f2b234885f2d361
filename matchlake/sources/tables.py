"""Tables out of web pages, draw articles and CSV files of other makers."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.functions.scalars import surname_key

#: Fixed value: id of the rankings table in its page.
RANKING_TABLE = "u868"


class _Cells(HTMLParser):
    """Cells of the rows of one table, without those of tables inside it."""

    def __init__(self, table: str):
        super().__init__()
        self.table, self.depth, self.rows, self.open = table, 0, [], False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.depth += bool(self.depth) or dict(attrs).get("id") == self.table
        elif self.depth == 1 and tag == "tr":
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
            self.open = True

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.depth == 1 and self.open:
            self.rows[-1][-1] += data


def html_rows(pages: DataFrame, key: str, html: str, table: str) -> DataFrame:
    """key, place, cells: the rows of the named table of each page; broken pages give what could be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, text in zip(frame[key], frame[html], strict=True):
                parser = _Cells(table)
                parser.feed(text or "")
                out += [(name, i, [c.replace("\xa0", " ").strip() for c in cells]) for i, cells in enumerate(parser.rows)]
            yield pd.DataFrame(out, columns=[key, "place", "cells"])

    return pages.select(key, html).mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, place int, cells array<string>")


def rankings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, rank, name, points and delta of each row of the rankings table that passes the digit gates."""
    cell = lambda i: F.get("cells", F.lit(i))
    points, delta = F.trim(F.replace(cell(6), F.lit(","), F.lit(""))), F.trim(cell(7))
    good = (F.size("cells") >= 7) & cell(0).rlike(r"^\d+$") & (F.trim(cell(3)) != "") & points.rlike(r"^\d+$")
    rows = html_rows(pages, key, html, RANKING_TABLE).filter(good)
    return rows.select(key, cell(0).cast("int").alias("rank"), F.trim(cell(3)).alias("name"), points.cast("int").alias("points"), F.when(delta.rlike(r"^[+-]\d+$"), delta.cast("int")).alias("delta"))


def draw_article(articles: DataFrame, key: str, text: str) -> DataFrame:
    """key, slot, player, seed, best_of: the ordered draw of each article of bracket templates.

    Sections follow each other; a match whose two first-round sides are missing is the bye of the player in the second
    round; places of qualifiers are numbered. Articles without a power of two of places give nothing.
    """
    flat = F.regexp_replace(F.regexp_replace(F.col(text), r"\{\{flag[^}]*\}\}\s*", ""), r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    parts = articles.select(key, F.posexplode(F.split(flat, r"\{\{")).alias("part", "body")).withColumn("leaves", F.regexp_extract("body", r"^\s*(\d+)TeamBracket[^|]*Compact", 1))
    sections = parts.filter("leaves <> ''").withColumn("leaves", F.col("leaves").cast("int"))
    fields = sections.withColumn("f", F.explode(F.regexp_extract_all("body", F.lit(r"RD[12]-(?:team|seed)0*\d+ *=[^|}]*"), F.lit(0))))
    each = fields.select(key, "part", "leaves", "body", F.regexp_extract("f", r"RD(\d)", 1).alias("rd"), F.regexp_extract("f", "(team|seed)", 1).alias("kind"), F.regexp_extract("f", r"(?:team|seed)0*(\d+)", 1).cast("int").alias("i"), F.regexp_replace(F.regexp_extract("f", r"=([^|}]*)", 1), r"'''?|^\s+|\s+$", "").alias("v"))
    named = each.filter("v <> ''")
    value = lambda rd, kind: named.filter((F.col("rd") == rd) & (F.col("kind") == kind)).select(key, "part", "i", F.col("v").alias(f"{kind}{rd}"))
    places = sections.select(key, "part", F.when(F.col("body").contains("Tennis5"), 5).otherwise(3).alias("best_of"), F.explode(F.sequence(F.lit(1), "leaves")).alias("i"))
    filled = places.join(value("1", "team"), [key, "part", "i"], "left").join(value("1", "seed"), [key, "part", "i"], "left")
    bye = value("2", "team").withColumnRenamed("i", "match")
    paired = filled.withColumn("match", ((F.col("i") + 1) / 2).cast("int")).join(bye, [key, "part", "match"], "left")
    empty = F.max("team1").over(W.partitionBy(key, "part", "match")).isNull()
    player = F.when(empty, F.when(F.col("i") % 2 == 1, F.col("team2"))).otherwise(F.col("team1"))
    order = W.partitionBy(key).orderBy("part", "i")
    slots = paired.withColumn("player", player).withColumns({"slot": F.row_number().over(order) - 1, "n": F.count("*").over(W.partitionBy(key)), "best_of": F.max("best_of").over(W.partitionBy(key))})
    open_place = F.lower("player") == "qualifier"
    number = F.sum(F.when(open_place, 1).otherwise(0)).over(order)
    shown = F.when(open_place, F.concat(F.lit("Qualifier "), number.cast("string"))).otherwise(F.col("player"))
    return slots.filter("n > 1 and bit_count(n) = 1").select(key, "slot", shown.alias("player"), F.when(F.col("player").isNotNull(), F.col("seed1").try_cast("int")).alias("seed"), "best_of")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any file system that Spark reads."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header as text columns; a missing one is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


#: The books of an odds file and their columns.
BOOKS = {"ps": ("PSW", "PSL"), "b365": ("B365W", "B365L"), "avg": ("AvgW", "AvgL")}


def read_odds(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """date, surface, best_of, w_key, l_key and the odds of each book; rows without date or names are dropped, odds that are
    no numbers are null."""
    raw = spark.read.option("header", True).csv(path)
    if years:  # before keys are made of the names of all other rows
        raw = raw.filter(F.year(F.try_to_timestamp("Date", F.lit("yyyy-MM-dd"))).isin(years))
    number = lambda c: F.col(f"`{c}`").try_cast("double") if c in raw.columns else F.lit(None).cast("double")
    keyed = raw.select(
        F.try_to_timestamp("Date", F.lit("yyyy-MM-dd")).cast("date").alias("date"), F.col("Surface").alias("surface"), F.coalesce(F.col("`Best of`").try_cast("int"), F.lit(3)).alias("best_of"),
        *[F.when(F.trim(c) != "", surname_key(F.col(c))).alias(k) for c, k in (("Winner", "w_key"), ("Loser", "l_key"))],
        *[number(c).alias(f"odds_{side}_{book}") for book, pair in BOOKS.items() for side, c in zip("wl", pair, strict=True)],
    )
    return keyed.dropna(subset=["date", "w_key", "l_key"])


def read_ledger(spark: SparkSession, path: str, numbers: list[str], columns: list[str]) -> DataFrame:
    """A ledger of text columns whose numeric ones are cast, null where they are no numbers."""
    text = read_or_empty(spark, path, ", ".join(f"{c} string" for c in columns))
    return text.select(*[F.col(c).try_cast("double").alias(c) if c in numbers else F.coalesce(c, F.lit("")).alias(c) for c in columns])


def stats_rows(payload: Column) -> Column:
    """Struct of the serve statistics of a match in an API's fields, null unless they agree with each other.

    Side a won if Winner is 2, side b if it is 3; anything else is no result.
    """
    get = lambda f, s: payload[f + s].try_cast("double")

    def side(s: Column | str) -> tuple[Column, Column]:
        served, first_in, first_won, won = (get(f, s) for f in ("totservplayed", "ptsplayed1stserv", "ptswon1stserv", "ptstotwonserv"))
        ok = (served > 0) & (first_in <= served) & (first_won <= first_in) & (won - first_won <= served - first_in)
        return F.struct(served.alias("svpt"), first_in.alias("first_in"), first_won.alias("first_won"), (won - first_won).alias("second_won")), F.coalesce(ok, F.lit(False))

    (a, a_ok), (b, b_ok) = side("a"), side("b")
    won = payload["Winner"]
    pair = F.when(won == "2", F.struct(a.alias("w"), b.alias("l"))).when(won == "3", F.struct(b.alias("w"), a.alias("l")))
    return F.when(a_ok & b_ok, pair)
