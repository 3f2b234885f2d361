"""Printed draws: numbered lines of a layout, read inside Catalyst.

A line is a place if it starts with its number. What follows the number is, in this order and each if it is there: an entry code
(which may be glued to the number), a seed, and the name in a column of its own. Places count as long as their numbers follow each other
from 1; a line whose number lies further ahead ends the block, and one of eight places or more is the draw.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: How an entrant came in, and what stands in a place without a player.
ENTRY_CODES = ("A", "ALT", "JE", "JR", "LL", "NG", "PR", "Q", "Q/LL", "SE", "WC")
UNRESOLVED = ("alt", "alternate", "ll", "lucky loser", "q", "qualifier", "qualifier/ll", "qualifier/lucky loser", "tba", "tbd", "wc", "wildcard")
#: Places of the smallest and of the largest draw.
LEAST, MOST = 8, 128

_CODE = rf"(?i)^(?:{'|'.join(sorted(ENTRY_CODES, key=len, reverse=True))})\s+"
_LETTER = r"[\p{L}…]"


def titled(name: Column) -> Column:
    """Each run of letters with a capital first."""
    return F.array_join(F.transform(F.split(F.lower(name), r"(?<=[^\p{L}])"), F.initcap), "")


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def columns(body: Column) -> tuple[Column, Column]:
    """Player (null: a bye) and seed of what follows a place's number; the player is empty where there is no name.

    SURNAME, Given becomes Given Surname; the given name ends before two spaces or a country's three capitals. A name without a
    comma ends before two spaces, and its capitals are turned into a title. A seed leads, or stands in brackets behind.
    """
    rest = _without(body, _CODE)
    behind = F.regexp_extract(rest, r"\[(\d+)\]\s*$", 1)
    leading = F.regexp_extract(rest, r"^(\d{1,2})\s+", 1)
    name = F.trim(_without(_without(rest, r"^\d{1,2}\s+"), r"\s*\[\d+\]\s*$"))
    first_column = lambda x: F.trim(F.regexp_extract(F.trim(x), r"^(.*?)(?:\s{2,}|$)", 1))
    one_space = lambda x: F.regexp_replace(x, r"\s+", " ")
    given = F.trim(_without(first_column(F.regexp_extract(name, r",(.*)$", 1)), r"\s+[A-Z]{3}$"))
    surname = titled(one_space(F.trim(F.regexp_extract(name, r"^([^,]*)", 1))))
    whole = one_space(first_column(name))
    clipped = F.when(whole.rlike(r"\p{Ll}"), whole).otherwise(titled(whole))
    named = name.contains(",")
    player = F.when(named, F.when(given.rlike(_LETTER) & (surname != ""), F.concat_ws(" ", one_space(given), surname))).when(whole.rlike(_LETTER), clipped)
    bye = body.rlike(r"(?i)^bye(\s|$)")
    seed = F.coalesce(leading.try_cast("int"), behind.try_cast("int"))
    return F.when(~bye, F.coalesce(player, F.lit(""))), F.when(~bye, seed)


def places(text: Column) -> Column:
    """Array of (player, seed), the draw of a text; null where there is none."""
    line = F.split(F.coalesce(text, F.lit("")), r"\R")

    def read(x: Column) -> Column:
        part = lambda i: F.regexp_extract(x, r"^\s{0,3}(\d{1,3})(\.?\s*)(\S.*?)\s*$", i)
        player, seed = columns(part(3))
        number = F.when((part(1) != "") & ((part(2) != "") | part(3).rlike(_CODE)) & (player.isNull() | (player != "")), part(1).cast("int"))
        return F.struct(number.alias("number"), player.alias("player"), seed.alias("seed"))

    numbered = F.filter(F.transform(line, read), lambda x: x["number"].isNotNull())
    empty = F.array().cast("array<struct<player:string,seed:int>>")
    start = F.struct(F.lit(False).alias("over"), empty.alias("rows"))

    def follow(state: Column, x: Column) -> Column:
        n = F.size(state["rows"])
        longer = F.struct((n + 1 == MOST).alias("over"), F.concat(state["rows"], F.array(F.struct(x["player"].alias("player"), x["seed"].alias("seed")))).alias("rows"))
        ended = F.struct(F.lit(True).alias("over"), state["rows"].alias("rows"))
        ahead = F.when(n >= LEAST, ended).otherwise(start)
        return F.when(state["over"] | (x["number"] <= n), state).when(x["number"] == n + 1, longer).otherwise(ahead)

    rows = F.aggregate(numbered, start, follow)["rows"]
    return F.when((F.size(rows) >= LEAST) & (F.bit_count(F.size(rows)) == 1), rows)


def printed_draws(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, slot, player, seed of each text with a draw; places that wait for a player get numbered names."""
    each = texts.select(key, F.posexplode(places(F.col(text))).alias("slot", "x")).select(key, "slot", "x.player", "x.seed")
    label = F.regexp_replace(F.regexp_replace(F.trim(F.replace(F.lower("player"), F.lit("ﬁ"), F.lit("fi"))), r"\s+", " "), r"\s*/\s*", "/")
    waits = F.coalesce(reduce(lambda a, b: a | b, [label == x for x in UNRESOLVED]), F.lit(False))
    nth = F.sum(F.when(waits, 1).otherwise(0)).over(W.partitionBy(key).orderBy("slot"))
    return each.select(key, "slot", F.when(waits, F.concat(F.lit("Qualifier "), nth.cast("string"))).otherwise(F.col("player")).alias("player"), "seed")
