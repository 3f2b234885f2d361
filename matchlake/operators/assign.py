"""One-to-one assignment of names: candidates from an inverted index, similarity of strings, greedy choice in rounds."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.names import name_key
from matchlake.sources.files import staged


def similarity(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Add the share of characters in matching blocks of two strings (0 to 1), for rows that are candidates already."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{name: [SequenceMatcher(None, x, y).ratio() for x, y in zip(frame[a], frame[b], strict=True)]})

    return pairs.mapInPandas(run, ", ".join(f"{c} {kind}" for c, kind in pairs.dtypes) + f", {name} double")


def greedy(pairs: DataFrame, within: str, left: str, right: str, order: list[Column]) -> DataFrame:
    """within, left, right: the pairs that a greedy loop over ``order`` takes, each side once.

    A pair that comes first among those of both its sides is taken by the loop whatever the others are, so every round takes
    all of these at once and drops what they block. Rounds are as many as the longest chain of pairs that wait for each
    other, whatever the number of pairs; the order must be total within ``within``.
    """
    rank = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    left_over = staged(pairs.select(within, left, right, rank.alias("_rank")))
    taken = None
    while not left_over.isEmpty():
        first = [left_over.groupBy(within, side).agg(F.min("_rank").alias("_rank")) for side in (left, right)]
        mutual = left_over.join(first[0], [within, left, "_rank"], "left_semi").join(first[1], [within, right, "_rank"], "left_semi")
        mutual = staged(mutual.select(within, left, right))
        taken = mutual if taken is None else taken.unionByName(mutual)
        left_over = staged(left_over.join(mutual, [within, left], "left_anti").join(mutual, [within, right], "left_anti"))
    return left_over.select(within, left, right) if taken is None else taken


def draw_names(slots: DataFrame, pool: DataFrame) -> DataFrame:
    """event, raw, player, how ("key", "similar", or "none" with the raw name itself): a draw's names as its event's own
    participants spell them.

    slots and pool: event, place, and raw or player. Names with equal keys match. Of the rest, pairs that share a word are
    candidates, met in an inverted index of words; they are taken one to one by most shared words, then by similarity, then by the
    slot's and the player's place. Repeated names count at their first place; null and empty names don't take part.
    """
    first = lambda df, c: df.filter(F.col(c) != "").groupBy("event", c).agg(F.min("place").alias("place"))
    a = first(slots, "raw").withColumn("key", name_key(F.col("raw")))
    b = first(pool, "player").withColumn("key", name_key(F.col("player")))
    one = b.groupBy("event", "key").agg(F.min_by("player", "place").alias("player"))  # spellings of one key are one participant
    exact = a.join(one, ["event", "key"])
    words = lambda df, *keep: df.select("event", *keep, F.explode(F.array_distinct(F.filter(F.split("key", " "), lambda x: x != ""))).alias("word"))
    left = a.join(exact.select("event", "key"), ["event", "key"], "left_anti").select("event", "raw", F.col("place").alias("i"), "key")
    free = b.join(exact.select("event", "key"), ["event", "key"], "left_anti").select("event", "player", F.col("place").alias("j"), "key")
    meet = words(left, "raw", "i", F.col("key").alias("key_a")).join(words(free, "player", "j", F.col("key").alias("key_b")), ["event", "word"])
    pairs = similarity(meet.groupBy("event", "raw", "i", "key_a", "player", "j", "key_b").agg(F.count("*").alias("shared")), "key_a", "key_b", "ratio")
    close = greedy(pairs, "event", "raw", "player", [-F.col("shared"), -F.col("ratio"), F.col("i"), F.col("j")])
    found = exact.select("event", "raw", "player", F.lit("key").alias("how")).unionByName(close.select("event", "raw", "player", F.lit("similar").alias("how")))
    return a.select("event", "raw").join(found, ["event", "raw"], "left").select("event", "raw", F.coalesce("player", "raw").alias("player"), F.coalesce("how", F.lit("none")).alias("how"))
