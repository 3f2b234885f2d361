"""Live draws: seating survivors by posted match-ups, folding decided rounds, pricing, sections and swings.

A draw is rows (event, slot, player) with a power of two of places; a null player is a bye.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.operators.bracket import seed_order
from matchlake.sources.files import staged


def units(alive: DataFrame, matchups: DataFrame, rating: str) -> DataFrame:
    """event, unit, status, a, b: one row for each match of the current round, the strongest first; b is null for players
    who are through. status: real where the posted pairs seat a power of two of units, partial where they don't, seeded
    where none is posted; the units of partial and seeded events are single players.

    alive: event, player, rating; matchups: event, seq, a, b; of a player's several pairs the first holds.
    """
    living = alive.select("event", F.col("player").alias("a"), F.col(rating).alias("ra"))
    known = matchups.filter("a <> b").join(living, ["event", "a"]).join(living.toDF("event", "b", "rb"), ["event", "b"])
    seat = known.select("event", "seq", "a", "b", "ra", "rb", F.explode(F.array("a", "b")).alias("p"))
    first = seat.withColumn("n", F.row_number().over(W.partitionBy("event", "p").orderBy("seq")))
    pairs = first.groupBy("event", "seq", "a", "b", "ra", "rb").agg(F.max("n").alias("n")).filter("n = 1")
    strong = (F.col("ra") > F.col("rb")) | ((F.col("ra") == F.col("rb")) & (F.col("a") < F.col("b")))
    paired = pairs.select("event", F.when(strong, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(strong, F.col("b")).otherwise(F.col("a")).alias("b"), F.greatest("ra", "rb").alias("r"))
    used = paired.select("event", F.explode(F.array("a", "b")).alias("a"))
    single = living.join(used, ["event", "a"], "left_anti").select("event", "a", F.lit(None).cast("bigint").alias("b"), F.col("ra").alias("r"))
    counts = alive.select("event").distinct().join(paired.groupBy("event").agg(F.count("*").alias("pairs")), "event", "left").join(single.groupBy("event").agg(F.count("*").alias("rest")), "event", "left")
    total = F.coalesce("pairs", F.lit(0)) + F.coalesce("rest", F.lit(0))
    status = F.when(F.col("pairs").isNull(), "seeded").when(F.bit_count(total) == 1, "real").otherwise("partial")
    judged = counts.select("event", status.alias("status"))
    real = paired.unionByName(single).join(judged.filter("status = 'real'"), "event")
    seeded = living.select("event", "a", F.lit(None).cast("bigint").alias("b"), F.col("ra").alias("r")).join(judged.filter("status <> 'real'"), "event")
    place = F.row_number().over(W.partitionBy("event").orderBy(F.desc("r"), "a"))
    return real.unionByName(seeded).withColumn("unit", place).select("event", "unit", "status", "a", "b")


def seat(units_: DataFrame) -> DataFrame:
    """event, slot, player, status: units spread by strength; of real draws each unit is a pair of places, of others a place."""
    n = units_.groupBy("event", "status").agg(F.length(F.bin(F.count("*") - 1)).alias("bits"), F.count("*").alias("n"))
    sized = n.withColumn("k", F.when(F.col("n") == 1, 0).otherwise(F.col("bits")))
    most = sized.agg(F.max("k")).first()[0] or 0
    order = units_.sparkSession.createDataFrame([(k, i, x) for k in range(most + 1) for i, x in enumerate(seed_order(k))], "k int, place int, unit int")
    placed = sized.join(F.broadcast(order), "k").join(units_.drop("status"), ["event", "unit"], "left")  # the order of places is no longer than a draw
    two = F.array(F.struct((2 * F.col("place")).alias("slot"), F.col("a").alias("player")), F.struct((2 * F.col("place") + 1).alias("slot"), F.col("b").alias("player")))
    one = F.array(F.struct(F.col("place").alias("slot"), F.col("a").alias("player")))
    return placed.select("event", "status", F.explode(F.when(F.col("status") == "real", two).otherwise(one)).alias("x")).select("event", "x.slot", "x.player", "status")


def advance(slots: DataFrame, eliminated: DataFrame) -> DataFrame:
    """event, slot, player: whole decided rounds folded to their winners; in the first round with an open match that match
    stays, and its decided neighbours become (winner, bye).

    slots: event, slot, player; eliminated: event, player. Every step is one grouping over all events; it ends when none folds.
    """
    out_ = eliminated.select("event", "player").distinct().withColumn("gone", F.lit(True))
    now = staged(slots.select("event", "slot", "player", F.lit(False).alias("done")))
    while True:
        side = now.join(out_, ["event", "player"], "left").withColumn("live", F.col("player").isNotNull() & F.col("gone").isNull())
        half = lambda i, c: F.max(F.when(F.col("slot") % 2 == i, F.col(c)))
        pairs = side.groupBy("event", "done", F.shiftright("slot", 1).alias("match")).agg(half(0, "player").alias("a"), half(1, "player").alias("b"), half(0, "live").alias("la"), half(1, "live").alias("lb"))
        here = W.partitionBy("event")
        pairs = pairs.withColumns({"open": F.col("la") & F.col("lb"), "any": F.max(F.col("la") & F.col("lb")).over(here), "n": F.count("*").over(here)})
        # the side that is neither a bye nor out; as in a fold, of two that are out the second
        winner = F.when(~F.col("la"), F.col("b")).otherwise(F.col("a"))
        keep = F.array(F.struct((2 * F.col("match")).alias("slot"), F.col("a").alias("player")), F.struct((2 * F.col("match") + 1).alias("slot"), F.col("b").alias("player")))
        bye = F.array(F.struct((2 * F.col("match")).alias("slot"), winner.alias("player")), F.struct((2 * F.col("match") + 1).alias("slot"), F.lit(None).cast(slots.schema["player"].dataType).alias("player")))
        fold = F.array(F.struct(F.col("match").alias("slot"), winner.alias("player")))
        still = F.col("done") | (F.col("n") <= 1)
        rows = F.when(still | (F.col("any") & F.col("open")), keep).when(F.col("any"), bye).otherwise(fold)
        now = staged(pairs.select("event", F.explode(rows).alias("x"), (still | F.col("any")).alias("done")).select("event", "x.slot", "x.player", "done"))
        if now.filter("not done").isEmpty():
            return now.select("event", "slot", "player")


def priced(matches: DataFrame, model: Column, logged: Column) -> DataFrame:
    """Add p, source and upset: of completed matches the forecast logged before goes first, else the model; walkovers and
    matches of unknown players have no price. Upsets are judged by the rounded chance.

    matches: a, b, winner (the player, or null), walkover.
    """
    known = F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.coalesce("walkover", F.lit(False))
    done = F.col("winner").isNotNull()
    p = F.when(known, F.when(done, F.coalesce(logged, model)).otherwise(model))
    source = F.when(known, F.when(done & logged.isNotNull(), "logged").when(model.isNotNull(), "model"))
    rounded = F.round(p, 4)
    chance = F.when(F.col("winner") == F.col("a"), rounded).otherwise(1 - rounded)
    return matches.withColumns({"p": rounded, "source": source, "upset": F.when(done & rounded.isNotNull(), chance < 0.5)})


def sections(slots: DataFrame, width: int = 16) -> DataFrame:
    """Add section: which stretch of ``width`` places a match of the given round lies in, and its place there."""
    per = F.greatest(F.lit(1), (F.lit(width) / F.pow(F.lit(2), F.col("round"))).cast("int"))
    return slots.withColumns({"section": F.floor(F.col("match") / per).cast("int"), "place": (F.col("match") % per).cast("int")})


def swings(outcomes: DataFrame, most: int) -> DataFrame:
    """The columns of ``outcomes``' matches, player, before, after, place: the largest changes of title chances of each match (a top-k
    report), found within its row."""
    both = F.transform(F.arrays_zip("players", "before", "after"), lambda x: F.struct((-F.abs(F.round(x["after"] - x["before"], 9))).alias("swing"), x["players"].alias("player"), x["before"].alias("before"), x["after"].alias("after")))
    found = outcomes.withColumn("top", F.slice(F.array_sort(both), 1, most)).select("event", "round", "block", F.posexplode("top").alias("i", "x"))
    return found.select("event", "round", "block", "x.player", "x.before", "x.after", (F.col("i") + 1).alias("place"))
