"""Scoreboards: nested JSON events with groupings of competitions, read as tables of results, schedules, fields and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions import levels as lv
from matchlake.operators.merge import keep_best

SCHEMA = (
    "id string, name string, shortName string, date string, endDate string, venue struct<displayName string, fullName string>,"
    " groupings array<struct<grouping struct<slug string>, competitions array<struct<date string, status struct<type struct<completed boolean, state string>>,"
    " round struct<id string, displayName string>, competitors array<struct<winner boolean, athlete struct<displayName string>, linescores array<struct<value double>>>>>>>>"
)
#: Names that stand for nobody yet.
NOBODY = ("", "tbd", "tba", "bye")


def _player(competitor: Column) -> Column:
    name = competitor["athlete"]["displayName"]
    return F.when(~F.lower(F.trim(name)).isin(*NOBODY), name)


def events(boards: DataFrame, payload: str = "payload") -> DataFrame:
    """event (short name first), feed_id, venue, start, finish and groupings of each JSON event."""
    e = boards.select(F.from_json(payload, SCHEMA).alias("e")).select("e.*")
    name = F.coalesce("shortName", "name")
    venue = F.coalesce("venue.displayName", "venue.fullName", name)
    return e.select(name.alias("event"), F.col("id").alias("feed_id"), venue.alias("venue"), F.substring("date", 1, 10).alias("start"), F.substring(F.coalesce("endDate", "date"), 1, 10).alias("finish"), "groupings")


def competitions(boards: DataFrame, gender: str) -> DataFrame:
    """One row for each main-draw competition of the gender's singles, with its draw-relative round; qualifying is dropped."""
    groups = events(boards).withColumn("g", F.explode("groupings")).filter(F.col("g.grouping.slug") == f"{gender}-singles")
    round_id = lambda c: F.when(c["round"]["id"].rlike(r"^\d+$"), c["round"]["id"].cast("int"))
    count = lambda r: F.size(F.filter("g.competitions", lambda c: F.coalesce(round_id(c), F.lit(0)) == r))
    each = groups.withColumn("draw", lv.bracket_size([count(r) for r in range(1, 5)])).withColumn("c", F.explode("g.competitions"))
    code = lv.round_code(round_id(F.col("c")), F.col("c.round.displayName"), F.col("draw"))
    return each.select("event", "feed_id", "venue", F.substring("c.date", 1, 10).alias("date"), code.alias("round"), F.coalesce("c.status.type.completed", F.lit(False)).alias("completed"), F.col("c.status.type.state").alias("state"), F.col("c.competitors").alias("sides")).filter(F.col("round").isNotNull())


def results(boards: DataFrame, gender: str) -> DataFrame:
    """Completed matches with both names, winner first, each (event, winner, loser, score) once, as it came first."""
    side = lambda won: F.filter("sides", lambda c: c["winner"] == F.lit(won))[0]
    rows = competitions(boards, gender).filter("completed").select("*", side(True).alias("w"), side(False).alias("l"))
    games = lambda x: F.round(x["value"]).cast("int").cast("string")
    score = F.array_join(F.zip_with(F.col("w.linescores"), F.col("l.linescores"), lambda a, b: F.concat_ws("-", games(a), games(b))), " ")
    named = rows.select("event", "feed_id", "date", "round", _player(F.col("w")).alias("winner"), _player(F.col("l")).alias("loser"), score.alias("score"))
    return named.filter("winner is not null and loser is not null").transform(lambda d: keep_best(d, ["event", "winner", "loser", "score"], [F.col("date"), F.col("round")]))


def upcoming(boards: DataFrame, gender: str) -> DataFrame:
    """Scheduled and running matches whose two players are known, each (event, a, b) once, as it came first."""
    names = F.array_compact(F.transform("sides", _player))
    rows = competitions(boards, gender).filter("not completed and state in ('pre', 'in')").withColumn("names", names).filter(F.size("names") > 1)
    pairs = rows.select("event", "feed_id", "date", "round", F.col("names")[0].alias("a"), F.col("names")[1].alias("b"))
    return keep_best(pairs, ["event", "a", "b"], [F.col("date"), F.col("round")])


def fields(boards: DataFrame, gender: str, least: int = 8) -> DataFrame:
    """event, feed_id, field and eliminated of events with so many known players, from matches in any state."""
    rows = competitions(boards, gender).withColumn("c", F.explode("sides"))
    lost = F.when(F.col("completed") & (F.col("c.winner") == F.lit(False)), _player(F.col("c")))
    sets = rows.groupBy("event", "feed_id").agg(F.array_sort(F.collect_set(_player(F.col("c")))).alias("field"), F.array_sort(F.collect_set(lost)).alias("eliminated"))
    return sets.filter(F.size("field") >= least)


def meta(boards: DataFrame) -> DataFrame:
    """event, feed_id, start and finish, one row a name (the smallest id)."""
    named = events(boards).filter("event <> ''")
    return named.groupBy("event").agg(F.min(F.struct("feed_id", "start", "finish")).alias("m")).select("event", "m.*")


def distinct_events(windows: DataFrame, order: str) -> DataFrame:
    """Events of several day windows, each id once: that of the first window."""
    e = windows.select(order, "payload", F.get_json_object("payload", "$.id").alias("id"))
    return e.groupBy("id").agg(F.min_by("payload", order).alias("payload")).select("id", "payload")
