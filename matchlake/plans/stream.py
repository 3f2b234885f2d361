"""Streams in several micro-batches, with rows that come late and files that come twice, that end up with what a batch query gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.operators.ratings import Rating
from matchlake.plans.ratings import _WALK, elo, parted
from matchlake.plans.registry import query
from matchlake.sources.adapters import MATCHES, forecasts, matches
from matchlake.sources.files import scratch, staged
from matchlake.streaming import forecast_log as log
from matchlake.streaming import walks

_SCHEMA = "event_id bigint, as_of timestamp, match bigint, player bigint, p double, version string, k int"
#: Periods that the log lands in, as many micro-batches, and rows of a file, about.
FILES, LANDED = 4, 500_000


def arriving(rows: DataFrame, by: str) -> tuple[str, int]:
    """A folder where the rows land in FILES periods, one after the other in order of a time, and the number of files of each: streams
    take files in the order in which they were written, so many a batch.

    Rows are made once and written by as many tasks as there are files; small tables have one file a period.
    """
    path = scratch(rows.sparkSession)
    at = staged(rows.withColumn("_at", F.unix_timestamp(F.col(by).cast("timestamp"))))
    files = 1 + at.count() // (FILES * LANDED)
    cuts = [-float("inf"), *at.approxQuantile("_at", [i / FILES for i in range(1, FILES)], 0.01), float("inf")]
    for low, high in zip(cuts, cuts[1:], strict=False):
        at.filter((F.col("_at") > low) & (F.col("_at") <= high)).drop("_at", by if by == "arrives" else "_at").repartition(files).write.mode("append").parquet(path)
    return path, files


def landed(spark: SparkSession, sf_dir: str, twice: bool = False) -> DataFrame:
    """The log as a stream of files in order of time; every tenth row comes up to an hour after its time. With ``twice`` a file follows
    that repeats rows of the last ones."""
    rows = forecasts(spark, sf_dir).withColumn("arrives", F.when(F.col("event_id") % 10 == 0, F.col("as_of") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("as_of")))
    path, files = arriving(rows, "arrives")
    if twice:
        latest = rows.agg(F.max("as_of").alias("latest"))
        again = rows.join(F.broadcast(latest), F.col("as_of") > F.col("latest") - F.expr("INTERVAL 1 HOUR")).drop("arrives", "latest")
        again.repartition(1).write.mode("append").parquet(path)
    return log.source(spark, path, _SCHEMA, files)


@query(MATCHES + "SELECT DISTINCT match, date_trunc('hour', as_of) AS hour FROM forecasts")
def stream_hour_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and hours in the log, each appended once, though rows repeat across batches."""
    stream = landed(spark, sf_dir, twice=True)
    return log.run(log.hourly(stream).select("match", "hour"))


@query(MATCHES + ", a AS (SELECT *, as_of + INTERVAL 1 HOUR * (CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS arrives FROM forecasts) SELECT DISTINCT match FROM a")
def stream_first_sighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match is locked once, whatever later batches say; a test holds the locked rows to the batches."""
    return log.run(log.first_sightings(landed(spark, sf_dir))).select("match")


@query(MATCHES + """, d AS (SELECT date_trunc('day', as_of) AS day, version, count(*) AS n, round(avg(p), 6) AS p FROM forecasts GROUP BY ALL) SELECT * FROM d
  WHERE day < (SELECT date_trunc('day', max(as_of) - INTERVAL 1 DAY) FROM forecasts)""")
def stream_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows that the watermark has closed; rows an hour late still count."""
    found = log.run(log.windows(landed(spark, sf_dir)))
    return found.select(F.col("w.start").alias("day"), "version", "n", "p")


@query(MATCHES + """, w AS (SELECT unnest([0, 1, 2, 3]) AS i), x AS (SELECT time_bucket(INTERVAL 6 HOUR, as_of, TIMESTAMP '1970-01-01') - i * INTERVAL 6 HOUR AS start, version, p FROM forecasts, w)
SELECT start, version, count(*) AS n, round(sum(p), 6) AS total FROM x WHERE start + INTERVAL 1 DAY <= (SELECT max(as_of) - INTERVAL 1 DAY FROM forecasts) GROUP BY ALL""")
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day every six hours that the watermark has closed."""
    found = log.run(log.sliding(landed(spark, sf_dir), "1 day", "6 hours"))
    return found.select(F.col("w.start").alias("start"), "version", "n", "total")


@query(MATCHES + """, o AS (SELECT *, as_of - lag(as_of) OVER (PARTITION BY player ORDER BY as_of, event_id) > INTERVAL 9 HOUR AS fresh FROM forecasts),
g AS (SELECT *, sum(CASE WHEN fresh IS NULL OR fresh THEN 1 ELSE 0 END) OVER (PARTITION BY player ORDER BY as_of, event_id) AS run FROM o),
s AS (SELECT player, run, count(*) AS n, min(as_of) AS first, max(as_of) AS last, round(arg_max(p, (as_of, event_id)), 6) AS p FROM g GROUP BY player, run)
SELECT player, n, first, last, p FROM s WHERE last + INTERVAL 9 HOUR <= (SELECT max(as_of) - INTERVAL 1 DAY FROM forecasts)""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A player's runs of forecasts with less than nine hours between them, over several batches with late rows; a run's state is
    dropped when it is given out."""
    found = log.run(log.sessions(landed(spark, sf_dir), "9 hours"))
    return found.select("player", "n", "first", "last", "p")


@query(MATCHES + """, r AS (SELECT match, as_of + INTERVAL 20 DAY AS ended, event_id % 2 = 0 AS won FROM forecasts
  WHERE event_id % 3 = 0) SELECT f.event_id, f.match, f.p, r.won FROM forecasts f
  JOIN r ON f.match = r.match AND r.ended >= f.as_of - INTERVAL 1 DAY AND r.ended <= f.as_of + INTERVAL 21 DAY""")
def stream_late_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts graded by results that come within three weeks: two streams joined by match and interval."""
    left = landed(spark, sf_dir)
    rows = forecasts(spark, sf_dir).filter("event_id % 3 = 0").select("match", (F.col("as_of") + F.expr("INTERVAL 20 DAYS")).alias("ended"), (F.col("event_id") % 2 == 0).alias("won"))
    path, files = arriving(rows, "ended")
    right = log.source(spark, path, "match bigint, ended timestamp, won boolean", files)
    return log.run(log.graded(left, right, 21, late="30 days"))


def rated_in_batches(m: DataFrame, rating: Rating, cuts: list[str], history: DataFrame | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The rating walk over matches that land period after period (from each cut on to the next), resumed for each from the
    checkpoint that the last left; history: a walk with states over what came before; initial: tour, player, state
    after it, where the caller has them."""
    spark, path, out, kept = m.sparkSession, scratch(m.sparkSession), scratch(m.sparkSession), scratch(m.sparkSession)
    initial = initial if history is None else walks.last_states(history)
    rows = m.withColumns({"w_home": F.lit(0), "l_home": F.lit(0), "at": F.col("date").cast("timestamp")})
    names = [x.split()[0] for x in walks.READS.split(", ")]
    rows = staged(rows.select(*[F.col(x).cast(kind) for x, kind in (y.split() for y in walks.READS.split(", "))]).select(*names))
    for low, high in zip(cuts, [*cuts[1:], "9999-01-01"], strict=True):
        rows.filter((F.col("date") >= low) & (F.col("date") < high)).write.mode("append").parquet(path)
        stream = spark.readStream.schema(rows.schema).parquet(path)
        found = log.run(walks.ratings(stream, rating, initial=initial), checkpoint=kept, out=out, parts=walks.PARTS)
    return found


@query(_WALK + "SELECT match_id, round(w_elo, 6) AS w_elo, round(l_elo, 6) AS l_elo, round(w_after, 6) AS w_after, round(l_after, 6) AS l_after FROM elo")
def stream_rating_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole walk, made of a walk over history whose states are saved, and three periods that arrive later, each resumed
    from the state store after a restart."""
    m = staged(matches(spark, sf_dir))
    before, cuts = "1999-01-01", ["1999-01-01", "2000-01-01", "2001-01-01"]
    past, states = parted(staged(elo(spark, sf_dir, Rating(), m.filter(F.col("date") < before), ends=True)))
    later = rated_in_batches(m.filter(F.col("date") >= before), Rating(), cuts, initial=states)
    columns = ["match_id", *[F.round(c, 6).alias(c) for c in ("w_elo", "l_elo", "w_after", "l_after")]]
    return past.select(*columns).unionByName(later.select(*columns))
