"""The forecast log as Structured Streaming: idempotent hourly snapshots, first sightings, windows, late rows and state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchlake.sources.files import scratch


def source(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """New Parquet files of a folder, so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first row of each match and hour, over all batches; keys are kept for as long as rows may be late."""
    keyed = stream.withColumn("hour", F.date_trunc("hour", "as_of"))
    return keyed.withWatermark("as_of", late).dropDuplicatesWithinWatermark(["match", "hour"])


def windows(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts and mean chances by day (an addition of this engine: event-time windows with a watermark)."""
    return stream.withWatermark("as_of", late).groupBy(F.window("as_of", "1 day").alias("w"), "version").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("p"))


def sliding(stream: DataFrame, width: str, step: str, late: str = "1 day") -> DataFrame:
    """Counts and sums of chances by version in windows that overlap, once each is closed."""
    return stream.withWatermark("as_of", late).groupBy(F.window("as_of", width, step).alias("w"), "version").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("total"))


def sessions(stream: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """A player's runs of forecasts without a gap: start, last chance and number of each run, given out when no row that may
    still come could lengthen it. Then its state is gone, so state follows the players of the last days."""
    run = F.session_window("as_of", gap).alias("w")
    last = F.round(F.max_by("p", F.struct("as_of", "event_id")), 6)
    return stream.withWatermark("as_of", late).groupBy("player", run).agg(F.count("*").alias("n"), F.min("as_of").alias("first"), F.max("as_of").alias("last"), last.alias("p"))


def first_sightings(stream: DataFrame) -> DataFrame:
    """Each match once, in the batch that first holds it, with the earliest row of that batch: a sighting is locked, later
    batches never change it. A batch's rows are dealt by match and cut to the earliest of each before they meet the state, which
    then takes one row a match."""

    def earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            rows = rows.sort_by([("match", "ascending"), ("as_of", "ascending"), ("event_id", "ascending")])
            match, none = rows.column("match").fill_null(0).to_numpy(), rows.column("match").is_null().to_numpy()
            new = np.ones(len(match), bool)
            new[1:] = (match[1:] != match[:-1]) | (none[1:] != none[:-1])
            kept = rows.filter(pa.array(new))
        if kept is not None:
            yield from kept.select(["match", "event_id", "p"]).to_batches()

    dealt = stream.select("match", "as_of", "event_id", "p").repartition("match")
    return dealt.mapInArrow(earliest, "match bigint, event_id bigint, p double").dropDuplicates(["match"])


def latest(stream: DataFrame, late: str, keep_hours: int) -> DataFrame:
    """Each match's last row, given out when ``keep_hours`` of event time have passed since it; then its state is gone, and
    a later row of the match starts anew."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, event_id, p = state.get
            state.remove()
            yield pd.DataFrame({"match": [key[0]], "event_id": [event_id], "p": [p]})
            return
        at, event_id, p = state.get if state.exists else (-1, -1, 0.0)
        if state.exists and at // 1000 + keep_hours * 3_600_000 <= state.getCurrentWatermarkMs():  # over, though rows came
            yield pd.DataFrame({"match": [key[0]], "event_id": [event_id], "p": [p]})
            at, event_id, p = -1, -1, 0.0
        for frame in frames:
            for stamp, new, value in zip(frame["as_of"], frame["event_id"], frame["p"], strict=True):
                when = int(stamp.timestamp() * 1_000_000)
                if (when, new) > (at, event_id):
                    at, event_id, p = when, int(new), float(value)
        state.update((at, event_id, p))
        state.setTimeoutTimestamp(max(at // 1000 + keep_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))

    return stream.withWatermark("as_of", late).groupBy("match").applyInPandasWithState(update, "match bigint, event_id bigint, p double", "at bigint, event_id bigint, p double", "append", GroupStateTimeout.EventTimeTimeout)


def graded(forecasts: DataFrame, results: DataFrame, grace_days: int, late: str = "1 day") -> DataFrame:
    """Forecasts joined to the results of their match that come within the grace window; both streams forget older rows."""
    f = forecasts.withWatermark("as_of", late).alias("f")
    r = results.withWatermark("ended", late).alias("r")
    within = F.expr(f"f.match = r.match and r.ended >= f.as_of - interval 1 day and r.ended <= f.as_of + interval {grace_days} days")
    return f.join(r, within).select("f.event_id", "f.match", "f.p", "r.won")


def run(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None, parts: int | None = None) -> DataFrame:
    """Process all files there are, a batch after the other, then read what was written; a checkpoint goes on where it ended.
    parts: partitions of its state at most, where keys are few."""
    spark, key = stream.sparkSession, "spark.sql.shuffle.partitions"
    out, checkpoint, before = out or scratch(spark), checkpoint or scratch(spark), spark.conf.get(key)
    spark.conf.set(key, min(int(before), parts or int(before)))
    try:
        query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(stream.schema).parquet(out)
