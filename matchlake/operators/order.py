"""Global orders and ordered folds without a single task for all rows."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.sources.files import staged


#: Rows of a bin that one task numbers, about.
BIN = 200_000
#: Of a long fold: partitions that keys are dealt to, rows that are given out together at a key's end, and bytes of blocks that
#: cross to Python together, about.
KEYS, LEFT, BATCH_BYTES = 64, 10_000, 16 << 20


def sequence(df: DataFrame, order: list[Column], name: str = "seq", bins: int | None = None) -> DataFrame:
    """Number all rows from 1 in a total order led by a number (nulls not allowed in it).

    Rows are ranged by the first key into bins cut at approximate quantiles of its value, numbered within bins, and
    shifted by the sizes of the bins before; only bin sizes meet in one place. Bins are as many as the rows ask for.
    """
    lead = df.withColumn("_lead", order[0].cast("double") if order else F.lit(0.0))
    bins = bins or min(1024, 1 + lead.count() // BIN)
    cuts = sorted(set(lead.approxQuantile("_lead", [i / bins for i in range(1, bins)], 0.001))) if bins > 1 else []
    binned = lead.withColumn("_bin", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_lead"))) if cuts else F.lit(0))
    sizes = binned.groupBy("_bin").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = binned.withColumn("_row", F.row_number().over(W.partitionBy("_bin").orderBy(*order)))
    return numbered.join(F.broadcast(before), "_bin").withColumn(name, (F.col("_row") + F.col("_before")).cast("long")).drop("_lead", "_bin", "_row", "_before")


def near(left: DataFrame, right: DataFrame, on: list[str], left_day: str, right_day: str, low: int, high: int) -> DataFrame:
    """Rows of equal keys whose right day is ``low`` to ``high`` days after the left one.

    Both sides meet by key and by a stretch of days, so a key's whole past is not paired; a left row is dealt to the two
    stretches at most that its days touch.
    """
    stretch = lambda d: F.floor(F.unix_date(d) / (high - low + 1)).cast("int")
    first, last = F.date_add(left_day, low), F.date_add(left_day, high)
    dealt = left.withColumn("_stretch", F.explode(F.sequence(stretch(first), stretch(last))))
    met = dealt.join(right.withColumn("_stretch", stretch(F.col(right_day))), [*on, "_stretch"]).drop("_stretch")
    return met.filter(F.datediff(right_day, left_day).between(low, high))


def ordered_fold(df: DataFrame, by: str, order: list[str], start: Callable[[], Callable[..., tuple]], schema: str) -> DataFrame:
    """Run a stateful step over the rows of each key, in order.

    ``start`` makes a step function with fresh state; its parameters are named as the columns that it reads, and it returns
    the output row as a tuple, or None for no row. Rows are dealt by key and sorted within partitions, then streamed, so a task holds the state
    but never a key's rows.
    """
    reads = list(inspect.signature(start()).parameters)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = object(), None
        for frame in frames:
            out = []
            for own, *values in zip(frame[by].tolist(), *[frame[c].tolist() for c in reads], strict=True):
                if own != key:
                    key, step = own, start()
                row = step(*values)
                if row is not None:
                    out.append(row)
            if out:
                yield pd.DataFrame(dict(zip(names, zip(*out, strict=True), strict=True)))

    return df.select(*dict.fromkeys([by, *order, *reads])).repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


def blocks_of(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """by, order (of a block's first row), _block: the rows of each key and month (of order[0], a date) sorted by many tasks and
    packed there into compressed blocks. Blocks of a key follow each other in the order of their first rows."""
    lead = F.year(order[0]) * 12 + F.month(order[0])
    dealt = df.withColumn("_month", lead).repartition(by, "_month").sortWithinPartitions(by, *order)
    head = [by, *order]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(batch.column(by).to_pylist(), batch.column("_month").to_pylist(), strict=True))
            cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] if len(set(keys)) > 1 else []
            for low, high in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                rows, sink = batch.slice(low, high - low).drop_columns(["_month"]), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(rows)
                yield pa.RecordBatch.from_arrays([*[rows.column(c).slice(0, 1) for c in head], pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[*head, "_block"])

    return dealt.mapInArrow(pack, ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in head], "_block binary"]))


def long_fold(df: DataFrame, by: str, order: list[str], start: Callable[[], Callable[..., tuple]], schema: str, finish: Callable[[object, Callable[..., tuple]], Iterable[tuple]] | None = None) -> DataFrame:
    """``ordered_fold`` for few keys with very many rows each, whose order is led by a date.

    Rows are sorted and packed by many tasks (``blocks_of``); the one task of a key sorts its compressed blocks and opens them
    one after the other. No two keys share a task while there are fewer than KEYS. finish: rows that a key and
    its step leave after the last row; columns beyond a row's end are null.
    """
    reads = list(inspect.signature(start()).parameters)
    names = [x.split()[0] for x in schema.split(", ")]

    def told(out: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*out, strict=True))
        return pd.DataFrame(dict(zip(names, [*columns, *[[None] * len(out)] * (len(names) - len(columns))], strict=True)))

    def ended(key, step: Callable[..., tuple] | None) -> Iterator[pd.DataFrame]:
        out = []
        for row in finish(key, step) if finish and step else ():
            out.append(row)
            if len(out) == LEFT:
                yield told(out)
                out = []
        if out:
            yield told(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = object(), None
        for frame in frames:
            for own, block in zip(frame[by].tolist(), frame["_block"], strict=True):
                if own != key:
                    yield from ended(key, step)
                    key, step = own, start()
                rows = pa.ipc.open_stream(block).read_all().to_pandas()
                out = [row for values in zip(*[rows[c].tolist() for c in reads], strict=True) if (row := step(*values)) is not None]
                if out:
                    yield told(out)
        yield from ended(key, step)

    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    df.sparkSession.conf.set(size, min(BATCH_BYTES, int(df.sparkSession.conf.get(size).removesuffix("b"))))
    blocks = staged(blocks_of(df.select(*dict.fromkeys([by, *order, *reads])), by, order))
    return blocks.repartitionByRange(KEYS, by).sortWithinPartitions(by, *order).mapInPandas(run, schema)


def batch_fold(df: DataFrame, by: str, order: list[str], start: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """The same for a step that takes the next rows of a key at once, and gives rows for them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, step = object(), None
        for frame in frames:
            for own, rows in frame.groupby(by, sort=False):  # keys come one after the other
                if own != key:
                    key, step = own, start()
                yield step(rows)

    return df.repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, schema)
