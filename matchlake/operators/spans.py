"""Joins of time spans that overlap, and of names that contain each other, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlapping(x: DataFrame, y: DataFrame, on: list[str], days: int = 64, least: int = 0) -> DataFrame:
    """Rows of both sides with equal keys whose spans (xlo to xhi, ylo to yhi, days) have ``least`` days between the later
    start and the earlier end, or more.

    Both sides are dealt to bins of ``days`` days that their spans touch and meet by key and bin, so a key's whole past is
    not paired; a pair is taken in the first bin that both touch, once.
    """
    number = lambda c: F.floor(F.unix_date(c) / days).cast("int")

    def dealt(df: DataFrame, side: str) -> DataFrame:
        first, last = number(F.col(f"{side}lo")), number(F.col(f"{side}hi"))
        return df.withColumn(f"_{side}first", first).withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, last))))

    met = dealt(x, "x").join(dealt(y, "y"), [*on, "_bin"])
    met = met.filter((F.col("_bin") == F.greatest("_xfirst", "_yfirst")) & (F.datediff(F.least("xhi", "yhi"), F.greatest("xlo", "ylo")) >= least))
    return met.drop("_bin", "_xfirst", "_yfirst")


def spanned(df: DataFrame, key: str, side: str, *keep: str) -> DataFrame:
    """Rows (key renamed to the side, keep) once, with the span of each key's dates."""
    span = df.groupBy(key).agg(F.min("date").alias(f"{side}lo"), F.max("date").alias(f"{side}hi"))
    return df.select(key, *keep).distinct().join(span, key).withColumnRenamed(key, side)


def containing(texts: DataFrame, text: str, parts: DataFrame, part: str, size: int = 3) -> DataFrame:
    """text, part: the pairs of distinct names of which the one contains the other; null and empty names are in nothing.

    A text is indexed by its runs of up to ``size`` letters. A part looks up one run of its own, the one that fewest texts
    have, and only these texts are searched.
    """
    def runs(name: str, n: int) -> F.Column:
        return F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(F.col(name), i, F.lit(n)))

    every = texts.select(text).filter(F.col(text) != "").distinct()
    index = None
    for n in range(1, size + 1):
        own = every.filter(F.length(text) >= n).select(text, F.explode(F.array_distinct(runs(text, n))).alias("_run"))
        index = own if index is None else index.unionByName(own)
    often = index.groupBy("_run").agg(F.count("*").alias("_n"))
    asked = parts.select(part).filter(F.col(part) != "").distinct()
    long = asked.filter(F.length(part) >= size).select(part, F.explode(F.array_distinct(runs(part, size))).alias("_run"))
    short = asked.filter(F.length(part) < size).select(part, F.col(part).alias("_run"))
    each = long.unionByName(short).join(often, "_run", "left")  # a run that no text has ends the search for its part
    rarest = each.groupBy(part).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_run")).alias("_best")).select(part, F.col("_best._run").alias("_run"))
    return rarest.join(index, "_run").filter(F.col(text).contains(F.col(part))).select(text, part)
