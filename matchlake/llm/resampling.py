"""Importance resampling towards a target: documents drawn by the likelihood ratio of their hashed n-grams.

Everything is Spark SQL. N-gram arrays are exploded and hashed to buckets by crc32; grouped counts of the corpus and of the
target give each bucket a gain, the log of its smoothed frequency ratio in thousandths; the table of gains has one row a
bucket, so it is broadcast whatever the corpus' size; a document's weight is the sum of its features' gains. Adding Gumbel
noise from a seeded hash makes the highest scores a draw without replacement. Ranks come from a range sort: each row has
its place within its partition, partitions are shifted by the sizes of those before.

Features and gains are summed for each different (id, text) before a shuffle, and repeated rows are restored from their
number, so neither a hot id nor very long texts meet in one task.

Words are runs of characters that are neither ASCII punctuation, control nor space, A-Z in lower case. Edge cases: a null text
has no words; a document without words has no features, weight 0, and is never drawn; a null id counts as an empty one and
comes after all ids on ties; repeated rows are drawn each by itself, equal in score, in any order; an empty table gives an
empty result, an empty target zero counts; columns other than the id and the text are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from matchlake.llm.blocks import staged

#: Characters between words, as a pattern over text in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text as an array (empty for null)."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, BETWEEN), "")


def features(rows: DataFrame, buckets: int, longest: int = 3) -> DataFrame:
    """One row for each run of 1 to ``longest`` words in ``words``: its ``bucket``, and ``mark``, 1 once for each input row.

    A row without words gives one row with a null bucket, so that it isn't lost.
    """
    each = rows.select("*", F.posexplode_outer("words").alias("at", "word"))
    runs = [F.col("word")]
    for i in range(1, longest):
        runs.append(F.concat(runs[-1], F.lit(" "), F.get("words", F.col("at") + i)))  # null beyond the end
    first = F.coalesce(F.col("at") == 0, F.lit(True))
    grams = each.select(*[c for c in rows.columns if c != "words"], first.alias("first"), F.posexplode(F.array(*runs)).alias("more", "gram"))
    grams = grams.filter((F.col("more") == 0) | F.col("gram").isNotNull())
    return grams.select(
        *[c for c in rows.columns if c != "words"],
        (F.crc32(F.col("gram").cast("binary")) % buckets).cast("int").alias("bucket"),
        (F.col("first") & (F.col("more") == 0)).cast("int").alias("mark"),
    )


def bucket_counts(df: DataFrame, buckets: int, longest: int, name: str) -> DataFrame:
    """Features of all texts in each bucket that has any."""
    each = features(df.select(words(F.col("text")).alias("words")), buckets, longest)
    return each.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int, longest: int = 3) -> DataFrame:
    """bucket, gain: one row for each of the buckets."""
    counted = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for df, name in ((docs, "s"), (target, "t")):
        counted = counted.join(bucket_counts(df, buckets, longest, name), "bucket", "left").fillna(0, [name])
    number = lambda c: F.col(c).cast("double")
    counted = counted.join(counted.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")))  # one row
    ratio = (number("t") + 1) * (number("all_s") + buckets) / ((number("s") + 1) * (number("all_t") + buckets))
    return counted.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def weighted(docs: DataFrame, gain: DataFrame, buckets: int, longest: int = 3) -> DataFrame:
    """doc_id, n_words, n_features, weight and copy (1, 2, ... among rows of equal id and text) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("same"), words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "same", F.size("words").alias("n_words"), "words")
    each = features(rows, buckets, longest).join(F.broadcast(gain), "bucket", "left")
    sums = each.groupBy("doc_id", "same", "n_words").agg(F.sum("mark").alias("copies"), F.count("bucket").alias("n"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    of_one = lambda c: F.expr(f"{c} div copies")
    return sums.select("doc_id", "n_words", of_one("n").alias("n_features"), of_one("gain").alias("weight"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296))).cast("long")


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number all rows 1, 2, 3 ... in a total order: a range sort, places within partitions, sizes of those before."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    placed = staged(placed.select("*", part.alias("_part")).withColumn("_at", F.col("_at") - F.shiftleft("_part", 33)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as partitions
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, buckets: int = 10_000, least_words: int = 20, longest: int = 3) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null for rows that aren't drawn.

    Of the rows with ``least_words`` words or more, ``percent`` of a hundred (rounded down) are drawn, ranked by score, ties by
    the smaller id.
    """
    gain = staged(gains(docs, target, buckets, longest))
    scored = staged(weighted(docs, gain, buckets, longest).withColumn("score", F.col("weight") + noise(seed)))
    enough = F.col("n_words") >= least_words
    draw = percent * scored.filter(enough).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("copy")]
    some = ranked(scored.filter(enough), order).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    every = some.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))
    return every.select("doc_id", "n_features", "weight", "score", "rank")
