"""Bottom-k fingerprints of documents: the k smallest hashes of the distinct five-word shingles.

Fingerprints of parts merge into the fingerprint of the whole (the k smallest of their union), and two fingerprints
estimate resemblance, containment and the number of distinct shingles.

Words are runs of bytes other than ASCII white space, A-Z in lower case; a text of one to four words is one shingle.
Edge cases: a null or empty text has an empty fingerprint, whose likeness is 1 to another empty one and 0 to all others;
equal texts have equal fingerprints; rows are ordered by doc_id (nulls last), then text, and repeated rows follow one
another; a single row is its own next one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm import words as w
from matchlake.llm.blocks import narrow_batches

#: Hashes in a fingerprint, words in a shingle.
SIZE, SHINGLE = 128, 5
#: Parts that a key's fingerprints are merged in, and keys that a task holds at once.
SALTS, HELD = 64, 20_000


def sketches(column: pa.Array, size: int = SIZE, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The fingerprint of each text as ascending 64-bit hashes."""
    column, out = w.binary(column), []
    _, offsets = w.raw(column)
    for a, b in w.slices(len(column), offsets):
        found = w.split(column.slice(a, b - a))
        hashes = found.hashes(lower=True)
        every = w.runs(hashes, shingle)
        for i, j in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            if j - i >= shingle:
                own = every[i : j - shingle + 1]
                out.append(_smallest(own, size))
            else:
                out.append(w.spans(hashes, np.array([i]), np.array([j])) if j > i else every[:0])
    return out


def _smallest(hashes: np.ndarray, size: int) -> np.ndarray:
    """The smallest distinct hashes, in order."""
    most = 4 * size
    while len(hashes) > most:
        few = np.unique(np.partition(hashes, most)[:most])
        if len(few) >= size:  # enough distinct ones
            return few[:size]
        most *= 4
    return np.unique(hashes)[:size]


def merged(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Fingerprint of the union."""
    return np.union1d(a, b)[:size]


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimate of the shared part of all shingles of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merged(a, b, size)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, size: int = SIZE) -> float:
    """Estimate of the number of distinct shingles, exact where there are fewer than ``size``."""
    return float(len(a)) if len(a) < size else (size - 1) / (float(a[-1]) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimate of the part of a's shingles that b has too."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, size) * distinct(merged(a, b, size), size)
    return min(1.0, shared / distinct(a, size))


def text_form(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_text(form: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(form), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, fingerprint and n_shingles (estimated) of every row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sketches(batch.column(1), size)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fingerprint": pa.array([text_form(x) for x in found], pa.string()), "n_shingles": pa.array([distinct(x, size) for x in found], pa.float64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, fingerprint string, n_shingles double")


def merge_fingerprints(prints: DataFrame, *keys: str, size: int = SIZE) -> DataFrame:
    """One fingerprint for each key: the smallest distinct hashes of its rows' fingerprints.

    Tasks merge what they hold of a key, then SALTS parts of every key are merged, then the parts; so no task sees more of
    a key than ``size`` hashes for each task before it. A null fingerprint is empty.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [[] for _ in keys]
            made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays([*made, pa.array([text_form(x) for x in held.values()], pa.string())], names=[*names, "fingerprint"])

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.column(i).type for i in range(len(keys))]
            for *key, form in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own, known = from_text(form), held.get(tuple(key))
                held[tuple(key)] = own if known is None else merged(known, own, size)
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    names = [f"k{i}" for i in range(len(keys))]
    now = prints.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.coalesce("fingerprint", F.lit("")).alias("fingerprint"))
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = now.mapInArrow(merge, now.schema)
    now = now.repartition(tasks, *names, F.pmod(F.xxhash64("fingerprint"), F.lit(SALTS))).mapInArrow(merge, now.schema)

    def last(table: pa.Table) -> pa.Table:
        out = np.zeros(0, np.uint64)
        for form in table.column("fingerprint").to_pylist():
            out = merged(out, from_text(form), size)
        return table.slice(0, 1).set_column(len(names), "fingerprint", pa.array([text_form(out)], pa.string()))

    return now.groupBy(*names).applyInArrow(last, now.schema).toDF(*keys, "fingerprint")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, copy: rows sorted by doc_id within buckets, and behind each bucket's rows the first row of
    the next bucket (of the first one behind the last), flagged as a copy.

    Buckets are ranges of ids cut at quantiles; the driver sees one id for each bucket.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = 4 * tasks
    cuts = sorted({float(x) for x in rows.approxQuantile("doc_id", [i / wanted for i in range(1, wanted)], max(1e-4, 1 / (20 * wanted)))} if wanted > 1 else set()) or [0.0]  # a Bucketizer has two ranges at least
    edges = [-float("inf"), *cuts, float("inf")]
    ranged = Bucketizer(splits=edges, inputCol="place", outputCol="range", handleInvalid="keep").transform(rows.withColumn("place", F.col("doc_id").cast("double")))
    ranged = ranged.select("doc_id", "text", F.coalesce(F.col("range").cast("int"), F.lit(len(edges))).alias("bucket"))  # null ids last
    heads = ranged.groupBy("bucket").agg(F.min("doc_id").alias("head")).orderBy("bucket").collect()
    if not heads:
        return ranged.withColumn("copy", F.lit(False))
    before = [(h["bucket"], h["head"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)]
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("previous").alias("bucket"), F.lit(True).alias("copy"))
    known = ranged.join(F.broadcast(spark.createDataFrame(before, "bucket int, head bigint, previous int")), "bucket")
    dealt = known.select("doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(own, copy)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("doc_id", "text", "to.bucket", "to.copy").repartition(tasks, "bucket")
    return dealt.sortWithinPartitions("bucket", "copy", F.col("doc_id").asc_nulls_last(), "text")


def edited_fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Every row's fingerprint beside that of its edited text and its likeness to the next row's.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of the next text.
    """

    def pairs(rows: list[tuple], sketch: list[np.ndarray]) -> pa.RecordBatch | None:
        """rows: (doc_id, text, bucket, copy); a row and the one behind it in its bucket give a result."""
        at = [i for i in range(len(rows) - 1) if not rows[i][3] and rows[i][2] == rows[i + 1][2]]
        if not at:
            return None
        edited = [rows[i][1][: (n := len(rows[i][1])) - n // 2] + rows[i + 1][1][: n // 2] for i in at]
        plain = [x.encode() for x in edited]
        other = sketches(pa.array(plain, pa.large_binary()), size)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array([rows[i][0] for i in at], pa.int64()),
            "n_chars": pa.array([len(rows[i][1]) for i in at], pa.int64()),
            "edited_sha256": [hashlib.sha256(x).hexdigest() for x in plain],
            "fingerprint": [text_form(sketch[i]) for i in at],
            "edited_fingerprint": [text_form(x) for x in other],
            "near_edited": [resemblance(sketch[i], x, size) for i, x in zip(at, other, strict=True)],
            "near_next": [resemblance(sketch[i], sketch[i + 1], size) for i in at],
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        seen: list[np.ndarray] = []
        for batch in batches:
            column = w.binary(batch.column(1))
            for a, b in w.slices(batch.num_rows, w.raw(column)[1]):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [*last, *zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                sketch = [*seen, *sketches(part.column(1), size)]
                if (out := pairs(rows, sketch)) is not None:
                    yield out
                last, seen = rows[-1:], sketch[-1:]

    return in_order(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
