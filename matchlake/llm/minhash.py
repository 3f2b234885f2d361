"""Near-duplicate documents by min-max hashing, banding and exact confirmation.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum: half the hash
evaluations of plain MinHash for as many values. Bands of ROWS values each propose links; what a band proposes is
confirmed on the full shingle sets. At similarity 0.8 a link escapes all bands with probability (1 - 0.8**4)**32 = 5e-8.

Texts with equal shingle sets are one class from the start. Within a band's bucket no pairs are listed: every class is
first compared only with the smallest class of each of its buckets, as far as the two are not connected yet. What is left
lies in buckets that still hold several components: there one task for each bucket (or each two blocks of a large one)
gets the full sets, counts shared shingles across components exactly, by matrix products, and gives back only links that
join components. So a large group of copies costs a few comparisons a member and a row for each join, while no link
between different components is lost.

Words are runs of bytes other than ASCII white space, A-Z in lower case. Edge cases: a null text or one without words has
an empty set and is its own component; fewer words than a shingle are one shingle; repeated rows are one class, and all
rows that carry the smallest id of a component are kept (of equal rows, ``keep_one`` keeps any); a null id never names a component unless all ids in it are null;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm import words as w
from matchlake.llm.blocks import groups, narrow_batches, staged
from matchlake.operators.graph import smallest_member

#: Bands and values in each; half as many permutations as values.
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS // 2
#: Shingles and classes of a bucket that meet in one task, with as many others; shingles in one matrix product.
TOGETHER, CLASSES, WIDE = 500_000, 2000, 1024
#: Pairs of one class that share a copy of its text.
CROWD = 500

_U = np.uint64
_FACTORS = w.mix(np.arange(1, PERMUTATIONS + 1, dtype=_U)) | _U(1)
_SHIFTS = w.mix(np.arange(1, PERMUTATIONS + 1, dtype=_U) + _U(1 << 32))
_SIGNED = "doc_id bigint, row binary, n_shingles bigint, class binary, bands array<bigint>"


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the texts: their distinct shingle hashes in order, text after text, and where each text's begin."""
    column = w.binary(column)
    for a, b in w.slices(len(column), w.raw(column)[1]):
        found = w.split(column.slice(a, b - a))
        hashes = found.hashes(lower=True)
        every = w.runs(hashes, shingle)
        sets = []
        for i, j in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            if j - i >= shingle:
                sets.append(np.unique(every[i : j - shingle + 1]))
            else:
                sets.append(w.spans(hashes, np.array([i]), np.array([j])) if j > i else every[:0])
        yield np.concatenate([np.zeros(0, _U), *sets]), np.cumsum([0, *map(len, sets)])


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima and maxima of every permutation for each (not empty) set, as rows of 32-bit values."""
    out = np.empty((len(first) - 1, 2 * PERMUTATIONS), np.uint32)
    for i, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS, strict=True)):
        permuted = ((values * factor + shift) >> _U(32)).astype(np.uint32)
        out[:, 2 * i] = np.minimum.reduceat(permuted, first[:-1])
        out[:, 2 * i + 1] = np.maximum.reduceat(permuted, first[:-1])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    values = signature.reshape(len(signature), BANDS, ROWS).astype(_U)
    key = np.broadcast_to(np.arange(BANDS, dtype=_U), values.shape[:2])
    for i in range(ROWS):
        key = w.mix(key * _U(0x9E3779B97F4A7C15) + values[:, :, i])
    return key.view(np.int64)


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row, n_shingles, class (hash of the whole set) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for values, first in shingle_sets(batch.column(2), shingle):
                sizes = np.diff(first)
                some = np.flatnonzero(sizes)
                classes = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                bands: list = [None] * len(sizes)
                if len(some):
                    signature = signatures(values, np.append(first[:-1][some], len(values)))
                    for i, keys in zip(some.tolist(), band_keys(signature).tolist(), strict=True):
                        bands[i] = keys
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, len(sizes)), "row": batch.column(1).slice(at, len(sizes)), "n_shingles": pa.array(sizes, pa.int64()), "class": pa.array(classes, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))})
                at += len(sizes)

    return docs.mapInArrow(run, _SIGNED)


def components(edges: DataFrame) -> DataFrame:
    """a, root: the smallest member of each vertex's component, for edges (a, b) of any order."""
    return smallest_member(edges, "a", "b").withColumnRenamed("vertex", "a")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough.

    texts: class and text of one row of each class. The text of a class with many pairs is copied once for each
    CROWD of them, so that they are spread over tasks.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = (w.binary(batch.column(c)) for c in ("text_a", "text_b"))
            size = np.diff(w.raw(left)[1]) + np.diff(w.raw(right)[1])
            bounds = np.concatenate([[0], np.cumsum(size)])
            for i, j in w.slices(batch.num_rows, bounds):
                sets = []
                for side in (left, right):
                    each = []
                    for values, first in shingle_sets(side.slice(i, j - i), shingle):
                        each += [values[x:y] for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                    sets.append(each)
                for x, y in zip(*sets, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    crowd = pairs.groupBy("b").agg(F.expr(f"count(*) div {CROWD}").cast("int").alias("copies"))
    dealt = pairs.join(crowd, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies") + 1).cast("int"))
    copied = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")).join(crowd, "b").withColumn("copy", F.explode(F.sequence(F.lit(0), "copies")))
    right = dealt.join(copied.drop("copies"), ["b", "copy"]).select("a", "b", "text_b")
    whole = right.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    return whole.select("a", "b", "text_a", "text_b").mapInArrow(check, "a binary, b binary")


def joining_links(mixed: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) within buckets that join different components, enough to join all that are linked.

    mixed: key, size and classes (shingles and number of all classes in the bucket), a, n, root. Large buckets are dealt to
    blocks of TOGETHER shingles and CLASSES classes at most (or one class), and every two blocks meet in one task.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [values[x:y].tobytes() for values, first in shingle_sets(batch.column(1), shingle) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"a": batch.column(0), "shingles": pa.array(own, pa.binary())})

    def across(table: pa.Table) -> pa.Table:
        block, low, high = table.column("block").to_numpy(), table.column("low")[0].as_py(), table.column("high")[0].as_py()
        names, count = table.column("a").to_pylist(), table.column("n").to_numpy()
        root = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
        most = np.bincount(root).argmax()
        asked = np.flatnonzero((root != most) | (block != low)) if low != high else np.flatnonzero(root != most)
        each = [np.frombuffer(x, _U) for x in table.column("shingles").to_pylist()]
        owner = np.repeat(np.arange(len(each)), [len(x) for x in each])
        order, start = groups(np.concatenate(each))
        size = np.diff(np.append(start, len(order)))
        column = np.repeat(np.cumsum(size > 1) - 1, size)[np.repeat(size > 1, size)]  # of shingles that occur twice
        owner = owner[order][np.repeat(size > 1, size)]
        shared = np.zeros((len(asked), len(each)), np.float32)
        for at in range(0, int(column.max(initial=-1)) + 1, WIDE):
            a, b = np.searchsorted(column, [at, at + WIDE])
            matrix = np.zeros((len(each), WIDE), np.float32)
            matrix[owner[a:b], column[a:b] - at] = 1
            shared += matrix[asked] @ matrix.T
        parent = list(range(int(root.max()) + 1))

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        found = []
        for counted, i in zip(shared, asked.tolist(), strict=True):
            row = counted.astype(np.int64)
            for j in np.flatnonzero(100 * row >= percent * (count[i] + count - row)).tolist():
                x, y = top(root[i]), top(root[j])
                if x != y:
                    parent[x] = y
                    found.append((max(names[i], names[j]), min(names[i], names[j])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([x for _, x in found], pa.binary())})

    wanted = texts.withColumnRenamed("class", "a").join(mixed.select("a").distinct(), "a", "left_semi").select("a", "text")
    own = wanted.mapInArrow(sets, "a binary, shingles binary")
    blocks = F.expr(f"greatest((size - 1) div {TOGETHER}, (classes - 1) div {CLASSES}) + 1").cast("int")
    dealt = mixed.withColumn("block", F.pmod(F.xxhash64("a"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", "a", "n", "root", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    return dealt.join(own, "a").groupBy("key", "low", "high").applyInArrow(across, "a binary, b binary").distinct()


def same_text() -> F.Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("binary"), F.unhex(F.lit("")))))


def members(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, row (128 bits of the text), n_shingles, root (null for empty sets) and component_id of every row."""
    narrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), same_text().alias("row"), F.col("text").cast("binary").alias("text"))
    each = staged(signed(rows, shingle))
    some = each.filter(F.col("n_shingles") > 0)
    classes = staged(some.groupBy("class").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")))
    member = classes.select(F.col("class").alias("a"), "n", F.explode("bands").alias("key"))
    buckets = member.groupBy("key").agg(F.min("a").alias("centre"), F.count("*").alias("size")).filter(F.col("size") > 1)
    inside = staged(member.join(buckets, "key").select("key", "a", "n", "centre"))
    sizes = classes.select(F.col("class").alias("b"), F.col("n").alias("m"))
    star = inside.filter("a <> centre").groupBy("a", F.col("centre").alias("b")).agg(F.max("n").alias("n")).join(sizes, "b")
    star = star.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("a", "b")
    texts = representatives(rows, classes, inside)
    # every class with its smallest centre, then with the other centres that it isn't connected to yet
    nearest = staged(star.groupBy("a").agg(F.min("b").alias("b")))
    links = staged(confirmed(nearest, texts, shingle, percent))
    rest = staged(apart(star.join(nearest, ["a", "b"], "left_anti"), components(links)))
    links = staged(links.unionByName(confirmed(rest, texts, shingle, percent)))
    links = staged(links.unionByName(joining_links(open_buckets(inside, components(links)), texts, shingle, percent)))
    roots = components(links)
    named = classes.join(roots.withColumnRenamed("a", "class"), "class", "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    result = each.select("doc_id", "row", "n_shingles", "class").join(named.join(smallest, "root"), "class", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select("doc_id", "row", "n_shingles", "root", component.alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    found = members(docs, shingle, percent).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component (of the smallest id, then text; of rows equal in both any), with all columns; rows
    without words all stay."""
    found = members(docs, shingle, percent)
    first = found.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    first = first.select(F.coalesce("first.doc_id", F.lit(0)).alias("id"), F.col("first.doc_id").isNull().alias("no_id"), "first.row")
    id, none = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").cast("long").isNull()
    rows = docs.select(id.alias("id"), none.alias("no_id"), same_text().alias("row"), F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("words"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("own"))
    some = rows.filter("words").join(first, ["id", "no_id", "row"], "left_semi").dropDuplicates(["id", "no_id", "row"])
    kept = some.select("own").unionByName(rows.filter("not words").select("own"))
    return kept.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def open_buckets(inside: DataFrame, roots: DataFrame) -> DataFrame:
    """key, size, classes, a, n, root of the buckets that hold several components."""
    placed = inside.join(roots, "a", "left").select("key", "a", "n", F.coalesce("root", "a").alias("root"))
    several = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.sum("n").alias("size"), F.count("*").alias("classes")).filter("lo <> hi").select("key", "size", "classes")
    return staged(placed.join(several, "key"))


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) that lie in different components."""
    found = pairs.join(roots.withColumnRenamed("root", "root_a"), "a", "left").join(roots.select(F.col("a").alias("b"), F.col("root").alias("root_b")), "b", "left")
    return found.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def representatives(rows: DataFrame, classes: DataFrame, inside: DataFrame) -> DataFrame:
    """class and text of one row of every class that shares a bucket."""
    shared = inside.select(F.col("a").alias("class")).distinct()
    wanted = classes.join(shared, "class", "left_semi").select("class", "row")
    return staged(rows.select("row", "text").join(wanted, "row").groupBy("class").agg(F.max("text").alias("text")))
