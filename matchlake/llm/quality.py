"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model on the shape of a text (shares of kinds of bytes, word lengths, repetition) gives each document's own
evidence; it is fitted on a bounded sample of labelled rows (TRAIN_ROWS). The evidence of all documents is then summed by
site (``source``) and by path (``source`` and ``lang``) with grouped aggregation. A site's posterior mean is shrunk toward
the global mean, a path's toward its site's; the strengths of both priors are moment estimates from the spread between
sites and between paths, so sparse sites count for little. A document's log-odds are its own plus what its path's
posterior says beyond the global mean.

Edge cases: a null text is empty and is judged by its shape like any other; null sources and languages count as empty
names; rows with null ids are scored and never learned from; without labels every document's evidence is 0.5; repeated
rows are scored alike; an empty table gives an empty result; columns named as the results are replaced by ``score`` and kept
by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm import words as w
from matchlake.llm.blocks import beside, staged

#: Labelled rows learned from at most, those of the smallest id hash.
TRAIN_ROWS = 30_000
#: Strengths of the priors, in documents, are kept between these.
WEAKEST, STRONGEST = 1.0, 1e6
#: Documents with this probability or more are kept.
KEEP = 0.5

_KINDS = np.zeros((256, 7), np.float32)
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = (_b < 128 and _c.islower(), _b < 128 and _c.isupper(), _b < 128 and _c.isdigit(), _c in ".,;:'\"?-()", _b < 128 and _c.isprintable() and not _c.isalnum() and _c not in ".,;:'\"?-() ", _c == "\n", _b >= 128)
SHAPE = 15


def shapes(column: pa.Array) -> np.ndarray:
    """SHAPE numbers for each text, all from the whole text."""
    column, out = w.binary(column), []
    for a, b in w.slices(len(column), w.raw(column)[1]):
        found = w.split(column.slice(a, b - a))
        n = found.texts
        size = np.maximum(1, np.diff(found.offsets)).astype(np.float64)
        sums = np.zeros((n, 7))
        for k in range(7):
            total = np.concatenate([[0], np.cumsum(_KINDS[found.data, k], dtype=np.float64)])
            sums[:, k] = total[found.offsets[1:]] - total[found.offsets[:-1]]
        share = sums / size[:, None]
        count = np.diff(found.first)
        many = np.maximum(1, count)
        length = np.concatenate([[0], np.cumsum(found.end - found.start)])
        mean = (length[found.first[1:]] - length[found.first[:-1]]) / many
        # distinct words and the commonest one's count
        owner, hashes = found.owner(), found.hashes()
        order = np.lexsort((hashes, owner))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        start = np.flatnonzero(new)
        times, whose = np.diff(np.append(start, len(order))), owner[order][start]
        distinct, top = np.bincount(whose, minlength=n), np.zeros(n)
        np.maximum.at(top, whose, times)
        marked = np.concatenate([[0], np.cumsum(_KINDS[found.data[found.end - 1], 4] > 0)]) if len(found) else np.zeros(1)
        ends = (marked[found.first[1:]] - marked[found.first[:-1]]) / many if len(found) else np.zeros(n)
        out.append(np.column_stack([share, np.log(np.maximum(share[:, [1, 2, 4]], 1e-4)), np.log1p(count), np.log1p(mean), np.log(many) - np.log(np.maximum(1, distinct)), np.log(np.maximum(1, top) / many), ends]))
    return np.concatenate([np.zeros((0, SHAPE)), *out])


class Logistic:
    """Ridge logistic model on standardised numbers."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-9) if len(x) else (np.zeros(SHAPE), np.ones(SHAPE))
        basis = self._basis(x)
        self.beta = np.zeros(basis.shape[1])
        if not len(y) or y.min() == y.max():
            return
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(basis @ self.beta, -30, 30)))
            hessian = basis.T @ (basis * (p * (1 - p))[:, None]) + np.eye(len(self.beta))
            step = np.linalg.solve(hessian, basis.T @ (y - p) - self.beta)
            self.beta = self.beta + step
            if abs(step).max() < 1e-8:
                break

    def _basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(x)), z, z * z])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._basis(x) @ self.beta, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Logistic:
    """The document model; the driver gets at most TRAIN_ROWS rows of numbers."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & learn)
    some = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(some), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"shape": pa.array(list(shapes(batch.column(0))), pa.list_(pa.float64())), "quality": batch.column(1)})

    found = rows.select("text", "quality").mapInArrow(run, "shape array<double>, quality int").toPandas()
    x = np.stack(found["shape"].to_list()) if len(found) else np.zeros((0, SHAPE))
    return Logistic(x, found["quality"].to_numpy(float))


def _strength(between: float | None, mean: float) -> float:
    """Prior documents that a variance between groups stands for."""
    if not between or between <= 0:
        return STRONGEST
    return float(np.clip(mean * (1 - mean) / between - 1, WEAKEST, STRONGEST))


def posteriors(evidence: DataFrame) -> DataFrame:
    """site, path, shift: what a path's posterior mean adds to the log-odds of its documents.

    evidence: site, path, p of every document. Moments: the weighted variance of group means less what sampling explains.
    """
    paths = staged(evidence.groupBy("site", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    sites = paths.groupBy("site").agg(F.sum("n").alias("site_n"), F.sum("s").alias("site_s"))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    if not total["n"]:
        return paths.select("site", "path", F.lit(0.0).alias("shift"))
    mean = min(1 - 1e-6, max(1e-6, total["s"] / total["n"]))
    within = max(0.0, total["q"] / total["n"] - mean * mean)
    spread = sites.agg((F.sum(F.col("site_n") * F.pow(F.col("site_s") / F.col("site_n") - mean, 2)) - within * F.count("*")) / F.sum("site_n")).first()[0]
    joined = paths.join(sites, "site")
    inner = joined.agg((F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("site_s") / F.col("site_n"), 2)) - within * F.count("*")) / F.sum("n")).first()[0]
    outer, inner = _strength(spread, mean), _strength(inner, mean)
    site = (F.col("site_s") + outer * mean) / (F.col("site_n") + outer)
    path = (F.col("s") + inner * site) / (F.col("n") + inner)
    bounded = F.least(F.greatest(path, F.lit(1e-6)), F.lit(1 - 1e-6))
    return joined.select("site", "path", (F.log(bounded / (1 - bounded)) - float(np.log(mean / (1 - mean)))).alias("shift"))


def rated(docs: DataFrame, labels: DataFrame, learn: Column, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of docs as c0, c1, ..., each document's own probability ``p`` and its ``final`` one.

    Every text is read once: the numbers that site and path need are staged beside the rows that they belong to.
    """
    model = fit(docs, labels, learn)
    place = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("source", "lang")]
    own = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(carry)], place[0].alias("site"), place[1].alias("path"), F.col("text").cast("string").alias("t"))
    kept = own.columns[:-1]
    text = carry.index("text") if "text" in carry else None
    found = beside(own, lambda column: model.probability(shapes(column)), "t" if text is None else f"k{text}", kept)
    found = staged(found.toDF(*[f"c{i}" for i in range(len(carry))], "site", "path", "own"))
    shift = posteriors(found.select("site", "path", F.col("own").alias("p")))
    joined = found.join(shift, ["site", "path"], "left")
    p = F.least(F.greatest(F.col("own"), F.lit(1e-9)), F.lit(1 - 1e-9))
    final = 1 / (1 + F.exp(-(F.log(p / (1 - p)) + F.coalesce("shift", F.lit(0.0)))))
    return joined.select(*[f"c{i}" for i in range(len(carry))], F.col("own").alias("p"), final.alias("final"))


def score(docs: DataFrame, labels: DataFrame, learn: Column, keep: float = KEEP, carry: list[str] | None = None) -> DataFrame:
    """The rows and columns (or those in ``carry``) of docs with ``evidence``, ``quality_score`` and ``quality_kept``."""
    names = [c for c in carry or docs.columns if c not in ("evidence", "quality_score", "quality_kept")]
    found = rated(docs, labels, learn, names)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("p").alias("evidence"), F.col("final").alias("quality_score"), (F.col("final") >= keep).alias("quality_kept"))


def accepted(docs: DataFrame, labels: DataFrame, learn: Column, keep: float = KEEP) -> DataFrame:
    """The rows that are kept, with the columns of docs as they are, whatever their names."""
    return rated(docs, labels, learn, docs.columns).filter(F.col("final") >= keep).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
