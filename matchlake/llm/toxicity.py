"""Toxic passages by maximum-scoring segment search over token log-odds.

Token weights are log-odds of the two classes under an informative Dirichlet prior, from document frequencies in a
bounded sample of labelled rows (TRAIN_ROWS); only significant tokens keep a weight, all others cost DRIFT. A linear-time
scan over each whole text finds every maximal-scoring passage. A passage's score is calibrated by its extreme-value
distribution in clean text, P(max >= S) = 1 - exp(-K n exp(-lambda S)), with lambda from the weights' rates in clean text
and K estimated from the highest passages of clean sample rows that gave no weights; what the significant passages of a text have
beyond chance is added up and turned into a probability by a logistic fit on sample rows that gave no weights.

Words are runs of letters (ASCII letters in lower case, and all bytes beyond ASCII). Each gives a token for itself and
one for each of its STEMS, so inflected and compounded forms of a learned word count too; the strongest weight holds. Edge cases: a null or empty text
has no passages and gets the lowest score; without labels every text gets the same score; rows with null ids are scored
and never learned from; repeated rows are scored alike; an empty table gives an empty result; columns named as the results
are replaced by ``score`` and kept by ``accepted``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.llm import words as w
from matchlake.llm.blocks import beside, staged

#: Labelled rows learned from at most, those of the smallest id hash.
TRAIN_ROWS = 30_000
#: Prior: PRIOR_SHARE pseudo-documents by background frequency and PRIOR_EACH for every token.
PRIOR_SHARE, PRIOR_EACH = 1000.0, 0.5
#: Least |z| of a weight, largest weight, and cost of a token without one.
SIGNIFICANT, LARGEST, DRIFT = 3.0, 6.0, 0.05
#: K of the extreme-value distribution before it is estimated, its bounds, and the largest chance of a passage that counts.
RATE, RATES, CHANCE = 0.1, (1e-4, 1.0), 0.05
#: Lengths in bytes of the stems that are tokens beside the whole word.
STEMS = (4, 5, 6, 8)

_U = np.uint64
_NO_LETTER = np.array([not (chr(b).isalpha() and b < 128 or b >= 128) for b in range(256)])


@dataclass
class Model:
    """Sorted token hashes with weights, lambda, K, and intercept and slope of the logistic fit."""

    tokens: np.ndarray
    weights: np.ndarray
    decay: float
    intercept: float = 0.0
    slope: float = 0.0
    rate: float = RATE

    def scores(self, forms: np.ndarray) -> np.ndarray:
        """The weight of each word: the strongest of its forms', or -DRIFT."""
        best = np.zeros(forms.shape[1])
        for hashes in forms if len(self.tokens) else ():
            at = np.minimum(np.searchsorted(self.tokens, hashes), len(self.tokens) - 1)
            weight = np.where(self.tokens[at] == hashes, self.weights[at], 0.0)
            best = np.where(np.abs(weight) > np.abs(best), weight, best)
        return np.where(best == 0, -DRIFT, best)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score), in one linear scan.

    A list of candidates is kept with the sums before and behind each and a link to the last one before that starts
    lower; a new positive score joins back to the candidate that starts lower, as long as that one ends lower than the
    new one. What a search passes by is behind the new candidate's link and is never passed again.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        begin, low, high, j = i, float(sums[i]), float(sums[i + 1]), len(found) - 1
        while j >= 0 and found[j][2] >= low:
            j = found[j][4]
        while j >= 0 and found[j][3] < high:
            begin, _, low, _, link = found[j]
            del found[j:]
            j = link
        found.append((begin, i + 1, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in found]


def passages(scores: np.ndarray, model: Model) -> list[tuple[int, int, float, float]]:
    """Significant passages of a text: begin, end, score and chance of one as high in clean text of this length."""
    out = []
    for a, b, score in maximal_segments(scores):
        chance = -np.expm1(-model.rate * len(scores) * np.exp(-model.decay * score))
        if chance <= CHANCE:
            out.append((a, b, score, float(chance)))
    return out


def _texts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Token hashes of slices of texts (a row for each kind of token, a column for each word) and where texts begin."""
    column = w.binary(column)
    for a, b in w.slices(len(column), w.raw(column)[1]):
        found = w.split(column.slice(a, b - a), _NO_LETTER)
        eights = found.eights(lower=True)
        yield np.stack([found.hashes(k, True, k or 0, eights) for k in (None, *STEMS)]), found.first


def evidence(column: pa.Array, model: Model) -> np.ndarray:
    """For each text what its significant passages have beyond chance, on a logarithmic scale."""

    def beyond(own: np.ndarray) -> float:
        return np.log1p(max(0.0, sum(model.decay * s - np.log(model.rate * len(own)) for _, _, s, _ in passages(own, model))))

    return _each(column, model, beyond)


def exponential(column: pa.Array, model: Model) -> np.ndarray:
    """For each text its length times exp(-lambda highest score): exponential with rate K where the text is clean."""
    return _each(column, model, lambda own: len(own) * np.exp(-model.decay * max((s for _, _, s in maximal_segments(own)), default=0.0)), all_texts=True)


def _each(column: pa.Array, model: Model, value, all_texts: bool = False) -> np.ndarray:
    """``value`` of each text's word scores; 0 for texts without a positive one, unless all are asked for."""
    out = []
    for forms, first in _texts(column):
        scores = model.scores(forms)
        positive = np.concatenate([[0], np.cumsum(scores > 0)])
        values = np.zeros(len(first) - 1)
        some = np.arange(len(values)) if all_texts else np.flatnonzero(positive[first[1:]] > positive[first[:-1]])
        for i in some.tolist():
            values[i] = value(scores[first[i] : first[i + 1]])
        out.append(values)
    return np.concatenate([np.zeros(0), *out])


def _probability(value: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-(model.intercept + model.slope * value)))


def sample(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """text, toxic, fold of at most TRAIN_ROWS labelled rows for which ``learn`` holds; the ids are broadcast (bounded).

    Copies of one text count once, so that a group of copies doesn't make its words significant.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn)
    some = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    distinct = rows.join(F.broadcast(some), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    return distinct.select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(5)).cast("int").alias("fold"))


def learn_weights(rows: DataFrame) -> Model:
    """Weights of the significant tokens of a sample (text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, at = batch.column(1).to_numpy(), 0
            for forms, first in _texts(batch.column(0)):
                kind = toxic[at : at + len(first) - 1]
                at += len(first) - 1
                # a text counts a token once
                hashes, owner = forms.ravel(), np.tile(np.repeat(np.arange(len(first) - 1), np.diff(first)), len(forms))
                order = np.lexsort((owner, hashes))
                new = np.ones(len(order), bool)
                new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
                token, bad = hashes[order][new], kind[owner[order][new]]
                start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
                if len(token):
                    yield pa.RecordBatch.from_pydict({"token": token[start].view(np.int64), "bad": np.add.reduceat(bad, start).astype(np.int64), "all": np.diff(np.append(start, len(token)))})

    tokens = rows.select("text", "toxic").mapInArrow(count, "token bigint, bad bigint, all bigint").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("all").alias("n"))
    total = tokens.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    if not total["n"] or not total["bad"] or total["bad"] == total["n"]:
        return Model(np.zeros(0, _U), np.zeros(0), 1.0)
    bad_all, good_all = float(total["bad"]), float(total["n"] - total["bad"])
    prior = F.lit(PRIOR_EACH) + F.lit(PRIOR_SHARE) * F.col("n") / F.lit(float(total["n"]))
    bad, good = F.col("bad") + prior, F.col("n") - F.col("bad") + prior
    odds = F.log(bad / (F.lit(bad_all + PRIOR_SHARE) - bad)) - F.log(good / (F.lit(good_all + PRIOR_SHARE) - good))
    scored = tokens.select("token", (F.col("n") - F.col("bad")).alias("good"), odds.alias("weight"), (odds / F.sqrt(1 / bad + 1 / good)).alias("z"))
    kept = scored.filter(F.abs("z") >= SIGNIFICANT).toPandas()  # of a bounded sample's tokens
    order = np.argsort(kept["token"].to_numpy().view(_U))
    weights = np.clip(kept["weight"].to_numpy()[order], -LARGEST, LARGEST)
    rates = (kept["good"].to_numpy()[order] + 0.01) / good_all
    return Model(kept["token"].to_numpy().view(_U)[order], weights, decay(weights, rates))


def decay(weights: np.ndarray, rates: np.ndarray) -> float:
    """The lambda at which the expected exp(lambda score) of a clean token is 1."""
    rest = max(0.0, 1 - rates.sum())
    if not (weights > 0).any():
        return 1.0
    low, high = 1e-6, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if (rates * np.exp(middle * weights)).sum() + rest * np.exp(-DRIFT * middle) < 1 else (low, middle)
    return low


def calibrate(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic fit of labels on evidence, with one pseudo-row of each class at either end and a slope of 0 at least."""
    top = max(1.0, value.max(initial=0.0))
    x, y = np.concatenate([value, [0.0, top]]), np.concatenate([label, [0.0, 1.0]])
    basis, beta = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-basis @ beta))
        hessian = basis.T @ (basis * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, basis.T @ (y - p) - 1e-3 * beta)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """Weights from four fifths of the sample, K and the logistic fit from the rest; the driver gets TRAIN_ROWS numbers at most."""
    rows = sample(docs, labels, learn)
    model = learn_weights(rows.filter("fold > 0"))
    rest = staged(rows.filter("fold = 0").select("text", "toxic"))
    clean = beside(rest.filter("toxic = 0"), partial(exponential, model=model), keep=["toxic"]).filter("value > 0")
    many, total = clean.agg(F.count("*"), F.sum("value")).first()
    if many:
        model.rate = float(np.clip(many / total, *RATES))
    found = beside(rest, partial(evidence, model=model), keep=["toxic"]).toPandas()
    model.intercept, model.slope = calibrate(found["value"].to_numpy(float), found["c0"].to_numpy(float))
    return model


def judged(docs: DataFrame, labels: DataFrame, learn: Column, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of docs as c0, c1, ..., and ``value``, the probability of each."""
    model = fit(docs, labels, learn)
    return beside(docs, lambda column: _probability(evidence(column, model), model), keep=carry)


def score(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7, carry: list[str] | None = None) -> DataFrame:
    """The rows and columns (or those in ``carry``) of docs with ``score`` and ``predicted`` (1 from the threshold on).

    Columns of these names are replaced. ``learn`` tells by doc_id which labels may be learned from.
    """
    names = [c for c in carry or docs.columns if c not in ("score", "predicted")]
    found = judged(docs, labels, learn, names)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("value").alias("score"), (F.col("value") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.7) -> DataFrame:
    """The rows below the threshold, with the columns of docs as they are, whatever their names."""
    return judged(docs, labels, learn, docs.columns).filter(F.col("value") < threshold).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def find_passages(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, first_token, n_tokens, score, chance of every significant passage of every row."""
    model = fit(docs, labels, learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            at, ids = 0, batch.column(0).to_pylist()
            for forms, first in _texts(batch.column(1)):
                scores = model.scores(forms)
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    out += [(ids[at], x, y - x, s, p) for x, y, s, p in passages(scores[a:b], model)]
                    at += 1
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "first_token", "n_tokens", "score", "chance"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, first_token bigint, n_tokens bigint, score double, chance double")
