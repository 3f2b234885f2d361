"""Column functions of the match domain; all but a bisection stay inside Catalyst."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake.functions.names import name_key

#: Rating curves (start, logistic scale) and the numbers of the two tours' default curves.
START, SCALE = 1500.0, 400.0
K, K_OFFSET, K_SHAPE = 250.0, 5.0, 0.4
SURFACE_K = 200.0
BLEND, MOV, MOV_CAP = 0.5, 0.30, 1.60


def surname_key(name: Column) -> Column:
    """"surname initial", from "First Last" or "Last F."."""
    parts = F.split(name_key(name), " ")
    last, first = F.element_at(parts, -1), F.element_at(parts, 1)
    return F.when(F.length(last) == 1, F.concat_ws(" ", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " "), last)).otherwise(F.concat_ws(" ", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), " ")).otherwise(last), F.substring(first, 1, 1)))


def event_key(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def event_letters(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(name), "[^a-z]", ""), 1, 18)


def parse_date(text: Column) -> Column:
    """yyyyMMdd, yyyy/M/d or yyyy-M-d; null for anything else."""
    dashed = F.regexp_replace(text, "/", "-")
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(dashed, F.lit("y-M-d"))).cast("date")


def _sets(score: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(score, F.lit("")), r"\[[^\]]*\]", ""), F.lit(r"\b(\d+-\d+)"), 1)


def _games(score: Column, side: int) -> Column:
    each = F.transform(_sets(score), lambda s: F.split(s, "-")[side].cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def parsed_score(score: Column) -> Column:
    """Struct of winner_games, loser_games, sets, completed, walkover.

    A missing score and W/O, WO, DEF or ABD alone are walkovers; RET is neither completed nor a walkover; bracketed
    super tie-breaks don't count as sets; without sets nothing is completed.
    """
    upper = F.upper(F.trim(F.coalesce(score, F.lit(""))))
    walkover = (upper == "") | upper.contains("W/O") | upper.isin("DEF", "ABD", "WO")
    sets = F.when(walkover, F.lit(0)).otherwise(F.size(_sets(score)))
    stopped = upper.rlike(r"\b(RET|DEF|ABD)\b")
    return F.struct(
        F.when(walkover, F.lit(0)).otherwise(_games(score, 0)).alias("winner_games"),
        F.when(walkover, F.lit(0)).otherwise(_games(score, 1)).alias("loser_games"),
        sets.alias("sets"),
        (~walkover & ~stopped & (sets > 0)).alias("completed"),
        walkover.alias("walkover"),
    )


def score_key(score: Column) -> Column:
    """Games of the sets only, without tie-break digits, markers and empty sets."""
    return F.array_join(F.filter(_sets(score), lambda s: s != "0-0"), ",")


def expected_score(a: Column, b: Column, stretch: float = 1.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -(a - b) * stretch / SCALE))


def dynamic_k(n: Column, k: float = K, offset: float = K_OFFSET, shape: float = K_SHAPE) -> Column:
    return F.lit(k) / F.pow(n + offset, F.lit(shape))


def margin(games: Column) -> Column:
    return F.least(1 + MOV * F.log1p(F.abs(games)), F.lit(MOV_CAP))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def hold_probability(p: Column) -> Column:
    """Chance of winning a service game when each point is won with chance p."""
    q = 1 - p
    return F.pow(p, 4) * (1 + 4 * q + 10 * q * q) + 20 * F.pow(p * q, 3) * p * p / (1 - 2 * p * q)


def match_from_set(s: Column, best_of: Column) -> Column:
    three = s * s * (3 - 2 * s)
    five = F.pow(s, 3) * (10 - 15 * s + 6 * s * s)
    return F.when(best_of == 5, five).otherwise(three)


def set_from_match(p: Column, best_of: int, steps: int = 60) -> Column:
    """The set chance that gives a match chance, by bisection of a batch at once."""
    @F.pandas_udf("double")
    def halved(p: pd.Series) -> pd.Series:
        p, low, high = p.to_numpy(float), np.zeros(len(p)), np.ones(len(p))
        for _ in range(steps):
            s = (low + high) / 2
            under = (s**3 * (10 - 15 * s + 6 * s * s) if best_of == 5 else s * s * (3 - 2 * s)) < p
            low, high = np.where(under, s, low), np.where(under, high, s)
        return pd.Series((low + high) / 2)

    return halved(p.cast("double"))


def entropy(parts: list[Column]) -> Column:
    """Shannon entropy of parts, over its maximum; null without any."""
    total = sum(parts[1:], parts[0])
    terms = [F.when(p > 0, -(p / total) * F.log(p / total)).otherwise(0.0) for p in parts]
    return F.when(total > 0, sum(terms[1:], terms[0]) / F.log(F.lit(float(len(parts)))))


def devig(a: Column, b: Column) -> Column:
    return a / (a + b)


def market_probability(odds_w: Column, odds_l: Column) -> Column:
    return (1 / odds_w) / (1 / odds_w + 1 / odds_l)


def draw_size(players: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(players, F.lit(1)).cast("double")))).cast("int")
