"""Split quality; all are minimised.  Input: rows (keys, side, class, weight); output: keys, score, left, right."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rng import u

MEASURES = ("info", "gini", "gini-info", "hellinger", "squared-chord", "jensen-difference", "bhattacharyya")


def _xlnx(x: Column) -> Column:
    return F.when(x > 0, x * F.log(x)).otherwise(0.0)


def _xlg(x: Column) -> Column:
    return _xlnx(x) / math.log(2)


def class_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """l and r: the weight of each class on each side."""
    on = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("weight"))), F.lit(0.0))
    return rows.groupBy(*keys, "class").agg(on("left").alias("l"), on("right").alias("r"))


def fold(f, zero: float = 0.0) -> Column:
    """The sum of f over the classes of a candidate: the structs (class, l, r) of the column c."""
    return F.aggregate("c", F.lit(zero), lambda s, e: s + f(e))


def by_candidate(counts: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each key with c, its classes, and the weights of both sides, wl and wr."""
    classes = F.array_sort(F.collect_list(F.struct("class", "l", "r"))).alias("c")  # a struct for each class
    return weighed(counts.groupBy(*keys).agg(classes) if keys else counts.agg(classes))


def weighed(rows: DataFrame) -> DataFrame:
    return rows.select(*rows.columns, fold(lambda e: e["l"]).alias("wl"), fold(lambda e: e["r"]).alias("wr"))


def _shares(rows: DataFrame) -> DataFrame:
    """With pa and qa: the sums over classes of the shares of a class that go left, and right."""
    of = lambda x: fold(lambda e: F.when(e["l"] + e["r"] > 0, e[x] / (e["l"] + e["r"])).otherwise(0.0))
    return rows.select(*rows.columns, of("l").alias("pa"), of("r").alias("qa"))


def score_of(measure: str, coin: Column | None = None) -> tuple[Column, Column, Column]:
    """score, left and right of a row of by_candidate(), for distances with _shares().

    One side empty: 1000 for the distances, as they need both.
    """
    wl, wr = F.col("wl"), F.col("wr")
    if measure == "gini-info":  # by coin
        both = zip(score_of("gini"), score_of("info"), strict=True)
        return tuple(F.when(coin <= 0.5, g).otherwise(i) for g, i in both)
    one_sided = (wl <= 0) | (wr <= 0)
    if measure == "info":
        left, right = _xlnx(wl) - fold(lambda e: _xlnx(e["l"])), _xlnx(wr) - fold(lambda e: _xlnx(e["r"]))
        return left + right, left, right
    if measure == "gini":
        square = lambda x, w: F.when(w > 0, fold(lambda e: e[x] * e[x]) / (w * w)).otherwise(0.0)
        left, right = square("l", wl), square("r", wr)
        return F.when(one_sided, left + right).otherwise(1 - (left + right)), left, right
    share = lambda e, x, total: F.when((e["l"] + e["r"] > 0) & (F.col(total) > 0), e[x] / (e["l"] + e["r"]) / F.col(total)).otherwise(0.0)
    p, q = lambda e: share(e, "l", "pa"), lambda e: share(e, "r", "qa")
    overlap = fold(lambda e: F.sqrt(p(e) * q(e)))
    forms = {
        "hellinger": lambda: 1 - F.sqrt(F.greatest(F.lit(0.0), 1 - overlap)),
        "squared-chord": lambda: overlap,
        "bhattacharyya": lambda: F.when(overlap > 0, 1 + F.log(overlap)).otherwise(1000.0),
        "jensen-difference": lambda: 1 - fold(lambda e: (_xlg(p(e)) + _xlg(q(e))) / 2 - _xlg((p(e) + q(e)) / 2)),
    }
    if measure not in forms:
        raise ValueError(f"unknown measure: {measure}")
    score = F.when(one_sided, 1000.0).otherwise(forms[measure]())
    return score, score, score


def chi_of() -> Column:
    """Chi-square of a row of by_candidate()."""
    all_ = F.col("wl") + F.col("wr")

    def cell(e, x, total):
        want = (e["l"] + e["r"]) * F.col(total) / all_
        return F.coalesce(F.try_divide((e[x] - want) ** 2, want), F.lit(0.0))

    return F.when(all_ > 0, fold(lambda e: cell(e, "l", "wl") + cell(e, "r", "wr"))).otherwise(0.0)


def scored(rows: DataFrame, keys: list[str], measure: str, seed=0, draws: list[Column] | None = None) -> DataFrame:
    """The rows of by_candidate() with score, left, right and chi2.  draws: by which a coin is drawn, the keys if not given."""
    rows = _shares(rows) if measure not in ("info", "gini", "gini-info") else rows
    score, left, right = score_of(measure, u(seed, "gini-info", *(draws or [F.col(k) for k in keys])))
    return rows.select(*rows.columns, score.alias("score"), left.alias("left"), right.alias("right"), chi_of().alias("chi2"))


def scores(counts: DataFrame, keys: list[str], measure: str = "info", seed=0) -> DataFrame:
    """counts: from class_counts()."""
    return scored(by_candidate(counts, keys), keys, measure, seed).select(*keys, "score", "left", "right")


def chi_square(counts: DataFrame, keys: list[str]) -> DataFrame:
    return by_candidate(counts, keys).select(*keys, chi_of().alias("chi2"))


def with_error(left: Column, right: Column) -> Column:
    """(score, left, right) of two sides with an error each: the lesser; a missing side has the error 1."""
    left, right = F.coalesce(left, F.lit(1.0)), F.coalesce(right, F.lit(1.0))
    return F.struct(F.least(left, right).alias("score"), left.alias("left"), right.alias("right"))


def purity(pos: Column, neg: Column) -> Column:
    return 1 - F.try_divide(pos, pos + neg)


def laplace(pos: Column, neg: Column, classes: int) -> Column:
    return 1 - (pos + 1) / (pos + neg + classes)


def m_estimate(pos: Column, neg: Column, m: float, prior: Column) -> Column:
    return 1 - (pos + m * prior) / (pos + neg + m)
