"""Splitting nodes: sides of rows, missing values, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from copse.functions.rng import running, u

LEFT, RIGHT, MISSING = "left", "right", "?"


def numeric_side(value: Column, threshold: Column) -> Column:
    return F.when(value.isNull(), MISSING).when(value >= threshold, LEFT).otherwise(RIGHT)


def categoric_side(value: Column, split: Column) -> Column:
    """An unknown category isn't equal and goes right."""
    return F.when(value.isNull(), MISSING).when(value == split, LEFT).otherwise(RIGHT)


def combined_side(a: Column, b: Column, coin: Column) -> Column:
    """Two sides in one: the known one, the common one, or by coin."""
    return F.when(a == b, a).when(a == MISSING, b).when(b == MISSING, a).when(coin <= 0.5, LEFT).otherwise(RIGHT)


def rule_side(sides: list[Column] | Column) -> Column:
    """All left: left; else as the first that is not left."""
    first = F.filter(F.array(*sides) if isinstance(sides, list) else sides, lambda s: s != LEFT)
    return F.coalesce(F.try_element_at(first, F.lit(1)), F.lit(LEFT))


def rule_shares(sides: list[Column]) -> dict[str, Column]:
    """The shares of a rule's conditions that hold, fail and miss their value."""
    n = float(len(sides))
    share = lambda s: sum(((x == s).cast("int") for x in sides), F.lit(0)) / n
    return {"left": share(LEFT), "right": share(RIGHT), "missing": share(MISSING)}


def centroid_side(vector: Column, centroid: Column, threshold: Column) -> Column:
    """By the radial closeness exp(-distance) of an array to a centroid."""
    square = F.aggregate(F.zip_with(vector, centroid, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.when(vector.isNull() | centroid.isNull(), MISSING).when(F.exp(-F.sqrt(square)) >= threshold, LEFT).otherwise(RIGHT)


def left_share(strategy: str, left: Column, right: Column) -> Column:
    """The share of the rows with a missing value that goes left; by expectation where a draw decides.  A strategy may be a function of both weights."""
    if callable(strategy):
        return strategy(left, right)
    if strategy == "weighted":
        return F.when((left > 0) & (left / (left + right) >= 0.5), 1.0).otherwise(0.0)
    if strategy in ("random", "partition"):
        return F.lit(0.5)
    if strategy in ("randomw", "wpartition"):
        return (left + 1) / (left + right + 2)
    return F.lit(1.0 if strategy == LEFT else 0.0)


def missing_side(strategy: str, left: Column, right: Column, draw: Column) -> Column:
    """The side of a row with a missing value; left, right: weights of the known ones; null: it goes."""
    if callable(strategy):
        return F.when(draw <= strategy(left, right), LEFT).otherwise(RIGHT)
    if strategy == "ignore":
        return F.lit(None).cast("string")
    if strategy not in ("weighted", "random", "partition", "randomw", "wpartition", LEFT, RIGHT):
        raise ValueError(f"unknown strategy for missing values: {strategy}")
    share = left_share(strategy, left, right)
    decided = share >= 1.0 if strategy in ("weighted", LEFT, RIGHT) else draw <= share
    return F.when(decided, LEFT).otherwise(RIGHT)


def placed(rows: DataFrame, strategy: str, left: Column, right: Column, draw: Column) -> DataFrame:
    """Rows with side left, right or ?: those with ? get a side, two with parts of the weight, or go."""
    if strategy in ("partition", "wpartition"):
        share = left_share(strategy, left, right)
        parts = F.array(F.struct(F.lit(LEFT).alias("side"), share.alias("share")), F.struct(F.lit(RIGHT).alias("side"), (1 - share).alias("share")))
        whole = F.array(F.struct(F.col("side"), F.lit(1.0).alias("share")))
        rows = rows.withColumn("_s", F.explode(F.when(F.col("side") == MISSING, parts).otherwise(whole)))
        return rows.withColumns({"side": F.col("_s.side"), "weight": F.col("weight") * F.col("_s.share")}).drop("_s")
    side = F.when(F.col("side") == MISSING, missing_side(strategy, left, right, draw)).otherwise(F.col("side"))
    return rows.withColumn("side", side).filter("side IS NOT NULL")


def place_missing(rows: DataFrame, strategy: str, keys: list[str], seed) -> DataFrame:
    """placed() by the weights of the known rows of each key."""
    known = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("weight"))), F.lit(0.0))
    totals = rows.groupBy(*keys).agg(known(LEFT).alias("_l"), known(RIGHT).alias("_r")) if keys else rows.agg(known(LEFT).alias("_l"), known(RIGHT).alias("_r"))
    rows = rows.join(totals, keys) if keys else rows.crossJoin(F.broadcast(totals))  # one row
    draw = u(seed, "missing", *[F.col(k) for k in keys], F.col("id"))
    return placed(rows, strategy, F.col("_l"), F.col("_r"), draw).drop("_l", "_r")


def exact_thresholds(rows: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """For each key the threshold (midway between neighbours) with the least weighted entropy, and that score.

    Rows become weights of (key, value, class).  What a class adds to the entropy of either side changes only
    at its own values, so running sums of these changes, in ranges of the order, give the score of every cut.
    """
    per = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value, "class").agg(F.sum("weight").alias("_w"))
    per = running(per, [*keys, "class"], value, {"_upto": "_w"})
    per = per.join(per.groupBy(*keys, "class").agg(F.sum("_w").alias("_all")), [*keys, "class"])
    xlnx = lambda x: F.when(x > 1e-9, x * F.log(x)).otherwise(0.0)
    rest = F.col("_all") - F.col("_upto")
    steps = per.groupBy(*keys, value).agg(
        F.sum("_w").alias("_w"),
        F.sum(xlnx(F.col("_upto")) - xlnx(F.col("_upto") - F.col("_w"))).alias("_low"),
        F.sum(xlnx(rest) - xlnx(rest + F.col("_w"))).alias("_high"),
    )
    steps = running(steps, keys, value, {"_n": "_w", "_a": "_low", "_b": "_high"}, following="_next")
    whole = per.groupBy(*keys, "class").agg(F.sum("_w").alias("_all"))
    whole = (whole.groupBy(*keys) if keys else whole).agg(F.sum("_all").alias("_total"), F.sum(xlnx(F.col("_all"))).alias("_classes"))
    steps = steps.join(whole, keys) if keys else steps.crossJoin(F.broadcast(whole))  # one row
    score = xlnx(F.col("_n")) - F.col("_a") + xlnx(F.col("_total") - F.col("_n")) - (F.col("_classes") + F.col("_b"))
    cut = ((F.col(value) + F.col("_next")) / 2).alias("threshold")
    best = F.min(F.when(F.col("_next").isNotNull(), F.struct(F.round(score, 6).alias("score"), cut))).alias("b")
    return (steps.groupBy(*keys) if keys else steps).agg(best).filter("b IS NOT NULL").select(*keys, "b.threshold", "b.score")
