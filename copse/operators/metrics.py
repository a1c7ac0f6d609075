"""Evaluation measures over votes (id, actual, tree, pred) or probabilities (id, actual, class, prob)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from copse.functions.rng import running


def probabilities(votes: DataFrame, trees: int) -> DataFrame:
    """The share of the configured trees that votes for each class; unvoted classes are absent."""
    return probabilities_of(votes.select("id", "actual", F.col("pred").alias("class"), F.lit(1).alias("n")), trees)


def probabilities_of(counts: DataFrame, trees: int) -> DataFrame:
    """probabilities() of rows that stand for n votes for a class."""
    per = counts.groupBy("id", "actual", "class").agg((F.sum("n") / F.lit(float(trees))).alias("prob"))
    order = Window.partitionBy("id").orderBy(F.desc("prob"), "class")
    return per.withColumn("rank", F.row_number().over(order).cast("bigint"))


def predicted(probs: DataFrame) -> DataFrame:
    return probs.filter("rank = 1").select("id", "actual", F.col("class").alias("pred"), "prob")


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg(F.when(F.col("pred") == F.col("actual"), 1.0).otherwise(0.0)).alias("accuracy"))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    return pred.groupBy("actual", "pred").agg(F.count(F.lit(1)).alias("n"))


def precision_recall(pred: DataFrame) -> DataFrame:
    """class, precision, recall and f_measure by their usual definitions; null where undefined."""
    actual = pred.groupBy(F.col("actual").alias("class")).agg(F.count(F.lit(1)).alias("n_actual"))
    said = pred.groupBy(F.col("pred").alias("class")).agg(F.count(F.lit(1)).alias("n_pred"), F.sum(F.when(F.col("pred") == F.col("actual"), 1).otherwise(0)).alias("tp"))
    rows = actual.join(said, "class", "full").na.fill(0, ["n_actual", "n_pred", "tp"])
    rows = rows.select("class", F.try_divide("tp", "n_pred").alias("precision"), F.try_divide("tp", "n_actual").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f_measure", F.try_divide(2 * p * r, p + r))


def macro(per_class: DataFrame) -> DataFrame:
    """Averages with undefined values as 0, and the F measure of these."""
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0))).alias(c)
    p, r = F.col("precision"), F.col("recall")
    return per_class.agg(mean("precision"), mean("recall")).withColumn("f_measure", F.try_divide(2 * p * r, p + r))


def _one_vs_rest(probs: DataFrame) -> DataFrame:
    """class (of all actual ones), prob, p and n: rows of the class and of the others that have this probability of it.

    Voted rows are counted by class and probability; those that no tree gave the class are what the class totals leave.
    """
    pos = (F.col("class") == F.col("actual")).cast("bigint")
    seen = probs.groupBy("class", "prob").agg(F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    ids = probs.filter("rank = 1") if "rank" in probs.columns else probs.select("id", "actual").distinct()  # a row for each id
    totals = ids.groupBy(F.col("actual").alias("class")).agg(F.count(F.lit(1)).alias("own"))
    totals = totals.crossJoin(totals.agg(F.sum("own").alias("all")))  # one row
    voted = seen.groupBy("class").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rest = totals.join(voted, "class", "left").select("class", F.lit(0.0).alias("prob"), (F.col("own") - zero("p")).alias("p"), (F.col("all") - F.col("own") - zero("n")).alias("n"))
    some = seen.join(totals.select("class"), "class", "left_semi").select("class", "prob", "p", "n").unionByName(rest.filter("p + n > 0"))
    return some.groupBy("class", "prob").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def auc(probs: DataFrame) -> DataFrame:
    """class, n and auc against the rest, ties halved.  Counts of each probability come first."""
    below = Window.partitionBy("class").orderBy("prob")
    rows = _one_vs_rest(probs).withColumn("less", F.sum("n").over(below) - F.col("n"))
    wins = F.sum(F.col("p") * (F.col("less") + F.col("n") / 2.0))
    return rows.groupBy("class").agg(F.sum("p").alias("n_pos"), F.try_divide(wins, F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def average_auc(per_class: DataFrame) -> DataFrame:
    weighted = F.try_divide(F.sum(F.col("n_pos") * F.col("auc")), F.sum("n_pos"))
    return per_class.agg(weighted.alias("weighted_auc"), F.avg("auc").alias("average_auc"))


def prc(probs: DataFrame) -> DataFrame:
    """The area under precision over recall of each class; equal probabilities are one step."""
    per = _one_vs_rest(probs).withColumn("n", F.col("p") + F.col("n"))
    upto = Window.partitionBy("class").orderBy(F.desc("prob"))
    rows = per.withColumns({"tp": F.sum("p").over(upto), "all": F.sum("n").over(upto), "pos": F.sum("p").over(Window.partitionBy("class"))})
    rows = rows.select("class", "prob", F.try_divide("tp", "pos").alias("x"), (F.col("tp") / F.col("all")).alias("y"))
    rows = rows.withColumns({"x0": F.lag("x", 1, 0.0).over(upto), "y0": F.lag("y", 1, 1.0).over(upto)})
    return rows.groupBy("class").agg((F.sum((F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0"))) / 2).alias("prc"))


def trapezoid(points: DataFrame, x: str = "x", y: str = "y", order: str = "i") -> DataFrame:
    """The area under points in their order; they are dealt by range, and a piece knows the first point of the next one."""
    rows = running(points.select(F.struct(F.col(order).alias("o"), F.col(x).alias("x"), F.col(y).alias("y")).alias("_at")), [], "_at", {}, following="_next")
    return rows.agg((F.sum((F.col("_next.x") - F.col("_at.x")) * (F.col("_next.y") + F.col("_at.y"))) / 2).alias("area"))


def brier(probs: DataFrame) -> DataFrame:
    """The mean over rows of the squared errors of the voted classes."""
    error = (F.col("prob") - F.when(F.col("class") == F.col("actual"), 1.0).otherwise(0.0)) ** 2
    return probs.groupBy("id").agg(F.sum(error).alias("e")).agg(F.avg("e").alias("brier"))


def margins(probs: DataFrame) -> DataFrame:
    """id and margin: the probability of the class less the largest other."""
    own = F.coalesce(F.max(F.when(F.col("class") == F.col("actual"), F.col("prob"))), F.lit(0.0))
    other = F.coalesce(F.max(F.when(F.col("class") != F.col("actual"), F.col("prob"))), F.lit(0.0))
    return probs.groupBy("id").agg((own - other).alias("margin"))


def strength(probs: DataFrame) -> DataFrame:
    m = F.avg("margin")
    return margins(probs).agg(m.alias("strength"), (F.avg(F.col("margin") ** 2) - m * m).alias("margin_variance"))


def base_accuracy(votes: DataFrame, probs: DataFrame) -> DataFrame:
    """tree, a: its accuracy; b: how often it votes for the best class other than the row's."""
    order = Window.partitionBy("id").orderBy(F.desc("prob"), "class")
    second = probs.filter("class <> actual").withColumn("r", F.row_number().over(order)).filter("r = 1").select("id", F.col("class").alias("rival"))
    rows = votes.join(second, "id", "left")
    share = lambda c: F.avg(F.when(F.col("pred") == F.col(c), 1.0).otherwise(0.0))
    return rows.groupBy("tree").agg(share("actual").alias("a"), share("rival").alias("b"))


def correlation(votes: DataFrame, probs: DataFrame) -> DataFrame:
    """correlation and c_s2, correlation over squared strength (0 at strength 0)."""
    a, b = F.col("a"), F.col("b")
    spread = base_accuracy(votes, probs).agg(F.avg(F.sqrt(a + b + (a - b) ** 2)).alias("s"))
    rows = strength(probs).crossJoin(spread).withColumn("correlation", F.try_divide("margin_variance", F.col("s") ** 2))
    return rows.select("correlation", F.when(F.col("strength") == 0, 0.0).otherwise(F.col("correlation") / F.col("strength") ** 2).alias("c_s2"))


def mse(probs: DataFrame) -> DataFrame:
    """mse (the Brier score) and variance: of probabilities about the means of their classes."""
    per = probs.groupBy("actual", "class").agg(F.avg("prob").alias("m"), F.count(F.lit(1)).alias("k"), F.sum(F.col("prob") ** 2).alias("s2"))
    n = probs.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum(F.col("s2") - F.col("k") * F.col("m") ** 2).alias("v")).crossJoin(n).crossJoin(brier(probs)).select(F.col("brier").alias("mse"), (F.col("v") / F.col("n")).alias("variance"))
