"""Bags of any learner: a learner fits all samples at once, keyed by tree, and says what each model votes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.operators import metrics
from copse.operators.examples import ExampleSet, Feature
from copse.operators.neighbors import ranges_of

from .forest import ForestModel, Options, _bags
from .grow import grow
from .tables import dealt, small, stored


@dataclass(frozen=True)
class Learner:
    """fit(ex, bags, options) gives the models of all trees of bags (tree, id, class, weight and features) as one table;

    vote(model, ex, df, options) gives id, actual, tree and pred of each row of df by each of them.
    """

    fit: Callable
    vote: Callable


@dataclass
class Bag:
    model: DataFrame
    ex: ExampleSet
    learner: Learner
    options: Options

    def votes(self, df: DataFrame) -> DataFrame:
        return self.learner.vote(self.model, self.ex, df, self.options)

    def transform(self, df: DataFrame) -> DataFrame:
        return metrics.probabilities(self.votes(df), self.options.trees)


def bagged(ex: ExampleSet, learner: Learner, options: Options) -> tuple[Bag, DataFrame]:
    """A bag of the learner's models, on the samples that the options name, and these."""
    bags = stored(dealt(_bags(ex, options), "tree", "id"), "bags")
    return Bag(stored(learner.fit(ex, bags, options), "models"), ex, learner, options), bags


#: Trees as a learner: the same forest as forest.fit() grows.
TREES = Learner(lambda ex, bags, o: grow(ex, o, bags), lambda model, ex, df, o: ForestModel(model, ex.features, o).votes(df))


def _centres(ex: ExampleSet, bags: DataFrame, o: Options) -> DataFrame:
    mean = lambda f: F.try_divide(F.sum(F.col(f"`{f.name}`") * F.col("weight")), F.sum(F.when(F.col(f"`{f.name}`").isNotNull(), F.col("weight"))))
    numeric, categoric = [[f for f in ex.features if (f.kind == "numeric") == n] for n in (True, False)]
    out = bags.groupBy("tree", "class").agg(F.sum("weight").alias("_w"), *[mean(f).alias(f.name) for f in numeric])
    for f in categoric:  # the value of the greatest weight, the smallest of equals
        per = bags.filter(F.col(f"`{f.name}`").isNotNull()).groupBy("tree", "class", f"`{f.name}`").agg(F.sum("weight").alias("_n"))
        out = out.join(per.groupBy("tree", "class").agg(F.min_by(f"`{f.name}`", F.struct(-F.col("_n"), f"`{f.name}`")).alias(f.name)), ["tree", "class"], "left")
    return out.drop("_w")


def _nearest_centre(model: DataFrame, ex: ExampleSet, df: DataFrame, o: Options) -> DataFrame:
    ranges = ranges_of(ex.df, ex.features)

    def part(f: Feature):
        a, b = F.col(f"`{f.name}`"), F.col(f"c.`{f.name}`")
        if f.kind != "numeric":
            return F.when(a == b, 0.0).otherwise(1.0)
        low, high = ranges[f.name]
        width = float((high or 0) - (low or 0)) or 1.0
        return F.coalesce(((a - b) / width) ** 2, F.lit(1.0))

    centres = model.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("class", *[f"`{f.name}`" for f in ex.features]))).alias("centres"))  # a struct for each class
    rows = df.select("id", F.col("class").alias("actual"), *[f"`{f.name}`" for f in ex.features]).withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(o.trees))))
    rows = rows.join(small(centres, o.trees), "tree").withColumn("c", F.explode("centres"))
    near = F.round(sum((part(f) for f in ex.features), F.lit(0.0)), 9)
    return rows.groupBy("id", "actual", "tree").agg(F.min_by("c.class", F.struct(near, F.col("c.class"))).alias("pred"))


#: A row votes for the class whose mean and most frequent values are nearest, numbers scaled by their ranges; a missing one is 1 away.
CENTRES = Learner(_centres, _nearest_centre)
