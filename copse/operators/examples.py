"""Example sets: typed rows with an id, a class and a weight."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str  # numeric or categoric
    ordinal: int = 0


@dataclass(frozen=True)
class ExampleSet:
    """df has id, class, weight and a column for each feature; a missing value is null."""

    df: DataFrame
    features: tuple[Feature, ...]

    @classmethod
    def of(cls, df: DataFrame, ident: str, klass: str, numeric=(), categoric=(), weight: Column | None = None) -> ExampleSet:
        features = tuple(Feature(n, k, i) for i, (n, k) in enumerate([(n, "numeric") for n in numeric] + [(n, "categoric") for n in categoric]))
        columns = [F.col(f.name).cast("double" if f.kind == "numeric" else "string").alias(f.name) for f in features]
        return cls(df.select(F.col(ident).alias("id"), F.col(klass).cast("string").alias("class"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"), *columns), features)

    def with_df(self, df: DataFrame) -> ExampleSet:
        return ExampleSet(df, self.features)

    def names(self, kind: str | None = None) -> list[str]:
        return [f.name for f in self.features if kind in (None, f.kind)]

    def cache(self) -> ExampleSet:
        return self.with_df(self.df.cache())

    def drop(self) -> None:
        self.df.unpersist()


def class_distribution(ex: DataFrame) -> DataFrame:
    return ex.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))


def total_weight(ex: DataFrame) -> DataFrame:
    return ex.agg(F.sum("weight").alias("w"))


def class_weight(ex: DataFrame, klass: str) -> DataFrame:
    return ex.agg(F.coalesce(F.sum(F.when(F.col("class") == klass, F.col("weight"))), F.lit(0.0)).alias("w"))


def weight_excluding(ex: DataFrame, klass: str) -> DataFrame:
    return ex.agg(F.coalesce(F.sum(F.when(F.col("class") != klass, F.col("weight"))), F.lit(0.0)).alias("w"))


def majority(ex: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The class with the largest weight of each key; the smallest of equals."""
    per = ex.groupBy(*keys, "class").agg(F.sum("weight").alias("w"))
    return per.groupBy(*keys).agg(F.min_by("class", F.struct(-F.col("w"), "class")).alias("class"), F.max("w").alias("w"))


def to_binary(ex: DataFrame, positive: str) -> DataFrame:
    """One class against the rest, as + and -."""
    if ex.filter(F.col("class") == positive).isEmpty():
        raise ValueError(f"cannot split: no example of class {positive}")
    return ex.withColumn("class", F.when(F.col("class") == positive, "+").otherwise("-"))


def coverage(ex: DataFrame) -> DataFrame:
    """The weights of the classes + and -."""
    side = lambda c: F.coalesce(F.sum(F.when(F.col("class") == c, F.col("weight"))), F.lit(0.0))
    return ex.agg(side("+").alias("pos"), side("-").alias("neg"))


def remove_covered(ex: DataFrame, covered: DataFrame) -> DataFrame:
    return ex.join(covered.select("id"), "id", "left_anti")


def feature_ranges(ex: DataFrame, numeric: list[str]) -> DataFrame:
    """feature, low, high and mean of the numeric features."""
    long = ex.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in numeric])).alias("s")).select("s.*")
    return long.groupBy("feature").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"))


def modes(ex: DataFrame, categoric: list[str]) -> DataFrame:
    long = ex.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in categoric])).alias("s")).select("s.*")
    per = long.filter("v IS NOT NULL").groupBy("feature", "v").count()
    return per.groupBy("feature").agg(F.min_by("v", F.struct(-F.col("count"), "v")).alias("mode"))
