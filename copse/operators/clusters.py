"""Clusters of rows with numbers, categories and missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from copse.functions.rng import u
from copse.plans.tables import BROADCAST_ROWS, discard, stored

from .examples import Feature

EMPTY = ("drop", "refill")


def gap(f: Feature, centre: Column) -> Column:
    """What f adds to the squared distance to a centroid: the square of the difference, or 1 for another category; 1 if a value is missing."""
    a, b = F.col(f"`{f.name}`"), centre[f.name]
    if f.kind != "numeric":
        return F.when(a == b, 0.0).otherwise(1.0)
    return F.coalesce((a - b) * (a - b), F.lit(1.0))


def nearest_centre(rows: DataFrame, centres: DataFrame, features: tuple[Feature, ...]) -> DataFrame:
    """rows with cluster and distance (squared) of the nearest centroid, of equals the least number.  centres: at most BROADCAST_ROWS."""
    names = [f"`{f.name}`" for f in features]
    all_ = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", *names))).alias("_all"))  # one row
    distance = lambda c: F.round(sum((gap(f, c) for f in features), F.lit(0.0)), 9)
    best = F.array_min(F.transform("_all", lambda c: F.struct(distance(c).alias("d"), c["cluster"].alias("cluster"))))
    out = rows.crossJoin(F.broadcast(all_)).withColumn("_best", best)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("_best.cluster").cast("bigint").alias("cluster"), F.col("_best.d").alias("distance"))


def kmeans(df: DataFrame, features: tuple[Feature, ...], k: int, seed, iterations: int = 100, empty: str = "drop", start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (id, cluster, distance) and centroids (cluster and the features) after moves until none moves.

    Centroids start at the k rows with the least draws (or as start has them) and move to the means of the known numbers and
    the most frequent known category of their rows, the smallest of equals: one aggregation.  empty: a cluster without
    rows goes (drop), or takes the row that is farthest from its own centroid, the second one the second farthest, of equals
    the least id (refill).
    """
    if not 0 < k <= BROADCAST_ROWS:
        raise ValueError(f"the number of clusters must be 1 to {BROADCAST_ROWS}")
    if empty not in EMPTY:
        raise ValueError(f"empty clusters: {' or '.join(EMPTY)}, not {empty!r}")
    names = [f"`{f.name}`" for f in features]
    rows = df.select("id", *names)
    if start is None:
        first = rows.orderBy(u(seed, "centroid", F.col("id")), "id").limit(k)
        start = first.withColumn("cluster", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(u(seed, "centroid", F.col("id")), "id")).cast("bigint"))  # k rows
    centres = stored(start.select("cluster", *names), "centroids")
    mean = lambda f: F.avg(f"`{f.name}`") if f.kind == "numeric" else F.mode(F.col(f"`{f.name}`"), True)
    for _ in range(iterations):
        near = nearest_centre(rows, centres, features)
        moved = stored(near.groupBy("cluster").agg(*[mean(f).alias(f.name) for f in features]), "centroids")
        if empty == "refill":
            lost = centres.select("cluster").join(moved, "cluster", "left_anti")
            if n := lost.count():
                nth = Window.partitionBy(F.lit(0))
                lost = lost.withColumn("nth", F.row_number().over(nth.orderBy("cluster")))  # k rows at most
                far = near.orderBy(F.desc("distance"), "id").limit(n).withColumn("nth", F.row_number().over(nth.orderBy(F.desc("distance"), "id")))
                moved = stored(moved.unionByName(lost.join(far.drop("cluster"), "nth").select("cluster", *names)), "centroids")
        differs = ~F.struct(*[F.col(f"a.{n}") for n in names]).eqNullSafe(F.struct(*[F.col(f"b.{n}") for n in names]))
        same = moved.alias("a").join(centres.alias("b"), "cluster", "full").filter(differs).isEmpty()
        discard(centres)
        centres = moved
        if same:
            break
    return nearest_centre(rows, centres, features).select("id", "cluster", "distance"), centres


def centre_examples(df: DataFrame, centres: DataFrame, features: tuple[Feature, ...]) -> tuple[DataFrame, tuple[Feature, ...]]:
    """id, class, weight and the closeness exp(-distance) to each centroid, and these as features of a forest: near1, near2, ..."""
    numbers = [r[0] for r in centres.select("cluster").orderBy("cluster").collect()]  # one for each cluster
    all_ = centres.agg(F.array_sort(F.collect_list(F.struct("cluster", *[f"`{f.name}`" for f in features]))).alias("_all"))  # one row
    near = F.transform("_all", lambda c: F.exp(-F.sqrt(sum((gap(f, c) for f in features), F.lit(0.0)))))
    rows = df.crossJoin(F.broadcast(all_)).withColumn("_near", near)
    made = tuple(Feature(f"near{n}", "numeric", i) for i, n in enumerate(numbers))
    return rows.select("id", "class", "weight", *[F.col("_near")[i].alias(f.name) for i, f in enumerate(made)]), made
