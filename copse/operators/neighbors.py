"""Nearest neighbours, oversampling by interpolation, k-means and radial features."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from copse.functions.rng import u
from copse.plans.tables import stored

from .examples import Feature

#: Rows of a block whose distances are measured in one group, and distances at hand at once.
BLOCK, CELLS = 2000, 500_000


def _terms(f: Feature, a: pa.ChunkedArray, b: pa.ChunkedArray, bounds: tuple[float | None, float | None] | None):
    """What f adds to the distance, as a function of a range of a's rows against all of b's.

    Numeric, the square of the scaled difference.  Missing both: 1; missing one: the other's place in the
    range; no width: 0 (1 if one is missing).  Categories differ by 0 or 1, missing ones by 1.
    """
    lost_a, lost_b = (pc.is_null(x).to_numpy() for x in (a, b))
    if f.kind != "numeric":
        codes = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        x, y = codes[: len(a)], codes[len(a) :]
        return lambda s: 1.0 - (x[s, None] == y) * ~(lost_a[s, None] | lost_b)
    x, y = (v.cast(pa.float64()).to_numpy() for v in (a, b))
    low, width = (np.nan, np.nan) if bounds is None or None in bounds else (bounds[0], bounds[1] - bounds[0])
    place = lambda v: np.ones(len(v)) if width == 0 else (v - low) / width
    at_x, at_y = place(x), place(y)

    def term(s):
        d = np.zeros((len(x[s]), len(y))) if width == 0 else (x[s, None] - y) / width
        if lost_a[s].any() or lost_b.any():
            p, q = lost_a[s, None], lost_b[None, :]
            d = np.where(p & q, 1.0, np.where(p, at_y[None, :], np.where(q, at_x[s, None], d)))
        return d * d

    return term


def _nearest_of_block(features: tuple[Feature, ...], k: int, ranges: dict, itself: bool = False):
    """The k candidates of a block nearest to each query of a block, of equals those with the least ids; itself: a query may find its own row."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        terms = [_terms(f, queries.column(f.name), rows.column(f.name), ranges.get(f.name)) for f in features]
        both = pa.chunked_array([*queries.column("_query").chunks, *rows.column("id").chunks]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        mine, others = both[: len(queries)], both[len(queries) :]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, CELLS // max(1, len(rows)))
        for low in range(0, len(queries) if len(rows) else 0, step):
            s = slice(low, low + step)
            d = reduce(add, (t(s) for t in terms), np.zeros((len(mine[s]), len(rows))))
            other = (mine[s, None] != others) | itself
            order = np.where(other & ~np.isnan(d), d, np.inf)
            most = np.partition(order, k - 1, axis=1)[:, k - 1 : k] if k < len(rows) else np.inf
            q, c = np.nonzero(other & (order <= most))
            place = np.lexsort((c, order[q, c], q))
            q, c = q[place], c[place]
            first = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append((q[first] + low, c[first], d[q[first], c[first]]))
        q, c, d = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query": queries.column("_query").take(pa.array(q)), "id": rows.column("id").take(pa.array(c)), "distance": pa.array(d)})

    return run


def ranges_of(df: DataFrame, features: tuple[Feature, ...]) -> dict[str, tuple[float | None, float | None]]:
    names = [f.name for f in features if f.kind == "numeric"]
    if not names:
        return {}
    row = df.agg(*[g(n).alias(f"{g.__name__}_{n}") for n in names for g in (F.min, F.max)]).first()
    return {n: (row[f"min_{n}"], row[f"max_{n}"]) for n in names}


def nearest(df: DataFrame, queries: DataFrame, features: tuple[Feature, ...], k: int, ranges=None, values: bool = False) -> DataFrame:
    """query, id, distance and rank of the k rows of df nearest to each query (a stated set), itself left out; values: with their features as v.

    The distance is the sum of squared scaled differences, see _terms().  Every query meets every row: blocks of
    queries meet blocks of rows, each pair of blocks in one group, of which k rows for each query go on.
    """
    ranges = ranges or ranges_of(df, features)
    names = [f.name for f in features]
    n_rows, n_queries = (max(1, -(-x.count() // BLOCK)) for x in (df, queries))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col("id").alias("_query"), *names, block(n_queries).alias("_of"), every(n_rows).alias("_to"))
    rows = df.select("id", *names, block(n_rows).alias("_to"), every(n_queries).alias("_of"))
    kind = f"query {queries.schema['id'].dataType.simpleString()}, id {df.schema['id'].dataType.simpleString()}, distance double"
    found = q.groupBy("_of", "_to").cogroup(rows.groupBy("_of", "_to")).applyInArrow(_nearest_of_block(features, k, ranges), kind)
    order = Window.partitionBy("query").orderBy("distance", "id")
    found = found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
    if not values:
        return found
    return found.join(df.select("id", F.struct(*names).alias("v")), "id").select("query", "id", "distance", "v", "rank")


def _nearest_of_vectors(k: int):
    """As _nearest_of_block(), by squared Euclidean distance."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        table = lambda c: np.stack(c.to_numpy()).astype(float) if len(c) else np.zeros((0, 1))
        a, b = table(queries.column("_v")), table(rows.column("v"))
        both = pa.chunked_array([*queries.column("_query").chunks, *rows.column("id").chunks]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        mine, others = both[: len(a)], both[len(a) :]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        step = max(1, CELLS * 4 // max(1, b.size))
        for low in range(0, len(a) if len(b) else 0, step):
            d = ((a[low : low + step, None, :] - b) ** 2).sum(2)
            d = np.where(mine[low : low + step, None] != others, d, np.inf)
            most = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < len(b) else np.inf
            q, c = np.nonzero(np.isfinite(d) & (d <= most))
            place = np.lexsort((c, d[q, c], q))
            q, c = q[place], c[place]
            first = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append((q[first] + low, c[first], d[q[first], c[first]]))
        q, c, d = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query": queries.column("_query").take(pa.array(q)), "id": rows.column("id").take(pa.array(c)), "distance": pa.array(d)})

    return run


def nearest_vectors(df: DataFrame, queries: DataFrame, k: int, ident: str = "id", vector: str = "vector") -> DataFrame:
    """As nearest(), by squared Euclidean distance of arrays; rows and queries without a vector are left out."""
    rows = df.select(F.col(ident).alias("id"), F.col(vector).alias("v")).filter("v IS NOT NULL")
    asked = queries.select(F.col(ident).alias("id"), F.col(vector).alias("_v")).filter("_v IS NOT NULL")
    n_rows, n_queries = (max(1, -(-x.count() // BLOCK)) for x in (rows, asked))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = asked.select(F.col("id").alias("_query"), "_v", block(n_queries).alias("_of"), every(n_rows).alias("_to"))
    r = rows.select("id", "v", block(n_rows).alias("_to"), every(n_queries).alias("_of"))
    kind = f"query {asked.schema['id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, distance double"
    found = q.groupBy("_of", "_to").cogroup(r.groupBy("_of", "_to")).applyInArrow(_nearest_of_vectors(k), kind)
    order = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def _most_frequent(array: Column) -> Column:
    """The most frequent known value of a short array; the smallest of equals."""
    values = F.filter(array, lambda x: x.isNotNull())
    counts = F.transform(F.array_distinct(values), lambda x: F.struct((-F.size(F.filter(values, lambda y: y == x))).alias("n"), x.alias("v")))
    return F.try_element_at(F.array_sort(counts), F.lit(1))["v"]


def smote(df: DataFrame, features: tuple[Feature, ...], seed, minority: str | None = None, k: int = 5, times: int = 1) -> DataFrame:
    """Made-up rows of the minority class: times for each of its rows.

    A numeric value lies between the row's and that of one of its k nearest in the class, with a draw for
    each feature; a category is the most frequent of the neighbours; a value missing on either side is
    missing.  A row without neighbour gets its own value plus the draw.  Neighbours are searched in cells.
    """
    if minority is None:
        minority = df.groupBy("class").count().orderBy("count", "class").first()["class"]
    own = df.filter(F.col("class") == minority)
    from .cells import lists_in_cells

    rows = lists_in_cells(own, own, features, k, ranges_of(own, features))
    rows = rows.withColumn("near", F.when(F.size("near") > 0, F.col("near"))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    pick = F.floor(u(seed, "pick", F.col("id"), F.col("copy")) * F.size("near")).cast("int")
    rows = rows.withColumn("one", F.when(F.col("near").isNotNull(), F.col("near")[pick]["v"]))
    out = []
    for f in features:
        draw = u(seed, f.name, F.col("id"), F.col("copy"))
        if f.kind == "numeric":
            made = F.col(f.name) + draw * (F.col(f"one.{f.name}") - F.col(f.name))
            out.append(F.when(F.col("near").isNull(), F.col(f.name) + draw).otherwise(made).alias(f.name))
        else:
            most = _most_frequent(F.col(f"near.v.{f.name}"))
            out.append(F.when(F.col(f.name).isNotNull(), F.coalesce(most, F.col(f.name))).alias(f.name))
    return rows.select(F.col("id").alias("from_id"), F.col("copy").cast("bigint").alias("copy"), F.lit(minority).alias("class"), *out)


def kmeans(df: DataFrame, k: int, seed, iterations: int = 10, vector: str = "vector") -> DataFrame:
    """id and cluster; centroids start at the k rows with the least draws and move until stable.

    The centroids are k rows and are broadcast; empty clusters go.
    """
    rows = df.select("id", F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    first = rows.orderBy(u(seed, "centroid", F.col("id")), "id").limit(k)
    centroids = stored(first.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(u(seed, "centroid", F.col("id")), "id")).alias("cluster"), F.col("v").alias("c")), "centroids")
    for _ in range(iterations):
        near = assign(rows, centroids)
        moved = near.select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
        moved = moved.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))
        moved = stored(moved, "centroids")
        same = moved.join(centroids.withColumnRenamed("c", "d"), "cluster", "full").filter(F.coalesce(F.col("c") != F.col("d"), F.lit(True))).isEmpty()
        centroids = moved
        if same:
            break
    return assign(rows, centroids).select("id", "cluster")


def assign(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    all_ = centroids.agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("all"))  # k rows
    square = lambda v, c: F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.transform("all", lambda x: F.struct(F.round(square(F.col("v"), x["c"]), 9).alias("d"), x["cluster"].alias("cluster"))))
    return rows.crossJoin(F.broadcast(all_)).withColumn("best", best).select("id", "v", F.col("best.cluster").cast("bigint").alias("cluster"), F.sqrt("best.d").alias("distance"))


def radial_features(df: DataFrame, centroids: DataFrame, gamma: float = 1.0, vector: str = "vector") -> DataFrame:
    """id, centroid and exp(-gamma * distance ** 2)."""
    c = centroids.select(F.col("id").alias("centroid"), F.col(vector).alias("c"))
    d = F.aggregate(F.zip_with(F.col(vector), F.col("c"), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return df.crossJoin(F.broadcast(c)).select("id", "centroid", F.exp(-gamma * d).alias("value"))


def radial_examples(df: DataFrame, centroids: DataFrame, vector: str = "vector") -> DataFrame:
    """id, class, weight and near0, near1, ...: exp(-distance) to each centroid (a few rows), features of a forest."""
    names = [r[0] for r in centroids.select("id").orderBy("id").collect()]  # the centroids' ids
    gathered = centroids.agg(F.array_sort(F.collect_list(F.struct("id", F.col(vector).alias("c")))).alias("_all"))
    d = lambda c: F.aggregate(F.zip_with(F.col(vector), c, lambda a, b: (a.cast("double") - b.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    rows = df.crossJoin(F.broadcast(gathered)).withColumn("_near", F.transform("_all", lambda s: F.exp(-F.sqrt(d(s["c"])))))  # one row
    return rows.select("id", "class", "weight", *[F.col("_near")[i].alias(f"near{i}") for i in range(len(names))])


def bootstrap_average(bags: DataFrame, numeric: list[str], categoric: list[str]) -> DataFrame:
    """For each tree's sample the weighted mean of numeric and the weighted mode of categoric features."""
    mean = [F.try_divide(F.sum(F.col(n) * F.col("weight")), F.sum(F.when(F.col(n).isNotNull(), F.col("weight")))).alias(n) for n in numeric]
    out = bags.groupBy("tree").agg(*mean) if mean else bags.select("tree").distinct()
    for n in categoric:
        per = bags.filter(F.col(n).isNotNull()).groupBy("tree", n).agg(F.sum("weight").alias("w"))
        out = out.join(per.groupBy("tree").agg(F.min_by(n, F.struct(-F.col("w"), n)).alias(n)), "tree", "left")
    return out
