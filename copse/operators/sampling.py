"""Sampling, shuffling and partitioning of examples; draws are hashes of the seed and the id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from copse.functions.draws import Leads
from copse.functions.rng import ranked, running, triangle, u, uniform_between
from copse.plans.tables import dealt, small, stored

#: Draws of a block of places, about, which are counted at once.
DRAWS = 2_000_000


def _round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def bootstrap(ex: DataFrame, seed, trees: int | None = None, within: list[str] | None = None) -> DataFrame:
    """In-bag rows: as many draws with replacement as rows; how often a row was drawn scales its weight.

    trees: as many samples, told apart by the column tree.  within: apart for each value of these columns (few values).
    """
    keys, tree = within or [], ["tree"] if trees is not None else []
    rows = ranked(ex, u(seed, "order", F.col("id")), "id", keys, name="place")
    sizes = [r.asDict() for r in ex.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()]  # a row for each value
    draws = ex.sparkSession.range(1, max([r["n"] for r in sizes], default=0) + 1).withColumnRenamed("id", "draw")
    each = F.array(*[F.struct(*[F.lit(v).cast(ex.schema[k].dataType if k != "n" else "long").alias(k) for k, v in r.items()]) for r in sizes]) if sizes else F.array(F.struct(F.lit(0).alias("n")))
    draws = draws.withColumn("_of", F.explode(each)).select("draw", "_of.*").filter(F.col("draw") <= F.col("n"))
    if tree:
        draws = draws.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees))))
    if not keys and not isinstance(seed, Column):
        return _dealt_draws(rows, sizes[0]["n"], seed, trees)
    place = (F.floor(u(seed, *map(F.col, tree), F.col("draw")) * F.col("n")) + 1).cast("bigint")
    # Draws are dealt by place alone, as the join needs them, so trees are counted and joined where they lie.
    times = dealt(draws.select(*keys, *tree, place.alias("place")), *keys, "place").groupBy(*keys, *tree, "place").agg(F.count(F.lit(1)).alias("times"))
    return rows.join(times.hint("merge"), [*keys, "place"]).withColumn("weight", F.col("weight") * F.col("times")).drop("place", "times")


def _dealt_draws(rows: DataFrame, n: int, seed, trees: int | None) -> DataFrame:
    """rows (which have a place, 1 to n) in the samples that draw them.

    Tasks make the draws as arrays and deal them in blocks of places; each block's are counted at once.  A place has one row for all samples.
    """
    count = trees or 1
    block = max(1, DRAWS // count)
    leads = Leads([f"{seed}:{t}:" for t in range(1, count + 1)] if trees is not None else [f"{seed}:"])

    def draw(batches):
        for batch in batches:
            draws = batch["draw"].to_numpy()
            tree = np.repeat(np.arange(count), len(draws))
            own = np.floor(leads.heads(tree, np.tile(draws, count)) / 4294967296.0 * n).astype(np.int64) * count + tree
            own.sort()
            part = own // (block * count)
            first = np.flatnonzero(np.diff(part, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array([(x - p * block * count).astype(np.uint32).tobytes() for x, p in zip(np.split(own, first[1:]), part[first], strict=True)], pa.binary())], names=["part", "draws"])

    def counted(key, table):
        own = np.frombuffer(b"".join(table["draws"].to_pylist()), np.uint32)
        times = np.bincount(own, minlength=block * count).reshape(block, count).astype(np.int32)
        there = np.flatnonzero(times.any(1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1, dtype=np.int32) * count), pa.array(times[there].reshape(-1)))
        return pa.table({"place": pa.array(key[0].as_py() * block + there + 1), "times": lists})

    draws = rows.sparkSession.range(1, n + 1).withColumnRenamed("id", "draw").mapInArrow(draw, "part bigint, draws binary")
    times = draws.groupBy("part").applyInArrow(counted, "place bigint, times array<int>")
    out = dealt(rows, "place").join(dealt(times, "place").hint("merge"), "place").select("*", F.posexplode("times").alias("_nth", "_n")).filter("_n > 0")
    out = out.withColumn("weight", F.col("weight") * F.col("_n"))
    return (out if trees is None else out.withColumn("tree", (F.col("_nth") + 1).cast("int"))).drop("place", "times", "_nth", "_n")


def class_bootstrap(ex: DataFrame, seed, trees: int, target: str, overlap: float) -> DataFrame:
    """In-bag rows of the target class in each of the samples, and a share of those of the other classes."""
    some = u(seed, "overlap", F.col("tree"), F.col("id")) < overlap
    return bootstrap(ex, seed, trees).filter((F.col("class") == target) | some)


def out_of_bag(ex: DataFrame, bag: DataFrame, trees: int | None = None) -> DataFrame:
    if trees is None:
        return ex.join(bag.select("id"), "id", "left_anti")
    return ex.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).join(bag.select("tree", "id"), ["tree", "id"], "left_anti")


def triangle_sample(ex: DataFrame, seed, threshold=0.3, low=1.0, high=10.0, mode=2.0) -> DataFrame:
    """Rows with a draw above threshold, weighted by a triangle-distributed number."""
    drawn = ex.filter(u(seed, "in", F.col("id")) > threshold)
    return drawn.withColumn("weight", _round(triangle(u(seed, "w", F.col("id")), low, high, mode)).cast("double"))


def uniform_sample(ex: DataFrame, seed, threshold=0.3, low=1.0, high=10.0) -> DataFrame:
    drawn = ex.filter(u(seed, "in", F.col("id")) > threshold)
    return drawn.withColumn("weight", _round(uniform_between(u(seed, "w", F.col("id")), low, high)).cast("double"))


def random_sample(ex: DataFrame, seed) -> DataFrame:
    """A triangle, uniform or bootstrap sample, by one draw of the seed."""
    x = ex.sparkSession.range(1).select(u(seed, "choice")).first()[0]
    return triangle_sample(ex, seed) if x <= 0.33 else uniform_sample(ex, seed) if x >= 0.66 else bootstrap(ex, seed)


def oversample(ex: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every class weighs as much as the largest; apart for each value of keys."""
    per = ex.groupBy(*keys, "class").agg(F.sum("weight").alias("own"))
    per = stored(per.withColumn("most", F.max("own").over(Window.partitionBy(*(keys or [F.lit(0)])))), "classes")  # a row for each class
    return ex.join(small(per, per.count()), [*keys, "class"]).withColumn("weight", F.col("weight") * F.col("most") / F.col("own")).drop("own", "most")


def undersample(ex: DataFrame, seed, keys: tuple[str, ...] = ()) -> DataFrame:
    """As many random rows of each class as the smallest has; apart for each value of keys."""
    per = ex.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("n"))
    rows = ranked(ex, u(seed, "under", F.col("id")), "id", [*keys, "class"])
    if not keys:
        return rows.filter(F.col("rank") <= (per.agg(F.min("n")).first()[0] or 0)).drop("rank")
    least = per.groupBy(*keys).agg(F.min("n").alias("_least"))
    return rows.join(least, [*keys]).filter(F.col("rank") <= F.col("_least")).drop("rank", "_least")


def nothing(ex: DataFrame) -> DataFrame:
    return ex


def subset(ex: DataFrame, size, seed, keys: tuple[str, ...] = ()) -> DataFrame:
    """A float in [0, 1]: that share of each class, rounded; an integer: so many rows at most.  Apart for each value of keys."""
    if isinstance(size, float):
        counts = stored(ex.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("n")), "classes")
        rows = ranked(ex, u(seed, "subset", F.col("id")), "id", [*keys, "class"]).join(small(counts, counts.count()), [*keys, "class"])
        return rows.filter(F.col("rank") <= _round(F.col("n") * F.lit(size))).drop("rank", "n")
    return ranked(ex, u(seed, "subset", F.col("id")), "id", [*keys]).filter(F.col("rank") <= size).drop("rank")


def subagging(ex: DataFrame, seed, fraction: float = 0.5, keys: tuple[str, ...] = ()) -> DataFrame:
    return subset(ex, float(fraction), seed, keys)


def train_test_split(ex: DataFrame, ratio: float, seed) -> DataFrame:
    """ex with train: the first share of each class in hash order."""
    counts = stored(ex.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "classes")
    rows = ranked(ex, u(seed, "split", F.col("id")), "id", ["class"]).join(small(counts, counts.count()), "class")
    return rows.withColumn("train", F.col("rank") <= _round(F.col("n") * F.lit(ratio))).drop("rank", "n")


def stratified_folds(ex: DataFrame, folds: int, seed) -> DataFrame:
    """ex with fold, 1 to folds: dealt in turn, on from class to class."""
    if folds < 2:
        raise ValueError("cross validation needs two folds or more")
    rows = ranked(ex, u(seed, "fold", F.col("id")), "id", ahead=["class"])
    return rows.withColumn("fold", ((F.col("rank") - 1) % folds + 1).cast("bigint")).drop("rank")


def merge_folds(ex: DataFrame, test: int) -> tuple[DataFrame, DataFrame]:
    return ex.filter(F.col("fold") == test), ex.filter(F.col("fold") != test)


def shuffled(ex: DataFrame, seed) -> DataFrame:
    return ranked(ex, u(seed, "shuffle", F.col("id")), "id", name="place")


def random_features(spark, names: list[str], n: int, seed, keys: DataFrame | None = None) -> DataFrame:
    """n of the names, by rank of their draws; for each row of keys, if given."""
    per = spark.createDataFrame([(x,) for x in names], "feature string")
    cols = keys.columns if keys is not None else []
    rows = keys.withColumn("feature", F.explode(F.array(*map(F.lit, names)))) if keys is not None else per
    draw = u(seed, "feature", *[F.col(c) for c in cols], F.col("feature"))
    order = Window.partitionBy(*(cols or [F.lit(0)])).orderBy(draw, "feature")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("rank")


def partition(ex: DataFrame, parts: int, seed) -> DataFrame:
    """ex with part, 0 to parts - 1: dealt in turn in hash order."""
    rows = ranked(ex, u(seed, "part", F.col("id")), "id")
    return rows.withColumn("part", ((F.col("rank") - 1) % parts).cast("bigint")).drop("rank")


def sample_one(ex: DataFrame, seed, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each key a class, all alike, and a member of it."""
    values = [c for c in ex.columns if c not in keys]
    draw = lambda tag, c: u(seed, tag, *[F.col(k) for k in keys], F.col(c))
    per = ex.groupBy(*keys, "class").agg(F.min_by(F.struct(*values), F.struct(draw("member", "id"), F.col("id"))).alias("v"))
    one = F.min_by("v", F.struct(draw("class", "class"), F.col("class"))).alias("v")
    return (per.groupBy(*keys) if keys else per).agg(one).select(*keys, "v.*")


def sample_pair(ex: DataFrame, seed, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each key two classes, a and b, drawn alike, and a member of each (its values as a struct)."""
    values = [c for c in ex.columns if c not in (*keys, "class", "weight")]
    member = F.min_by(F.struct(*values), F.struct(u(seed, "member", *[F.col(k) for k in keys], F.col("id")), F.col("id")))
    per = ex.groupBy(*keys, "class").agg(member.alias("v"))
    draw = u(seed, "class", *[F.col(k) for k in keys], F.col("class"))
    both = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(draw.alias("d"), "class", "v"))).alias("s"))
    return both.filter(F.size("s") > 1).select(*keys, F.col("s")[0]["class"].alias("class_a"), F.col("s")[0]["v"].alias("a"), F.col("s")[1]["class"].alias("class_b"), F.col("s")[1]["v"].alias("b"))


def weighted_pick(weights: DataFrame, n: int, seed) -> DataFrame:
    """n draws of item in proportion to weight: draw and item.

    Items have an edge each on a line of the total weight; draws and edges are sorted together in pieces, and a draw takes
    the first edge above it, in its piece or the next one that has any.
    """
    upto = stored(running(weights, [], "item", {"upto": "weight"}), "edges")
    total = upto.agg(F.max("upto")).first()[0] or 0.0
    draws = weights.sparkSession.range(1, n + 1).withColumnRenamed("id", "draw").withColumn("x", u(seed, "pick", F.col("draw")))
    edge = upto.select((F.col("upto") / F.lit(total)).alias("x"), F.lit(1).alias("is_draw"), F.lit(None).cast("long").alias("draw"), "item")
    # A draw goes after an edge that it equals.
    line = draws.select("x", F.lit(2).alias("is_draw"), "draw", F.lit(None).cast(weights.schema["item"].dataType).alias("item")).unionByName(edge)
    line = stored(line.repartitionByRange("x", "is_draw").withColumn("_piece", F.spark_partition_id()), "line")
    after = Window.partitionBy("_piece").orderBy(F.desc("x"), F.desc("is_draw"), F.desc("item")).rowsBetween(Window.unboundedPreceding, 0)
    heads = line.filter("is_draw = 1").groupBy("_piece").agg(F.min_by("item", F.struct("x", "item")).alias("head"))
    pieces = line.select("_piece").distinct().join(heads, "_piece", "left")
    pieces = pieces.select("_piece", F.first("head", True).over(Window.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(1, Window.unboundedFollowing)).alias("next"))  # a row for each piece
    out = line.withColumn("item", F.coalesce("item", F.last("item", True).over(after))).filter("is_draw = 2").join(pieces, "_piece")
    return out.select("draw", F.coalesce("item", "next").alias("item"))
