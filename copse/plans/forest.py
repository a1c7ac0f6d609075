"""Random forests: fitting, prediction, importance, proximity, storage.  A model is a table of nodes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

from copse.functions.rng import u
from copse.functions.tops import top
from copse.operators import metrics, sampling, split
from copse.operators.examples import ExampleSet, Feature

from .grow import AT, SPLIT_COLUMNS, drawn, grow, side_of, values_of
from .folds import folded
from .options import ALIASES, BRANCHES, PAIRED, REDRAW, RULED, Options
from .packed import DECIDED, Nodes, ended, kept, walked
from .tables import BROADCAST_ROWS, dealt, discard, small, stored

__all__ = ["ALIASES", "BRANCHES", "REDRAW", "ForestModel", "Options", "build", "drawn", "fit", "fit_groups", "impute_by_proximity", "partial"]

VERSION = "2"
#: Nodes of a model over which rows walk arrays in tasks.
ARRAYS = 2000
#: Nodes of a model that is a literal of the plan; salts of queries in the same leaves; classes of a leaf's list in one deal.
LITERAL, DEALS, LIST = 2000, 16, 10_000


def _bags(ex: ExampleSet, o: Options, group: str | None = None) -> DataFrame:
    """The rows of each tree.  group: a column of ex with numbers 1 to o.groups; the forest of each grows on the rows of the others."""
    df, n, kind = ex.df, o.trees, o.example_sampling
    if group:
        df = df.withColumn("_for", F.explode(F.filter(F.sequence(F.lit(1), F.lit(o.groups)), lambda g: g != F.col(group)))).drop(group)
    number = (F.col("_for") - 1) * n + F.col("tree") if group else F.col("tree")
    if kind == "bagging":
        return sampling.bootstrap(df, o.seed, n, ["_for"] if group else None).withColumn("tree", number.cast("int")).drop("_for")
    rows = df.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(n))))
    seed = F.concat(F.lit(f"{o.seed}-"), F.col("tree").cast("string"))
    keys, spread = (*(["_for"] if group else []), "tree"), o.variance_options or ()
    if kind == "oversample":
        out = sampling.oversample(df, keys[:-1]).withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(n))))
    elif callable(kind):  # a function of the rows of one tree
        parts = [kind(rows.filter(F.col("tree") == t).drop("tree"), f"{o.seed}-{t}").withColumn("tree", F.lit(t)).select(*rows.columns) for t in range(1, n + 1)]
        out = reduce(DataFrame.unionByName, parts)
    elif kind == "random":
        out = _random_samples(rows, df, o, seed, keys)
    else:
        out = {
            "nothing": lambda: rows, "subagging": lambda: sampling.subagging(rows, seed, keys=keys), "undersample": lambda: sampling.undersample(rows, seed, keys),
            "triangle-variance": lambda: sampling.triangle_sample(rows, seed, *spread), "uniform-variance": lambda: sampling.uniform_sample(rows, seed, *spread[:3]),
        }[kind]()
    return out.withColumn("tree", number.cast("int")).select(*[c for c in df.columns if c != "_for"], "tree")


def _spread(ex: ExampleSet, o: Options, group: str | None = None) -> DataFrame:
    """_bags() in as many even partitions as dealt() makes; a bootstrap has them already."""
    bags = _bags(ex, o, group)
    return bags if o.example_sampling == "bagging" else dealt(bags, "tree", "id")


def _random_samples(rows: DataFrame, df: DataFrame, o: Options, seed: Column, keys: tuple[str, ...]) -> DataFrame:
    """For each tree a triangle, uniform or bootstrap sample, by one draw of its seed."""
    each = df.sparkSession.range(1, o.trees + 1).withColumnRenamed("id", "tree")
    x = {r[0]: r[1] for r in each.select("tree", u(seed, "choice")).collect()}  # a row for each tree
    among = lambda ts: rows.filter(F.col("tree").isin(ts))
    low, high, mid = [t for t, v in x.items() if v <= 0.33], [t for t, v in x.items() if v >= 0.66], [t for t, v in x.items() if 0.33 < v < 0.66]
    parts = [sampling.triangle_sample(among(low), seed)] * bool(low) + [sampling.uniform_sample(among(high), seed)] * bool(high)
    group = [k for k in keys if k != "tree"]
    parts += [sampling.bootstrap(df, f"{o.seed}-{t}", within=group or None).withColumn("tree", F.lit(t)) for t in mid]
    return reduce(DataFrame.unionByName, [p.select(*rows.columns) for p in parts])


@dataclass
class ForestModel:
    nodes: DataFrame
    features: tuple[Feature, ...]
    options: Options

    def leaves(self, df: DataFrame) -> DataFrame:
        """id, actual, tree, node, pred and laplace of each row in each tree.

        A missing value goes where most of the known ones went, or as the strategy draws; with ignore the row stays.
        Up to LITERAL nodes are a literal of the plan, an array for each tree, which rows walk.  Rows of larger models walk
        arrays in tasks; where splits aren't of single features, or rows draw, they walk a level a time, joined with its nodes.
        """
        sizes = self._sizes()
        if self._walks(sizes):
            place, nodes = F.posexplode("ends").alias("_tree", "_end"), self._own_nodes()
            ends = self._ends(df.select("id", F.col("class").alias("actual"), *[f"`{f.name}`" for f in self.features]), ["id", "actual"])
            rows = ends.select("id", "actual", place).join(small(nodes.drop("tree"), sum(sizes.values())), "_end")
            return rows.select("id", "actual", (F.col("_tree") + 1).alias("tree"), "node", F.col("class").alias("pred"), "laplace")
        at = df.select("id", F.col("class").alias("actual"), *[v.alias(k) for k, v in values_of(self.features).items()])
        at = dealt(at, "id").withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(self.options.trees))))  # votes meet by id anyway
        if not 0 < sum(sizes.values()) <= LITERAL:
            return self._by_level(at, sizes)
        nodes = self._packed()
        end = F.get(F.get(nodes, F.col("tree") - 1), self._walked(nodes, max(sizes)))
        rows = at.select("id", "actual", "tree", end.alias("_end"))
        return rows.select("id", "actual", "tree", F.col("_end.node").alias("node"), F.col("_end.class").alias("pred"), F.col("_end.laplace").alias("laplace"))

    def _sizes(self) -> dict[int, int]:
        return dict(map(tuple, self.nodes.groupBy("depth").count().collect()))  # a row for each depth

    def _walks(self, sizes: dict[int, int]) -> bool:
        """Whether rows walk arrays in tasks."""
        o = self.options
        alone = isinstance(o.branch, str) and o.branch not in (*PAIRED, *RULED) and not callable(o.distribute)
        return alone and isinstance(o.missing, str) and o.missing in (*DECIDED, "proximity") and ARRAYS < sum(sizes.values()) <= BROADCAST_ROWS

    def _collected(self) -> tuple[pa.Table, Nodes, dict[int, list[str]], np.ndarray]:
        """The nodes, BROADCAST_ROWS at most, as a table and as arrays, the words of their splits, and the places of the table's rows in the arrays."""
        table = self.nodes.select("tree", "node", "kind", "ordinal", "threshold", "category", "n_left", "n_right", "class", "laplace").toArrow()
        return table, *walked(table, self.options.trees, "weighted" if self.options.missing == "proximity" else self.options.missing)

    def _ends(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """The columns kept of df (which has the features) and ends: for each tree the place of the node where the row ends."""
        _, nodes, words, _ = self._collected()

        def give(rows: pa.Table, ends: np.ndarray) -> pa.Table:
            starts = pa.array(np.arange(len(ends) + 1, dtype=np.int32) * ends.shape[1])
            return rows.append_column("ends", pa.ListArray.from_arrays(starts, pa.array(ends.reshape(-1))))

        return ended(dealt(df, "id"), keep, self.features, nodes, words, self.options.trees, give, f"{kept(df, keep)}, ends array<int>")

    def _own_nodes(self) -> DataFrame:
        """tree, node, class and laplace of the nodes by their places, as _end."""
        table, _, _, places = self._collected()
        return self.nodes.sparkSession.createDataFrame(table.select(["tree", "node", "class", "laplace"]).append_column("_end", pa.array(places, pa.int32())))

    def _packed(self) -> Column:
        """For each tree an array of its nodes, in which a node knows the places of its children."""
        own = self.nodes.select("tree", F.struct("node", *SPLIT_COLUMNS, "kind", "n_left", "n_right", "class", "laplace").alias("n"))
        trees = [[] for _ in range(self.options.trees)]
        for r in own.collect():  # LITERAL nodes at most
            trees[r["tree"] - 1].append(r["n"].asDict(True))
        for nodes in trees:
            nodes.sort(key=lambda n: (len(n["node"]), n["node"]))
            place = {n["node"]: i for i, n in enumerate(nodes)}
            for n in nodes:
                n |= {"left": place.get(n["node"] + "0"), "right": place.get(n["node"] + "1")}
        kind = own.schema["n"].dataType.add("left", IntegerType()).add("right", IntegerType()).simpleString()
        return F.from_json(F.lit(json.dumps(trees)), f"array<array<{kind}>>")

    def _walked(self, nodes: Column, depth: int) -> Column:
        """The place of the node where a row ends."""
        o = self.options

        def step(at: Column, _: Column) -> Column:
            n = lambda c: F.get(F.get(nodes, F.col("tree") - 1), at)[c]
            draw = u(o.seed, "predict", F.col("tree"), n("node"), F.col("id"))
            lost = split.missing_side("weighted" if o.missing == "proximity" else o.missing, n("n_left"), n("n_right"), draw)
            to = lambda side: F.when(side == split.LEFT, n("left")).when(side == split.RIGHT, n("right")).otherwise(at)
            moved = lambda _, side: F.when(side == split.MISSING, to(lost)).otherwise(to(side))
            return F.when(n("kind") == "node", F.aggregate(F.array(side_of(o, n)), at, moved)).otherwise(at)  # the side is found once

        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step) if depth else F.lit(0)

    def _by_level(self, at: DataFrame, sizes: dict[int, int]) -> DataFrame:
        o, nodes = self.options, self.nodes
        at = at.withColumns({"node": F.lit("1"), "pred": F.lit(None).cast("string"), "laplace": F.lit(None).cast("double")})
        draw = u(o.seed, "predict", F.col("tree"), F.col("node"), F.col("id"))
        lost = split.missing_side("weighted" if o.missing == "proximity" else o.missing, F.col("n_left"), F.col("n_right"), draw)
        side = side_of(o)
        side = F.when(F.col("kind") == "node", F.when(side == split.MISSING, lost).otherwise(side))
        here = nodes.select(*AT, "kind", *SPLIT_COLUMNS, "n_left", "n_right", F.col("class").alias("_class"), F.col("laplace").alias("_laplace"), "depth")
        for depth in sorted(sizes):
            rows = at.join(small(here.filter(F.col("depth") == depth).drop("depth"), sizes[depth]), AT, "left")
            moved = F.when(side == "left", F.concat("node", F.lit("0"))).when(side == "right", F.concat("node", F.lit("1"))).otherwise(F.col("node"))
            at = rows.withColumns({"node": moved, "pred": F.coalesce("_class", "pred"), "laplace": F.coalesce("_laplace", "laplace")}).select(*at.columns)
        return at.select("id", "actual", "tree", "node", "pred", "laplace")

    def votes(self, df: DataFrame) -> DataFrame:
        return self.leaves(df).select("id", "actual", "tree", "pred")

    def transform(self, df: DataFrame) -> DataFrame:
        if self._walks(self._sizes()):
            return metrics.probabilities_of(self._counted(df), self.options.trees)
        return metrics.probabilities(self.votes(df), self.options.trees)

    def _counted(self, df: DataFrame) -> DataFrame:
        """id, actual, class and n: how many trees vote for a class, a row for each class with votes."""
        table, nodes, words, places = self._collected()
        classes = pc.dictionary_encode(table["class"], null_encoding="encode").combine_chunks()
        vote = np.zeros(len(table), np.int64)
        vote[places] = classes.indices.to_numpy()
        k, known = len(classes.dictionary), classes.dictionary

        def give(rows: pa.Table, ends: np.ndarray) -> pa.Table:
            pairs, n = np.unique(np.arange(len(ends))[:, None] * k + vote[ends], return_counts=True)
            return rows.take(pa.array(pairs // k)).append_column("class", known.take(pa.array(pairs % k))).append_column("n", pa.array(n.astype(np.int64)))

        df = df.select("id", F.col("class").alias("actual"), *[f"`{f.name}`" for f in self.features])
        keep = ["id", "actual"]
        return ended(dealt(df, "id"), keep, self.features, nodes, words, self.options.trees, give, f"{kept(df, keep)}, class string, n bigint")

    def vote_lists(self, df: DataFrame) -> DataFrame:
        """id, class and a 0 or 1 for each tree in order."""
        v = self.votes(df)
        v = stored(v, "votes")
        some = stored(v.select(F.col("pred").alias("class")).distinct(), "classes")  # those that any row got
        lists = v.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "pred"))), lambda s: s["pred"]).alias("preds"))  # a vote for each tree
        rows = lists.crossJoin(small(some, some.count()))
        return rows.select("id", "class", F.transform("preds", lambda p: (p == F.col("class")).cast("int")).alias("votes"))

    def query_trees(self, df: DataFrame, keys: list[str], values: list, fold, only: DataFrame | None = None) -> DataFrame:
        """A fold of what all trees say: values are columns of leaves() (id, actual, tree, node, pred, laplace), keys some of them.

        only: (tree, id) of the rows to ask of each tree.
        """
        rows = self.leaves(df)
        return folded(rows if only is None else rows.join(only.select("tree", "id"), ["tree", "id"], "left_semi"), keys, values, fold)

    def importance(self) -> DataFrame:
        """feature and importance: gains as shares of their tree's, over the number of trees."""
        per = self.nodes.filter("kind = 'node'").groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
        share = F.try_divide("g", F.sum("g").over(Window.partitionBy("tree")))
        return per.select("feature", share.alias("s")).groupBy("feature").agg((F.sum("s") / self.options.trees).alias("importance"))

    def n_rules(self) -> DataFrame:
        return self.nodes.agg(F.count(F.when(F.col("kind") == "leaf", 1)).alias("n_rules"))

    def oob_accuracy(self, ex: DataFrame, bags: DataFrame) -> DataFrame:
        out = sampling.out_of_bag(ex, bags, self.options.trees).select("tree", "id")
        rows = self.votes(ex).join(out, ["tree", "id"])
        return rows.groupBy("tree").agg(F.avg(F.when(F.col("pred") == F.col("actual"), 1.0).otherwise(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))

    def proximity(self, df: DataFrame, queries: DataFrame, k: int = 5, counts: dict | None = None) -> DataFrame:
        """The k rows that share most leaves with each query (a stated set), by the share of trees; of equals the least ids.

        Rows in the same leaf of every tree are one class, for which the k + 1 with the least ids speak.  Leaves list
        their classes.  A query reads the lists of its leaves, the rarest first; what it finds is compared in all trees
        at once.  A class in none of the lists read shares no more than the other trees, so a query ends when its k + 1-th
        place shares more than that.  Long lists are split in deals.  counts: gets the classes compared, and all pairs.
        """
        n_trees, depths = self.options.trees, self._sizes()

        def paths(rows: DataFrame, name: str) -> DataFrame:
            if self._walks(depths):
                return self._ends(rows.select("id", *[f"`{f.name}`" for f in self.features]), ["id"]).withColumnRenamed("ends", name)
            by_tree = F.array_sort(F.collect_list(F.struct("tree", F.xxhash64("node").alias("leaf"))))  # a struct for each tree
            return self.leaves(rows).groupBy("id").agg(F.transform(by_tree, lambda s: s["leaf"]).alias(name))

        least = top(paths(df, "theirs"), ["theirs"], ["id"], k + 1, by=F.col("id"))
        classes = stored(least.groupBy("theirs").agg(F.collect_list("id").alias("ids")), "classes")  # k + 1 at most
        q = stored(paths(queries, "mine").withColumnRenamed("id", "query"), "queries")
        lists = classes.select("theirs", "ids", F.posexplode("theirs").alias("tree", "leaf"))
        sizes = stored(lists.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")), "sizes")
        deals = sizes.select("tree", "leaf", F.ceil(F.col("n") / LIST).cast("int").alias("deals"))
        long = deals.filter("deals > 1")
        dealt = lists.join(long, ["tree", "leaf"], "left").withColumn("deal", F.when(F.col("deals").isNotNull(), F.pmod(F.xxhash64("theirs"), F.col("deals"))).otherwise(0).cast("int")).drop("deals")
        own = q.select("mine").distinct().select("mine", F.posexplode("mine").alias("tree", "leaf")).join(sizes, ["tree", "leaf"], "left")
        rarest = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "tree"))), lambda s: s["tree"])  # a struct for each tree
        active = asked = stored(own.groupBy("mine").agg(rarest.alias("order")), "asked")
        best, read, compared = None, 0, 0
        while read < n_trees:
            now = max(1, min(read, n_trees - read))  # 1, 1, 2, 4, ...
            wanted = active.select("mine", "order", F.explode(F.sequence(F.lit(read), F.lit(read + now - 1))).alias("nth")).withColumn("tree", F.get("order", F.col("nth")))
            wanted = wanted.withColumn("leaf", F.get("mine", F.col("tree"))).join(long, ["tree", "leaf"], "left")
            wanted = wanted.withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
            before = F.exists(F.slice("order", F.lit(1), F.col("nth")), lambda t: F.get("mine", t) == F.get("theirs", t))
            pairs = wanted.join(dealt, ["tree", "leaf", "deal"]).filter(~before)
            same = F.aggregate(F.zip_with("mine", "theirs", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
            if counts is not None:
                compared += pairs.count()
            found = pairs.select("mine", same.alias("shared"), F.explode("ids").alias("id"))
            found = found if best is None else found.unionByName(best)
            last, best = best, stored(top(found, ["mine"], [F.desc("shared"), "id"], k + 1, by=F.col("id")), "best")
            read += now
            if last is not None:
                discard(last)
            if read < n_trees:
                worst = best.groupBy("mine").agg(F.when(F.count(F.lit(1)) > k, F.min("shared")).alias("worst"))
                active = stored(active.join(worst, "mine", "left").filter(F.coalesce("worst", F.lit(0)) <= n_trees - read).select("mine", "order"), "active")
                if active.isEmpty():
                    break
        if counts is not None:
            counts |= {"compared": compared, "all": asked.count() * classes.count(), "read": read}
        near = best.groupBy("mine").agg(F.collect_list(F.struct("shared", "id")).alias("near")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))  # k + 1 at most
        pairs = q.withColumn("deal", F.pmod(F.xxhash64("query"), F.lit(DEALS)).cast("int")).join(near, ["mine", "deal"])
        pairs = pairs.select("query", F.explode("near").alias("n")).select("query", "n.id", (F.col("n.shared") / float(n_trees)).alias("proximity")).filter("id <> query")
        return top(pairs, ["query"], [F.desc("proximity"), "id"], k, rank="rank", parts=1)

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        meta = {"version": VERSION, "options": self.options.as_dict(), "features": [asdict(f) for f in self.features]}
        self.nodes.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if meta["version"] != VERSION:
            raise ValueError(f"invalid version: {meta['version']}")
        return cls(spark.read.parquet(f"{path}/nodes"), tuple(Feature(**f) for f in meta["features"]), Options(**meta["options"]))


def impute_by_proximity(ex: ExampleSet, model: ForestModel, k: int = 5) -> ExampleSet:
    """Missing values from the k rows nearest by proximity: mean or most frequent value."""
    gaps = ex.df.filter(" OR ".join(f"`{f.name}` IS NULL" for f in ex.features))
    near = model.proximity(ex.df, gaps, k).select("query", "id").join(ex.df.select("id", *ex.names()), "id")
    fill = [(F.avg(f.name) if f.kind == "numeric" else F.mode(F.col(f.name), True)).alias(f"_{f.name}") for f in ex.features]
    filled = ex.df.join(near.groupBy(F.col("query").alias("id")).agg(*fill), "id", "left")
    return ex.with_df(filled.select("id", "class", "weight", *[F.coalesce(f.name, f"_{f.name}").alias(f.name) for f in ex.features]))


def fit(ex: ExampleSet, options: Options = Options(), **changes) -> tuple[ForestModel, DataFrame]:
    """The model and its in-bag rows."""
    o = replace(options, **changes)
    if o.missing == "proximity":
        first, _ = fit(ex, replace(o, missing="weighted"))
        ex = impute_by_proximity(ex, first)
        o = replace(o, missing="weighted")
    bags = stored(_spread(ex, o), "bags")
    return ForestModel(stored(grow(ex, o, bags), "forest"), ex.features, o), bags


def build(ex: ExampleSet, options: Options, path: str, batch: int = 5, most: int | None = None) -> ForestModel:
    """fit() in batches of trees, each a table under path: a later run takes up those that are there and grows the others.

    A tree draws by its own number, so batches give the trees that one run gives.  Other options or another batch size than
    those of the path are an error.  most: batches to grow in this run.
    """
    spark = ex.df.sparkSession
    if options.missing == "proximity":
        raise ValueError("missing=proximity needs all trees at once")
    meta = json.dumps({"version": VERSION, "options": options.as_dict(), "features": [asdict(f) for f in ex.features], "batch": batch}, sort_keys=True)
    if _exists(spark, f"{path}/meta/_SUCCESS"):
        if (have := spark.read.text(f"{path}/meta").first()[0]) != meta:
            raise ValueError(f"{path} has trees of other settings: {have}")
    else:
        spark.createDataFrame([(meta,)], "value string").write.mode("overwrite").text(f"{path}/meta")
    todo = [b for b in range(-(-options.trees // batch)) if not _exists(spark, f"{path}/batch-{b}/_SUCCESS")][:most]
    bags = stored(_spread(ex, options), "bags") if todo else None
    for b in todo:
        own = range(b * batch + 1, min(options.trees, (b + 1) * batch) + 1)
        grow(ex, options, bags.filter(F.col("tree").between(own[0], own[-1])), own).write.mode("overwrite").parquet(f"{path}/batch-{b}")
    if todo:
        discard(bags)
    return partial(spark, path)


def partial(spark: SparkSession, path: str) -> ForestModel:
    """The forest of the batches that build() has finished; it votes with the trees that there are."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    o, size = Options(**meta["options"]), meta["batch"]
    done = [b for b in range(-(-o.trees // size)) if _exists(spark, f"{path}/batch-{b}/_SUCCESS")]
    if not done:
        raise ValueError(f"{path} has no trees yet")
    trees = [t for b in done for t in range(b * size + 1, min(o.trees, (b + 1) * size) + 1)]
    nodes = spark.read.parquet(*[f"{path}/batch-{b}" for b in done])
    if trees != list(range(1, len(trees) + 1)):  # a batch before others is missing: the trees get numbers in turn
        number = F.create_map(*[F.lit(x) for i, t in enumerate(trees, 1) for x in (t, i)])
        nodes = nodes.withColumn("tree", number[F.col("tree")])
    return ForestModel(nodes, tuple(Feature(**f) for f in meta["features"]), replace(o, trees=len(trees)))


def _exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(file)


def fit_groups(ex: ExampleSet, group: str, groups: int, options: Options) -> list[tuple[ForestModel, DataFrame]]:
    """For each number of the column group a model of the other rows and its in-bag rows, as fit() of these gives.

    All of them grow in one plan: a tree of a group is a tree like any other, so the jobs don't grow with the groups.
    """
    o = replace(options, groups=groups)
    bags = stored(_spread(ex, o, group), "bags")
    nodes = stored(grow(ex, o, bags), "forests")
    own = lambda df, g: df.filter(F.ceil(F.col("tree") / o.trees) == g).withColumn("tree", F.col("tree") - (g - 1) * o.trees)
    return [(ForestModel(own(nodes, g), ex.features, options), own(bags, g)) for g in range(1, groups + 1)]
