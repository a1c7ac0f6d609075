"""Queries over the driver's tables for the operators, and independent SQL for those that SQL can express.

Example set O: orders by o_orderstatus; E: events by event_type; V: five votes for each order, made by
hashes, for the measures.  Missing values are made by hashes too.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse import oracles
from copse.functions import measures
from copse.functions.rng import u
from copse.operators import clusters, examples, metrics, neighbors, rules, sampling, split
from copse.operators.cells import nearest_in_cells
from copse.operators.examples import ExampleSet
from copse.oracles import U, ForestSQL
from copse.plans import bagging, folds, forest, validate
from copse.plans.tables import shared_dir

TREES = 5
#: Features of example set O, in order.
O_FEATURES = [("o_totalprice", "numeric"), ("month", "numeric"), ("o_orderpriority", "categoric")]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark, d) -> ExampleSet:
    df = _table(spark, d, "orders").withColumn("month", F.month("o_orderdate"))
    return ExampleSet.of(df, "o_orderkey", "o_orderstatus", ("o_totalprice", "month"), ("o_orderpriority",))


def gappy_orders(spark, d) -> ExampleSet:
    ex = orders(spark, d)
    return ex.with_df(ex.df.withColumn("o_totalprice", F.when(u("gap", F.col("id")) >= 0.1, F.col("o_totalprice"))))


def events(spark, d) -> ExampleSet:
    df = _table(spark, d, "events").withColumn("hour", F.hour("ts"))
    return ExampleSet.of(df, "event_id", "event_type", ("value", "hour"), ())


def votes(spark, d) -> DataFrame:
    ids = orders(spark, d).df.select("id", F.col("class").alias("actual")).withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(TREES))))
    drawn = F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.floor(u("other", F.col("tree"), F.col("id")) * 3) + 1).cast("int"))
    return ids.withColumn("pred", F.when(u("hit", F.col("tree"), F.col("id")) < 0.6, F.col("actual")).otherwise(drawn))


def probs(spark, d) -> DataFrame:
    return metrics.probabilities(votes(spark, d), TREES)


O_SQL = "SELECT o_orderkey AS id, o_orderstatus AS class, o_totalprice, month(o_orderdate)::DOUBLE AS month, o_orderpriority FROM orders"
G_SQL = f"SELECT id, class, CASE WHEN {U('gap', 'id')} >= 0.1 THEN o_totalprice END AS o_totalprice, month, o_orderpriority FROM ({O_SQL})"
E_SQL = "SELECT event_id AS id, event_type AS class, value, hour(ts)::DOUBLE AS hour FROM events"
V_SQL = f"""SELECT id, class AS actual, tree, CASE WHEN {U('hit', 'tree', 'id')} < 0.6 THEN class
  ELSE ['F', 'O', 'P'][(floor({U('other', 'tree', 'id')} * 3) + 1)::INT] END AS pred FROM ({O_SQL}), range(1, {TREES + 1}) t(tree)"""
P_SQL = oracles.probabilities(V_SQL, TREES)
R6 = lambda c: F.round(c, 6).alias(c)


def _catalogue() -> dict:
    q: dict = {}

    def add(name, run, sql=None):
        q[name] = (run, sql)

    # Rows and classes.
    add("class_distribution", lambda s, d: examples.class_distribution(orders(s, d).df), f"SELECT class, count(*) AS n, count(*)::DOUBLE AS w FROM ({O_SQL}) GROUP BY class")
    add("class_coverage_binary", lambda s, d: examples.coverage(examples.to_binary(orders(s, d).df, "F")), f"SELECT sum((class = 'F')::INT)::DOUBLE AS pos, sum((class <> 'F')::INT)::DOUBLE AS neg FROM ({O_SQL})")
    add("majority_class", lambda s, d: examples.majority(orders(s, d).df), f"SELECT class, w FROM (SELECT class, count(*)::DOUBLE AS w FROM ({O_SQL}) GROUP BY class) ORDER BY w DESC, class LIMIT 1")
    add("feature_ranges", lambda s, d: examples.feature_ranges(orders(s, d).df, ["o_totalprice", "month"]).select("feature", "low", "high", R6("mean")),
        f"SELECT 'o_totalprice' AS feature, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 6) AS mean FROM orders UNION ALL SELECT 'month', min(month), max(month), round(avg(month), 6) FROM ({O_SQL})")
    add("feature_modes", lambda s, d: examples.modes(orders(s, d).df, ["o_orderpriority"]), "SELECT 'o_orderpriority' AS feature, o_orderpriority AS mode FROM orders GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 1")
    add("weight_excluding", lambda s, d: examples.weight_excluding(orders(s, d).df, "F"), f"SELECT count(*)::DOUBLE AS w FROM ({O_SQL}) WHERE class <> 'F'")
    add("remove_covered", lambda s, d: examples.remove_covered(orders(s, d).df, orders(s, d).df.filter("month >= 6")).select("id", "class"), f"SELECT id, class FROM ({O_SQL}) WHERE NOT month >= 6")

    # Sampling.
    place = f"SELECT *, row_number() OVER (ORDER BY {U('b', chr(39) + 'order' + chr(39), 'id')}, id) AS place FROM ({O_SQL})"
    drawn = f"SELECT (floor({U('b', 'draw')} * (SELECT count(*) FROM orders)) + 1)::BIGINT AS place FROM range(1, (SELECT count(*) FROM orders) + 1) t(draw)"
    bag = f"SELECT id, class, times::DOUBLE AS weight FROM ({place}) JOIN (SELECT place, count(*) AS times FROM ({drawn}) GROUP BY place) USING (place)"
    add("bootstrap_inbag", lambda s, d: sampling.bootstrap(orders(s, d).df, "b").select("id", "class", "weight"), bag)
    add("bootstrap_oob", lambda s, d: sampling.out_of_bag(orders(s, d).df, sampling.bootstrap(orders(s, d).df, "b")).select("id", "class"), f"SELECT id, class FROM ({O_SQL}) WHERE id NOT IN (SELECT id FROM ({bag}))")
    add("oversample_weights", lambda s, d: sampling.oversample(orders(s, d).df).groupBy("class").agg(F.round(F.sum("weight"), 4).alias("w"), F.round(F.max("weight"), 9).alias("each")),
        f"WITH c AS (SELECT class, count(*)::DOUBLE AS n FROM ({O_SQL}) GROUP BY class) SELECT class, round((SELECT max(n) FROM c), 4) AS w, round((SELECT max(n) FROM c) / n, 9) AS each FROM c")
    add("undersample_ids", lambda s, d: sampling.undersample(orders(s, d).df, "x").select("id", "class"),
        f"SELECT id, class FROM (SELECT id, class, row_number() OVER (PARTITION BY class ORDER BY {U('x', chr(39) + 'under' + chr(39), 'id')}, id) AS r FROM ({O_SQL})) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))")
    tri = f"CASE WHEN x < 1.0 / 9 THEN 1 + sqrt(x * 9 * 1) ELSE 10 - sqrt((1 - x) * 9 * 8) END"
    q1 = lambda t: f"'{t}'"
    add("triangle_sample", lambda s, d: sampling.triangle_sample(orders(s, d).df, "t").select("id", "weight"), f"SELECT id, floor({tri} + 0.5)::DOUBLE AS weight FROM (SELECT id, {U('t', q1('w'), 'id')} AS x FROM ({O_SQL}) WHERE {U('t', q1('in'), 'id')} > 0.3)")
    add("uniform_sample", lambda s, d: sampling.uniform_sample(orders(s, d).df, "n").select("id", "weight"), f"SELECT id, floor(1 + {U('n', q1('w'), 'id')} * 10 + 0.5)::DOUBLE AS weight FROM ({O_SQL}) WHERE {U('n', q1('in'), 'id')} > 0.3")
    ranks = lambda tag: f"SELECT *, row_number() OVER (PARTITION BY class ORDER BY {U('s', q1(tag), 'id')}, id) AS r, count(*) OVER (PARTITION BY class) AS n FROM ({O_SQL})"
    add("subset_fraction", lambda s, d: sampling.subset(orders(s, d).df, 0.2, "s").select("id", "class"), f"SELECT id, class FROM ({ranks('subset')}) WHERE r <= floor(n * 0.2::DOUBLE + 0.5)")
    add("subset_absolute", lambda s, d: sampling.subset(orders(s, d).df, 100, "s").select("id", "class"), f"SELECT id, class FROM ({O_SQL}) ORDER BY {U('s', q1('subset'), 'id')}, id LIMIT 100")
    add("train_test_split", lambda s, d: sampling.train_test_split(orders(s, d).df, 0.66, "s").select("id", "class", "train"), f"SELECT id, class, r <= floor(n * 0.66::DOUBLE + 0.5) AS train FROM ({ranks('split')})")
    add("stratified_folds", lambda s, d: sampling.stratified_folds(orders(s, d).df, 10, "s").select("id", "class", "fold"), f"SELECT id, class, (row_number() OVER (ORDER BY class, {U('s', q1('fold'), 'id')}, id) - 1) % 10 + 1 AS fold FROM ({O_SQL})")
    add("shuffle_order", lambda s, d: sampling.shuffled(events(s, d).df, "s").select("id", "place"), f"SELECT id, row_number() OVER (ORDER BY {U('s', q1('shuffle'), 'id')}, id) AS place FROM ({E_SQL})")
    add("random_feature_subset", lambda s, d: sampling.random_features(s, ["a", "b", "c", "d", "e"], 2, "s", _table(s, d, "nation").select("n_nationkey")),
        f"SELECT n_nationkey, feature FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY {U('s', q1('feature'), 'n_nationkey', 'feature')}, feature) AS r FROM nation, (SELECT unnest(['a', 'b', 'c', 'd', 'e']) AS feature)) WHERE r <= 2")
    pick = f"""WITH m AS (SELECT class, arg_min(id, ({U('p', q1('member'), 'id')}, id)) AS id FROM ({E_SQL}) GROUP BY class),
      r AS (SELECT *, row_number() OVER (ORDER BY {U('p', q1('class'), 'class')}, class) AS r FROM m)
      SELECT a.class AS class_a, b.class AS class_b, x.value AS a, y.value AS b, (x.value + y.value) / 2 AS threshold FROM r a, r b, ({E_SQL}) x, ({E_SQL}) y WHERE a.r = 1 AND b.r = 2 AND x.id = a.id AND y.id = b.id"""
    add("random_threshold_pair", lambda s, d: sampling.sample_pair(events(s, d).df, "p").select("class_a", "class_b", F.col("a.value").alias("a"), F.col("b.value").alias("b"), ((F.col("a.value") + F.col("b.value")) / 2).alias("threshold")), pick)
    add("partition_round_robin", lambda s, d: sampling.partition(orders(s, d).df, 7, "s").select("id", "part"), f"SELECT id, (row_number() OVER (ORDER BY {U('s', q1('part'), 'id')}, id) - 1) % 7 AS part FROM ({O_SQL})")
    one = f"SELECT class, arg_min(id, ({U('p', q1('member'), 'id')}, id)) AS id FROM ({E_SQL}) GROUP BY class"
    add("random_example", lambda s, d: sampling.sample_one(events(s, d).df, "p").select("id", "class"), f"SELECT id, class FROM ({one}) ORDER BY {U('p', q1('class'), 'class')}, class LIMIT 1")
    add("weighted_random_pick", lambda s, d: sampling.weighted_pick(_table(s, d, "nation").selectExpr("n_nationkey as item", "cast(n_nationkey + 1 as double) as weight"), 1000, "w").groupBy("item").agg(F.count(F.lit(1)).alias("n")),
        f"WITH e AS (SELECT n_nationkey AS item, sum(n_nationkey + 1.0::DOUBLE) OVER (ORDER BY n_nationkey) / (SELECT sum(n_nationkey + 1.0::DOUBLE) FROM nation) AS e FROM nation), x AS (SELECT draw, {U('w', q1('pick'), 'draw')} AS x FROM range(1, 1001) t(draw)) SELECT item, count(*) AS n FROM (SELECT draw, min(item) AS item FROM x JOIN e ON e > x GROUP BY draw) GROUP BY item")

    # Sides and missing values.
    urgent = lambda: split.categoric_side(F.col("o_orderpriority"), F.lit("1-URGENT"))
    sided = lambda s, d: gappy_orders(s, d).df.withColumn("side", split.numeric_side(F.col("o_totalprice"), F.lit(150000.0)))
    side_sql = "CASE WHEN o_totalprice IS NULL THEN '?' WHEN o_totalprice >= 150000 THEN 'left' ELSE 'right' END"
    prio_sql = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'left' ELSE 'right' END"
    add("distribute_numeric", lambda s, d: sided(s, d).select("id", "side"), f"SELECT id, {side_sql} AS side FROM ({G_SQL})")
    add("distribute_categoric", lambda s, d: orders(s, d).df.select("id", urgent().alias("side")), f"SELECT id, {prio_sql} AS side FROM ({O_SQL})")
    add("distribute_combined", lambda s, d: sided(s, d).select("id", split.combined_side(F.col("side"), urgent(), u("coin", F.col("id"))).alias("side")),
        f"SELECT id, CASE WHEN a = b THEN a WHEN a = '?' THEN b WHEN {U('coin', 'id')} <= 0.5 THEN 'left' ELSE 'right' END AS side FROM (SELECT id, {side_sql} AS a, {prio_sql} AS b FROM ({G_SQL}))")
    both = lambda: [F.col("side"), urgent(), split.numeric_side(F.col("month"), F.lit(6.0))]
    three = f"SELECT id, {side_sql} AS a, {prio_sql} AS b, CASE WHEN month >= 6 THEN 'left' ELSE 'right' END AS c FROM ({G_SQL})"
    add("distribute_rule", lambda s, d: sided(s, d).select("id", split.rule_side(both()).alias("side")), f"SELECT id, CASE WHEN a <> 'left' THEN a WHEN b <> 'left' THEN b ELSE c END AS side FROM ({three})")
    add("distribute_rule_weighted", lambda s, d: sided(s, d).select("id", *[F.round(v, 6).alias(k) for k, v in split.rule_shares(both()).items()]),
        "SELECT id, " + ", ".join(f"round(((a = '{t}')::INT + (b = '{t}')::INT + (c = '{t}')::INT) / 3.0::DOUBLE, 6) AS {n}" for n, t in (("left", "left"), ("right", "right"), ("missing", "?"))) + f" FROM ({three})")
    base = f"SELECT id, side, sum((side = 'left')::INT) OVER () AS l, sum((side = 'right')::INT) OVER () AS r, {U('m', q1('missing'), 'id')} AS u FROM (SELECT id, {side_sql} AS side FROM ({G_SQL}))"
    lost = {"weighted": "CASE WHEN l > 0 AND l / (l + r) >= 0.5 THEN 'left' ELSE 'right' END", "random": "CASE WHEN u <= 0.5 THEN 'left' ELSE 'right' END", "randomw": "CASE WHEN u <= (l + 1) / (l + r + 2) THEN 'left' ELSE 'right' END", "left": "'left'", "right": "'right'", "ignore": "NULL"}
    for kind, case in lost.items():
        add(f"missing_{kind}", lambda s, d, kind=kind: split.place_missing(sided(s, d), kind, [], "m").select("id", "side", R6("weight")), f"SELECT * FROM (SELECT id, CASE WHEN side = '?' THEN {case} ELSE side END AS side, 1.0::DOUBLE AS weight FROM ({base})) WHERE side IS NOT NULL")
    for kind, share in (("partition", "0.5::DOUBLE"), ("wpartition", "((l + 1) / (l + r + 2))::DOUBLE")):
        add(f"missing_{kind}", lambda s, d, kind=kind: split.place_missing(sided(s, d), kind, [], "m").select("id", "side", R6("weight")),
            f"WITH b AS ({base}) SELECT id, side, 1.0::DOUBLE AS weight FROM b WHERE side <> '?' UNION ALL SELECT id, 'left', round({share}, 6) FROM b WHERE side = '?' UNION ALL SELECT id, 'right', round(1 - {share}, 6) FROM b WHERE side = '?'")
    exact = f"""WITH e AS ({E_SQL}), v AS (SELECT DISTINCT hour FROM e), c AS (SELECT (hour + lag(hour) OVER (ORDER BY hour)) / 2 AS cut FROM v),
      k AS (SELECT cut, class, sum((hour < cut)::INT)::DOUBLE AS a, sum((hour >= cut)::INT)::DOUBLE AS b FROM c, e WHERE cut IS NOT NULL GROUP BY ALL),
      x AS (SELECT cut, round(sum(a) * ln(sum(a)) - sum(CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END) + sum(b) * ln(sum(b)) - sum(CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END), 6) AS score FROM k GROUP BY cut)
      SELECT cut AS threshold, score FROM x ORDER BY score, cut LIMIT 1"""
    add("exact_best_threshold", lambda s, d: split.exact_thresholds(events(s, d).df, "hour", []), exact)

    # Split measures: a candidate for each month.
    def counted(s, d):
        df = orders(s, d).df.withColumn("cut", F.explode(F.sequence(F.lit(2), F.lit(12))))
        return measures.class_counts(df.withColumn("side", split.numeric_side(F.col("month"), F.col("cut").cast("double"))), ["cut"])

    k = f"""WITH k AS (SELECT cut, class, sum((month >= cut)::INT)::DOUBLE AS l, sum((month < cut)::INT)::DOUBLE AS r FROM ({O_SQL}), range(2, 13) t(cut) GROUP BY ALL),
      s AS (SELECT *, l / (l + r) AS p0, r / (l + r) AS q0 FROM k), z AS (SELECT *, p0 / sum(p0) OVER (PARTITION BY cut) AS p, q0 / sum(q0) OVER (PARTITION BY cut) AS q FROM s),
      g AS (SELECT cut, -sum(l * ln(l / wl)) - sum(r * ln(r / wr)) AS info, 1 - (sum((l / wl) ** 2) + sum((r / wr) ** 2)) AS gini, sum(sqrt(p * q)) AS bc, 0.5 * sum((sqrt(p) - sqrt(q)) ** 2) AS half,
        sum((p * log2(p) + q * log2(q)) / 2 - (p + q) / 2 * log2((p + q) / 2)) AS jd FROM (SELECT *, sum(l) OVER (PARTITION BY cut) AS wl, sum(r) OVER (PARTITION BY cut) AS wr FROM z) GROUP BY cut)
      SELECT cut::INT AS cut, round({{}}, 6) AS score FROM g"""
    forms = {"info": "info", "gini": "gini", "hellinger": "1 - sqrt(2 * half) / sqrt(2)", "squared-chord": "1 - half", "bhattacharyya": "1 + ln(bc)", "jensen-difference": "1 - jd", "gini-info": f"CASE WHEN {U(7, q1('gini-info'), 'cut')} <= 0.5 THEN gini ELSE info END"}
    for name, form in forms.items():
        add(f"split_{name.replace('-', '_')}", lambda s, d, name=name: measures.scores(counted(s, d), ["cut"], name, 7).select("cut", R6("score")), k.format(form))
    chi = f"""WITH k AS (SELECT month >= 6 AS side, class, count(*)::DOUBLE AS n FROM ({O_SQL}) GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY side) AS ns, sum(n) OVER (PARTITION BY class) AS nc, sum(n) OVER () AS nn FROM k)
      SELECT round(sum((n - nc * ns / nn) ** 2 / (nc * ns / nn)), 6) AS chi2 FROM t"""
    add("chisquare_split", lambda s, d: measures.chi_square(counted(s, d).filter("cut = 6").drop("cut"), []).select(R6("chi2")), chi)
    def candidates(s, d):
        """Three features' cuts for each priority, as if it were a node."""
        cut = lambda f, v: F.struct(F.lit(f).alias("feature"), F.lit(float(v)).alias("cut"))
        some = [cut("month", m) for m in range(2, 13)] + [cut("o_totalprice", p) for p in range(50_000, 450_000, 50_000)] + [cut("day", x) for x in (8, 15, 22)]
        df = orders(s, d).df.join(_table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.dayofmonth("o_orderdate").cast("double").alias("day")), "id")
        df = df.withColumn("c", F.explode(F.array(*some))).select("*", "c.*")
        value = F.when(F.col("feature") == "month", F.col("month")).when(F.col("feature") == "day", F.col("day")).otherwise(F.col("o_totalprice"))
        keys = ["o_orderpriority", "feature", "cut"]
        best = F.min(F.struct(F.round("score", 6).alias("score"), "feature", "cut")).alias("b")
        scored = measures.scores(measures.class_counts(df.withColumn("side", split.numeric_side(value, F.col("cut"))), keys), keys)
        return scored.groupBy("o_orderpriority").agg(best).select("o_orderpriority", "b.feature", "b.cut", "b.score")

    days = "SELECT o.*, day(o_orderdate)::DOUBLE AS day FROM (" + O_SQL + ") o JOIN orders ON o_orderkey = o.id"
    cells = " UNION ALL ".join(f"SELECT o_orderpriority, '{f}' AS feature, cut::DOUBLE AS cut, class, sum(({f} >= cut)::INT)::DOUBLE AS l, sum(({f} < cut)::INT)::DOUBLE AS r FROM d, {cuts} GROUP BY ALL" for f, cuts in (("month", "range(2, 13) t(cut)"), ("o_totalprice", "range(50000, 450000, 50000) t(cut)"), ("day", "(VALUES (8), (15), (22)) t(cut)")))
    x = oracles.xlnx
    add("best_feature_per_node", candidates,
        f"WITH d AS ({days}), k AS ({cells}), s AS (SELECT o_orderpriority, feature, cut, round({x('sum(l)')} - sum({x('l')}) + {x('sum(r)')} - sum({x('r')}), 6) AS score FROM k GROUP BY ALL) SELECT o_orderpriority, feature, cut, score FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY score, feature, cut) AS nth FROM s) WHERE nth = 1")

    # Trees and forests.
    small = forest.Options(trees=3, max_depth=4, seed=5)
    fitted = lambda s, d, **o: forest.fit(orders(s, d), small, **o)
    sql_of = lambda rows=O_SQL, **o: ForestSQL(rows, O_FEATURES, replace(small, **o))
    columns = lambda: ["tree", "node", "depth", "kind", "feature", R6("threshold"), "category", "class", R6("n"), R6("laplace")]
    nodes_sql = lambda f: f.query(f"SELECT tree, node, depth::INT AS depth, kind, feature, round(threshold, 6) AS threshold, category, class, round(n, 6) AS n, round(laplace, 6) AS laplace FROM {f.nodes}")

    def on_leaves(select, **o):
        f = sql_of(**o)
        at = f.leaves(O_SQL)
        return f.query(select.format(at=at, nodes=f.nodes, bag=f.bag))

    for name, o in {"tree_depth2_nodes": {"features": "all"}, "exact_tree_nodes": {"features": "all", "threshold": "exact", "example_sampling": "nothing"}}.items():
        add(name, lambda s, d, o=o: fitted(s, d, trees=1, max_depth=2, **o)[0].nodes.select(*columns()), nodes_sql(sql_of(trees=1, max_depth=2, **o)))
    add("missing_tree_nodes", lambda s, d: forest.fit(gappy_orders(s, d), small, trees=2, max_depth=3)[0].nodes.select(*columns()), nodes_sql(sql_of(G_SQL, trees=2, max_depth=3)))
    add("tree_predict", lambda s, d: fitted(s, d, trees=1)[0].leaves(orders(s, d).df).select("id", "actual", "node", "pred", R6("laplace")),
        on_leaves("SELECT id, actual, node, pred, round(laplace, 6) AS laplace FROM {at}", trees=1))
    add("forest_votes", lambda s, d: fitted(s, d, trees=5, max_depth=1)[0].votes(orders(s, d).df), on_leaves("SELECT id, actual, tree, pred FROM {at}", trees=5, max_depth=1))
    add("forest_vote_lists", lambda s, d: fitted(s, d, max_depth=1)[0].vote_lists(orders(s, d).df).withColumn("votes", F.array_join("votes", ",")),
        on_leaves("SELECT id, class, string_agg((pred = class)::INT::VARCHAR, ',' ORDER BY tree) AS votes FROM {at}, (SELECT DISTINCT pred AS class FROM {at}) GROUP BY id, class", max_depth=1))
    add("forest_majority", lambda s, d: metrics.predicted(fitted(s, d, trees=5)[0].transform(orders(s, d).df)), on_leaves(oracles.predicted(oracles.probabilities("SELECT * FROM {at}", 5)), trees=5))

    # All options as they are by default: ten trees of depth 12.
    whole = forest.Options(seed=5)
    of_whole = ForestSQL(O_SQL, O_FEATURES, whole)
    at_whole = of_whole.leaves(O_SQL)
    add("forest_default", lambda s, d: metrics.predicted(forest.fit(orders(s, d), whole)[0].transform(orders(s, d).df)), of_whole.query(oracles.predicted(oracles.probabilities(f"SELECT * FROM {at_whole}", whole.trees))))
    add("query_all_trees", lambda s, d: fitted(s, d, trees=5, max_depth=1)[0].query_trees(orders(s, d).df, ["id", "actual"], ["pred"], folds.majority(5)),
        on_leaves(oracles.predicted(oracles.probabilities("SELECT * FROM {at}", 5)), trees=5, max_depth=1))

    def resumed(s, d):
        """A forest of four trees in two batches, of which the first is there when the second run begins."""
        path = f"{shared_dir(s)}/resumed-{uuid.uuid4().hex[:12]}"
        forest.build(orders(s, d), replace(small, trees=4, max_depth=2), path, batch=2, most=1)
        return forest.build(orders(s, d), replace(small, trees=4, max_depth=2), path, batch=2).nodes.select(*columns())

    add("resumed_forest_nodes", resumed, nodes_sql(sql_of(trees=4, max_depth=2)))
    bag_of = replace(small, trees=3)
    add("bagged_centroids", lambda s, d: metrics.predicted(bagging.bagged(orders(s, d), bagging.CENTRES, bag_of)[0].transform(orders(s, d).df)).select("id", "actual", "pred", R6("prob")),
        f"WITH o AS ({O_SQL}), b AS ({oracles.bag_sql(O_SQL, bag_of.seed, 3)}), r AS (SELECT max(o_totalprice) - min(o_totalprice) AS wp, max(month) - min(month) AS wm FROM o), "
        "m AS (SELECT tree, class, sum(o_totalprice * weight) / sum(weight) AS p, sum(month * weight) / sum(weight) AS m FROM b GROUP BY ALL), "
        "k AS (SELECT tree, class, o_orderpriority AS c, row_number() OVER (PARTITION BY tree, class ORDER BY sum(weight) DESC, o_orderpriority) AS nth FROM b GROUP BY tree, class, o_orderpriority), "
        "n AS (SELECT o.id, o.class AS actual, tree::INT AS tree, m.class AS pred, row_number() OVER (PARTITION BY id, tree ORDER BY round(((o_totalprice - p) / wp) ** 2 + ((month - m) / wm) ** 2 + (o_orderpriority <> c)::INT, 9), m.class) AS near FROM o, r, m JOIN k USING (tree, class) WHERE k.nth = 1) "
        + oracles.predicted(oracles.probabilities("SELECT id, actual, tree, pred FROM n WHERE near = 1", 3)).replace(", prob FROM", ", round(prob, 6) AS prob FROM"))

    def oob(s, d):
        model, bags = fitted(s, d)
        return model.oob_accuracy(orders(s, d).df, bags).select("tree", R6("accuracy"), "n")

    add("oob_accuracy_per_tree", oob, on_leaves("SELECT tree, round(avg((pred = actual)::INT), 6) AS accuracy, count(*) AS n FROM {at} l WHERE NOT EXISTS (SELECT 1 FROM {bag} b WHERE b.tree = l.tree AND b.id = l.id) GROUP BY tree"))
    add("variable_importance", lambda s, d: fitted(s, d)[0].importance().select("feature", R6("importance")),
        on_leaves("SELECT feature, round(sum(g / whole) / 3, 6) AS importance FROM (SELECT *, sum(g) OVER (PARTITION BY tree) AS whole FROM (SELECT tree, feature, sum(gain) AS g FROM {nodes} WHERE kind = 'node' GROUP BY ALL)) GROUP BY feature"))
    add("no_rules", lambda s, d: fitted(s, d)[0].n_rules(), on_leaves("SELECT count(*) AS n_rules FROM {nodes} WHERE kind = 'leaf'"))
    for branch in forest.BRANCHES:
        o = {"trees": 1, "max_depth": 2, "branch": branch} | ({"score": "hellinger"} if branch == "hellinger" else {})
        add(f"branch_{branch.replace('-', '_')}", lambda s, d, o=o: fitted(s, d, **o)[0].nodes.select(*columns()), nodes_sql(sql_of(**o)))
    weighted_rules = {"trees": 1, "max_depth": 2, "branch": "rule", "distribute": "rulew"}
    add("rule_weighted_nodes", lambda s, d: fitted(s, d, **weighted_rules)[0].nodes.select(*columns()), nodes_sql(sql_of(**weighted_rules)))
    near = "SELECT q.id AS query, l.id, round(count(*) / 3.0::DOUBLE, 6) AS proximity FROM {at} q JOIN {at} l ON q.tree = l.tree AND q.node = l.node AND q.id <> l.id WHERE q.id % 20 = 0 GROUP BY ALL"
    add("proximity_topk", lambda s, d: fitted(s, d)[0].proximity(orders(s, d).df, orders(s, d).df.filter("id % 20 = 0"), 5).select("query", "id", R6("proximity"), "rank"),
        on_leaves(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY proximity DESC, id) AS rank FROM ({near})) WHERE rank <= 5"))

    near_whole = near.format(at=at_whole).replace("/ 3.0", "/ 10.0")
    add("proximity_default", lambda s, d: forest.fit(orders(s, d), whole)[0].proximity(orders(s, d).df, orders(s, d).df.filter("id % 20 = 0"), 5).select("query", "id", R6("proximity"), "rank"),
        of_whole.query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY proximity DESC, id) AS rank FROM ({near_whole})) WHERE rank <= 5"))
    some = forest.Options(trees=3, max_depth=4, seed=5)
    gaps = ForestSQL(G_SQL, O_FEATURES, some)
    at_gaps = gaps.leaves(G_SQL)
    near_gaps = f"SELECT q.id AS query, l.id, row_number() OVER (PARTITION BY q.id ORDER BY count(*) DESC, l.id) AS nth FROM {at_gaps} q JOIN {at_gaps} l ON q.tree = l.tree AND q.node = l.node AND q.id <> l.id JOIN ({G_SQL}) g ON g.id = q.id WHERE g.o_totalprice IS NULL GROUP BY q.id, l.id"

    def filled(s, d):
        """Prices from the five rows nearest by proximity."""
        ex = gappy_orders(s, d)
        return forest.impute_by_proximity(ex, forest.fit(ex, some)[0], 5).df.select("id", R6("o_totalprice"))

    add("missing_proximity", filled, gaps.query(f"SELECT g.id, round(coalesce(g.o_totalprice, f.price), 6) AS o_totalprice FROM ({G_SQL}) g LEFT JOIN (SELECT query, avg(o_totalprice) AS price FROM ({near_gaps}) n JOIN ({G_SQL}) x ON x.id = n.id WHERE nth <= 5 GROUP BY query) f ON f.query = g.id"))

    # Measures.
    pred_sql = oracles.predicted(P_SQL)
    pred = lambda s, d: metrics.predicted(probs(s, d))
    add("majority_vote", lambda s, d: pred(s, d), pred_sql)
    add("accuracy", lambda s, d: metrics.accuracy(pred(s, d)).select(R6("accuracy")), f"SELECT round(avg((pred = actual)::INT), 6) AS accuracy FROM ({pred_sql})")
    add("confusion", lambda s, d: metrics.confusion_matrix(pred(s, d)), f"SELECT actual, pred, count(*) AS n FROM ({pred_sql}) GROUP BY ALL")
    pr = oracles.precision_recall(pred_sql)
    add("precision_recall", lambda s, d: metrics.precision_recall(pred(s, d)).select("class", R6("precision"), R6("recall"), R6("f_measure")), pr + " SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f_measure, 6) AS f_measure FROM z")
    add("f_measure", lambda s, d: metrics.macro(metrics.precision_recall(pred(s, d))).select(R6("precision"), R6("recall"), R6("f_measure")),
        pr + " SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(2 * avg(precision) * avg(recall) / (avg(precision) + avg(recall)), 6) AS f_measure FROM z")
    ovr, auc = oracles.one_vs_rest(P_SQL), oracles.auc(P_SQL)
    add("auc_ovr", lambda s, d: metrics.auc(probs(s, d)).select("class", "n_pos", R6("auc")), auc + " SELECT class, n_pos, round(auc, 6) AS auc FROM a")
    add("auc_average", lambda s, d: metrics.average_auc(metrics.auc(probs(s, d))).select(R6("weighted_auc"), R6("average_auc")), auc + " SELECT round(sum(n_pos * auc) / sum(n_pos), 6) AS weighted_auc, round(avg(auc), 6) AS average_auc FROM a")
    add("prc_ovr", lambda s, d: metrics.prc(probs(s, d)).select("class", R6("prc")),
        ovr + ", g AS (SELECT class, prob, sum(pos::INT) AS p, count(*) AS n FROM o GROUP BY ALL), c AS (SELECT class, prob, sum(p) OVER w / sum(p) OVER (PARTITION BY class) AS x, sum(p) OVER w / sum(n) OVER w AS y FROM g WINDOW w AS (PARTITION BY class ORDER BY prob DESC)), l AS (SELECT *, lag(x, 1, 0) OVER w AS x0, lag(y, 1, 1) OVER w AS y0 FROM c WINDOW w AS (PARTITION BY class ORDER BY prob DESC)) SELECT class, round(sum((x - x0) * (y + y0)) / 2, 6) AS prc FROM l GROUP BY class")
    add("brier", lambda s, d: metrics.brier(probs(s, d)).select(R6("brier")), f"SELECT round(avg(e), 6) AS brier FROM (SELECT id, sum((prob - (class = actual)::INT) ** 2) AS e FROM ({P_SQL}) GROUP BY id)")
    marg = f"SELECT id, coalesce(max(CASE WHEN class = actual THEN prob END), 0) - coalesce(max(CASE WHEN class <> actual THEN prob END), 0) AS m FROM ({P_SQL}) GROUP BY id"
    stre = f"SELECT avg(m) AS strength, avg(m * m) - avg(m) ** 2 AS margin_variance FROM ({marg})"
    add("strength", lambda s, d: metrics.strength(probs(s, d)).select(R6("strength"), R6("margin_variance")), f"SELECT round(strength, 6) AS strength, round(margin_variance, 6) AS margin_variance FROM ({stre})")
    rival = f"SELECT id, class AS rival FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, class) AS r FROM ({P_SQL}) WHERE class <> actual) WHERE r = 1"
    bas = f"SELECT tree, avg((pred = actual)::INT) AS a, avg(coalesce((pred = rival)::INT, 0)) AS b FROM ({V_SQL}) v LEFT JOIN ({rival}) USING (id) GROUP BY tree"
    add("base_accuracy", lambda s, d: metrics.base_accuracy(votes(s, d), probs(s, d)).select("tree", R6("a"), R6("b")), f"SELECT tree::INT AS tree, round(a, 6) AS a, round(b, 6) AS b FROM ({bas})")
    add("correlation_c_s2", lambda s, d: metrics.correlation(votes(s, d), probs(s, d)).select(R6("correlation"), R6("c_s2")),
        f"SELECT round(c, 6) AS correlation, round(c / strength ** 2, 6) AS c_s2 FROM (SELECT strength, margin_variance / (SELECT avg(sqrt(a + b + (a - b) ** 2)) FROM ({bas})) ** 2 AS c FROM ({stre}))")
    add("mse", lambda s, d: metrics.mse(probs(s, d)).select(R6("mse"), R6("variance")),
        f"WITH p AS ({P_SQL}), m AS (SELECT *, avg(prob) OVER (PARTITION BY actual, class) AS mean FROM p) SELECT (SELECT round(avg(e), 6) FROM (SELECT id, sum((prob - (class = actual)::INT) ** 2) AS e FROM p GROUP BY id)) AS mse, round(sum((prob - mean) ** 2) / count(DISTINCT id), 6) AS variance FROM m")
    add("trapz", lambda s, d: metrics.trapezoid(probs(s, d).groupBy(F.col("prob").alias("x")).agg(F.avg((F.col("class") == F.col("actual")).cast("double")).alias("y")), order="x").select(R6("area")),
        f"WITH p AS ({P_SQL}), c AS (SELECT prob AS x, avg((actual = class)::INT) AS y FROM p GROUP BY prob) SELECT round(sum((x - px) * (y + py)) / 2, 6) AS area FROM (SELECT x, y, lag(x) OVER (ORDER BY x) AS px, lag(y) OVER (ORDER BY x) AS py FROM c)")

    # Validation.
    row = "fold string, accuracy double, average_auc double, brier double, f_measure double"
    frame = lambda s, rs: s.createDataFrame([(r["fold"], *[None if r[c] is None else round(r[c], 6) for c in ("accuracy", "average auc", "brier", "f-measure")]) for r in rs], row)
    tiny = forest.Options(trees=3, max_depth=2, seed=3)
    dealt = f"SELECT *, (row_number() OVER (ORDER BY class, {U(1, q1('fold'), 'id')}, id) - 1) % 2 + 1 AS fold FROM ({O_SQL})"
    parts = {
        "cv_average": ([(str(i), f"SELECT * EXCLUDE (fold) FROM ({dealt}) WHERE fold <> {i}", f"SELECT * EXCLUDE (fold) FROM ({dealt}) WHERE fold = {i}") for i in (1, 2)], lambda ex: validate.cross_validation(ex, tiny, 2)),
        "in_sample_validation": ([("in-sample", O_SQL, O_SQL)], lambda ex: validate.in_sample_validation(ex, tiny)),
    }
    of_split = lambda test: f"SELECT id, class, o_totalprice, month, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {U(1, q1('split'), 'id')}, id) AS r, count(*) OVER (PARTITION BY class) AS n FROM ({O_SQL})) WHERE {'NOT ' if test else ''}r <= floor(n * 0.66::DOUBLE + 0.5)"
    parts["split_validation"] = ([("split 0.66", of_split(False), of_split(True))], lambda ex: validate.split_validation(ex, tiny))
    for name, (rows, run) in parts.items():
        add(name, lambda s, d, run=run: frame(s, run(orders(s, d))), oracles.validations(rows, O_FEATURES, tiny, name == "cv_average"))
    bag1 = f"SELECT id, class, o_totalprice, month, o_orderpriority, times::DOUBLE AS weight FROM (SELECT *, row_number() OVER (ORDER BY {U(1, q1('order'), 'id')}, id) AS place FROM ({O_SQL})) JOIN (SELECT place, count(*) AS times FROM (SELECT (floor({U(1, 'draw')} * (SELECT count(*) FROM orders)) + 1)::BIGINT AS place FROM range(1, (SELECT count(*) FROM orders) + 1) t(draw)) GROUP BY place) USING (place)"
    add("bootstrap_validation", lambda s, d: frame(s, validate.bootstrap_validation(orders(s, d), tiny)),
        oracles.validations([("bootstrap", bag1, f"SELECT * FROM ({O_SQL}) WHERE id NOT IN (SELECT id FROM ({bag1}))")], O_FEATURES, tiny, weighted=True))

    # Neighbours.
    vectors = lambda s, d: _table(s, d, "embeddings").selectExpr("vec_id as id", "embedding as vector")
    dist = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))"
    add("knn_topk", lambda s, d: neighbors.nearest_vectors(vectors(s, d), vectors(s, d).filter("id % 20 = 0"), 5).select("query", "id", R6("distance"), "rank"),
        f"SELECT * FROM (SELECT q.vec_id AS query, v.vec_id AS id, round({dist}, 6) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {dist}, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id) WHERE rank <= 5")
    def kd_topk(ex):
        return nearest_in_cells(ex.df, ex.df.filter("id % 20 = 0"), ex.features, 5).select("query", "id", R6("distance"), "rank")

    part = lambda f: f"CASE WHEN a.{f} IS NULL AND b.{f} IS NULL THEN 1 WHEN a.{f} IS NULL THEN (b.{f} - low_{f}) / (high_{f} - low_{f}) WHEN b.{f} IS NULL THEN (a.{f} - low_{f}) / (high_{f} - low_{f}) ELSE (a.{f} - b.{f}) / (high_{f} - low_{f}) END"
    ends = lambda fs: ", ".join(f"min({f})::DOUBLE AS low_{f}, max({f})::DOUBLE AS high_{f}" for f in fs)
    nearest_sql = lambda rows, fs, cs=(): (
        f"WITH x AS MATERIALIZED ({rows}), r AS (SELECT {ends(fs)} FROM x), d AS (SELECT a.id AS query, b.id, {' + '.join([f'({part(f)}) ** 2' for f in fs] + [f'(a.{c} IS DISTINCT FROM b.{c} OR a.{c} IS NULL)::INT' for c in cs])} AS distance FROM x a, x b, r WHERE a.id % 20 = 0 AND a.id <> b.id) "
        "SELECT query, id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d) WHERE rank <= 5"
    )
    add("kd_topk", lambda s, d: kd_topk(events(s, d)), nearest_sql(E_SQL, ("value", "hour")))
    add("kd_topk_mixed", lambda s, d: kd_topk(gappy_orders(s, d)), nearest_sql(G_SQL, ("o_totalprice", "month"), ("o_orderpriority",)))
    add("rbf_features", lambda s, d: neighbors.radial_features(vectors(s, d), vectors(s, d).filter("id < 3"), 0.5).select("id", "centroid", R6("value")), f"SELECT v.vec_id AS id, q.vec_id AS centroid, round(exp(-0.5 * {dist}), 6) AS value FROM embeddings v, embeddings q WHERE q.vec_id < 3")
    gap = lambda v, c: f"list_sum(list_transform(list_zip({v}, {c}), lambda z: (z[1] - z[2]) ** 2))"
    steps = [f"v AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)", f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {U('k', q1('centroid'), 'id')}, id) AS cluster, v AS c FROM v ORDER BY 1 LIMIT 4)"]
    for i in range(6):  # each row to its centroid; the last step is the result
        steps.append(f"a{i} AS MATERIALIZED (SELECT id, v, cluster FROM (SELECT id, v, cluster, row_number() OVER (PARTITION BY id ORDER BY round({gap('v', 'c')}, 9), cluster) AS nth FROM v, c{i}) WHERE nth = 1)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, list(x ORDER BY pos) AS c FROM (SELECT cluster, pos, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY ALL) GROUP BY cluster)")
    add("kmeans", lambda s, d: neighbors.kmeans(vectors(s, d), 4, "k", 5), f"WITH {', '.join(steps)} SELECT id, cluster FROM a5")

    add("smote_rows", lambda s, d: neighbors.smote(events(s, d).df, events(s, d).features, "m", minority="click", k=5).select("from_id", "copy", R6("value"), R6("hour")),
        f"""WITH e AS (SELECT * FROM ({E_SQL}) WHERE class = 'click'), g AS (SELECT max(value) - min(value) AS wv, max(hour) - min(hour) AS wh FROM e),
        n AS (SELECT a.id AS from_id, b.id, b.value, b.hour, row_number() OVER (PARTITION BY a.id ORDER BY ((a.value - b.value) / wv) ** 2 + ((a.hour - b.hour) / wh) ** 2, b.id) AS r FROM e a, e b, g WHERE a.id <> b.id),
        c AS (SELECT from_id, max(least(r, 5)) AS k FROM n GROUP BY from_id), p AS (SELECT e.id, e.value, e.hour, floor({U('m', q1('pick'), 'e.id', '1')} * k)::INT + 1 AS r FROM e JOIN c ON e.id = from_id)
        SELECT p.id AS from_id, 1::BIGINT AS copy, round(p.value + {U('m', q1('value'), 'p.id', '1')} * (n.value - p.value), 6) AS value, round(p.hour + {U('m', q1('hour'), 'p.id', '1')} * (n.hour - p.hour), 6) AS hour FROM p JOIN n ON p.id = n.from_id AND p.r = n.r""")
    # Rows with numbers of one scale, gaps and categories; centroids that start at rows, or far from all.
    scaled = f"SELECT id, class, o_totalprice / 100000 AS price, month / 4 AS season, CASE WHEN {U('lost', 'id')} >= 0.1 THEN o_orderpriority END AS priority FROM ({G_SQL})"
    mixed = (examples.Feature("price", "numeric", 0), examples.Feature("season", "numeric", 1), examples.Feature("priority", "categoric", 2))

    def seasons(s, d):
        lost = F.when(u("lost", F.col("id")) >= 0.1, F.col("o_orderpriority"))
        return gappy_orders(s, d).df.select("id", "class", "weight", (F.col("o_totalprice") / 100000).alias("price"), (F.col("month") / 4).alias("season"), lost.alias("priority"))

    def clusters_sql(rounds: int, start: str, refill: bool, last: str) -> str:
        d = "coalesce((x.price - c.price) ** 2, 1) + coalesce((x.season - c.season) ** 2, 1) + CASE WHEN x.priority = c.priority THEN 0 ELSE 1 END"
        out = [f"x AS MATERIALIZED ({scaled})", f"c0 AS MATERIALIZED ({start})"]
        for i in range(rounds + 1):
            out.append(f"a{i} AS MATERIALIZED (SELECT * FROM (SELECT x.*, c.cluster, round({d}, 9) AS distance, row_number() OVER (PARTITION BY x.id ORDER BY round({d}, 9), c.cluster) AS nth FROM x, c{i} c) WHERE nth = 1)")
            mode = f"SELECT cluster, priority FROM (SELECT cluster, priority, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, priority) AS r FROM a{i} WHERE priority IS NOT NULL GROUP BY cluster, priority) WHERE r = 1"
            moved = f"SELECT cluster, price, season, priority FROM (SELECT cluster, avg(price) AS price, avg(season) AS season FROM a{i} GROUP BY cluster) LEFT JOIN ({mode}) USING (cluster)"
            if refill:
                lost = f"SELECT cluster, row_number() OVER (ORDER BY cluster) AS place FROM c{i} WHERE cluster NOT IN (SELECT cluster FROM a{i})"
                moved += f" UNION ALL SELECT l.cluster, price, season, priority FROM ({lost}) l JOIN (SELECT *, row_number() OVER (ORDER BY distance DESC, id) AS place FROM a{i}) USING (place)"
            out.append(f"c{i + 1} AS MATERIALIZED ({moved})")
        return f"WITH {', '.join(out)} {last}"

    start_sql = f"SELECT row_number() OVER (ORDER BY {U('c', q1('centroid'), 'id')}, id) AS cluster, price, season, priority FROM x ORDER BY 1 LIMIT 4"
    add("kmeans_mixed", lambda s, d: clusters.kmeans(seasons(s, d), mixed, 4, "c", 4)[0].select("id", "cluster", R6("distance")), clusters_sql(4, start_sql, False, "SELECT id, cluster, round(distance, 6) AS distance FROM a4"))
    far = "SELECT * FROM (VALUES (1::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE, '5-LOW'), (2, 3.0, 2.0, '1-URGENT'), (3, 1e6, 1e6, '5-LOW'), (4, -1e6, -1e6, '5-LOW')) t(cluster, price, season, priority)"
    far_rows = [(1, 1.0, 1.0, "5-LOW"), (2, 3.0, 2.0, "1-URGENT"), (3, 1e6, 1e6, "5-LOW"), (4, -1e6, -1e6, "5-LOW")]
    add("kmeans_refill", lambda s, d: clusters.kmeans(seasons(s, d), mixed, 4, "c", 3, "refill", s.createDataFrame(far_rows, "cluster long, price double, season double, priority string"))[1].select("cluster", R6("price"), R6("season"), "priority"),
        clusters_sql(2, far, True, "SELECT cluster, round(price, 6) AS price, round(season, 6) AS season, priority FROM c3"))

    def centroid_forest(s, d):
        """A forest on the closeness of rows to centroids."""
        rows = seasons(s, d)
        made, features = clusters.centre_examples(rows, clusters.kmeans(rows, mixed, 4, "c", 2)[1], mixed)
        ex = ExampleSet(made.withColumns({f.name: F.round(f.name, 6) for f in features}), features)
        return metrics.predicted(forest.fit(ex, forest.Options(trees=3, max_depth=2, seed=5))[0].transform(ex.df))

    gap_sql = "coalesce((x.price - c.price) ** 2, 1) + coalesce((x.season - c.season) ** 2, 1) + CASE WHEN x.priority = c.priority THEN 0 ELSE 1 END"
    wide = ", ".join(f"max(round(exp(-sqrt({gap_sql})), 6)) FILTER (c.cluster = {i}) AS near{i}" for i in range(1, 5))
    of_centres = ForestSQL("SELECT * FROM near", [(f"near{i}", "numeric") for i in range(1, 5)], forest.Options(trees=3, max_depth=2, seed=5))
    at_centres = of_centres.leaves("SELECT * FROM near")
    near_sql = clusters_sql(2, start_sql, False, f", near AS MATERIALIZED (SELECT x.id, x.class, {wide} FROM x, c2 c GROUP BY ALL)").rstrip()
    add("centroid_forest", centroid_forest, near_sql.replace(" , near AS", ", near AS") + of_centres.query(oracles.predicted(oracles.probabilities(f"SELECT * FROM {at_centres}", 3))).replace("WITH ", ", ", 1))
    add("bootstrap_average_overlap", lambda s, d: neighbors.bootstrap_average(sampling.class_bootstrap(orders(s, d).df, "a", 3, "P", 0.3), ["o_totalprice", "month"], ["o_orderpriority"]).select("tree", R6("o_totalprice"), R6("month"), "o_orderpriority"),
        f"WITH b AS (SELECT * FROM ({oracles.bag_sql(O_SQL, 'a', 3)}) WHERE class = 'P' OR {U('a', q1('overlap'), 'tree', 'id')} < 0.3), m AS (SELECT tree, o_orderpriority, row_number() OVER (PARTITION BY tree ORDER BY sum(weight) DESC, o_orderpriority) AS nth FROM b GROUP BY tree, o_orderpriority) SELECT tree::INT AS tree, round(sum(o_totalprice * weight) / sum(weight), 6) AS o_totalprice, round(sum(month * weight) / sum(weight), 6) AS month, any_value(m.o_orderpriority) AS o_orderpriority FROM b JOIN m USING (tree) WHERE nth = 1 GROUP BY tree")
    add("bootstrap_average_example", lambda s, d: neighbors.bootstrap_average(sampling.bootstrap(orders(s, d).df, "a", 3), ["o_totalprice", "month"], ["o_orderpriority"]).select("tree", R6("o_totalprice"), R6("month"), "o_orderpriority"),
        f"WITH b AS ({oracles.bag_sql(O_SQL, 'a', 3)}), m AS (SELECT tree, o_orderpriority, row_number() OVER (PARTITION BY tree ORDER BY sum(weight) DESC, o_orderpriority) AS nth FROM b GROUP BY tree, o_orderpriority) SELECT tree::INT AS tree, round(sum(o_totalprice * weight) / sum(weight), 6) AS o_totalprice, round(sum(month * weight) / sum(weight), 6) AS month, any_value(m.o_orderpriority) AS o_orderpriority FROM b JOIN m USING (tree) WHERE nth = 1 GROUP BY tree")

    # Rules.
    pn = f"SELECT sum((class = 'F')::INT)::DOUBLE AS p, sum((class <> 'F')::INT)::DOUBLE AS n, (SELECT avg((class = 'F')::INT) FROM ({O_SQL})) AS pi FROM ({O_SQL}) WHERE month >= 6 AND o_orderpriority = '1-URGENT'"

    def scored(s, d, kind):
        ex = orders(s, d).df
        prior = ex.agg(F.avg((F.col("class") == "F").cast("double"))).first()[0]
        c = examples.coverage(examples.to_binary(rules.covered(ex, [("month", "numeric", 6.0, True), ("o_orderpriority", "categoric", "1-URGENT", True)]), "F"))
        return c.select("pos", "neg", F.round(rules.rule_score(F.col("pos"), F.col("neg"), kind, 3, F.lit(prior)), 6).alias("score"))

    for kind, form in (("laplace", "1 - (p + 1) / (p + n + 3)"), ("m", "1 - (p + 3 * pi) / (p + n + 3)"), ("purity", "1 - p / (p + n)")):
        add(f"rule_{'m_estimate' if kind == 'm' else kind}", lambda s, d, kind=kind: scored(s, d, kind), f"SELECT p AS pos, n AS neg, round({form}, 6) AS score FROM ({pn})")
    add("rule_learning", lambda s, d: s.createDataFrame([(i, f, k, str(v), h) for i, (f, k, v, h) in enumerate(rules.learn_rule(orders(s, d), "F", "r"))], "step int, feature string, kind string, value string, holds boolean"), oracles.learned_rule(O_SQL, O_FEATURES, "F", "r"))
    # Sides by the closeness of embeddings to a centroid, the first vector.
    close = "exp(-sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))))"

    def by_centroid(s, d):
        rows = vectors(s, d)
        centre = rows.filter("id = 0").select(F.transform("vector", lambda x: x.cast("double")).alias("c"))  # one row
        side = split.centroid_side(F.transform("vector", lambda x: x.cast("double")), F.col("c"), F.lit(0.25))
        return rows.crossJoin(F.broadcast(centre)).select("id", side.alias("side"))

    add("distribute_centroid", by_centroid, f"SELECT v.vec_id AS id, CASE WHEN {close} >= 0.25 THEN 'left' ELSE 'right' END AS side FROM embeddings v, embeddings q WHERE q.vec_id = 0")
    text = lambda n, turn: f"{n}.feature || ' ' || CASE WHEN {n}.threshold IS NOT NULL THEN CASE WHEN {turn} = '0' THEN '>=' ELSE '<' END ELSE CASE WHEN {turn} = '0' THEN '=' ELSE '<>' END END || ' ' || coalesce(round({n}.threshold, 6)::VARCHAR, {n}.category)"
    extracted = (
        "SELECT * FROM (WITH g AS (SELECT tree, node, kind, class, majority_n / n AS confidence, n / (SELECT count(*) FROM orders) AS coverage FROM {nodes} WHERE CASE WHEN kind = 'leaf' THEN majority_n / n > 0.35 AND n / (SELECT count(*) FROM orders) > 0.05 ELSE majority_n / n >= 0.35 AND n / (SELECT count(*) FROM orders) >= 0.05 END), "
        "s AS (SELECT g.tree, g.node, i, " + text("a", "substr(g.node, (i + 1)::INT, 1)") + " AS t FROM g, range(1, 9) r(i), {nodes} a WHERE i < length(g.node) AND a.tree = g.tree AND a.node = substr(g.node, 1, i::INT)) "
        "SELECT g.node, g.kind, g.class, round(confidence, 6) AS confidence, round(coverage, 6) AS coverage, coalesce(string_agg(t, ' & ' ORDER BY i), '') AS rule FROM g LEFT JOIN s USING (tree, node) GROUP BY ALL)"
    )
    add("rule_extraction", lambda s, d: rules.extract_rules(fitted(s, d, trees=1)[0].nodes, orders(s, d).df.count(), 0.35, 0.05).select("node", "kind", "class", R6("confidence"), R6("coverage"), "rule"), on_leaves(extracted, trees=1))

    def grid(s, d):
        """The classes that a tree gives a grid of two features."""
        cells = s.range(0, 101).selectExpr("id as i", "explode(sequence(0, 100)) as j")
        rows = cells.selectExpr("i * 101 + j as id", "'?' as class", "1.0D as weight", "i * 5000.0D as o_totalprice", "1 + j * 0.11D as month", "'3-MEDIUM' as o_orderpriority")
        return fitted(s, d, trees=3)[0].transform(rows).filter("rank = 1").select(F.floor(F.col("id") / 101).alias("i"), (F.col("id") % 101).alias("j"), "class", R6("prob"))

    cells = "SELECT i * 101 + j AS id, '?' AS class, i * 5000.0::DOUBLE AS o_totalprice, 1 + j * 0.11::DOUBLE AS month, '3-MEDIUM' AS o_orderpriority FROM range(0, 101) a(i), range(0, 101) b(j)"
    f = sql_of()
    at = f.leaves(cells)
    add("decision_grid", grid, f.query(f"SELECT id // 101 AS i, id % 101 AS j, class, round(prob, 6) AS prob FROM ({oracles.probabilities(f'SELECT * FROM {at}', 3)}) WHERE rank = 1"))
    return q


def queries() -> dict:
    return {name: run for name, (run, _) in _catalogue().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _catalogue().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-level information-gain tree on orders: predictions of all rows."""
    model, _ = forest.fit(orders(spark, sf_dir), forest.Options(trees=1, max_depth=2, features="all", example_sampling="nothing"))
    return metrics.predicted(model.transform(orders(spark, sf_dir).df))
