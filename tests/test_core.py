"""Closed-form values, invariants and a small forest end to end."""

import math

import pytest
from pyspark.sql import functions as F

from copse import queries
from copse.functions import measures
from copse.operators import examples, metrics, neighbors, sampling
from copse.operators.examples import ExampleSet
from copse.plans.forest import ForestModel, Options, drawn, fit
from copse.sources import typed_csv


def counts(spark, left, right):
    keys = sorted({*left, *right})
    return spark.createDataFrame([(c, float(left.get(c, 0)), float(right.get(c, 0))) for c in keys], "class string, l double, r double")


def examples_of(spark, sizes):
    rows, n = [], 0
    for c, k in sizes.items():
        for _ in range(k):
            n += 1
            rows.append((n, c, 1.0))
    return spark.createDataFrame(rows, "id long, class string, weight double")


def test_chi_square(spark):
    got = measures.chi_square(counts(spark, {"green": 4, "red": 1}, {"green": 3, "red": 1}), []).first()[0]
    assert got == pytest.approx(0.03214285714285711, abs=1e-12)
    got = measures.chi_square(counts(spark, {"green": 0, "red": 8}, {"green": 7, "red": 2}), []).first()[0]
    assert got == pytest.approx(10.577777777777778, abs=1e-12)


def test_measures_on_unbalanced_splits(spark):
    large = counts(spark, {"a": 2, "b": 100001}, {"a": 1, "b": 99999})
    small = counts(spark, {"a": 0, "b": 100099}, {"a": 4, "b": 99901})
    s = lambda c, m: measures.scores(c, [], m).first()["score"]
    want = {"hellinger": (0.349738244426696, 0.8782824622443043), "squared-chord": (0.5771596492387245, 0.9851848410026908), "jensen-difference": (0.5406319710346652, 0.97867951267289)}
    for m, (a, b) in want.items():
        assert sorted([s(small, m), s(large, m)]) == pytest.approx([a, b], abs=1e-9)
        assert s(small, m) < s(large, m)
    assert s(small, "info") > s(large, "info") or math.isclose(s(small, "info"), s(large, "info"), rel_tol=1e-1)


def test_info_of_even_split(spark):
    got = measures.scores(counts(spark, {"a": 6, "b": 4}, {"a": 6, "b": 4}), []).first()
    assert tuple(got) == pytest.approx((13.46023334018513, 6.730116670092565, 6.730116670092565), abs=1e-9)


def test_subset_and_majority(spark):
    ex = examples_of(spark, {"a": 10, "b": 20})
    assert [sampling.subset(ex, n, 1).count() for n in (0.2, 10, 33)] == [6, 10, 30]
    few = sampling.subset(examples_of(spark, {"a": 10, "b": 2}), 0.2, 1)
    assert [tuple(r) for r in few.groupBy("class").count().collect()] == [("a", 2)]
    assert tuple(examples.majority(examples_of(spark, {"a": 3, "b": 1, "c": 9})).first()) == ("c", 9.0)


def test_bootstrap_keeps_the_weight(spark):
    ex = examples_of(spark, {"a": 1000, "b": 2000})
    bag = sampling.bootstrap(ex, 7)
    assert bag.agg(F.sum("weight")).first()[0] == 3000
    assert sampling.out_of_bag(ex, bag).count() / 3000 == pytest.approx(0.36, abs=0.03)


def test_folds_differ_by_one_at_most(spark):
    per = sampling.stratified_folds(examples_of(spark, {"a": 13, "b": 8, "c": 2}), 4, 1).groupBy("fold").count().collect()
    assert sum(r["count"] for r in per) == 23 and max(r["count"] for r in per) - min(r["count"] for r in per) <= 1
    with pytest.raises(ValueError):
        sampling.stratified_folds(examples_of(spark, {"a": 3}), 1, 1)


def test_trapezoid(spark):
    xs, ys = (0, 0.2, 0.4, 0.6, 0.6, 0.6, 0.8, 1), (1, 1, 1, 1, 0.75, 0.6, 0.8, 0.8)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, ys, strict=True))], "i int, x double, y double")
    assert metrics.trapezoid(points).first()[0] == pytest.approx(0.9)


def test_one_class_has_no_auc(spark):
    p = spark.createDataFrame([(1, "a", "a", 1.0, 1)], "id long, actual string, class string, prob double, rank long")
    assert metrics.auc(p).first()["auc"] is None


def iris_like(spark):
    rows = [(i, "xyz"[i % 3], float((i * 7) % 11), (i % 3) * 5.0 + (i % 4) * 0.5 if i % 17 else None, "uvw"[(i // 3) % 3]) for i in range(1, 151)]
    return ExampleSet.of(spark.createDataFrame(rows, "i long, c string, noise double, good double, cat string"), "i", "c", ("noise", "good"), ("cat",))


def test_forest_end_to_end(spark, tmp_path):
    ex = iris_like(spark)
    model, bags = fit(ex, Options(trees=5, max_depth=5, features="all", seed=3))
    assert metrics.accuracy(metrics.predicted(model.transform(ex.df))).first()[0] > 0.8
    assert model.importance().orderBy(F.desc("importance")).first()["feature"] == "good"
    assert model.oob_accuracy(ex.df, bags).count() == 5
    model.save(str(tmp_path / "m"))
    again = ForestModel.load(spark, str(tmp_path / "m"))
    key = lambda m: sorted(map(tuple, m.leaves(ex.df).select("id", "tree", "node", "pred").collect()))
    assert key(again) == key(model)
    # A plain walk of the table of nodes gives the same leaves.
    nodes = {(r["tree"], r["node"]): r for r in model.nodes.collect()}
    rows = {r["id"]: r for r in ex.df.collect()}
    for ident, tree, leaf, _ in key(model)[:60]:
        at, row = "1", rows[ident]
        while nodes[tree, at]["kind"] == "node":
            n = nodes[tree, at]
            v = row[n["feature"]]
            if v is None:
                left = n["n_left"] > 0 and n["n_left"] / (n["n_left"] + n["n_right"]) >= 0.5
            else:
                left = v >= n["threshold"] if n["threshold"] is not None else v == n["category"]
            at += "0" if left else "1"
        assert at == leaf


def chi_of(rows, n):
    """Chi-square of a split, from its definition."""
    side = lambda r: r[n["feature"]] >= n["threshold"] if n["threshold"] is not None else r[n["feature"]] == n["category"]
    known = [(bool(side(r)), r["class"]) for r in rows if r[n["feature"]] is not None]
    out = 0.0
    for c in {c for _, c in known}:
        for s in (True, False):
            want = sum(x[1] == c for x in known) * sum(x[0] == s for x in known) / len(known)
            out += (sum(x == (s, c) for x in known) - want) ** 2 / want if want else 0.0
    return out


def test_policies_take_each_feature_once():
    of = lambda branch, total, n: [drawn(Options(branch=branch, features=n), total, r) for r in range(4)]
    assert of("chisquare", 9, 3) == [(3, 0), (3, 3), (3, 6), (3, 9)]
    assert of("chisquare-decrease", 9, 5) == [(5, 0), (3, 5), (2, 8), (1, 10)]
    assert of("infinite-resample", 9, 4)[:2] == [(4, 0), (9, 4)]


@pytest.mark.parametrize("branch", ["chisquare", "chisquare-decrease", "sample-examples"])
def test_splits_of_chi_square_policies_are_significant(spark, branch):
    ex = iris_like(spark)
    o = Options(trees=1, max_depth=1, features=1, example_sampling="nothing", branch=branch, sigma=30.0, share=0.3, seed=4)
    rows, nodes = ex.df.collect(), fit(ex, o)[0].nodes.filter("kind = 'node'").collect()
    assert all(chi_of(rows, n) >= 30 for n in nodes)
    if branch != "sample-examples":
        assert {n["feature"] for n in nodes} == {"good"} and len(nodes) == 1
    if branch == "chisquare":
        assert fit(ex, o, sigma=1e9)[0].nodes.count() == 1  # nothing suffices: a leaf


@pytest.mark.parametrize("branch", ["random-subset", "random-chisquare", "resquare"])
def test_random_policies_keep_all_rows(spark, branch):
    ex = iris_like(spark)
    nodes = {r["node"]: r for r in fit(ex, Options(trees=1, max_depth=1, branch=branch, example_sampling="nothing", seed=2))[0].nodes.collect()}
    assert nodes["1"]["n"] == 150 and set(nodes) in ({"1"}, {"1", "10", "11"})
    if len(nodes) == 3:
        assert nodes["10"]["n"] + nodes["11"]["n"] == 150


def test_typed_csv_round_trip(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_bytes(b"numeric, class ,CATEGORIC\r\n a, y, c\r\n.5,no,u\r\n?,yes,?\r\n3.,no,v\r\n")
    ex = typed_csv.read(spark, str(path))
    assert [tuple(r) for r in ex.df.orderBy("id").collect()] == [(1, "no", 1.0, 0.5, "u"), (2, "yes", 1.0, None, None), (3, "no", 1.0, 3.0, "v")]
    path.write_text("Age,Sex\n1,2\n")
    with pytest.raises(ValueError):
        typed_csv.read(spark, str(path))
    path.write_text("numeric,class\na,y\n1d,no\n")
    with pytest.raises(Exception, match="invalid number format"):
        typed_csv.read(spark, str(path)).df.collect()


def test_smote_lies_between_neighbours(spark):
    ex = iris_like(spark)
    made = neighbors.smote(ex.df.filter("good IS NOT NULL"), ex.features, 1, minority="x", k=3).collect()
    own = [r for r in ex.df.filter("class = 'x' AND good IS NOT NULL").collect()]
    low, high = min(r["good"] for r in own), max(r["good"] for r in own)
    assert len(made) == len(own) and all(low <= r["good"] <= high and r["cat"] in "uvw" for r in made)


def test_smote_query_uses_all_rows(spark):
    d = "/root/testdata/sf0.001"
    ex = queries.events(spark, d)
    own = sorted((r["id"], r["value"], r["hour"]) for r in ex.df.filter("class = 'click'").collect())
    made = {r["from_id"]: r for r in queries.queries()["smote_rows"](spark, d).collect()}
    assert sorted(made) == [i for i, *_ in own] and len(own) > 100
    wv, wh = (max(c) - min(c) for c in list(zip(*own, strict=True))[1:])
    for i, v, h in own:
        near = sorted((((v - y) / wv) ** 2 + ((h - z) / wh) ** 2, j, y, z) for j, y, z in own if j != i)[:5]
        between = lambda x, a, b: min(a, b) - 1e-6 <= x <= max(a, b) + 1e-6
        assert any(between(made[i]["value"], v, y) and between(made[i]["hour"], h, z) for *_, y, z in near)


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 7)
    monkeypatch.setattr(neighbors, "CELLS", 20)
    rows = [(i, None if i % 7 == 0 else float(i * i % 11), None if i % 5 == 0 else "abc"[i % 3], 2.0 if i % 4 else None) for i in range(40)]
    ex = ExampleSet.of(spark.createDataFrame([(*r, "x") for r in rows], "id long, n double, c string, w double, class string"), "id", "class", ("n", "w"), ("c",))

    low, high = (g(r[1] for r in rows if r[1] is not None) for g in (min, max))

    def apart(a, b):  # w has no width
        n = 1.0 if a[1] is None and b[1] is None else b[1] - low if a[1] is None else a[1] - low if b[1] is None else a[1] - b[1]
        n = n if a[1] is None and b[1] is None else n / (high - low)
        return n * n + (0.0 if a[2] == b[2] and a[2] is not None else 1.0) + (1.0 if a[3] is None or b[3] is None else 0.0)

    got = neighbors.nearest(ex.df, ex.df.filter("id % 3 = 0"), ex.features, 4, values=True).collect()
    want = set()
    for a in rows[::3]:
        near = sorted((round(apart(a, b), 9), b[0]) for b in rows if b[0] != a[0])[:4]
        want |= {(a[0], b, d, r + 1) for r, (d, b) in enumerate(near)}
    assert {(r["query"], r["id"], round(r["distance"], 9), r["rank"]) for r in got} == want
    assert all(r["v"]["n"] == rows[r["id"]][1] for r in got)


def test_proximity_query_searches_all_orders(spark):
    d = "/root/testdata/sf0.001"
    ex = queries.orders(spark, d)
    model, _ = fit(ex, Options(trees=3, max_depth=4, seed=5))
    at = {}
    for r in model.leaves(ex.df).collect():
        at.setdefault(r["id"], set()).add((r["tree"], r["node"]))
    want = set()
    for a in at:
        if a % 20 == 0:
            near = sorted((-len(at[a] & at[b]), b) for b in at if b != a and at[a] & at[b])[:5]
            want |= {(a, b, round(-n / 3, 6), i + 1) for i, (n, b) in enumerate(near)}
    assert len(want) == 5 * sum(i % 20 == 0 for i in at)
    assert {tuple(r) for r in queries.queries()["proximity_topk"](spark, d).collect()} == want


def test_queries_have_their_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 80
