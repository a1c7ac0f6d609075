"""Forests against plain walks and brute force: policies, rules, weights, options, commands, streams."""

import hashlib
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse import cli
from copse.functions import measures
from copse.functions.rng import running
from copse.operators import rules, sampling, split
from copse.operators.examples import ExampleSet
from copse.plans import bagging, folds, forest, grow, policies, validate
from copse.plans.forest import BRANCHES, Options, build, fit, fit_groups, partial
from copse.sources import typed_csv
from copse.streaming.scoring import score_stream


def u(*keys):
    return int(hashlib.md5(":".join(map(str, keys)).encode()).hexdigest()[:8], 16) / 2**32


def fixture(spark, gaps=False, n=120):
    rows = [(i, "xyz"[(i * i) % 7 % 3], float((i * 7) % 11), (i % 5) * 2.0 + (i % 3) if not gaps or i % 6 else None, "uvw"[(i // 3) % 3] if not gaps or i % 10 else None, float(i % 13)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "i long, c string, a double, b double, cat string, d double")
    return ExampleSet.of(df, "i", "c", ("a", "b", "d"), ("cat",))


def node_rows(nodes):
    return {(r["tree"], r["node"]): r for r in nodes.collect()}


PLAIN = Options(trees=1, max_depth=1, example_sampling="nothing", features="all", seed=11)


@pytest.mark.parametrize("wrong", [{"branch": "weird"}, {"score": "x"}, {"missing": "no"}, {"example_sampling": "?"}, {"threshold": "fine"}, {"distribute": "r"}, {"rule_score": "f"}, {"features": "many"}, {"features": 0}, {"rules": "sh"}, {"trees": 0}, {"share": 0.0}])
def test_unknown_options_are_errors(wrong):
    with pytest.raises(ValueError):
        Options(**wrong)
    assert Options(branch="weka").branch == "infinite-resample" and Options(missing="partitionw").missing == "wpartition"


def holds(row, features, c):
    f = features[c["ordinal"]]
    v = row[f.name]
    if v is None:
        return None
    test = v >= c["threshold"] if c["threshold"] is not None else v == c["category"]
    return test == c["holds"]


def info(left, right):
    def part(counts):
        n = sum(counts.values())
        return sum(-x * math.log(x / n) for x in counts.values() if x)

    return part(left) + part(right)


def counted(rows):
    out = {}
    for r in rows:
        out[r["class"]] = out.get(r["class"], 0) + 1
    return out


def brute_rules(rows, features, o):
    """The rules of the root, each grown condition by condition, and the best of them."""
    classes, total = sorted({r["class"] for r in rows}), len(features)
    at, best = (1, "1"), None
    for rule in range(1, o.n_rules(total) + 1):
        target = classes[int(u(o.seed, "target", *at, rule) * len(classes))]
        todo = sorted(range(total), key=lambda i: u(o.seed, "rule", *at, rule, i))[: o.n_features(total)]  # noqa: B023
        conditions, score, covered = [], math.inf, rows
        for step in range(o.n_features(total)):
            options = []
            for i in todo:
                name, cand = features[i].name, rule * total + i
                member = {}
                for r in covered:
                    if r[name] is not None:
                        key = (u(o.seed, f"rule{step}", *at, cand, r["id"]), r["id"])
                        pos = r["class"] == target
                        if pos not in member or key < member[pos][0]:
                            member[pos] = (key, r[name])
                if len(member) < 2:
                    continue
                first, second = (member[p][1] for p in sorted(member, key=lambda p: (u(o.seed, f"rule{step}", *at, cand, str(p).lower()), p)))  # noqa: B023
                c = {"ordinal": i, "threshold": None if features[i].kind == "categoric" else (first + second) / 2, "category": first if features[i].kind == "categoric" else None, "holds": True}
                sides = [[r for r in covered if holds(r, features, c) is s] for s in (True, False)]
                pn = [(sum(r["class"] == target for r in s), sum(r["class"] != target for r in s)) for s in sides]
                errors = [round(1 - (p + 1) / (p + n + len(classes)), 9) for p, n in pn]
                options.append((min(errors), i, bool(sides[0]) and bool(sides[1]), errors[0] < errors[1], c, pn))
            if not options:
                break
            s, i, both, left, c, pn = min(options, key=lambda x: x[:2])
            p, n = pn[0 if left else 1]
            if not both or s >= score or p <= 0:
                break
            c["holds"], score = left, s
            conditions.append(c)
            todo.remove(i)
            covered = [r for r in covered if holds(r, features, c)]
            if n <= 0:
                break
        sides = [[r for r in rows if all(holds(r, features, c) for c in conditions) is s] for s in (True, False)]
        value = round(info(*map(counted, sides)), 9)
        if conditions and (best is None or (value, rule) < best[:2]):
            best = (value, rule, conditions, target, len(sides[0]))
    return best


def test_rules_against_brute_force(spark):
    ex = fixture(spark)
    rows = ex.df.collect()
    nodes = node_rows(fit(ex, PLAIN, branch="rule")[0].nodes)
    value, _, conditions, target, n = brute_rules(rows, ex.features, PLAIN)
    root = nodes[1, "1"]
    assert root["feature"].startswith("rule: ") and root["target"] == target and root["ordinal"] is None
    assert [(c["ordinal"], c["threshold"], c["category"], c["holds"]) for c in root["conditions"]] == [(c["ordinal"], c["threshold"], c["category"], c["holds"]) for c in conditions]
    assert root["score"] == pytest.approx(value) and nodes[1, "10"]["n"] == n and nodes[1, "11"]["n"] == len(rows) - n
    assert len({c["ordinal"] for c in conditions}) == len(conditions)


def test_mixed_policies_follow_their_coin(spark):
    ex = fixture(spark)
    of = lambda **o: {k: (r["feature"], r["threshold"], r["n"]) for k, r in node_rows(fit(ex, PLAIN, **o)[0].nodes).items()}
    assert of(branch="random-rule", factor=1.0) == of(branch="rule") != of(branch="subset") == of(branch="random-rule", factor=0.0)
    assert of(branch="combination", factor=1.0) == of(branch="correlation") and " & " in of(branch="correlation")[1, "1"][0]
    either = node_rows(fit(ex, PLAIN, branch="choose-rule")[0].nodes)[1, "1"]

    def chi(r):
        rows = ex.df.collect()
        left = [x for x in rows if (all(holds(x, ex.features, c) for c in r["conditions"]) if r["conditions"] else x[r["feature"]] >= r["threshold"] if r["threshold"] is not None else x[r["feature"]] == r["category"])]
        out = 0.0
        for c, n in counted(rows).items():
            for side, k in ((left, len(left)), (None, len(rows) - len(left))):
                got = counted(left).get(c, 0) if side is not None else n - counted(left).get(c, 0)
                out += (got - n * k / len(rows)) ** 2 / (n * k / len(rows))
        return out

    ruled, plain = (node_rows(fit(ex, PLAIN, branch=b)[0].nodes)[1, "1"] for b in ("rule", "subset"))
    assert either["feature"] == (ruled if chi(ruled) >= chi(plain) else plain)["feature"]


def test_weighted_rules_deal_shares(spark):
    ex = fixture(spark, gaps=True)
    nodes = node_rows(fit(ex, PLAIN, branch="rule", distribute="rulew", missing="right")[0].nodes)
    conditions, rows = nodes[1, "1"]["conditions"], ex.df.collect()
    left = sum(sum(holds(r, ex.features, c) is True for c in conditions) / len(conditions) for r in rows)
    assert nodes[1, "10"]["n"] == pytest.approx(left) and nodes[1, "11"]["n"] == pytest.approx(len(rows) - left)


@pytest.mark.parametrize("missing", ["partition", "wpartition", "ignore", "randomw"])
def test_weights_of_children(spark, missing):
    nodes = node_rows(fit(fixture(spark, gaps=True), PLAIN, missing=missing)[0].nodes)
    root, known = nodes[1, "1"], nodes[1, "1"]["n_left"] + nodes[1, "1"]["n_right"]
    both = nodes[1, "10"]["n"] + nodes[1, "11"]["n"]
    assert both == pytest.approx(known if missing == "ignore" else root["n"])
    if missing == "wpartition":
        assert nodes[1, "10"]["n"] == pytest.approx(root["n_left"] + (root["n"] - known) * (root["n_left"] + 1) / (known + 2))


def test_pruning_and_functions_as_options(spark):
    ex = fixture(spark)
    assert fit(ex, PLAIN, prune=1e9)[0].nodes.count() == 1 and fit(ex, PLAIN, prune=0.0)[0].nodes.count() == 3

    def gini(counts, keys):
        return measures.scores(counts, keys, "gini")

    def first_half(df, seed):
        return df.filter("id <= 60")

    def cheapest(grower, state, live, n):
        asked = grower.asked(live, 0)
        return grower.level(state, asked, n, 0)[1]

    same = lambda **o: sorted((r["node"], r["feature"] or "", r["n"]) for r in fit(ex, PLAIN, **o)[0].nodes.collect())
    assert same(score=gini) == same(score="gini") and same(branch=cheapest) == same(branch="subset")
    model, _ = fit(ex, PLAIN, example_sampling=first_half)
    assert node_rows(model.nodes)[1, "1"]["n"] == 60 and model.options.as_dict()["example_sampling"] == "first_half"


def test_every_policy_has_a_query():
    from copse import queries

    assert {f"branch_{b.replace('-', '_')}" for b in BRANCHES} <= set(queries.queries())


def test_rows_are_not_shuffled_to_their_leaves(spark, monkeypatch):
    ex = fixture(spark)
    model, _ = fit(ex, PLAIN, max_depth=2)
    plan = model.leaves(ex.df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    want = sorted(map(tuple, model.leaves(ex.df).collect()))
    monkeypatch.setattr(forest, "LITERAL", 0)
    plan = model.leaves(ex.df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 3
    assert sorted(map(tuple, model.leaves(ex.df).collect())) == want


def test_candidates_are_columns_of_a_row(spark, monkeypatch):
    ex, o = fixture(spark, gaps=True), {"max_depth": 2, "branch": "random-subset", "features": 2}
    from copse.plans import grow

    seen = []
    whole = grow.Grower.members_at_once
    monkeypatch.setattr(grow.Grower, "members_at_once", lambda *a: seen.append(1) or whole(*a))
    told = lambda: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in fit(ex, PLAIN, **o)[0].nodes.collect())
    want = told()
    assert seen
    monkeypatch.setattr(grow, "SLOTS", 0)
    assert told() == want


@pytest.mark.parametrize("o", [{"branch": "correlation"}, {"branch": "rule"}, {"missing": "randomw"}, {"missing": "ignore"}])
def test_literal_models_predict_alike(spark, monkeypatch, o):
    ex = fixture(spark, gaps=True)
    model, _ = fit(ex, PLAIN, max_depth=3, trees=2, features=2, **o)
    want = sorted(map(str, model.leaves(ex.df).collect()))
    monkeypatch.setattr(forest, "LITERAL", 0)
    assert sorted(map(str, model.leaves(ex.df).collect())) == want


@pytest.mark.parametrize("alone", [0, 100_000])
def test_running_sums(spark, monkeypatch, alone):
    monkeypatch.setattr("copse.functions.rng.ALONE", alone)
    rng = np.random.default_rng(1)
    rows = [(int(k), float(v), int(w)) for k, v, w in zip(rng.integers(0, 3, 500), rng.permutation(500), rng.integers(1, 9, 500), strict=True)]
    got = running(spark.createDataFrame(rows, "k int, v double, w int").repartition(4), ["k"], "v", {"upto": "w"}, following="after").collect()
    for k in range(3):
        own = sorted((r["v"], r["w"], r["upto"], r["after"]) for r in got if r["k"] == k)
        assert [r[2] for r in own] == np.cumsum([r[1] for r in own]).tolist() and [r[3] for r in own] == [r[0] for r in own[1:]] + [None]


def test_sides_of_centroids(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0]), (3, None)], "id long, v array<double>")
    got = df.select(split.centroid_side(F.col("v"), F.array(F.lit(0.0), F.lit(0.0)), F.lit(0.5))).collect()
    assert [r[0] for r in got] == ["left", "right", "?"]


def test_error_of_two_sides(spark):
    df = spark.createDataFrame([(0.2, 0.4), (None, 0.7), (0.3, None)], "l double, r double")
    assert [tuple(r[0]) for r in df.select(measures.with_error(F.col("l"), F.col("r"))).collect()] == [(0.2, 0.2, 0.4), (0.7, 1.0, 0.7), (0.3, 0.3, 1.0)]


def test_learned_rules_use_a_feature_once(spark):
    ex = fixture(spark)
    rule = rules.learn_rule(ex, "x", "r")
    assert rule and len({c[0] for c in rule}) == len(rule)
    inside = rules.covered(ex.df, rule).groupBy("class").count().collect()
    share = {r["class"]: r["count"] for r in inside}
    assert share["x"] / sum(share.values()) > ex.df.filter("class = 'x'").count() / 120


def test_keel_files(spark, tmp_path):
    path = tmp_path / "k.dat"
    path.write_text("@relation r\n@attribute Width real [0.1, 2.5]\n@attribute Colour {red, blue}\n@attribute Kind {a, b}\n@inputs Width, Colour\n@output Kind\n@data\n0.5, red, a\n<null>, blue, b\n\n2.5, <null>, a\n")
    ex = typed_csv.read_keel(spark, str(path))
    assert ex.names("numeric") == ["Width"] and ex.names("categoric") == ["Colour"]
    assert [tuple(r)[1:] for r in ex.df.orderBy("id").collect()] == [("a", 1.0, 0.5, "red"), ("b", 1.0, None, "blue"), ("a", 1.0, 2.5, None)]
    path.write_text("@data\n1,2\n")
    with pytest.raises(ValueError):
        typed_csv.read_keel(spark, str(path))


def test_made_rows_have_ids_of_their_own(spark):
    ex = fixture(spark)
    low = ex.with_df(ex.df.withColumn("id", F.col("id") - 300))
    for some in (low, ex.with_df(ex.df.withColumn("id", F.concat(F.lit("r"), F.col("id").cast("string"))))):
        out = validate.smote_processor(k=3, times=2)(some).df
        assert out.count() == out.select("id").distinct().count() > some.df.count()


def test_one_of_each_and_parts(spark):
    ex = fixture(spark).df
    one = sampling.sample_one(ex, 3).collect()
    assert len(one) == 1 and one[0]["class"] in "xyz"
    parts = [r["count"] for r in sampling.partition(ex, 7, 1).groupBy("part").count().collect()]
    assert sum(parts) == 120 and len(parts) == 7 and max(parts) - min(parts) <= 1


def test_commands(spark, tmp_path, capsys):
    data, model = tmp_path / "set" / "d.txt", str(tmp_path / "model")
    data.parent.mkdir()
    data.write_text("numeric,numeric,class\nA,B,C\n" + "".join(f"{i % 7},{i % 5},{'yes' if i % 7 > 3 else 'no'}\n" for i in range(60)))
    rf = "rf -n 2 --max-depth 2 --no-features all"
    run = lambda *a: cli.main(list(a), spark)
    assert run("deploy", "-i", str(data), "-c", rf, "-o", model) == f"saved {model}\n"
    lines = run("predict-all", "-m", model, "-i", str(data)).splitlines()
    assert len(lines) == 60 and lines[0].startswith("1,no,") and all(":" in x for x in lines)
    assert run("predict", "-m", model, "-i", "6,1").strip() == "yes" and run("predict", "-m", model, "-i", "1,1").strip() == "no"
    assert run("vi", "-m", model).startswith("A,")
    assert " accuracy: " in run("employ", "-m", model, "-i", str(data)) and "class yes" in run("employ", "-m", model, "-i", str(data))
    assert run("test", "-i", str(data), "-c", rf, "-e", "sv --ratio 0.5", "-o", "csv").startswith("fold,accuracy")
    both = run("employ", "-m", model, "-i", str(data), "-o", f"csv,vi,predictions:{tmp_path}/said")
    assert both.startswith("fold,accuracy") and "\nA," in both and both.endswith(f"saved {tmp_path}/said\n")
    assert run("predict-all", "-m", model, "-i", str(data), "-o", f"{tmp_path}/all").startswith("saved")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/all").collect()) == sorted(r[0] for r in spark.read.text(f"{tmp_path}/said").collect()) == sorted(lines)
    assert "<-" in run("rex", "-i", str(data), "-c", rf, "--min-coverage", "0.1")
    assert run("experiment", "-d", str(data.parent), "-t", "1", "-c", rf, "-e", "in").count("in-sample") == 1
    assert "predict-all" in run("help") and "--feature-sampling" in run("help", "rf") and "--model" in run("help", "vi")
    assert cli.run(["test", "-i", str(data), "-c", "svm"]) == 1 and "error: unknown classifier" in capsys.readouterr().err
    assert cli.run(["help", "nothing"]) == 1
    config = tmp_path / "c.json"
    config.write_text('{"log-level": "error", "log-file": "%s"}' % (tmp_path / "log"))
    assert cli.main(["--config", str(config), "help"]) and os.path.exists(tmp_path / "log")


def test_streams_score_like_batches(spark, tmp_path):
    ex = fixture(spark)
    model, _ = fit(ex, PLAIN)
    ex.df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ex.df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    key = lambda df: sorted(map(tuple, df.select("id", "class", "prob", "rank").collect()))
    assert key(got) == key(model.transform(ex.df))


def test_policies_combine(spark):
    """Pairs for some nodes, for the others the more significant of a rule and a redrawn feature, against their parts."""
    ex = fixture(spark, n=200)
    o = {"max_depth": 2, "features": 1}
    coin = F.pmod(F.xxhash64("node"), F.lit(2)).cast("double")
    redrawn = policies.again(policies.plain(), lambda r: F.coalesce(F.col("chi2") < 3.0, F.lit(True)), 3)
    mixed = policies.either(policies.paired(), policies.significant([policies.ruled(), redrawn]), coin, 0.5)
    of = lambda policy: node_rows(fit(ex, PLAIN, branch=policy, **o)[0].nodes)
    got = of(mixed)
    coins = {r[0]: r[1] for r in spark.createDataFrame([(n,) for _, n in got], "node string").select("node", coin).collect()}
    parts = {k: of(p) for k, p in {"pair": policies.paired(), "rule": policies.ruled(), "again": redrawn}.items()}
    shape = lambda r: (r["kind"], r["feature"], r["threshold"], r["n_left"], r["score"])
    root = got[1, "1"]
    if coins["1"] <= 0.5:
        assert shape(root) == shape(parts["pair"][1, "1"])
    else:
        assert shape(root) in (shape(parts["rule"][1, "1"]), shape(parts["again"][1, "1"]))
    assert {r["feature"] is not None and " & " in r["feature"] for k, r in got.items() if r["kind"] == "node" and coins[k[1]] <= 0.5} <= {True}
    assert not any(" & " in r["feature"] for k, r in got.items() if r["kind"] == "node" and coins[k[1]] > 0.5)
    assert of(policies.again(policies.plain(), lambda r: F.col("chi2").isNull(), 0)) == of(policies.plain()) == node_rows(fit(ex, PLAIN, branch="subset", **o)[0].nodes)


def test_strategies_are_functions(spark):
    ex = fixture(spark, gaps=True)
    same = lambda **o: sorted(map(str, fit(ex, PLAIN, **o)[0].nodes.collect()))
    assert same(missing=lambda left, right: F.lit(0.0), features=lambda n: n) == same(missing="right")
    assert same(threshold=lambda x, y: (x + y) / 2) == same() and same(threshold=lambda x, y: x) == same(threshold="value")
    assert same(prune=lambda chi2, left, right: chi2 >= 1e9) == same(prune=1e9)
    least = node_rows(fit(ex, PLAIN, prune=lambda chi2, left, right: F.least(left, right) >= 1e6)[0].nodes)
    assert set(least) == {(1, "1")}
    from copse.operators import split

    assert same(distribute=lambda v, by: split.numeric_side(v, by) if "num" in str(v) or "nums" in str(v) else split.categoric_side(v, by)) == same()
    turned = node_rows(fit(ex, PLAIN, threshold=lambda x, y: F.greatest(x, y), distribute=lambda v, by: F.when(v == by, "left").otherwise("right"))[0].nodes)[1, "1"]
    rows = [r for r in ex.df.collect() if r[turned["feature"]] == (turned["threshold"] if turned["threshold"] is not None else turned["category"])]
    assert turned["n_left"] == len(rows)


def test_folds_over_trees_give_votes_accuracy_and_importance(spark, monkeypatch):
    ex = fixture(spark)
    model, bags = fit(ex, PLAIN, trees=4, max_depth=3, features=2, example_sampling="bagging")
    want = {(r["id"], r["class"], r["prob"]) for r in model.transform(ex.df).filter("rank = 1").collect()}
    for at_hand in (50_000, 7):
        monkeypatch.setattr(folds, "AT_HAND", at_hand)
        got = model.query_trees(ex.df, ["id"], ["pred"], folds.majority(4)).collect()
        assert {tuple(r) for r in got} == want and len(got) == 120
    out = sampling.out_of_bag(ex.df, bags, 4)
    hit = (F.col("pred") == F.col("actual")).cast("double")
    oob = {r["tree"]: (r["accuracy"], r["n"]) for r in model.query_trees(ex.df, ["tree"], [hit], folds.mean("accuracy"), only=out).collect()}
    assert oob == {r["tree"]: (pytest.approx(r["accuracy"]), r["n"]) for r in model.oob_accuracy(ex.df, bags).collect()}
    gains = model.nodes.filter("kind = 'node'")
    gains = gains.join(gains.groupBy("tree").agg(F.sum("gain").alias("all")), "tree")
    shares = {r["feature"]: r["importance"] for r in folds.folded(gains, ["feature"], [F.col("gain") / F.col("all") / 4], folds.total("importance")).collect()}
    assert shares == {r["feature"]: pytest.approx(r["importance"]) for r in model.importance().collect()}


def test_bags_of_trees_are_forests(spark):
    ex = fixture(spark)
    o = Options(trees=3, max_depth=2, seed=4)
    bag, _ = bagging.bagged(ex, bagging.TREES, o)
    model, _ = fit(ex, o)
    assert sorted(map(tuple, bag.votes(ex.df).collect())) == sorted(map(tuple, model.votes(ex.df).collect()))
    centres, _ = bagging.bagged(fixture(spark, gaps=True), bagging.CENTRES, o)
    assert centres.votes(fixture(spark, gaps=True).df).count() == 360


def test_forests_resume(spark, tmp_path):
    ex = fixture(spark)
    o = Options(trees=5, max_depth=3, seed=4)
    path = str(tmp_path / "forest")
    first = build(ex, o, path, batch=2, most=1)
    assert first.options.trees == 2 and first.votes(ex.df).select("tree").distinct().count() == 2
    (tmp_path / "forest" / "batch-1").mkdir()  # a run that stopped
    (tmp_path / "forest" / "batch-1" / "part-0.parquet").write_bytes(b"half")
    assert partial(spark, path).options.trees == 2
    whole = build(ex, o, path, batch=2)
    assert sorted(map(str, whole.nodes.collect())) == sorted(map(str, fit(ex, o)[0].nodes.collect()))
    with pytest.raises(ValueError):
        build(ex, Options(trees=5, max_depth=3, seed=5), path, batch=2)


@pytest.mark.parametrize("kind", ["bagging", "subagging", "random"])
def test_groups_grow_as_alone(spark, kind):
    ex = fixture(spark)
    dealt = ex.with_df(ex.df.withColumn("fold", F.col("id") % 3 + 1))
    o = Options(trees=2, max_depth=2, seed=4, example_sampling=kind)
    both = fit_groups(dealt, "fold", 3, o)
    for fold, (model, bags) in enumerate(both, 1):
        alone, own = fit(ex.with_df(ex.df.filter(F.col("id") % 3 + 1 != fold)), o)
        shape = lambda nodes: sorted((r["tree"], r["node"], r["feature"] or "", r["threshold"] or 0.0, r["n"], r["class"]) for r in nodes.collect())
        assert shape(model.nodes) == shape(alone.nodes)
        assert sorted(map(str, bags.select("tree", "id", "weight").collect())) == sorted(map(str, own.select("tree", "id", "weight").collect()))


def test_proximity_reads_rare_leaves_first(spark):
    ex = fixture(spark, n=300)
    model, _ = fit(ex, Options(trees=6, max_depth=8, seed=3))
    at = {}
    for r in model.leaves(ex.df).collect():
        at.setdefault(r["id"], {})[r["tree"]] = r["node"]
    counts = {}
    queries = ex.df.filter("id % 10 = 0")
    got = sorted((r["query"], r["rank"], r["id"], round(r["proximity"], 9)) for r in model.proximity(ex.df, queries, 4, counts).collect())
    want = []
    for q in range(10, 301, 10):
        near = sorted((-sum(at[q][t] == at[i][t] for t in at[q]), i) for i in at if i != q)
        want += [(q, n, i, round(-s / 6, 9)) for n, (s, i) in enumerate(near[:4], 1) if s]
    assert got == sorted(want) and counts["compared"] < counts["all"]


@pytest.mark.parametrize("o", [{"branch": "rule"}, {"branch": "rule", "distribute": "rulew", "missing": "partition"}])
def test_rules_by_columns_and_by_rows_agree(spark, monkeypatch, o):
    """Candidates as columns of their rows, or, where they are too many, as rows of their own."""
    ex = fixture(spark, gaps=True)
    of = lambda: sorted((str(tuple(r)) for r in fit(ex, PLAIN, max_depth=2, features=2, **o)[0].nodes.collect()))
    columns = of()
    monkeypatch.setattr(grow, "SLOTS", 0)
    assert of() == columns and "rule: " in "".join(columns)


def test_rules_meet_rows_in_compiled_columns(spark, capsys):
    """No function over an array of conditions is called row by row."""
    grower = grow.Grower(fixture(spark).features, Options(branch="rule", distribute="rulew"))
    state = spark.createDataFrame([(1, "1", 7, "x", 1.0, [1.0, None], ["u", None])], "tree int, node string, id long, class string, weight double, nums array<double>, cats array<string>")
    cuts = spark.createDataFrame([(1, "1", 1, None, None, None, None, None, None, [(0, 0.5, None, True), (1, 2.0, None, False)], "x")], f"tree int, node string, cand int, {grow.SPLIT}")
    rows = grower.sided(state, cuts, 1)
    assert [tuple(r)[-3:] for r in rows.collect()] == [(0.5, 0.0, 0.5)]
    rows.explain()
    grower.route(state, cuts.withColumns({"n_left": F.lit(1.0), "n_right": F.lit(1.0)}), 1).explain()
    assert "lambda" not in capsys.readouterr().out
