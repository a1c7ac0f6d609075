"""Rows as arrays against rows of tables, and hashes of arrays against hashlib."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.functions.draws import Leads
from copse.operators import metrics, sampling
from copse.operators.examples import ExampleSet
from copse.plans import forest, grow, packed
from copse.plans.forest import Options, fit


def fixture(spark, n=150):
    """Prices with gaps and NaN, words with gaps, two classes and rows without a class."""
    rows = [(i * 7, "xyz"[(i * i) % 7 % 3] if i % 11 else None, float((i * 37) % 101) if i % 6 else float("nan") if i % 4 else None, float(i % 12), "uvw"[(i // 3) % 3] if i % 10 else None) for i in range(n)]
    return ExampleSet.of(spark.createDataFrame(rows, "i long, c string, a double, b double, cat string"), "i", "c", ("a", "b"), ("cat",))


def told(df):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.collect())


def test_hashes_of_arrays():
    texts = ["5:0:1:1011:2:", "5:0:10:1011:2:", "x" * 50 + ":", "", "\u00e9:", "z" * 130]
    numbers = np.array([n for k in range(19) for n in (0, 10**k - 1, 10**k, 10**k + 7)] + [2**31, 2**32, 2**63 - 1])
    which = np.arange(len(numbers)) % len(texts)
    want = [int(hashlib.md5((texts[w] + str(n)).encode()).hexdigest()[:8], 16) for w, n in zip(which, numbers, strict=True)]
    assert Leads(texts).heads(which, numbers).tolist() == want


@pytest.mark.parametrize("o", [{}, {"missing": "ignore", "branch": "random-subset"}, {"missing": "right", "threshold": "value", "score": "gini", "features": "all"}])
def test_rows_in_arrays_grow_the_same_trees(spark, monkeypatch, o):
    """No level writes its rows or joins them with their nodes; where nodes are too many, rows go on as a table."""
    ex, o = fixture(spark), Options(trees=3, max_depth=6, seed=5, **o)
    want = told(fit(ex, o)[0].nodes)
    names, of = [], grow.stored
    monkeypatch.setattr(grow, "stored", lambda df, name, *a: names.append(name) or of(df, name, *a))
    monkeypatch.setattr(packed, "FEW", 0)
    monkeypatch.setattr(packed, "BLOCK", 64)
    assert told(fit(ex, o)[0].nodes) == want
    assert "cuts" in names and "level" not in names
    monkeypatch.setattr(packed, "CELLS", 100)
    assert told(fit(ex, o)[0].nodes) == want and "level" in names


@pytest.mark.parametrize("missing", ["weighted", "ignore", "left"])
def test_rows_in_arrays_predict_alike(spark, monkeypatch, missing):
    ex = fixture(spark)
    model, _ = fit(ex, Options(trees=3, max_depth=5, seed=5, missing=missing, features="all"))
    other = ex.df.withColumn("cat", F.when(F.col("id") % 3 == 0, "new").otherwise(F.col("cat")))
    want = [told(model.leaves(other)), told(metrics.predicted(model.transform(other))), told(model.proximity(other, other.filter("id % 4 = 0"), 3))]
    monkeypatch.setattr(forest, "ARRAYS", 0)
    assert "MapInArrow" in model.leaves(other)._jdf.queryExecution().executedPlan().toString()
    assert [told(model.leaves(other)), told(metrics.predicted(model.transform(other))), told(model.proximity(other, other.filter("id % 4 = 0"), 3))] == want


def test_equal_draws_go_by_id(spark):
    """As SQL orders them; hashes of ids order rows whose ids are no numbers."""
    from copse.functions.rng import among_equals

    df = spark.createDataFrame([(0,), (7,), (2**31 - 1,), (2**31,), (-1,)], "id long")
    got = [r[0] for r in df.select(among_equals(df)).collect()]
    assert got[:3] == [0, 7, 2**31 - 1] and all(0 <= x < 2**31 for x in got)


@pytest.mark.parametrize("trees", [None, 3])
def test_draws_are_counted_in_blocks(spark, monkeypatch, trees):
    monkeypatch.setattr(sampling, "DRAWS", 20)
    ex = fixture(spark, 101)
    u = lambda *k: int(hashlib.md5(":".join(map(str, k)).encode()).hexdigest()[:8], 16) / 2**32
    order, want = sorted((u(9, "order", i * 7), i * 7) for i in range(101)), {}
    for t in range(1, (trees or 1) + 1):
        for draw in range(1, 102):
            key = t, order[int(u(9, *([t] if trees else []), draw) * 101)][1]
            want[key] = want.get(key, 0) + 1
    got = sampling.bootstrap(ex.df, 9, trees)
    assert {(r["tree"] if trees else 1, r["id"]): r["weight"] for r in got.collect()} == want


def test_proximity_makes_no_row_for_each_tree(spark, monkeypatch):
    """The leaves of a row come as one array."""
    ex = fixture(spark, 60)
    model, _ = fit(ex, Options(trees=2, max_depth=3, seed=5))
    monkeypatch.setattr(forest, "ARRAYS", 0)
    monkeypatch.setattr(forest.ForestModel, "leaves", None)
    assert model.proximity(ex.df, ex.df.filter("id % 4 = 0"), 2).count() == 2 * ex.df.filter("id % 4 = 0").count()
