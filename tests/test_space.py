"""Cells of a space partition, bounded tops and proximity against full searches."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from copse.functions.tops import top
from copse.operators import cells, neighbors
from copse.operators.examples import Feature
from copse.plans import tables

MIXED = (Feature("x", "numeric"), Feature("kind", "categoric", 1), Feature("y", "numeric", 2))
PLAIN = (MIXED[0], Feature("y", "numeric", 1))


def mixed(spark, n, seed=1):
    """Ties, equal points (a third of the rows), missing numbers and categories."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((i, 5.0, "a", 2.0))
        else:
            rows.append((i, rng.choice([None, float(rng.randint(0, 9)), rng.random() * 10]), rng.choice(["a", "b", "c", None]), rng.choice([None, float(rng.randint(0, 3))])))
    return spark.createDataFrame(rows, "id long, x double, kind string, y double")


def rows_of(df):
    return sorted((r["query"], r["rank"], r["id"], round(r["distance"], 9)) for r in df.collect())


def test_cells_find_what_a_full_search_finds(spark, monkeypatch):
    df = mixed(spark, 400)
    queries = df.filter("id % 7 = 0").unionByName(spark.createDataFrame([(-1, None, None, None), (-2, 99.0, "zz", -5.0)], df.schema))
    want = rows_of(neighbors.nearest(df, queries, MIXED, 4))
    assert rows_of(cells.nearest_in_cells(df, queries, MIXED, 4, rows=40)) == want
    monkeypatch.setattr(cells, "LEVELS", 2)
    monkeypatch.setattr(cells, "NODES", 8)
    assert rows_of(cells.nearest_in_cells(df, queries, MIXED, 4, rows=15)) == want  # several rounds of cuts
    space = cells.partition(df, MIXED, rows=15)
    assert len(space.rounds) > 1 and space.rows.count() == 400


def test_few_cells_are_searched(spark):
    df = spark.range(4000).select("id", (F.xxhash64("id", F.lit(1)) % 1000 / 10.0).alias("x"), (F.xxhash64("id", F.lit(2)) % 1000 / 7.0).alias("y"))
    counts = {}
    queries = df.filter("id % 20 = 0")
    assert rows_of(cells.nearest_in_cells(df, queries, PLAIN, 3, rows=60, counts=counts)) == rows_of(neighbors.nearest(df, queries, PLAIN, 3))
    assert counts["searched"] < 0.2 * counts["all"]


def test_cells_of_nothing_and_of_one_point(spark):
    none = spark.createDataFrame([], "id long, x double, kind string, y double")
    assert cells.nearest_in_cells(none, none, MIXED, 3).count() == 0
    same = spark.range(300).select("id", F.lit(1.0).alias("x"), F.lit("a").alias("kind"), F.lit(None).cast("double").alias("y"))
    got = rows_of(cells.nearest_in_cells(same, same.filter("id < 3"), MIXED, 2, rows=10))
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (1, 1, 0, 1.0), (1, 2, 2, 1.0), (2, 1, 0, 1.0), (2, 2, 1, 1.0)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 4)), min_size=1, max_size=40), st.integers(1, 4), st.integers(1, 5))
def test_tops_merge(spark, rows, k, parts):
    numbered = [(key, v, i) for i, (key, v) in enumerate(rows)]
    df = spark.createDataFrame(numbered, "key int, v int, i int")
    want = {(key, v, i, r) for key in range(3) for r, (_, v, i) in enumerate(sorted(x for x in numbered if x[0] == key)[:k], 1)}
    assert {tuple(r) for r in top(df, ["key"], ["v", "i"], k, rank="rank", parts=parts).collect()} == want
    low, high = df.filter("i % 2 = 0"), df.filter("i % 2 = 1")
    both = top(low, ["key"], ["v", "i"], k).unionByName(top(high, ["key"], ["v", "i"], k))
    assert {tuple(r) for r in top(both, ["key"], ["v", "i"], k, rank="rank").collect()} == want


def test_tops_are_cut_before_the_shuffle(spark, capsys):
    top(spark.range(100).selectExpr("id % 3 AS key", "id"), ["key"], ["id"], 2).explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan and plan.rindex("Partial") > plan.index("Exchange")


def test_equal_queries_are_searched_once(spark):
    """300 queries of 30 points; each leaves itself out, though its equals share the search."""
    df = spark.range(600).select("id", (F.col("id") % 30).cast("double").alias("x"), F.when(F.col("id") % 4 > 0, (F.col("id") % 5).cast("double")).alias("y"))
    counts, queries = {}, df.filter("id % 2 = 0")
    assert rows_of(cells.nearest_in_cells(df, queries, PLAIN, 4, rows=40, counts=counts)) == rows_of(neighbors.nearest(df, queries, PLAIN, 4))
    points = queries.select("x", "y").distinct().count()
    assert points < 60 and counts["searched"] <= counts["all"] and counts["all"] % points == 0 and counts["all"] < 300 * 15


def test_rows_come_to_cells_by_compiled_joins(spark, monkeypatch):
    """Joins of each level's cuts lead to the cells that the walk along arrays of cuts leads to, and no row takes such arrays along."""
    monkeypatch.setattr(cells, "LEVELS", 3)
    monkeypatch.setattr(cells, "NODES", 16)
    df = mixed(spark, 600)
    asked = df.unionByName(spark.createDataFrame([(-1, None, None, None), (-2, 99.0, "zz", -5.0), (-3, float("nan"), "", 1.0)], df.schema))
    space = cells.partition(df, MIXED, rows=10)
    assert len(space.rounds) > 1 and all(c.nodes is not None for c in space.rounds)
    joined = {r["id"]: r["cell"] for r in space.of(asked).collect()}
    plan = cells._moved(space.space, df.withColumn("cell", F.lit(0).cast("long")), space.rounds[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin") == space.rounds[0].levels and "lambda" not in plan and "axes" not in plan.split("BroadcastExchange")[0]
    walked = cells.Cells(space.space, space.rows, [cells.Cuts(c.by_cell, c.levels, None) for c in space.rounds], space.boxes)
    assert {r["id"]: r["cell"] for r in walked.of(asked).collect()} == joined and len(set(joined.values())) > 10
    assert {r["id"]: r["cell"] for r in space.rows.collect()} == {i: c for i, c in joined.items() if i >= 0}
    monkeypatch.setattr(tables, "BROADCAST_ROWS", 0)
    many = cells.partition(df, MIXED, rows=10)
    assert all(c.nodes is None for c in many.rounds) and {r["id"]: r["cell"] for r in many.rows.collect()} == {r["id"]: r["cell"] for r in space.rows.collect()}


def test_ranges_are_those_of_the_points(spark, monkeypatch):
    """The ranges come from the table of distinct points that is written anyway; rows aren't made once more for them."""
    seen, ranges_of = [], cells.ranges_of
    monkeypatch.setattr(cells, "ranges_of", lambda df, features: seen.append((hasattr(df, "stored_at"), ranges_of(df, features))) or seen[-1][1])
    df = mixed(spark, 200)
    cells.nearest_in_cells(df, df.filter("id % 7 = 0"), MIXED, 3, rows=40).count()
    assert seen == [(True, ranges_of(df, MIXED))]
