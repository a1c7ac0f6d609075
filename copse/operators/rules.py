"""Conjunctive rules: scores, separate and conquer, extraction from a table of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.functions import measures
from copse.functions.rng import u

from .examples import ExampleSet


def condition(feature: str, kind: str, value, holds: bool = True) -> Column:
    """A condition with its direction; a missing value never fulfils it."""
    test = F.col(feature) >= F.lit(value) if kind == "numeric" else F.col(feature) == F.lit(value)
    return F.coalesce(test if holds else ~test, F.lit(False))


def covered(ex: DataFrame, rule: list[tuple[str, str, object, bool]]) -> DataFrame:
    out = ex
    for c in rule:
        out = out.filter(condition(*c))
    return out


def rule_score(pos: Column, neg: Column, kind: str = "laplace", classes: int = 2, prior: Column | None = None) -> Column:
    if kind == "laplace":
        return measures.laplace(pos, neg, classes)
    if kind == "m":
        return measures.m_estimate(pos, neg, float(classes), prior if prior is not None else F.lit(0.5))
    return measures.purity(pos, neg)


def learn_rule(ex: ExampleSet, positive: str, seed, kind: str = "laplace", longest: int | None = None) -> list[tuple[str, str, object, bool]]:
    """Separate and conquer: the best condition on a feature that the rule hasn't yet, while the score falls.

    It ends where no features, positive or negative rows are left (or at longest conditions).  A step takes two
    aggregations over the rows that the rule covers; a row of each reaches the driver.
    """
    rows = ex.df.withColumn("_pos", (F.col("class") == positive).cast("double"))
    classes = ex.df.select("class").distinct().count()
    have = rows.agg(F.coalesce(F.sum("_pos"), F.lit(0.0)), F.coalesce(F.sum(1 - F.col("_pos")), F.lit(0.0))).first()
    total = have[0] + have[1]
    prior = have[0] / total if total else 0.0
    score = lambda p, n: {"laplace": 1 - (p + 1) / (p + n + classes), "m": 1 - (p + classes * prior) / (p + n + classes)}.get(kind, 1 - p / (p + n))
    rule, best, left = [], 1.0, list(ex.features)
    while left and have[0] and have[1] and (longest is None or len(rule) < longest):
        here = covered(rows, rule)
        # A value of each feature: that of the positive row with the least draw.
        order = lambda f: F.when(F.col(f.name).isNotNull(), F.struct(F.when(F.col("_pos") == 1, u(seed, len(rule), f.name, F.col("id"))).otherwise(2.0), F.col("id")))  # noqa: E731, B023
        values = here.agg(*[F.min_by(f.name, order(f)) for f in left]).first()
        options = [(f.name, f.kind, v, holds) for f, v in zip(left, values, strict=True) if v is not None for holds in (True, False)]
        if not options:
            break
        part = lambda c, pos: F.coalesce(F.sum(F.when(condition(*c), (F.col("_pos") if pos else 1 - F.col("_pos")) * F.col("weight"))), F.lit(0.0))
        got = here.agg(*[part(c, pos) for c in options for pos in (True, False)]).first()
        scored = [(score(got[2 * i], got[2 * i + 1]), i) for i in range(len(options)) if got[2 * i]]
        if not scored or min(scored)[0] >= best:
            break
        best, i = min(scored)
        have = (got[2 * i], got[2 * i + 1])
        rule.append(options[i])
        left = [f for f in left if f.name != options[i][0]]
    return rule


def extract_rules(nodes: DataFrame, total: float, min_confidence: float = 0.7, min_coverage: float = 0.3) -> DataFrame:
    """Nodes and leaves whose majority share and coverage suffice, with the conditions of their path."""
    confidence, share = F.col("majority_n") / F.col("n"), F.col("n") / F.lit(float(total))
    leaf = F.col("kind") == "leaf"
    ok = F.when(leaf, (confidence > min_confidence) & (share > min_coverage)).otherwise((confidence >= min_confidence) & (share >= min_coverage))
    good = nodes.filter(ok).select("tree", "node", "kind", F.col("class").alias("class"), confidence.alias("confidence"), share.alias("coverage"))
    steps = good.select("tree", "node", F.explode(F.expr("transform(sequence(1, length(node)), i -> struct(i as depth, substring(node, 1, i) as up, substring(node, i + 1, 1) as turn))")).alias("s")).select("tree", "node", "s.*").filter("turn <> ''")
    above = nodes.select("tree", F.col("node").alias("up"), "feature", "threshold", "category", *(["ordinal_b", "conditions"] if "conditions" in nodes.columns else []))
    plain = F.concat_ws(" ", "feature", F.when(F.col("threshold").isNotNull(), F.when(F.col("turn") == "0", ">=").otherwise("<")).otherwise(F.when(F.col("turn") == "0", "=").otherwise("<>")), F.coalesce(F.round("threshold", 6).cast("string"), "category"))
    text = plain
    if "conditions" in nodes.columns:  # pairs of features and rules by their name, with the side
        text = F.when(F.col("ordinal_b").isNotNull() | F.col("conditions").isNotNull(), F.concat(F.when(F.col("turn") == "1", "not ").otherwise(""), F.lit("("), F.col("feature"), F.lit(")"))).otherwise(plain)
    paths = steps.join(above, ["tree", "up"]).groupBy("tree", "node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", text.alias("t")))), lambda s: s["t"]), " & ").alias("rule"))
    return good.join(paths, ["tree", "node"], "left").withColumn("rule", F.coalesce("rule", F.lit("")))
