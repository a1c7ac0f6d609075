"""Branching policies as values, and combinators that make policies of policies.

A policy is asked about nodes (tree, node, entropy) of a level and gives the best splits of those it can split.  What it
draws, it draws by the node alone, so a policy may be asked about any set of nodes, and combinators ask each
policy about the nodes that concern it.  A policy may be asked about again, in a later round, with other features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stored

AT = ["tree", "node"]


@dataclass
class Level:
    """What policies work on: the grower, the rows of the level, its class weights, and how many nodes it has.

    live: the nodes that may split; base: their splits by plain() in round 0, from the aggregation that gives the weights;
    None where the option branch is rule, which doesn't ask plain().
    """

    grower: object
    state: DataFrame
    weights: DataFrame
    n: int
    live: DataFrame
    base: DataFrame | None


@dataclass(frozen=True)
class Policy:
    """ask(level, nodes, round) gives the splits of nodes; a value of the option branch."""

    ask: Callable[[Level, DataFrame, int], DataFrame]

    def __call__(self, level: Level, nodes: DataFrame, round_: int) -> DataFrame:
        return self.ask(level, nodes, round_)


def plain() -> Policy:
    """The best of the features (or pairs, as the options say) that a node draws in a round."""

    def run(level: Level, nodes: DataFrame, round_: int) -> DataFrame:
        if not round_:
            return level.base if nodes is level.live else level.base.join(nodes.select(*AT), AT, "left_semi")
        return level.grower.level(level.state, level.grower.asked(nodes, round_), level.n, round_)[1]

    return Policy(run)


def paired() -> Policy:
    """The best of the pairs of features that a node draws."""
    return Policy(lambda level, nodes, round_: level.grower.level(level.state, level.grower.asked(nodes, round_, paired=True), level.n, round_)[1])


def ruled() -> Policy:
    """The best of some rules of a node."""
    return Policy(lambda level, nodes, round_: stored(level.grower.of_rules(level.state, nodes, level.weights, level.n), "ruled"))


def either(one: Policy, two: Policy, coin: Column, threshold: float) -> Policy:
    """The first policy where a node's coin is at most the threshold, else the second."""

    def run(level: Level, nodes: DataFrame, round_: int) -> DataFrame:
        return one(level, nodes.filter(coin <= threshold), round_).unionByName(two(level, nodes.filter(coin > threshold), round_))

    return Policy(run)


def most(policies: list[Policy], by: Callable[[int], list[Column]]) -> Policy:
    """Of what the policies find for a node, the one with the greatest by(i), where i is the policy's place."""

    def run(level: Level, nodes: DataFrame, round_: int) -> DataFrame:
        found = [p(level, nodes, round_) for p in policies]
        columns = found[0].columns
        both = None
        for i, f in enumerate(found):
            f = f.select(*columns, F.struct(*by(i)).alias("_by"))
            both = f if both is None else both.unionByName(f)
        one = both.groupBy(*AT).agg(F.max_by(F.struct(*columns), "_by").alias("b"))
        return one.select("b.*")

    return Policy(run)


def significant(policies: list[Policy]) -> Policy:
    """The split with the greatest chi-square, of equals the one of the later policy."""
    return most(policies, lambda i: [F.col("chi2"), F.lit(i)])


def again(do: Policy, poor: Callable[[int], Column], rounds: int, ends: Callable[[int], bool] = lambda round_: False) -> Policy:
    """Asks do again, in up to so many more rounds, about nodes whose split is poor, or that have none.

    poor(round): a condition on the columns of the split found before (null where there is none, which counts as poor
    where the condition is null) and the node.  ends(round): whether the nodes asked have nothing left in that round; they get
    no split.
    """

    def run(level: Level, nodes: DataFrame, round_: int) -> DataFrame:
        asked, found = nodes, stored(do(level, nodes, round_), "found")
        for r in range(1, rounds + 1):
            left = stored(asked.join(found, AT, "left").filter(poor(r)).select(*asked.columns), "poor")
            n = left.count()
            if not n:
                break
            found, asked = found.join(left, AT, "left_anti"), left
            if ends(r):
                break
            own = Level(level.grower, level.state, level.weights, n, level.live, level.base)
            found = stored(found.unionByName(do(own, left, r)), "found")
        return found

    return Policy(run)
