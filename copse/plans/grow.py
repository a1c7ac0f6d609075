"""Growing trees level by level, all trees in one plan.

The rows of a level are (tree, node, id, class, weight, nums, cats), with a value for each feature in nums or cats.
What a node may inspect is drawn before rows are read.  Then a level takes two aggregations over its rows, one for
class weights and candidate thresholds, one for what each candidate puts on either side; a projection moves rows to
their child.  Splits meet rows by broadcast joins, so rows aren't shuffled; where a level has more nodes than may be
broadcast, they are joined by (tree, node).  Every few levels the rows are written, which bounds the plans.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copse.functions import measures
from copse.functions.rng import among_equals, u
from copse.operators import rules, split
from copse.operators.examples import ExampleSet, Feature

from .options import PAIRED, RULED, Options
from .packed import DECIDED, PLAIN, WORDS, Packed, packed
from .policies import Level, Policy, again, either, plain, ruled, significant
from .tables import discard, small, stored

AT = ["tree", "node"]
#: Levels after which the rows are written; between, they are routed again from the last table.  With rules, whose levels read
#: their rows many times, they are written after each.
STORE_LEVELS = 4
#: Candidates of a node that a row counts for at once; more are rows of their own.
SLOTS = 8
CONDITIONS = "array<struct<ordinal: int, threshold: double, category: string, holds: boolean>>"
#: A split: one condition, two (b) or a rule for a target class; null where it isn't of that form.
SPLIT = "ordinal int, threshold double, category string, ordinal_b int, threshold_b double, category_b string, conditions " + CONDITIONS + ", target string"
SPLIT_COLUMNS = [c.split()[0] for c in SPLIT.replace(CONDITIONS, "x").split(", ")]
#: The shares of a row on its sides.
ON = {"on_left": split.LEFT, "on_right": split.RIGHT, "on_missing": split.MISSING}


def values_of(features: tuple[Feature, ...]) -> dict[str, Column]:
    """The columns nums and cats of rows with a column for each feature, in the order of ordinals."""
    of = lambda kind, type_: F.array(*[(F.col(f"`{f.name}`") if f.kind == kind else F.lit(None)).cast(type_) for f in features])
    return {"nums": of("numeric", "double"), "cats": of("categoric", "string")}


def _value(array: str, ordinal: Column) -> Column:
    return F.try_element_at(F.col(array), ordinal + 1)


def condition_side(ordinal: Column, threshold: Column, category: Column, o: Options | None = None) -> Column:
    """The side by one feature, or what the option distribute says of its value and what it is split by."""
    number, word = _value("nums", ordinal), _value("cats", ordinal)
    if o is not None and callable(o.distribute):
        known = F.when(threshold.isNotNull(), o.distribute(number, threshold)).otherwise(o.distribute(word, category))
        return F.when(F.when(threshold.isNotNull(), number.isNull()).otherwise(word.isNull()), split.MISSING).otherwise(known)
    return F.when(threshold.isNotNull(), split.numeric_side(number, threshold)).otherwise(split.categoric_side(word, category))


def own_tree(o: Options) -> Column:
    """The number of a tree in its own forest, by which it draws."""
    return F.col("tree") if o.groups == 1 else F.pmod(F.col("tree") - 1, F.lit(o.trees)) + 1


def _of_rule(conditions: Column | str = "conditions") -> Column:
    """The sides by all conditions of a rule, an array; for rules of any length."""

    def side(c):
        plain = condition_side(c["ordinal"], c["threshold"], c["category"])
        return F.when((plain == split.MISSING) | c["holds"], plain).when(plain == split.LEFT, split.RIGHT).otherwise(split.LEFT)

    return F.transform(conditions, side)


def _flat(conditions: Column, longest: int, name: str = "_c") -> dict[str, Column]:
    """The conditions of a rule, which has longest at most, as columns: these are compiled, functions over an array of conditions aren't."""
    return {f"{name}{i}_{f}": F.get(conditions, F.lit(i))[f] for i in range(longest) for f in ("ordinal", "threshold", "category", "holds")}


def _met(name: str) -> Column:
    """Whether a row meets the condition of these columns, whichever way it goes; null if it misses the value or there is no condition."""
    number, word = F.get("nums", f"{name}_ordinal"), F.get("cats", f"{name}_ordinal")
    return F.when(number.isNotNull(), number >= F.col(f"{name}_threshold")).when(word.isNotNull(), F.coalesce(word == F.col(f"{name}_category"), F.lit(False))) == F.col(f"{name}_holds")


def longest_rule(o: Options, total: int) -> int | None:
    """How many conditions a rule has at most: a feature each; None if unknown, or too many to be columns."""
    n = o.n_features(total)
    return n if o.branch in RULED and n <= SLOTS else None


def side_of(o: Options, of=F.col) -> Column:
    """The side of a row by the columns of SPLIT and its node, or by what else of() gives for their names."""
    one = condition_side(of("ordinal"), of("threshold"), of("category"), o)
    if o.branch in PAIRED or callable(o.branch):
        two = condition_side(of("ordinal_b"), of("threshold_b"), of("category_b"), o)
        coin = u(o.seed, "coin", own_tree(o), of("node"), F.col("id"))
        one = F.when(of("ordinal_b").isNotNull(), split.combined_side(one, two, coin)).otherwise(one)
    if o.branch in RULED or callable(o.branch):
        one = F.when(of("conditions").isNotNull(), split.rule_side(_of_rule(of("conditions")))).otherwise(one)
    return one


def _shared(o: Options, rows: DataFrame, cuts: DataFrame, longest: int | None) -> DataFrame:
    """Rows joined with cuts (the columns of SPLIT and more), and the shares of a row on either side and missing: the columns of ON.

    With rulew these are the shares of its rule's conditions; else the row is on one side as a whole.
    """
    weighted = o.distribute == "rulew" and (o.branch in RULED or callable(o.branch))
    if longest is None:
        rows = rows.join(cuts, AT)
        side, sides, count = side_of(o), _of_rule(), lambda s: F.size(F.filter("_sides", lambda x: x == s))
        rows = rows.withColumn("_sides", sides) if weighted else rows
    else:
        rows = rows.join(cuts.withColumns(_flat(F.col("conditions"), longest)), AT)
        rows = rows.withColumns({f"_met{i}": _met(f"_c{i}") for i in range(longest)})
        of_met = lambda i: F.when(F.col(f"_met{i}"), split.LEFT).when(~F.col(f"_met{i}"), split.RIGHT).when(F.col(f"_c{i}_ordinal").isNotNull(), split.MISSING)
        rows = rows.withColumns({f"_s{i}": of_met(i) for i in range(longest)})
        sides = [F.col(f"_s{i}") for i in range(longest)]
        count = lambda s: reduce(Column.__add__, [F.when(x == s, 1).otherwise(0) for x in sides])
        side = F.when(F.col("conditions").isNotNull(), _first_other(sides)).otherwise(condition_side(F.col("ordinal"), F.col("threshold"), F.col("category"), o))
    n = F.coalesce(F.when(F.col("conditions").isNotNull(), F.size("conditions")), F.lit(0)) if weighted else F.lit(0)
    rows = rows.withColumn("_side", F.when(n == 0, side))
    of = lambda s: F.when(F.col("_side").isNull(), count(s) / n).when(F.col("_side") == s, 1.0).otherwise(0.0) if weighted else F.when(F.col("_side") == s, 1.0).otherwise(0.0)
    return rows.withColumns({name: of(s) for name, s in ON.items()})


def _first_other(sides: list[Column]) -> Column:
    """The side by a rule: all left, left; else as the first that is not left."""
    return F.coalesce(*[F.when(s != split.LEFT, s) for s in sides], F.lit(split.LEFT))


@dataclass
class Grower:
    features: tuple[Feature, ...]
    o: Options
    codes: DataFrame | None = None  # ordinal, code and word of the categories
    n_codes: int = 0
    words: dict[int, list[str]] | None = None  # the words of each categoric feature, if they are few
    code_arrays: dict | None = None  # and their codes

    @property
    def total(self) -> int:
        return len(self.features)

    @property
    def longest(self) -> int | None:
        return longest_rule(self.o, self.total)

    def walks(self) -> bool:
        """Whether rows may be arrays that walk the nodes: single features are asked once, and rows stay whole."""
        o = self.o
        return isinstance(o.branch, str) and o.branch in PLAIN and self.slots(0) is not None and o.threshold != "exact" and o.distribute == "default" and isinstance(o.missing, str) and o.missing in DECIDED and self.n_codes <= WORDS

    # What nodes draw.

    def _order(self, *tag) -> Column:
        """All ordinals in the order of their draws."""
        draw = lambda i: F.struct(u(self.o.seed, *tag, own_tree(self.o), F.col("node"), i).alias("d"), i.alias("i"))
        return F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(self.total - 1)), draw)), lambda s: s["i"])

    def coin(self) -> Column:
        return u(self.o.seed, "policy", own_tree(self.o), F.col("node"))

    def drawn(self, round_: int) -> tuple[int, int]:
        """How many features a node draws in a round, and how many earlier rounds have taken."""
        return drawn(self.o, self.total, round_)

    def asked(self, nodes: DataFrame, round_: int, paired: bool | None = None) -> DataFrame:
        """nodes with asks: the candidates (cand, ordinal, ordinal_b) that each inspects in a round."""
        o, (n, tried) = self.o, self.drawn(round_)
        size = F.lit(n)
        if o.branch == "random-subset":
            spread = (2 * u(o.seed, "size", own_tree(o), F.col("node")) - 1) * o.variance
            size = F.least(F.lit(self.total), F.greatest(F.lit(1), F.round(n + spread).cast("int")))
        none = F.lit(None).cast("int")
        one = F.transform(F.slice(self._order("feature"), tried + 1, size), lambda i: F.struct(i.alias("cand"), i.alias("ordinal"), none.alias("ordinal_b")))
        asks = one
        if paired if paired is not None else o.branch in PAIRED:
            other = F.slice(self._order("other"), 1, n)
            pair = lambda i, j: F.struct((i * self.total + j).alias("cand"), i.alias("ordinal"), j.alias("ordinal_b"))
            pairs = F.flatten(F.transform(F.slice(self._order("feature"), 1, n), lambda i: F.transform(F.filter(other, lambda j: j != i), lambda j: pair(i, j))))
            asks = F.when(self.coin() <= o.factor, pairs).otherwise(one) if o.branch == "combination" else pairs
        return nodes.select(*AT, asks.alias("asks"))

    def slots(self, round_: int) -> int | None:
        """How many candidates a node has at most, if they are single features and few enough to be columns."""
        o = self.o
        if o.branch in PAIRED or callable(o.branch) or isinstance(o.branch, Policy) or o.branch == "sample-examples" or o.distribute == "rulew":
            return None
        n = self.total if o.branch == "random-subset" else min(self.total, self.drawn(round_)[0])
        return n if 0 < n <= SLOTS else None

    # Aggregations over rows.

    def members_at_once(self, state: DataFrame, asked: DataFrame, n: int, round_: int, slots: int) -> DataFrame:
        """members() of all candidates, and the class weights as candidate -1: a row counts once, each candidate has columns.

        What a draw is of but the id is made once for each candidate, not for each row.
        """
        tag = F.concat_ws(":", F.lit(str(self.o.seed)), F.lit(str(round_)), own_tree(self.o).cast("string"), F.col("node"))
        lead = lambda a: F.struct(a["cand"].alias("cand"), a["ordinal"].alias("ordinal"), F.concat(tag, F.lit(":"), a["cand"].cast("string"), F.lit(":")).alias("lead"))
        rows = state.join(small(asked.select(*AT, F.transform("asks", lead).alias("asks")), n), AT)
        after = among_equals(rows)
        columns, aggregates, each = [], [F.sum("weight").alias("w")], []
        for i in range(slots):
            a = F.get("asks", F.lit(i))
            num, word = _value("nums", a["ordinal"]), _value("cats", a["ordinal"])
            draw = F.conv(F.substring(F.md5(F.concat(a["lead"], F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint")
            order = F.when(num.isNotNull() | word.isNotNull(), draw * 2147483648 + F.col("_after"))
            columns += [a["cand"].alias(f"cand{i}"), order.alias(f"o{i}"), num.alias(f"num{i}"), F.when(word.isNotNull(), F.xxhash64(word)).alias(f"cat{i}")]
            aggregates += [F.min(f"cand{i}").alias(f"cand{i}"), F.min(f"o{i}").alias(f"o{i}"), F.min_by(f"num{i}", f"o{i}").alias(f"num{i}"), F.min_by(f"cat{i}", f"o{i}").alias(f"cat{i}")]
            v = F.struct(F.col(f"num{i}").alias("num"), F.col(f"cat{i}").alias("cat"), F.lit(None).cast("double").alias("num_b"), F.lit(None).cast("long").alias("cat_b"))
            each.append(F.struct(F.col(f"cand{i}").alias("cand"), F.when(F.col(f"o{i}").isNotNull(), v).alias("v")))
        found = rows.withColumn("_after", after).select(*AT, "class", "weight", *columns).groupBy(*AT, "class").agg(*aggregates)
        whole = F.struct(F.lit(-1).alias("cand"), F.when(F.lit(False), each[0]["v"]).alias("v"))
        return found.select(*AT, "class", "w", F.explode(F.array(whole, *each)).alias("e")).select(*AT, "e.cand", "class", "w", "e.v").filter("cand IS NOT NULL")

    def sides_at_once(self, state: DataFrame, cuts: DataFrame, n: int, slots: int) -> DataFrame:
        """tree, node, cand, class: weights left, right and missing (l, r, m) by each candidate; a row counts once, each candidate has columns."""
        of_node = cuts.groupBy(*AT).agg(F.collect_list(F.struct("cand", *SPLIT_COLUMNS)).alias("cuts"))  # slots at most
        at = [F.get("cuts", F.lit(i)) for i in range(slots)]
        rows = state.join(small(of_node, n), AT).select(*AT, "class", "weight", *[c for i, a in enumerate(at) for c in (a["cand"].alias(f"cand{i}"), side_of(self.o, lambda name, a=a: a[name]).alias(f"side{i}"))])
        on = lambda i, s: F.coalesce(F.sum(F.when(F.col(f"side{i}") == s, F.col("weight"))), F.lit(0.0))
        aggregates = [c for i in range(slots) for c in (F.min(f"cand{i}").alias(f"cand{i}"), on(i, "left").alias(f"l{i}"), on(i, "right").alias(f"r{i}"), on(i, "?").alias(f"m{i}"))]
        each = [F.struct(*[F.col(f"{c}{i}").alias(c) for c in ("cand", "l", "r", "m")]) for i in range(slots)]
        found = rows.groupBy(*AT, "class").agg(*aggregates).select(*AT, "class", F.explode(F.array(*each)).alias("e"))
        return found.select(*AT, "e.cand", "class", "e.l", "e.r", "e.m").filter("cand IS NOT NULL")

    def members(self, rows: DataFrame, key: str, klass: str, round_) -> DataFrame:
        """tree, node, key, class: weight and the values of the row with the least draw, for rows (.., ordinal, ordinal_b)."""
        one, two = (lambda array, c=c: _value(array, F.col(c)) for c in ("ordinal", "ordinal_b"))
        code = lambda x: F.when(x.isNotNull(), F.xxhash64(x))
        values = {"num": one("nums"), "cat": code(one("cats")), "num_b": two("nums"), "cat_b": code(two("cats"))}
        # One number orders rows, and categories are codes, so that the aggregation needs no sort.
        draw = u(self.o.seed, round_, own_tree(self.o), F.col("node"), F.col(key), F.col("id"))
        order = (draw * 4294967296).cast("bigint") * 2147483648 + among_equals(rows)
        order = F.when(F.coalesce(*[F.when(v.isNotNull(), F.lit(True)) for v in values.values()]), order)
        rows = rows.select(*AT, key, klass, "weight", order.alias("_order"), *[v.alias(k) for k, v in values.items()])
        found = rows.groupBy(*AT, key, klass).agg(F.sum("weight").alias("w"), F.min("_order").alias("o"), *[F.min_by(k, "_order").alias(k) for k in values])
        return found.select(*AT, key, klass, "w", F.when(F.col("o").isNotNull(), F.struct(*values)).alias("v"))

    def named(self, cuts: DataFrame) -> DataFrame:
        """cuts with categories instead of their codes."""
        if self.codes is None:
            return cuts.withColumns({c: F.lit(None).cast("string") for c in ("category", "category_b") if c in cuts.columns})
        for b in ("", "_b"):
            if f"ordinal{b}" in cuts.columns:
                words = small(self.codes.select(F.col("ordinal").alias("_o"), F.col("code").alias("_c"), F.col("word").alias("_w")), self.n_codes)
                found = cuts.join(words, (F.col(f"ordinal{b}") == F.col("_o")) & (F.col(f"category{b}") == F.col("_c")), "left")
                cuts = found.withColumn(f"category{b}", F.col("_w")).drop("_o", "_c", "_w")
        return cuts

    def cuts(self, members: DataFrame, key: str, klass: str, round_) -> DataFrame:
        """A candidate for each key: midway between the rows of two classes (a category: that of the first)."""
        draw = u(self.o.seed, round_, own_tree(self.o), F.col("node"), F.col(key), F.col(klass).cast("string")).alias("d")
        both = members.filter("v IS NOT NULL").groupBy(*AT, key).agg(F.array_sort(F.collect_list(F.struct(draw, klass, "v"))).alias("s"))  # a row for each class
        a, b = F.col("s")[0]["v"], F.col("s")[1]["v"]
        between = self.o.threshold if callable(self.o.threshold) else (lambda x, y: x) if self.o.threshold == "value" else (lambda x, y: (x + y) / 2)
        mid = lambda c: F.coalesce(between(a[c], b[c]), a[c], b[c])
        word = lambda c: F.coalesce(a[c], b[c])
        return both.filter(F.size("s") > 1).select(*AT, key, mid("num").alias("threshold"), word("cat").alias("category"), mid("num_b").alias("threshold_b"), word("cat_b").alias("category_b"))

    def exact(self, rows: DataFrame, key: str) -> DataFrame:
        known = rows.select(*AT, key, "class", "weight", _value("nums", F.col("ordinal")).alias("num"))
        return split.exact_thresholds(known, "num", [*AT, key]).select(*AT, key, "threshold")

    def scored(self, sided: DataFrame, key: str) -> DataFrame:
        """tree, node, key: score, left, right, chi2 and weights of rows (.., class, weight and shares).

        Rows with a missing value count on the sides that the strategy gives them; random ones by expectation.
        """
        on = lambda name: F.sum(F.col("weight") * F.col(name))
        counts = sided.groupBy(*AT, key, "class").agg(on("on_left").alias("l"), on("on_right").alias("r"), on("on_missing").alias("m"))
        return self.judged(counts, key)

    def judged(self, counts: DataFrame, key: str) -> DataFrame:
        """scored() of the weights (l, r, m) of the classes."""
        o, keys = self.o, [*AT, key]
        c = F.array_sort(F.collect_list(F.struct("class", "l", "r", "m"))).alias("c")  # a struct for each class
        known = counts.groupBy(*keys).agg(c, F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
        share = split.left_share(o.missing, F.col("n_left"), F.col("n_right"))
        lost = lambda e: F.lit(0.0) if o.missing == "ignore" else e["m"]
        placed = F.transform("c", lambda e: F.struct(e["class"].alias("class"), (e["l"] + lost(e) * share).alias("l"), (e["r"] + lost(e) * (1 - share)).alias("r"))).alias("c")
        rows = known.select(*keys, placed, "n_left", "n_right")
        if callable(o.score):
            made = o.score(rows.select(*keys, F.explode("c").alias("e")).select(*keys, "e.*"), keys)
            rows = rows.join(made.select(*keys, "score", "left", "right"), keys)
            rows = measures.weighed(rows)
            return rows.select(*keys, "score", "left", "right", "n_left", "n_right", F.col("wl").alias("all_left"), F.col("wr").alias("all_right"), measures.chi_of().alias("chi2"))
        rows = measures.scored(measures.weighed(rows), keys, o.score, o.seed, [own_tree(o), F.col("node"), F.col(key)])
        return rows.select(*keys, "score", "left", "right", "n_left", "n_right", F.col("wl").alias("all_left"), F.col("wr").alias("all_right"), "chi2")

    def best(self, scored: DataFrame, key: str) -> DataFrame:
        """The lowest score of each (tree, node), then the lowest key."""
        pick = F.min(F.struct(F.round("score", 9).alias("score"), key, "left", "right", "n_left", "n_right", "all_left", "all_right", "chi2")).alias("b")
        return scored.groupBy(*AT).agg(pick).select(*AT, "b.*")

    # Policies: the best split of each node asked.

    def level(self, state: DataFrame, asked: DataFrame, n: int, round_: int, first: bool = False) -> tuple[DataFrame | None, DataFrame]:
        """Class weights (first: of all nodes of the state) and the best splits of the nodes asked, which are n."""
        o, sampled = self.o, self.o.branch == "sample-examples"
        slots = self.slots(round_)
        if isinstance(state, Packed):
            lead = lambda tree, node, cand: f"{o.seed}:{round_}:{(tree - 1) % o.trees + 1 if o.groups > 1 else tree}:{node}:{cand}:"
            members = state.members(asked, lead, slots, self.code_arrays)
        elif slots:
            members = self.members_at_once(state, asked, n, round_, slots)
        else:
            stats = F.struct(F.lit(-1).alias("cand"), F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("int").alias("ordinal_b"))
            asks = F.explode(F.concat(F.array(stats), "asks") if first else F.col("asks")).alias("a")
            rows = state.join(small(asked, n), AT).select(*state.columns, asks).select(*state.columns, "a.*")
            on_sample = F.col("ordinal").isNull() | (u(o.seed, "sample", round_, own_tree(o), F.col("node"), F.col("id")) < o.share * 2**round_) if sampled else None
            members = self.members(rows.filter(on_sample) if sampled else rows, "cand", "class", round_)
        members = stored(members, "members")
        weights = members.filter("cand = -1").select(*AT, "class", "w") if first else None
        if first:
            live = weights.groupBy(*AT).agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("k")).filter((F.col("k") > 1) & (F.col("n") > o.min_examples))
            asked = asked.join(live.select(*AT), AT, "left_semi")
        return weights, self._splits(state, asked, members, n, round_)

    def _splits(self, state: DataFrame, asked: DataFrame, members: DataFrame, n: int, round_: int) -> DataFrame:
        o, sampled = self.o, self.o.branch == "sample-examples"
        cuts = self.cuts(members.filter("cand >= 0"), "cand", "class", round_)
        asks = asked.select(*AT, F.explode("asks").alias("a")).select(*AT, "a.*")
        cuts = self.named(asks.join(cuts, [*AT, "cand"]))
        if o.threshold == "exact":
            long = state.join(small(asks, n * self.total), AT).filter("ordinal_b IS NULL")
            cuts = cuts.join(self.exact(long, "cand").withColumnRenamed("threshold", "_exact"), [*AT, "cand"], "left")
            alone = F.col("ordinal_b").isNull() & F.col("threshold").isNotNull()
            cuts = cuts.withColumn("threshold", F.when(alone, F.col("_exact")).otherwise(F.col("threshold"))).drop("_exact").filter("threshold IS NOT NULL OR category IS NOT NULL")
        cuts = cuts.select(*AT, "cand", *self._columns(cuts))
        if sampled or o.threshold == "exact":
            cuts = stored(cuts, "cuts")
        if sampled:  # found on the sample, scored on all rows
            some = state.filter(u(o.seed, "sample", round_, own_tree(o), F.col("node"), F.col("id")) < o.share * 2**round_)
            found = stored(self.best(self.scored(self.sided(some, cuts, n), "cand"), "cand").select(*AT, "cand"), "found")
            cuts = cuts.join(found, [*AT, "cand"], "left_semi")
        slots = self.slots(round_)
        if isinstance(state, Packed):
            cuts = stored(cuts, "cuts")
            return self.best(self.judged(state.sides(cuts, slots), "cand"), "cand").join(cuts, [*AT, "cand"]).drop("cand")
        scored = self.judged(self.sides_at_once(state, cuts, n, slots), "cand") if slots else self.scored(self.sided(state, cuts, n), "cand")
        return self.best(scored, "cand").join(cuts, [*AT, "cand"]).drop("cand")

    def _columns(self, df: DataFrame) -> list[Column]:
        """The columns of SPLIT, null where df has none."""
        types = dict(zip(SPLIT_COLUMNS, ("int", "double", "string", "int", "double", "string", CONDITIONS, "string"), strict=True))
        return [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()]

    def sided(self, state: DataFrame, cuts: DataFrame, n: int) -> DataFrame:
        """Rows of the state with each candidate of their node and their shares on its sides."""
        return _shared(self.o, state, small(cuts, n * self.total), self.longest).select(*AT, "cand", "class", "weight", *ON)

    def of_rules(self, state: DataFrame, nodes: DataFrame, weights: DataFrame, n: int) -> DataFrame:
        """The best of some rules of each node, grown in step: a condition each, while their score falls.

        A rule has a class at random and a draw of features, each of which it takes once.
        """
        o, count = self.o, self.o.n_rules(self.total)
        per = weights.groupBy(*AT).agg(F.array_sort(F.collect_list("class")).alias("classes"), F.map_from_entries(F.collect_list(F.struct("class", "w"))).alias("of"), F.sum("w").alias("all"))  # a row for each class
        at = [own_tree(o), F.col("node"), F.col("rule")]
        start = nodes.select(*AT).join(per, AT).withColumn("rule", F.explode(F.sequence(F.lit(1), F.lit(count))))
        pick = F.floor(u(o.seed, "target", *at) * F.size("classes")).cast("int")
        draw = lambda i: F.struct(u(o.seed, "rule", *at, i).alias("d"), i.alias("i"))
        todo = F.transform(F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(self.total - 1)), draw)), 1, o.n_features(self.total)), lambda s: s["i"])
        start = start.withColumn("target", F.col("classes")[pick]).withColumns({"todo": todo, "prior": F.element_at("of", F.col("target")) / F.col("all"), "k": F.size("classes")})
        rules_ = stored(start.select(*AT, "rule", "target", "todo", "prior", "k", F.array().cast(CONDITIONS).alias("conditions"), F.lit(None).cast("double").alias("best"), F.lit(True).alias("open")), "rules")
        wide = self.longest is not None and count * o.n_features(self.total) <= SLOTS
        for step in range(o.n_features(self.total)):
            live = rules_.filter(F.col("open") & (F.size("todo") > 0))
            if step and live.isEmpty():
                break
            asks = live.select(*AT, "rule", "target", "conditions", F.explode("todo").alias("ordinal")).withColumn("cand", F.col("rule") * self.total + F.col("ordinal"))
            rows = state.join(small(asks, n * count * self.total), AT).filter(~F.exists(_of_rule(), lambda s: s != split.LEFT))
            rows = rows.select(*state.columns, "rule", "cand", (F.col("class") == F.col("target")).alias("pos"), "ordinal", F.lit(None).cast("int").alias("ordinal_b"))
            slots = count * (o.n_features(self.total) - step)  # an open rule took a feature in each step
            members = self._members_of_rules(state, asks, n, step, slots) if wide else self.members(rows, "cand", "pos", f"rule{step}")
            cuts = self.cuts(members, "cand", "pos", f"rule{step}")
            if o.threshold == "exact":
                exact = self.exact(rows.withColumn("class", F.col("pos").cast("string")), "cand").withColumnRenamed("threshold", "_exact")
                cuts = cuts.join(exact, [*AT, "cand"], "left").withColumn("threshold", F.when(F.col("threshold").isNotNull(), F.col("_exact")))
            cuts = cuts.withColumns({"rule": F.floor(F.col("cand") / self.total).cast("int"), "ordinal": (F.col("cand") % self.total).cast("int")}).drop("threshold_b", "category_b")
            cuts = stored(self.named(cuts), "cuts")
            counts = self._sides_of_rules(state, asks, cuts, n, step, slots) if wide else self._sides(rows, cuts, n * count)
            rules_ = stored(self._longer(rules_, counts, cuts), "rules")
        chosen = rules_.filter(F.size("conditions") > 0).select(*AT, F.col("rule").alias("cand"), "conditions", "target")
        cuts = stored(chosen.select(*AT, "cand", *self._columns(chosen)), "cuts")
        return self.best(self.scored(self.sided(state, cuts, n * count), "cand"), "cand").join(cuts, [*AT, "cand"]).drop("cand")

    def _beside(self, state: DataFrame, asks: DataFrame, n: int, step: int, slots: int, columns: dict[str, Column]) -> DataFrame:
        """Rows with columns of each candidate of their node (cand0, .. and those named), and _in0, ..: whether its rule covers the row so far."""
        of_node = asks.groupBy(*AT).agg(F.collect_list(F.struct("cand", "conditions", *[c.alias(k) for k, c in columns.items()])).alias("a"))  # slots at most
        flat = {}
        for i in range(slots):
            a = F.get("a", F.lit(i))
            flat |= {f"{k}{i}": a[k] for k in ("cand", *columns)} | _flat(a["conditions"], step, f"_c{i}_")
        rows = state.join(small(of_node.select(*AT, *[c.alias(k) for k, c in flat.items()]), n), AT)
        covers = lambda i: reduce(Column.__and__, [F.coalesce(_met(f"_c{i}_{j}"), F.lit(False)) for j in range(step)], F.col(f"cand{i}").isNotNull())
        return rows.withColumns({f"_in{i}": covers(i) for i in range(slots)})

    def _members_of_rules(self, state: DataFrame, asks: DataFrame, n: int, step: int, slots: int) -> DataFrame:
        """members() by cand and pos of the rows that rules cover; a row counts once, each candidate has columns."""
        lead = F.concat(F.concat_ws(":", F.lit(str(self.o.seed)), F.lit(f"rule{step}"), own_tree(self.o).cast("string"), F.col("node"), F.col("cand").cast("string")), F.lit(":"))
        rows = self._beside(state, asks.withColumn("lead", lead), n, step, slots, {"ordinal": F.col("ordinal"), "lead": F.col("lead")})
        rows = rows.withColumn("_after", among_equals(rows))
        columns, aggregates, each = [], [], []
        for i in range(slots):
            num, word = F.get("nums", f"ordinal{i}"), F.get("cats", f"ordinal{i}")
            draw = F.conv(F.substring(F.md5(F.concat(F.col(f"lead{i}"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint")
            columns += [F.when(F.col(f"_in{i}") & (num.isNotNull() | word.isNotNull()), draw * 2147483648 + F.col("_after")).alias(f"o{i}")]
            columns += [num.alias(f"num{i}"), F.when(word.isNotNull(), F.xxhash64(word)).alias(f"cat{i}"), f"cand{i}"]
            aggregates += [F.min(f"cand{i}").alias(f"cand{i}"), F.min(f"o{i}").alias(f"o{i}"), F.min_by(f"num{i}", f"o{i}").alias(f"num{i}"), F.min_by(f"cat{i}", f"o{i}").alias(f"cat{i}")]
            v = F.struct(F.col(f"num{i}").alias("num"), F.col(f"cat{i}").alias("cat"), F.lit(None).cast("double").alias("num_b"), F.lit(None).cast("long").alias("cat_b"))
            each.append(F.struct(F.col(f"cand{i}").alias("cand"), F.col(f"o{i}").alias("o"), v.alias("v")))
        found = rows.select(*AT, "class", *columns).groupBy(*AT, "class").agg(*aggregates).select(*AT, "class", F.explode(F.array(*each)).alias("e"))
        found = found.select(*AT, "class", "e.*").filter("o IS NOT NULL").join(asks.select(*AT, "cand", "target"), [*AT, "cand"])
        return found.groupBy(*AT, "cand", (F.col("class") == F.col("target")).alias("pos")).agg(F.min_by("v", "o").alias("v"))

    def _sides_of_rules(self, state: DataFrame, asks: DataFrame, cuts: DataFrame, n: int, step: int, slots: int) -> DataFrame:
        """_sides(); a row counts once, each candidate has columns."""
        asked = asks.select(*AT, "cand", "conditions", "target").join(cuts, [*AT, "cand"])
        rows = self._beside(state, asked, n, step, slots, {c: F.col(c) for c in ("ordinal", "threshold", "category")})
        rows = rows.select(*AT, "class", "weight", *[c for i in range(slots) for c in (f"cand{i}", F.when(F.col(f"_in{i}"), condition_side(F.col(f"ordinal{i}"), F.col(f"threshold{i}"), F.col(f"category{i}"))).alias(f"side{i}"))])
        on = lambda i, s: F.coalesce(F.sum(F.when(F.col(f"side{i}") == s, F.col("weight"))), F.lit(0.0))
        aggregates = [c for i in range(slots) for c in (F.min(f"cand{i}").alias(f"cand{i}"), F.count(f"side{i}").alias(f"n{i}"), on(i, "left").alias(f"l{i}"), on(i, "right").alias(f"r{i}"), on(i, "?").alias(f"m{i}"))]
        each = [F.struct(*[F.col(f"{c}{i}").alias(c) for c in ("cand", "n", "l", "r", "m")]) for i in range(slots)]
        found = rows.groupBy(*AT, "class").agg(*aggregates).select(*AT, "class", F.explode(F.array(*each)).alias("e")).select(*AT, "class", "e.*").filter("n > 0")
        found = found.join(asked.select(*AT, "cand", "rule", "ordinal", "target"), [*AT, "cand"]).withColumn("pos", F.col("class") == F.col("target"))
        sums = [F.sum(F.when(F.col("pos") == p, F.col(c)).otherwise(0.0)).alias(f"{c}{'p' if p else 'n'}") for c in ("l", "r", "m") for p in (True, False)]
        return found.groupBy(*AT, "rule", "ordinal").agg(*sums)

    def _sides(self, rows: DataFrame, cuts: DataFrame, n: int) -> DataFrame:
        """tree, node, rule, ordinal: weights left, right and missing of the target class and others (lp, ln, rp, ...)."""
        keys = [*AT, "rule", "ordinal"]
        sided = rows.drop("cand", "ordinal_b").join(small(cuts.drop("cand"), n * self.total), keys).withColumn("side", condition_side(F.col("ordinal"), F.col("threshold"), F.col("category")))
        on = lambda s, pos: F.coalesce(F.sum(F.when((F.col("side") == s) & (F.col("pos") == pos), F.col("weight"))), F.lit(0.0))
        return sided.groupBy(*keys).agg(*[on(s, p).alias(f"{name}{'p' if p else 'n'}") for s, name in (("left", "l"), ("right", "r"), ("?", "m")) for p in (True, False)])

    def _longer(self, rules_: DataFrame, c: DataFrame, cuts: DataFrame) -> DataFrame:
        """The rules with their best next condition by the weights c, and whether they are still open."""
        o, keys = self.o, [*AT, "rule", "ordinal"]
        share = split.left_share(o.missing, F.col("lp") + F.col("ln"), F.col("rp") + F.col("rn"))
        lost = lambda x: F.lit(0.0) if o.missing == "ignore" else F.col(x)
        c = c.withColumn("share", share).select(*keys, *[(F.col(f"l{x}") + lost(f"m{x}") * F.col("share")).alias(f"l{x}") for x in "pn"], *[(F.col(f"r{x}") + lost(f"m{x}") * (1 - F.col("share"))).alias(f"r{x}") for x in "pn"])
        c = c.join(rules_.select(*AT, "rule", "prior", F.col("k")), [*AT, "rule"])
        of = lambda s: F.coalesce(rules.rule_score(F.col(f"{s}p"), F.col(f"{s}n"), o.rule_score, F.col("k"), F.col("prior")), F.lit(1.0))
        both = (F.col("lp") + F.col("ln") > 0) & (F.col("rp") + F.col("rn") > 0)
        c = c.withColumns({"sl": F.round(of("l"), 9), "sr": F.round(of("r"), 9), "both": both})
        c = c.groupBy(*AT, "rule").agg(F.min(F.struct(F.least("sl", "sr").alias("s"), "ordinal", "both", (F.col("sl") < F.col("sr")).alias("holds"), "lp", "ln", "rp", "rn")).alias("b"))
        c = c.select(*AT, "rule", "b.ordinal", "b.both", "b.holds", F.col("b.s").alias("s"), F.when(F.col("b.holds"), F.col("b.lp")).otherwise(F.col("b.rp")).alias("p"), F.when(F.col("b.holds"), F.col("b.ln")).otherwise(F.col("b.rn")).alias("neg"))
        c = c.join(cuts.select(*keys, "threshold", "category"), keys)
        out = rules_.join(c, [*AT, "rule"], "left")
        better = F.col("open") & F.coalesce(F.col("both") & (F.col("s") < F.coalesce(F.col("best"), F.lit(math.inf))) & (F.col("p") > 0), F.lit(False))
        grown = F.concat("conditions", F.array(F.struct(F.col("ordinal"), F.col("threshold"), F.col("category"), F.col("holds"))))
        return out.select(
            *AT, "rule", "target", F.when(better, F.array_remove("todo", F.col("ordinal"))).otherwise(F.col("todo")).alias("todo"), "prior", "k",
            F.when(better, grown).otherwise(F.col("conditions")).cast(CONDITIONS).alias("conditions"),
            F.when(better, F.col("s")).otherwise(F.col("best")).alias("best"), (better & (F.col("neg") > 0)).alias("open"),
        )

    def poor(self, round_: int) -> Column:
        """Whether a node draws again; one without a split does."""
        o, chi = self.o, F.col("chi2") < self.o.sigma
        gain = F.col("entropy") - F.col("left") - F.col("right") <= o.min_gain
        poor = F.coalesce({"hellinger": F.col("score") >= 1, "resample": gain, "infinite-resample": gain}.get(o.branch, chi), F.lit(True))
        if o.branch == "random-chisquare":
            return poor & (self.coin() <= 0.5)
        return poor & (u(o.seed, "again", round_, own_tree(o), F.col("node")) < 0.5) if o.branch == "resquare" else poor

    def policy(self) -> Policy:
        """The policy of the options: one of policies.py, or a combination of these."""
        o, total = self.o, self.total
        if isinstance(o.branch, Policy):
            return o.branch
        if callable(o.branch):
            return Policy(lambda level, nodes, round_: o.branch(self, level.state, nodes, level.n))
        if o.branch in RULED:
            return {"rule": ruled(), "random-rule": either(ruled(), plain(), self.coin(), o.factor), "choose-rule": significant([plain(), ruled()])}[o.branch]
        if rounds := redraws(o, total):
            spent = lambda r: (o.branch == "sample-examples" and o.share * 2**r >= 1) or self.drawn(r)[1] >= total
            return again(plain(), self.poor, rounds, spent)
        return plain()

    def winners(self, state: DataFrame, nodes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """Class weights of the state's nodes, and the splits of those that don't end here."""
        o = self.o
        if o.branch == "rule":  # rules draw their own features
            weights, base = stored(state.groupBy(*AT, "class").agg(F.sum("weight").alias("w")), "weights"), None
        else:
            weights, base = self.level(state, self.asked(nodes, 0), n, 0, first=True)
        stats = stats_of(weights)
        live = stats.filter((F.col("k") > 1) & (F.col("n") > o.min_examples)).select(*AT, "entropy")
        found = self.policy()(Level(self, state, weights, n, live, base), live, 0)
        found = found.filter("all_left > 0 AND all_right > 0")  # a one-sided winner is a leaf
        if o.prune is not None:
            found = found.filter(o.prune(F.col("chi2"), F.col("n_left"), F.col("n_right")) if callable(o.prune) else F.col("chi2") >= o.prune)
        return stats, stored(found, "winners")

    def route(self, state: DataFrame, winners: DataFrame, n: int) -> DataFrame:
        """The rows of split nodes, in their children."""
        o = self.o
        cuts = small(winners.select(*AT, *SPLIT_COLUMNS, "n_left", "n_right"), n)
        draw = u(o.seed, "missing", own_tree(o), F.col("node"), F.col("id"))
        if o.distribute == "rulew":
            parts = F.array(*[F.struct(F.lit(s).alias("side"), F.col(name).alias("share")) for name, s in ON.items()])
            rows = _shared(o, state, cuts, self.longest).withColumn("_p", F.explode(parts)).filter("_p.share > 0")
            rows = rows.withColumns({"side": F.col("_p.side"), "weight": F.col("weight") * F.col("_p.share")})
        else:
            rows = state.join(cuts, AT).withColumn("side", side_of(o))
        rows = split.placed(rows, o.missing, F.col("n_left"), F.col("n_right"), draw)
        return rows.withColumn("node", F.concat("node", F.when(F.col("side") == "left", "0").otherwise("1"))).select(*state.columns)


def drawn(o: Options, total: int, round_: int) -> tuple[int, int]:
    """How many features a node draws in a round, and how many earlier rounds have taken."""
    n = o.n_features(total)
    if o.branch == "infinite-resample" and round_:
        return (total, n) if round_ == 1 else (0, total)
    if o.branch == "chisquare-decrease":
        sizes = [n]
        for _ in range(round_):
            sizes.append(max(1, int(sizes[-1] / 2 + 0.5)))
        return sizes[-1], sum(sizes[:-1])
    return n, n * round_


def redraws(o: Options, total: int) -> int:
    """Rounds after the first at most: each takes features that a node hasn't tried yet."""
    if o.branch == "sample-examples":
        return math.ceil(math.log2(1 / o.share))
    return {"resample": o.resamples, "infinite-resample": 2, "hellinger": total}.get(o.branch, total if o.branch in ("chisquare", "random-chisquare", "resquare", "chisquare-decrease") else 0)


def stats_of(weights: DataFrame) -> DataFrame:
    """tree, node: weight, number of classes, majority and entropy."""
    xlnx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    return weights.groupBy(*AT).agg(
        F.sum("w").alias("n"), F.count(F.lit(1)).alias("k"), F.min_by("class", F.struct(-F.col("w"), "class")).alias("class"), F.max("w").alias("majority_n"),
        (xlnx(F.sum("w")) - F.sum(xlnx(F.col("w")))).alias("entropy"),
    )


def grow(ex: ExampleSet, o: Options, bags: DataFrame, only: range | None = None) -> DataFrame:
    """The table of nodes of bags (tree, id, class, weight and the features of ex); only: the trees that bags has, if not all."""
    grower, spark = Grower(ex.features, o), bags.sparkSession
    words = [F.struct(F.lit(f.ordinal).alias("ordinal"), F.col(f"`{f.name}`").cast("string").alias("word")) for f in ex.features if f.kind == "categoric"]
    if words:
        known = bags.select(F.explode(F.array(*words)).alias("w")).select("w.*").filter("word IS NOT NULL").distinct()
        grower.codes = stored(known.withColumn("code", F.xxhash64("word")), "codes")
        grower.n_codes = grower.codes.count()
    only = only or range(1, o.trees * o.groups + 1)
    rows = None
    if grower.walks():
        known = sorted(map(tuple, grower.codes.select("ordinal", "word", "code").collect())) if words else []  # WORDS at most
        grower.words = {f.ordinal: [w for i, w, _ in known if i == f.ordinal] for f in ex.features if f.kind == "categoric"}
        grower.code_arrays = {i: np.array([c for j, _, c in known if j == i], np.int64) for i in grower.words}
        rows = packed(ex, bags, only, o.missing, grower.words)
    names = F.create_map(*[F.lit(x) for f in ex.features for x in (f.ordinal, f.name)])
    rule = F.concat(F.lit("rule: "), F.array_join(F.transform("conditions", lambda c: F.element_at(names, c["ordinal"])), ", "))
    feature = F.when(F.col("conditions").isNotNull(), rule).when(F.col("ordinal_b").isNotNull(), F.concat_ws(" & ", names[F.col("ordinal")], names[F.col("ordinal_b")])).otherwise(names[F.col("ordinal")])
    state, written = bags.select(F.col("tree").cast("int").alias("tree"), F.lit("1").alias("node"), "id", "class", "weight", *[v.alias(k) for k, v in values_of(ex.features).items()]), None
    n = len(only)
    unpacked, routed = state, []
    state = rows or state
    nodes = spark.range(only[0], only[-1] + 1).select(F.col("id").cast("int").alias("tree"), F.lit("1").alias("node"))
    tables = []
    for depth in range(o.max_depth + 1):
        last = depth == o.max_depth or not ex.features
        if isinstance(state, Packed) and not state.fits(n, 0 if last else grower.slots(0)):  # too many nodes for a task: the rows go on as a table
            for i, (w, k) in enumerate(routed, 1):
                unpacked = grower.route(unpacked, w, k)
                unpacked = stored(unpacked, "level") if i % STORE_LEVELS == 0 else unpacked
            state = unpacked
        if last:
            weights = state.members(None, None, 0, {}).select(*AT, "class", "w") if isinstance(state, Packed) else state.groupBy(*AT, "class").agg(F.sum("weight").alias("w"))
            stats, count = stats_of(weights), 0
            none = dict.fromkeys(("n_left", "n_right", "score", "left", "right"), F.lit(None).cast("double"))
            winners = nodes.limit(0).select(*AT, *grower._columns(nodes), *[v.alias(k) for k, v in none.items()])
        else:
            stats, winners = grower.winners(state, nodes, n)
            count = winners.count()
        gain = F.col("entropy") - F.col("left") - F.col("right")
        split_ = F.coalesce(F.col("ordinal").isNotNull() | F.col("conditions").isNotNull(), F.lit(False))
        tables.append(
            stats.join(small(winners, count), AT, "left").select(
                *AT, F.lit(depth).alias("depth"), F.when(split_, "node").otherwise("leaf").alias("kind"), F.when(split_, feature).alias("feature"), *SPLIT_COLUMNS,
                "n_left", "n_right", "class", "n", "majority_n", "score", gain.alias("gain"), ((F.col("majority_n") + 1) / (F.col("n") + 2)).alias("laplace"),
            )
        )
        if not count:
            break
        routed.append((winners, count))
        if isinstance(state, Packed):
            state.split(winners)
        else:
            state = grower.route(state, winners, count)
        if not isinstance(state, Packed) and (depth + 1) % (1 if o.branch in RULED else STORE_LEVELS) == 0 and depth + 1 < o.max_depth:  # the last level is read once
            before, written = written, stored(state, "level")
            state = written
            if before is not None:
                discard(before)
        nodes = winners.select("tree", F.explode(F.array(F.concat("node", F.lit("0")), F.concat("node", F.lit("1")))).alias("node"))
        n = 2 * count
    return reduce(DataFrame.unionByName, tables)
