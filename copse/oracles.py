"""Independent SQL of trees, forests and validation for the test tables.

The engine's draws are hashes of a seed and keys, so SQL can repeat them: a level of trees is a handful of common table
expressions, unrolled to the depth asked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from copse.plans.options import PAIRED, RULED, Options


def drawn(o: Options, total: int, r: int) -> tuple[int, int]:
    """Features that a node draws in round r, and those it has taken before."""
    per = 1 if o.branch in ("random", "hellinger") else total if o.branch == "all" or o.features == "all" else min(total, o.features) if isinstance(o.features, int) else {1: 1, 2: 2, 3: 2, 4: 3}[total]
    if o.branch == "infinite-resample":
        return [(per, 0), (total, per), (0, total)][min(r, 2)]
    sizes = [per]
    while len(sizes) <= r:
        sizes.append(max(1, (sizes[-1] + 1) // 2) if o.branch == "chisquare-decrease" else per)
    return sizes[r], sum(sizes[:r])


def U(seed, *keys) -> str:
    """The number of copse.functions.rng.u() in SQL."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join([repr(str(seed)), *map(str, keys)])})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def xlnx(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} * ln({x}) ELSE 0 END"


def bag_sql(rows: str, seed, trees: int, weighted: bool = False) -> str:
    """rows with tree and weight: as many draws with replacement as rows, for each tree; weighted: rows have a weight."""
    place = f"SELECT *, row_number() OVER (ORDER BY {U(seed, repr('order'), 'id')}, id) AS place FROM ({rows})"
    n = f"(SELECT count(*) FROM ({rows}))"
    draws = f"SELECT tree, (floor({U(seed, 'tree', 'draw')} * {n}) + 1)::BIGINT AS place FROM range(1, {n} + 1) d(draw), range(1, {trees + 1}) t(tree)"
    weight = "* EXCLUDE (place, times, weight), times * weight AS weight" if weighted else "* EXCLUDE (place, times), times::DOUBLE AS weight"
    return f"SELECT {weight} FROM ({place}) JOIN (SELECT tree, place, count(*) AS times FROM ({draws}) GROUP BY ALL) USING (place)"


@dataclass
class ForestSQL:
    """Common table expressions of a forest on rows (id, class and the features): nodes, then leaves of other rows."""

    rows: str
    features: list[tuple[str, str]]  # name and kind, in order
    o: Options
    prefix: str = "f"
    weighted: bool = False
    ctes: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self):
        bags = bag_sql(self.rows, self.o.seed, self.o.trees, self.weighted) if self.o.example_sampling == "bagging" else f"SELECT *, 1.0::DOUBLE AS weight FROM ({self.rows}), range(1, {self.o.trees + 1}) t(tree)"
        self.bag = self.add("bag", bags)
        self.nodes = self._grow()

    def add(self, name: str, sql: str) -> str:
        self.ctes.append((f"{self.prefix}_{name}", sql))
        return f"{self.prefix}_{name}"

    def query(self, select: str) -> str:
        return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in self.ctes) + "\n" + select

    def _value(self, kind: str, ordinal: str, of: str) -> str:
        cases = "".join(f" WHEN {i} THEN {of}{n}" for i, (n, k) in enumerate(self.features) if k == kind)
        return f"CASE {ordinal}{cases} ELSE NULL END" if cases else "NULL"

    def _side(self, of: str, cut: str, b: str = "") -> str:
        num, cat = self._value("numeric", f"{cut}ordinal{b}", of), self._value("categoric", f"{cut}ordinal{b}", of)
        return (
            f"CASE WHEN {cut}threshold{b} IS NOT NULL THEN CASE WHEN {num} IS NULL THEN '?' WHEN {num} >= {cut}threshold{b} THEN 'left' ELSE 'right' END"
            f" ELSE CASE WHEN {cat} IS NULL THEN '?' WHEN {cat} = {cut}category{b} THEN 'left' ELSE 'right' END END"
        )

    @property
    def n_rule(self) -> int:
        """Conditions of a rule at most."""
        return drawn(self.o, len(self.features), 0)[0] if self.o.branch in RULED else 0

    def condition(self, of: str, cut: str, i: int) -> str:
        """The side by condition i of a rule: turned where it is what must not hold."""
        side = self._side(of, cut, f"_{i}")
        return f"CASE WHEN {cut}holds_{i} OR ({side}) = '?' THEN ({side}) WHEN ({side}) = 'left' THEN 'right' ELSE 'left' END"

    def rule_side(self, of: str, cut: str) -> str:
        """As the first condition that isn't left."""
        turns = "".join(f" WHEN {cut}ordinal_{i} IS NOT NULL AND ({self.condition(of, cut, i)}) <> 'left' THEN ({self.condition(of, cut, i)})" for i in range(self.n_rule))
        return f"CASE{turns} ELSE 'left' END"

    def side(self, of: str, cut: str) -> str:
        one = self._side(of, cut)
        if self.n_rule:
            return f"CASE WHEN {cut}ordinal_0 IS NOT NULL THEN {self.rule_side(of, cut)} ELSE {one} END"
        if self.o.branch not in PAIRED:
            return one
        two, coin = self._side(of, cut, "_b"), U(self.o.seed, "'coin'", f"{of}tree", f"{of}node", f"{of}id")
        both = f"CASE WHEN ({one}) = ({two}) THEN ({one}) WHEN ({one}) = '?' THEN ({two}) WHEN ({two}) = '?' THEN ({one}) WHEN {coin} <= 0.5 THEN 'left' ELSE 'right' END"
        return f"CASE WHEN {cut}ordinal_b IS NOT NULL THEN {both} ELSE {one} END"

    def _grow(self) -> str:
        o, total, tables = self.o, len(self.features), []
        state = self.add("s0", f"SELECT *, '1' AS node FROM {self.bag}")
        for d in range(o.max_depth + 1):
            per = f"SELECT tree, node, class, sum(weight) AS w FROM {state} GROUP BY ALL"
            stats = self.add(f"t{d}", f"SELECT tree, node, sum(w) AS n, count(*) AS k, arg_min(class, (-w, class)) AS class, max(w) AS majority_n, {xlnx('sum(w)')} - sum({xlnx('w')}) AS entropy FROM ({per}) GROUP BY tree, node")
            if d < o.max_depth:
                won = self._winners(d, state, stats, total)
            else:
                won = self.add(f"w{d}", f"SELECT * FROM {self.prefix}_w{d - 1} WHERE false")
            tables.append(
                f"SELECT s.tree::INT AS tree, s.node, {d} AS depth, CASE WHEN w.ordinal IS NULL{' AND w.ordinal_0 IS NULL' if self.n_rule else ''} THEN 'leaf' ELSE 'node' END AS kind, w.ordinal, w.threshold, w.category, w.ordinal_b, w.threshold_b, w.category_b, "
                f"{self._name()} AS feature, w.n_left, w.n_right, s.class, s.n, s.majority_n, w.score, s.entropy - w.l - w.r AS gain, (s.majority_n + 1) / (s.n + 2) AS laplace FROM {stats} s LEFT JOIN {won} w USING (tree, node)"
            )
            if d < o.max_depth:
                lost = "CASE WHEN n_left > 0 AND n_left / (n_left + n_right) >= 0.5 THEN 'left' ELSE 'right' END"
                side = f"SELECT s.*, {self.side('s.', 'w.')} AS side, n_left, n_right FROM {state} s JOIN {won} w USING (tree, node)"
                if o.distribute == "rulew":  # a row for each side, with the share of the conditions that give it
                    part = lambda t: " + ".join(f"coalesce((({self.condition('s.', 'w.', i)}) = '{t}')::INT, 0) * (ordinal_{i} IS NOT NULL)::INT" for i in range(self.n_rule))
                    count = " + ".join(f"(ordinal_{i} IS NOT NULL)::INT" for i in range(self.n_rule))
                    side = " UNION ALL ".join(f"SELECT * FROM (SELECT s.* REPLACE (weight * ({part(t)}) / ({count})::DOUBLE AS weight), '{t}' AS side, n_left, n_right FROM {state} s JOIN {won} w USING (tree, node)) WHERE weight > 0" for t in ("left", "right", "?"))
                state = self.add(f"s{d + 1}", f"SELECT * EXCLUDE (node, side, n_left, n_right), node || CASE CASE side WHEN '?' THEN {lost} ELSE side END WHEN 'left' THEN '0' ELSE '1' END AS node FROM ({side})")
        return self.add("nodes", " UNION ALL ".join(tables))

    def _name(self) -> str:
        names = lambda c: "CASE " + c + "".join(f" WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(self.features)) + " END"
        if self.n_rule:
            rule = "'rule: ' || concat_ws(', ', " + ", ".join(names(f"w.ordinal_{i}") for i in range(self.n_rule)) + ")"
            return f"CASE WHEN w.ordinal_0 IS NOT NULL THEN {rule} ELSE {names('w.ordinal')} END"
        return f"CASE WHEN w.ordinal_b IS NOT NULL THEN {names('w.ordinal')} || ' & ' || {names('w.ordinal_b')} ELSE {names('w.ordinal')} END"

    def _asked(self, live: str, total: int, round_: int) -> str:
        """The candidates of a round: tree, node, cand, ordinal, ordinal_b."""
        o, (n, tried) = self.o, drawn(self.o, total, round_)
        order = lambda tag: f"SELECT l.*, i, row_number() OVER (PARTITION BY tree, node ORDER BY {U(o.seed, repr(tag), 'tree', 'node', 'i')}, i) AS r FROM ({live}) l, range({total}) f(i)"
        size = str(n)
        if o.branch == "random-subset":
            size = f"least({total}, greatest(1, round({n} + (2 * {U(o.seed, repr('size'), 'tree', 'node')} - 1) * {o.variance}::DOUBLE)::INT))"
        one = f"SELECT tree, node, i AS cand, i AS ordinal, NULL::BIGINT AS ordinal_b FROM ({order('feature')}) WHERE r > {tried} AND r <= {tried} + {size}"
        if o.branch not in PAIRED:
            return one
        pair = f"SELECT a.tree, a.node, a.i * {total} + b.i AS cand, a.i AS ordinal, b.i AS ordinal_b FROM ({order('feature')}) a JOIN ({order('other')}) b USING (tree, node) WHERE a.r <= {n} AND b.r <= {n} AND a.i <> b.i"
        coin = U(o.seed, "'policy'", "tree", "node")
        return pair if o.branch == "correlation" else f"SELECT * FROM ({pair}) WHERE {coin} <= {o.factor}::DOUBLE UNION ALL SELECT * FROM ({one}) WHERE {coin} > {o.factor}::DOUBLE"

    def _rules(self, d: int, state: str, live: str, total: int) -> str:
        """The best rule of each node, grown a condition at a time; a rule has a target class and a draw of features."""
        o, n = self.o, self.n_rule
        count = {2: 2, 3: 2, 4: 3}[total] + 1
        per = f"SELECT tree, node, list(class ORDER BY class) AS classes, list(w ORDER BY class) AS weights, sum(w) AS whole FROM (SELECT tree, node, class, sum(weight) AS w FROM {state} GROUP BY ALL) JOIN ({live}) USING (tree, node) GROUP BY tree, node"
        pick = f"floor({U(o.seed, repr('target'), 'tree', 'node', 'rule')} * len(classes))::INT + 1"
        have = self.add(f"r{d}_0", f"SELECT tree, node, rule, classes[{pick}] AS target, weights[{pick}] / whole AS prior, len(classes) AS k, NULL::DOUBLE AS low, true AS open FROM ({per}), range(1, {count + 1}) x(rule)")
        order = f"SELECT tree, node, rule, i, row_number() OVER (PARTITION BY tree, node, rule ORDER BY {U(o.seed, repr('rule'), 'tree', 'node', 'rule', 'i')}, i) AS r FROM {have}, range({total}) f(i)"
        todo = self.add(f"d{d}", f"SELECT tree, node, rule, i FROM ({order}) WHERE r <= {n}")
        for step in range(n):
            tag, used = f"rule{step}", [f"ordinal_{i}" for i in range(step)]
            covered = " AND ".join([f"({self.condition('s.', 'r.', i)}) = 'left'" for i in range(step)] or ["true"])
            open_ = "SELECT s.*, r.rule, s.class = r.target AS pos, t.i AS ordinal, r.rule * {0} + t.i AS cand FROM {1} s JOIN {2} r USING (tree, node) JOIN {3} t USING (tree, node, rule) WHERE r.open AND {4}{5}".format(total, state, have, todo, covered, "".join(f" AND t.i <> r.{c}" for c in used))
            rows = self.add(f"o{d}_{step}", f"SELECT x.*, ({self._value('numeric', 'ordinal', 'x.')})::DOUBLE AS num, ({self._value('categoric', 'ordinal', 'x.')})::VARCHAR AS cat FROM ({open_}) x")
            known = f"SELECT *, row_number() OVER (PARTITION BY tree, node, cand, pos ORDER BY {U(o.seed, repr(tag), 'tree', 'node', 'cand', 'id')}, id) AS place FROM {rows} WHERE num IS NOT NULL OR cat IS NOT NULL"
            both = f"SELECT *, row_number() OVER (PARTITION BY tree, node, cand ORDER BY {U(o.seed, repr(tag), 'tree', 'node', 'cand', 'pos')}, pos) AS nth FROM ({known}) WHERE place = 1"
            of = lambda c, k: f"max({c}) FILTER (nth = {k})"
            cut = self.add(f"k{d}_{step}", f"SELECT tree, node, rule, cand, ordinal, coalesce(({of('num', 1)} + {of('num', 2)}) / 2, {of('num', 1)}, {of('num', 2)}) AS threshold, coalesce({of('cat', 1)}, {of('cat', 2)}) AS category FROM ({both}) GROUP BY tree, node, rule, cand, ordinal HAVING count(*) > 1")
            sided = f"SELECT x.*, {self._side('x.', 'c.')} AS side FROM {rows} x JOIN {cut} c USING (tree, node, rule, cand)"
            on = lambda t, p: f"coalesce(sum(weight) FILTER (side = '{t}' AND pos = {p}), 0)::DOUBLE"
            sums = f"SELECT tree, node, rule, cand, {on('left', 'true')} AS lp, {on('left', 'false')} AS ln, {on('right', 'true')} AS rp, {on('right', 'false')} AS rn, {on('?', 'true')} AS mp, {on('?', 'false')} AS mn FROM ({sided}) GROUP BY ALL"
            to = "(lp + ln > 0 AND (lp + ln) / (lp + ln + rp + rn) >= 0.5)"
            placed = f"SELECT tree, node, rule, cand, lp + CASE WHEN {to} THEN mp ELSE 0 END AS lp, ln + CASE WHEN {to} THEN mn ELSE 0 END AS ln, rp + CASE WHEN {to} THEN 0 ELSE mp END AS rp, rn + CASE WHEN {to} THEN 0 ELSE mn END AS rn FROM ({sums})"
            score = lambda p, q: f"round(1 - ({p} + 1) / ({p} + {q} + k), 9)"
            scored = f"SELECT p.*, {score('lp', 'ln')} AS sl, {score('rp', 'rn')} AS sr, c.ordinal, c.threshold, c.category FROM ({placed}) p JOIN {have} r USING (tree, node, rule) JOIN {cut} c USING (tree, node, rule, cand)"
            best = f"SELECT *, row_number() OVER (PARTITION BY tree, node, rule ORDER BY least(sl, sr), ordinal) AS first FROM ({scored})"
            one = f"SELECT tree, node, rule, ordinal, threshold, category, sl < sr AS holds, least(sl, sr) AS s, lp + ln > 0 AND rp + rn > 0 AS two_sided, CASE WHEN sl < sr THEN lp ELSE rp END AS p, CASE WHEN sl < sr THEN ln ELSE rn END AS neg FROM ({best}) WHERE first = 1"
            better = "coalesce(r.open AND two_sided AND s < coalesce(low, 'inf'::DOUBLE) AND p > 0, false)"
            take = ", ".join(f"CASE WHEN {better} THEN b.{c} END AS {c}_{step}" for c in ("ordinal", "threshold", "category", "holds"))
            have = self.add(f"r{d}_{step + 1}", f"SELECT r.* EXCLUDE (low, open), {take}, CASE WHEN {better} THEN s ELSE low END AS low, {better} AND neg > 0 AS open FROM {have} r LEFT JOIN ({one}) b USING (tree, node, rule)")
        cuts = self.add(f"q{d}", f"SELECT *, rule AS cand, NULL::BIGINT AS ordinal, NULL::DOUBLE AS threshold, NULL::VARCHAR AS category, NULL::BIGINT AS ordinal_b, NULL::DOUBLE AS threshold_b, NULL::VARCHAR AS category_b FROM {have} WHERE ordinal_0 IS NOT NULL")
        return self._best(f"{d}_rule", state, cuts)

    def _mixed(self, d: int, state: str, live: str, total: int) -> str:
        """Rules, or rules and features, as the policy says."""
        o = self.o
        rule = f"SELECT *, 1 AS ruled FROM {self._rules(d, state, live, total)}"
        if o.branch == "rule":
            return self.add(f"w{d}", f"SELECT * FROM ({rule}) WHERE all_left > 0 AND all_right > 0")
        both = f"{rule} UNION ALL BY NAME SELECT *, 0 AS ruled FROM {self._round(d, 0, state, live, total)}"
        coin = f"{U(o.seed, repr('policy'), 'tree', 'node')} <= {o.factor}::DOUBLE"
        pick = f"SELECT * FROM ({both}) WHERE (ruled = 1) = ({coin})" if o.branch == "random-rule" else f"SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY chi2 DESC, ruled DESC) AS nth FROM ({both})) WHERE nth = 1"
        return self.add(f"w{d}", f"SELECT * FROM ({pick}) WHERE all_left > 0 AND all_right > 0")

    def _winners(self, d: int, state: str, stats: str, total: int) -> str:
        o, live = self.o, f"SELECT tree, node, entropy FROM {stats} WHERE k > 1 AND n > {self.o.min_examples}"
        if o.branch in RULED:
            return self._mixed(d, state, live, total)
        most = {"resample": o.resamples, "infinite-resample": 1, "sample-examples": 4}.get(o.branch, total if o.branch in ("hellinger", "chisquare", "random-chisquare", "resquare", "chisquare-decrease") else 0)
        rounds = [r for r in range(most + 1) if r == 0 or drawn(o, total, r)[1] < total and not (o.branch == "sample-examples" and o.share * 2**r >= 1)]
        tables = [f"SELECT *, {r} AS round FROM {self._round(d, r, state, live, total)}" for r in rounds]
        chi = f"chi2 < {o.sigma}::DOUBLE"
        gain = f"entropy - l - r <= {o.min_gain}::DOUBLE"
        poor = {"hellinger": "score >= 1", "resample": gain, "infinite-resample": gain}.get(o.branch, chi if most else "false")
        if o.branch == "random-chisquare":
            poor = f"{poor} AND {U(o.seed, repr('policy'), 'tree', 'node')} <= 0.5"
        if o.branch == "resquare":
            poor = f"{poor} AND {U(o.seed, repr('again'), '(round + 1)', 'tree', 'node')} < 0.5"
        good = f"SELECT * FROM ({' UNION ALL '.join(tables)}) JOIN ({live}) USING (tree, node) WHERE NOT ({poor})"
        first = f"SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY round) AS nth FROM ({good})"
        return self.add(f"w{d}", f"SELECT * FROM ({first}) WHERE nth = 1 AND all_left > 0 AND all_right > 0")

    def _round(self, d: int, r: int, state: str, live: str, total: int) -> str:
        o, key = self.o, f"{d}_{r}"
        asked = self.add(f"a{key}", self._asked(live, total, r))
        value = lambda kind, b: self._value(kind, f"a.ordinal{b}", "s.")
        rows = f"SELECT s.*, cand, a.ordinal, a.ordinal_b, ({value('numeric', '')})::DOUBLE AS num, ({value('categoric', '')})::VARCHAR AS cat, ({value('numeric', '_b')})::DOUBLE AS num_b, ({value('categoric', '_b')})::VARCHAR AS cat_b FROM {state} s JOIN {asked} a USING (tree, node)"
        sample = f"{U(o.seed, repr('sample'), r, 'tree', 'node', 'id')} < {o.share * 2**r}::DOUBLE"
        if o.branch == "sample-examples":
            rows = f"SELECT * FROM ({rows}) WHERE {sample}"
        known = f"SELECT *, row_number() OVER (PARTITION BY tree, node, cand, class ORDER BY {U(o.seed, r, 'tree', 'node', 'cand', 'id')}, id) AS place FROM ({rows}) WHERE num IS NOT NULL OR cat IS NOT NULL OR num_b IS NOT NULL OR cat_b IS NOT NULL"
        member = f"SELECT *, row_number() OVER (PARTITION BY tree, node, cand ORDER BY {U(o.seed, r, 'tree', 'node', 'cand', 'class')}, class) AS nth FROM ({known}) WHERE place = 1"
        one = lambda c, k: f"max({c}) FILTER (nth = {k})"
        mid = lambda c: f"coalesce(({one(c, 1)} + {one(c, 2)}) / 2, {one(c, 1)}, {one(c, 2)})"
        word = lambda c: f"coalesce({one(c, 1)}, {one(c, 2)})"
        cuts = f"SELECT tree, node, cand, any_value(ordinal) AS ordinal, any_value(ordinal_b) AS ordinal_b, {mid('num')} AS threshold, {word('cat')} AS category, {mid('num_b')} AS threshold_b, {word('cat_b')} AS category_b FROM ({member}) WHERE nth <= 2 GROUP BY tree, node, cand HAVING count(*) > 1"
        if self.n_rule:  # not rules
            none = ", ".join(f"NULL::{t} AS {c}_{i}" for i in range(self.n_rule) for c, t in (("ordinal", "BIGINT"), ("threshold", "DOUBLE"), ("category", "VARCHAR"), ("holds", "BOOLEAN")))
            cuts = f"SELECT *, {none} FROM ({cuts})"
        cuts = self.add(f"c{key}", self._exact(cuts, rows) if o.threshold == "exact" else cuts)
        if o.branch == "sample-examples":  # found on the sample, scored on all rows
            found = self._best(f"{key}_s", f"(SELECT * FROM {state} WHERE {sample})", cuts)
            cuts = self.add(f"e{key}", f"SELECT c.* FROM {cuts} c JOIN {found} f USING (tree, node, cand)")
        return self._best(key, state, cuts)

    def _best(self, key: str, state: str, cuts: str) -> str:
        """The candidate of each node with the least score, and its weights."""
        o = self.o
        sided = f"SELECT s.tree, s.node, c.cand, s.class, s.weight, {self.side('s.', 'c.')} AS side FROM {state} s JOIN {cuts} c USING (tree, node)"
        part = lambda t: f"coalesce(sum(weight) FILTER (side = '{t}'), 0)::DOUBLE"
        if o.distribute == "rulew":
            each = lambda t: " + ".join(f"coalesce((({self.condition('s.', 'c.', i)}) = '{t}')::INT, 0) * (ordinal_{i} IS NOT NULL)::INT" for i in range(self.n_rule))
            count = " + ".join(f"(ordinal_{i} IS NOT NULL)::INT" for i in range(self.n_rule))
            sided = " UNION ALL ".join(f"SELECT s.tree, s.node, c.cand, s.class, s.weight * ({each(t)}) / ({count})::DOUBLE AS weight, '{t}' AS side FROM {state} s JOIN {cuts} c USING (tree, node)" for t in ("left", "right", "?"))
        counts = f"SELECT tree, node, cand, class, {part('left')} AS kl, {part('right')} AS kr, {part('?')} AS m FROM ({sided}) GROUP BY ALL"
        wide = f"SELECT *, sum(kl) OVER k AS n_left, sum(kr) OVER k AS n_right FROM ({counts}) WINDOW k AS (PARTITION BY tree, node, cand)"
        to_left = "n_left > 0 AND n_left / (n_left + n_right) >= 0.5"
        placed = f"SELECT *, kl + CASE WHEN {to_left} THEN m ELSE 0 END AS l, kr + CASE WHEN {to_left} THEN 0 ELSE m END AS r FROM ({wide})"
        sums = f"SELECT *, sum(l) OVER k AS wl, sum(r) OVER k AS wr FROM ({placed}) WINDOW k AS (PARTITION BY tree, node, cand)"
        want = lambda w: f"((l + r) * {w} / (wl + wr))"
        chi = " + ".join(f"CASE WHEN {want(w)} > 0 THEN ({c} - {want(w)}) ** 2 / {want(w)} ELSE 0 END" for c, w in (("l", "wl"), ("r", "wr")))
        if o.score == "hellinger":
            p = "SELECT *, pl / nullif(sum(pl) OVER k, 0) AS p, pr / nullif(sum(pr) OVER k, 0) AS q FROM (SELECT *, l / (l + r) AS pl, r / (l + r) AS pr FROM ({})) WINDOW k AS (PARTITION BY tree, node, cand)".format(sums)
            score = "CASE WHEN any_value(wl) <= 0 OR any_value(wr) <= 0 THEN 1000 ELSE 1 - sqrt(greatest(0, 1 - sum(sqrt(p * q)))) END"
            sums, sides = p, (score, score)
        else:
            sides = tuple(f"{xlnx(f'any_value({w})')} - sum({xlnx(c)})" for c, w in (("l", "wl"), ("r", "wr")))
            score = f"({sides[0]}) + ({sides[1]})"
        scored = f"SELECT tree, node, cand, round({score}, 9) AS score, {sides[0]} AS l, {sides[1]} AS r, any_value(n_left) AS n_left, any_value(n_right) AS n_right, any_value(wl) AS all_left, any_value(wr) AS all_right, sum({chi}) AS chi2 FROM ({sums}) GROUP BY tree, node, cand"
        best = f"SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY score, cand) AS best FROM ({scored})"
        return self.add(f"b{key}", f"SELECT b.* EXCLUDE (best), c.* EXCLUDE (tree, node, cand) FROM ({best}) b JOIN {cuts} c USING (tree, node, cand) WHERE best = 1")

    def _exact(self, cuts: str, rows: str) -> str:
        """Numeric thresholds with the least weighted entropy, midway between neighbours."""
        per = f"SELECT tree, node, cand, num, class, sum(weight) AS w FROM ({rows}) WHERE num IS NOT NULL GROUP BY ALL"
        values = "SELECT DISTINCT tree, node, cand, num FROM per"
        grid = "SELECT v.*, c.class, coalesce(p.w, 0) AS w FROM v JOIN (SELECT DISTINCT tree, node, cand, class FROM per) c USING (tree, node, cand) LEFT JOIN per p USING (tree, node, cand, num, class)"
        upto = "SELECT *, sum(w) OVER (PARTITION BY tree, node, cand, class ORDER BY num) AS low, sum(w) OVER (PARTITION BY tree, node, cand, class) AS whole FROM grid"
        score = f"SELECT tree, node, cand, num, round({xlnx('sum(low)')} - sum({xlnx('low')}) + {xlnx('sum(whole - low)')} - sum({xlnx('(whole - low)')}), 6) AS score FROM upto GROUP BY ALL"
        nxt = "SELECT tree, node, cand, num, lead(num) OVER (PARTITION BY tree, node, cand ORDER BY num) AS after FROM v"
        best = "SELECT tree, node, cand, arg_min((num + after) / 2, (score, num)) AS exact FROM score JOIN nxt USING (tree, node, cand, num) WHERE after IS NOT NULL GROUP BY ALL"
        return f"WITH per AS ({per}), v AS ({values}), grid AS ({grid}), upto AS ({upto}), score AS ({score}), nxt AS ({nxt}), best AS ({best}) SELECT q.* REPLACE (CASE WHEN threshold IS NOT NULL THEN exact END AS threshold) FROM ({cuts}) q LEFT JOIN best USING (tree, node, cand)"

    def leaves(self, rows: str, name: str = "leaves") -> str:
        """id, actual, tree, node, pred and laplace of rows in each tree."""
        at = self.add(f"{name}0", f"SELECT *, '1' AS node FROM ({rows}), range(1, {self.o.trees + 1}) t(tree)")
        lost = "CASE WHEN n_left > 0 AND n_left / (n_left + n_right) >= 0.5 THEN 'left' ELSE 'right' END"
        for d in range(self.o.max_depth):
            side = f"SELECT s.*, CASE WHEN w.kind = 'node' THEN {self.side('s.', 'w.')} END AS side, w.n_left, w.n_right FROM {at} s LEFT JOIN {self.nodes} w USING (tree, node)"
            at = self.add(f"{name}{d + 1}", f"SELECT * EXCLUDE (node, side, n_left, n_right), node || CASE CASE side WHEN '?' THEN {lost} ELSE side END WHEN 'left' THEN '0' WHEN 'right' THEN '1' ELSE '' END AS node FROM ({side})")
        return self.add(name, f"SELECT s.id, s.class AS actual, s.tree::INT AS tree, node, w.class AS pred, w.laplace FROM {at} s JOIN {self.nodes} w USING (tree, node)")


def probabilities(votes: str, trees: int) -> str:
    per = f"SELECT id, actual, pred AS class, count(*) / {trees}.0::DOUBLE AS prob FROM ({votes}) GROUP BY ALL"
    return f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY prob DESC, class) AS rank FROM ({per})"


def predicted(probs: str) -> str:
    return f"SELECT id, actual, class AS pred, prob FROM ({probs}) WHERE rank = 1"


def precision_recall(pred: str) -> str:
    """The head of a query: z has class, precision, recall and f_measure."""
    return f"""WITH p AS ({pred}), x AS (SELECT class, sum((pred = class AND actual = class)::INT)::DOUBLE AS tp, sum((pred = class)::INT) AS np, sum((actual = class)::INT) AS na FROM p, (SELECT DISTINCT actual AS class FROM p UNION SELECT DISTINCT pred FROM p) GROUP BY class),
      y AS (SELECT class, tp / nullif(np, 0) AS precision, tp / nullif(na, 0) AS recall FROM x), z AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f_measure FROM y)"""


def macro_f(pred: str) -> str:
    mean = lambda c: f"avg(coalesce({c}, 0))"
    return precision_recall(pred) + f" SELECT 2 * {mean('precision')} * {mean('recall')} / nullif({mean('precision')} + {mean('recall')}, 0) FROM z"


def one_vs_rest(probs: str) -> str:
    return f"WITH p AS ({probs}), o AS (SELECT a.id, c.class, coalesce(p.prob, 0) AS prob, a.actual = c.class AS pos FROM (SELECT DISTINCT id, actual FROM p) a CROSS JOIN (SELECT DISTINCT actual AS class FROM p) c LEFT JOIN p ON p.id = a.id AND p.class = c.class)"


def auc(probs: str) -> str:
    return one_vs_rest(probs) + ", r AS (SELECT *, rank() OVER (PARTITION BY class ORDER BY prob) + (count(*) OVER (PARTITION BY class, prob) - 1) / 2.0 AS r FROM o), a AS (SELECT class, sum(pos::INT)::BIGINT AS n_pos, (sum(CASE WHEN pos THEN r ELSE 0 END)::DOUBLE - sum(pos::INT) * (sum(pos::INT) + 1) / 2) / (sum(pos::INT)::DOUBLE * sum((NOT pos)::INT)) AS auc FROM r GROUP BY class)"


def brier(probs: str) -> str:
    return f"SELECT avg(e) FROM (SELECT id, sum((prob - (class = actual)::INT) ** 2) AS e FROM ({probs}) GROUP BY id)"


def validation_row(fold: str, votes: str, trees: int) -> str:
    """fold and four measures of votes, unrounded."""
    probs = probabilities(f"SELECT * FROM {votes}", trees)
    pred = predicted(probs)
    return (
        f"SELECT '{fold}' AS fold, (SELECT avg((pred = actual)::INT) FROM ({pred})) AS accuracy, (SELECT avg(auc) FROM ({auc(probs)} SELECT * FROM a)) AS average_auc, "
        f"({brier(probs)}) AS brier, ({macro_f(pred)}) AS f_measure"
    )


def validations(parts: list[tuple[str, str, str]], features, o: Options, average: bool = False, weighted: bool = False) -> str:
    """(fold, rows to train on, rows to test) of a validation, and their average."""
    ctes, rows = [], []
    for i, (fold, train, test) in enumerate(parts):
        f = ForestSQL(train, features, o, f"v{i}", weighted)
        rows.append(validation_row(fold, f.leaves(test), o.trees))
        ctes += f.ctes
    names = ("accuracy", "average_auc", "brier", "f_measure")
    sql = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({s})" for n, s in ctes) + f", each AS ({' UNION ALL '.join(rows)})"
    out = "SELECT fold, " + ", ".join(f"round({c}, 6) AS {c}" for c in names) + " FROM each"
    return sql + " " + out + (" UNION ALL SELECT 'average', " + ", ".join(f"round(avg(coalesce({c}, 0)), 6)" for c in names) + " FROM each" if average else "")


def learned_rule(rows: str, features: list[tuple[str, str]], positive: str, seed) -> str:
    """The conditions of a rule in turn: the best on a feature not yet used, while the score falls."""
    ctes = [f"x0 AS MATERIALIZED (SELECT *, class = '{positive}' AS pos FROM ({rows}))", "k AS (SELECT count(DISTINCT class) AS k FROM x0)"]
    ctes.append("h AS (SELECT 1.0::DOUBLE AS score, (SELECT sum(pos::INT) FROM x0)::DOUBLE AS p, (SELECT sum((NOT pos)::INT) FROM x0)::DOUBLE AS n)")
    before, names = "h", []
    for t in range(len(features)):
        used = "".join(f" AND NOT EXISTS (SELECT 1 FROM {n} WHERE {n}.ordinal = {{0}})" for n in names)
        value = lambda i, f, k: f"SELECT {i} AS ordinal, '{f}' AS feature, '{k}' AS kind, {'v' if k == 'numeric' else 'NULL'}::DOUBLE AS num, {'v' if k != 'numeric' else 'NULL'}::VARCHAR AS cat FROM (SELECT arg_min({f}, (CASE WHEN pos THEN {U(seed, t, repr(f), 'id')} ELSE 2 END, id)) AS v FROM x{t} WHERE {f} IS NOT NULL) WHERE v IS NOT NULL" + used.format(i)  # noqa: E731, B023
        ctes.append(f"v{t} AS MATERIALIZED ({' UNION ALL '.join(value(i, f, k) for i, (f, k) in enumerate(features))})")
        test = lambda v: "CASE " + v + ".ordinal" + "".join(f" WHEN {i} THEN {f} {'>=' if k == 'numeric' else '='} {v}.{'num' if k == 'numeric' else 'cat'}" for i, (f, k) in enumerate(features)) + " END"
        part = lambda pos: f"coalesce(sum((coalesce(({test('o')}) = holds, false) AND {pos})::INT), 0)::DOUBLE"
        counted = f"SELECT ordinal, feature, kind, num, cat, holds, {part('pos')} AS p, {part('NOT pos')} AS n FROM x{t}, (SELECT * FROM v{t}, (VALUES (true), (false)) b(holds)) o GROUP BY ALL"
        scored = f"SELECT *, 1 - (p + 1) / (p + n + (SELECT k FROM k)) AS score FROM ({counted}) WHERE p > 0 ORDER BY score, ordinal, holds DESC LIMIT 1"
        ctes.append(f"h{t} AS MATERIALIZED (SELECT s.* FROM ({scored}) s, {before} b WHERE s.score < b.score AND b.p > 0 AND b.n > 0)")
        ctes.append(f"x{t + 1} AS MATERIALIZED (SELECT x.* FROM x{t} x, h{t} o WHERE coalesce(({test('o')}) = o.holds, false))")
        before, names = f"h{t}", [*names, f"h{t}"]
    out = " UNION ALL ".join(f"SELECT {t} AS step, feature, kind, coalesce(num::VARCHAR, cat) AS value, holds FROM h{t}" for t in range(len(features)))
    return f"WITH {', '.join(ctes)} {out}"
