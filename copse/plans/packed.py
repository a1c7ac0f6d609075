"""Rows as arrays that walk the nodes of a forest: what a level reads of its rows, and predictions, by batches in tasks.

A row has a number for each feature; a category's is its place among the words of the bags.  Nodes are arrays too, and
tasks get those of all levels so far.  So nothing is written between levels, a row isn't joined with its node, and the draws of
rows are hashed many at once.  Tasks add up what their rows give; Spark merges these by node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.functions.draws import Leads
from copse.functions.rng import among_equals, whole_number
from copse.operators import split
from copse.operators.examples import ExampleSet, Feature

from .tables import BROADCAST_ROWS, small, stored

#: Rows that a task takes at once; sums that it keeps at most, of nodes, candidates and classes; words and classes known to tasks.
ROWS, CELLS, WORDS = 100_000, 8_000_000, 10_000
#: Rows of a block, which are worked on at once, and blocks of a file, which a task may hold at once.
BLOCK, BLOCKS = 16_384, 64
#: Rows of bags that are worth arrays.
FEW = 10_000
#: Policies that look at single features, once; strategies for missing values that need no draw and leave a row whole.
PLAIN = ("subset", "random", "all", "random-subset")
DECIDED = ("weighted", split.LEFT, split.RIGHT, "ignore")


def numbered(df: DataFrame, features: tuple[Feature, ...], words: dict[int, list[str]]) -> DataFrame:
    """df with x0, x1, .. instead of the features: a word's number is its place, -1 if unknown."""
    for f in features:
        name = F.col(f"`{f.name}`")
        if f.kind == "numeric":
            df = df.withColumn(f"x{f.ordinal}", name.cast("double"))
            continue
        known = words[f.ordinal]
        own = df.sparkSession.createDataFrame(pa.table({"_word": pa.array(known, pa.string()), "_place": pa.array(range(len(known)), pa.float64())}))
        df = df.join(small(own, len(known)), name.cast("string") == F.col("_word"), "left")
        df = df.withColumn(f"x{f.ordinal}", F.when(name.isNotNull(), F.coalesce("_place", F.lit(-1.0)))).drop("_word", "_place")
    return df


@dataclass
class Walk:
    """The nodes of trees, the roots first; a node's place is its number."""

    trees: range
    names: list[tuple[int, str]] = field(default_factory=list)
    tables: list[dict[str, np.ndarray]] = field(default_factory=list)  # of the splits found, level by level
    begin: int = 0  # the first node of the last level

    def __post_init__(self):
        self.names = [(t, "1") for t in self.trees]
        self.places = {n: i for i, n in enumerate(self.names)}

    def add(self, splits: pa.Table, words: dict[int, list[str]], missing: str) -> None:
        """A level of splits (tree, node, ordinal, threshold, category, n_left, n_right); their children are the next level."""
        at = np.array([self.places[t, n] for t, n in zip(splits["tree"].to_pylist(), splits["node"].to_pylist(), strict=True)], np.int64)
        left, right = (pc.fill_null(splits[c], 0.0).to_numpy() for c in ("n_left", "n_right"))
        first = len(self.names)
        ordinal, by, equal = cut_arrays(splits, words)
        child = first + 2 * np.arange(len(at))
        with np.errstate(invalid="ignore", divide="ignore"):
            lost = child + {"left": 0, "right": 1}.get(missing, ~((left > 0) & (left / (left + right) >= 0.5)))
        self.tables.append({"at": at, "ordinal": ordinal, "by": by, "equal": equal, "child": child, "lost": np.full(len(at), -1) if missing == "ignore" else lost})
        self.begin = first
        for i in at:
            tree, node = self.names[i]
            for side in "01":
                self.places[tree, node + side] = len(self.names)
                self.names.append((tree, node + side))

    def arrays(self) -> Nodes:
        n = len(self.names)
        of = {"ordinal": np.full(n, -1, np.int8), "by": np.zeros(n), "equal": np.zeros(n, bool), "child": np.zeros(n, np.int32), "lost": np.full(n, -1, np.int32)}
        for t in self.tables:
            for name, array in of.items():
                array[t["at"]] = t[name]
        return Nodes(depth=len(self.tables), **of)


def cut_arrays(cuts: pa.Table, words: dict[int, list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What cuts look at, by which number, and whether rows must equal it."""
    ordinal = cuts["ordinal"].to_numpy()
    places = {(o, w): float(i) for o, known in words.items() for i, w in enumerate(known)}
    equal = ~cuts["threshold"].is_valid().to_numpy()
    by = pc.fill_null(cuts["threshold"], 0.0).to_numpy().copy()
    category = cuts["category"].to_pylist()
    for i in np.flatnonzero(equal):
        by[i] = places[int(ordinal[i]), category[i]]
    return ordinal, by, equal


@dataclass
class Nodes:
    ordinal: np.ndarray  # -1: no split
    by: np.ndarray
    equal: np.ndarray
    child: np.ndarray  # the left one; the right one is next
    lost: np.ndarray  # where rows without the value go; -1: they stay
    depth: int = 0

    def ends(self, at: np.ndarray, values: list[np.ndarray], gaps: list[np.ndarray | None]) -> np.ndarray:
        """Where rows that begin at nodes end."""
        at, live = at.astype(np.int32), None
        table = np.stack(values) if values else None
        for _ in range(self.depth):
            here = at if live is None else at[live]
            o = self.ordinal[here]
            go = np.flatnonzero(o >= 0)
            if not len(go):
                break
            if len(go) < len(here):
                live = go if live is None else live[go]
                here, o = here[go], o[go]
            x = table[o, np.arange(len(at)) if live is None else live]
            to = self.child[here] + ~holds(x, self.by[here], self.equal[here])
            for i, gap in enumerate(gaps):
                if gap is not None:
                    lost = (o == i) & (gap if live is None else gap[live])
                    to[lost] = self.lost[here[lost]]
            if live is None:
                stay, at = at, to
                at[to < 0] = stay[to < 0]
                live = np.flatnonzero(at != stay) if (at == stay).any() else None
            else:
                moved = to >= 0
                live = live[moved]
                at[live] = to[moved]
        return at


def holds(x: np.ndarray, by: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Whether values go left; NaN is greater than all numbers, as in Spark."""
    return np.where(equal, x == by, (x >= by) | (x != x))


def chunks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    """Tables of so many rows, the last one of fewer."""
    have, n = [], 0
    for b in batches:
        have.append(b)
        n += b.num_rows
        while n >= rows:
            whole = pa.Table.from_batches(have)
            yield whole.slice(0, rows).combine_chunks()
            rest = whole.slice(rows)
            have, n = rest.to_batches(), len(rest)
    if n:
        yield pa.Table.from_batches(have).combine_chunks()


def columns_of(chunk: pa.Table, total: int) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
    """The numbers of the features, and where they are missing (None: nowhere)."""
    columns = [chunk[f"x{i}"] for i in range(total)]
    values = [(pc.fill_null(c, 0.0) if c.null_count else c).to_numpy() for c in columns]
    return values, [c.is_null().to_numpy() if c.null_count else None for c in columns]


#: Columns of a block and their types; x0, x1, .. are doubles, and gap0, .. bytes, empty where no value is missing.
KINDS = {"tree": np.int32, "id": np.int64, "after": np.int64, "class": np.int32, "weight": np.float64}


def in_blocks(rows: DataFrame, total: int) -> DataFrame:
    """Blocks of up to BLOCK rows, a row each with an array of bytes for each column: so the tasks that read them convert no single rows."""
    names = [*KINDS, *[f"x{i}" for i in range(total)], *[f"gap{i}" for i in range(total)]]

    def run(batches):
        for part in chunks(batches, BLOCK):
            values, gaps = columns_of(part, total)
            arrays = [part[c].to_numpy().astype(kind) for c, kind in KINDS.items()] + [v.astype(np.float64) for v in values] + [np.zeros(0, bool) if g is None else g for g in gaps]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=names)

    return rows.mapInArrow(run, ", ".join(f"{c} binary" for c in names))


@dataclass
class Block:
    """Some rows as arrays."""

    columns: dict[str, np.ndarray]
    values: list[np.ndarray]
    gaps: list[np.ndarray | None]

    def __len__(self) -> int:
        return len(self.columns["tree"])


def blocks(batches: Iterator[pa.RecordBatch], total: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            of = lambda c, kind: np.frombuffer(batch[c][i].as_buffer(), kind)  # noqa: B023, E731
            gaps = [of(f"gap{j}", bool) for j in range(total)]
            yield Block({c: of(c, kind) for c, kind in KINDS.items()}, [of(f"x{j}", np.float64) for j in range(total)], [g if len(g) else None for g in gaps])


def add_to(sums: np.ndarray, at: np.ndarray, x: np.ndarray) -> None:
    if len(sums) > 4 * len(at):
        np.add.at(sums, at, x)
    else:
        sums += np.bincount(at, x, len(sums))


@dataclass
class Packed:
    """The rows of bags as arrays, in the nodes that they have come to."""

    rows: DataFrame
    features: tuple[Feature, ...]
    words: dict[int, list[str]]
    classes: list[str | None]
    walk: Walk
    missing: str

    def fits(self, nodes: int, slots: int) -> bool:
        return nodes <= BROADCAST_ROWS and nodes * max(1, slots) * max(1, len(self.classes)) * 3 <= CELLS

    def split(self, winners: DataFrame) -> None:
        self.walk.add(winners.select("tree", "node", "ordinal", "threshold", "category", "n_left", "n_right").toArrow(), self.words, self.missing)

    def _named(self, at: np.ndarray) -> tuple[list[int], list[str]]:
        names = [self.walk.names[self.walk.begin + i] for i in at]
        return [t for t, _ in names], [n for _, n in names]

    def members(self, asked: DataFrame | None, lead, slots: int, codes: dict[int, np.ndarray]) -> DataFrame:
        """tree, node, cand, class: weight (of all rows, as candidate -1) and the values of the row with the least draw."""
        begin, n, k, nodes = self.walk.begin, len(self.walk.names) - self.walk.begin, len(self.classes), self.walk.arrays()
        cand, ordinal, texts = np.full((n, max(1, slots)), -1), np.full((n, max(1, slots)), -1), [""] * (n * slots)
        for r in asked.toArrow().to_pylist() if slots else []:  # a row for each node of a level
            at = self.walk.places[r["tree"], r["node"]] - begin
            for s, a in enumerate(r["asks"]):
                cand[at, s], ordinal[at, s], texts[at * slots + s] = a["cand"], a["ordinal"], lead(r["tree"], r["node"], a["cand"])
        leads, total, classes, start = Leads(texts or [""]), len(self.features), pa.array(self.classes, pa.string()), self.walk.trees[0]
        tree, node = (pa.array(x) for x in self._named(np.arange(n)))
        of_word = [f.kind != "numeric" for f in self.features]
        schema = pa.schema([("tree", pa.int32()), ("node", pa.string()), ("cand", pa.int32()), ("class", pa.string()), ("w", pa.float64()), ("o", pa.int64()), ("num", pa.float64()), ("cat", pa.int64())])

        def run(batches):
            weight, seen = np.zeros(n * k), np.zeros(n * k, bool)
            least, value = np.full(n * k * slots, np.iinfo(np.int64).max), np.zeros(n * k * slots)
            for block in blocks(batches, total):
                own, values, gaps = block.columns, block.values, block.gaps
                at = nodes.ends(own["tree"] - start, values, gaps) - begin
                rows = np.flatnonzero(at >= 0)
                at, klass = at[rows], own["class"][rows]
                add_to(weight, at * k + klass, own["weight"][rows])
                seen[at * k + klass] = True
                if not slots:
                    continue
                ids, after = own["id"][rows], own["after"][rows]
                table, gap = np.stack(values), None if all(g is None for g in gaps) else np.stack([np.zeros(len(block), bool) if g is None else g for g in gaps])
                for s in range(slots):
                    o = ordinal[at, s]
                    some = np.flatnonzero((o >= 0) if gap is None else (o >= 0) & ~gap[o, rows])
                    draw = leads.heads(at[some] * slots + s, ids[some]).astype(np.int64) * 2147483648 + after[some]
                    key = (at[some] * k + klass[some]) * slots + s
                    better = np.flatnonzero(draw < least[key])
                    key, draw, some = key[better], draw[better], some[better]
                    order = np.lexsort((draw, key))
                    first = order[np.flatnonzero(np.diff(key[order], prepend=-1))]
                    least[key[first]] = draw[first]
                    value[key[first]] = table[o[some[first]], rows[some[first]]]
            there = np.flatnonzero(seen)
            yield _batch(schema, tree.take(there // k), node.take(there // k), np.full(len(there), -1), classes.take(there % k), weight[there], np.zeros(len(there)), None, None)
            found = np.flatnonzero(least < np.iinfo(np.int64).max)
            at, s = found // slots // k if slots else found, found % slots if slots else found
            o, x = ordinal[at, s], value[found]
            word = np.array(of_word, bool)[o]
            code = np.zeros(len(x), np.int64)
            for i, known in codes.items():
                code[o == i] = known[x[o == i].astype(np.int64)]
            yield _batch(schema, tree.take(at), node.take(at), cand[at, s], classes.take(found // slots % k if slots else found), np.zeros(len(x)), least[found], pa.array(x, mask=word), pa.array(code, mask=~word))

        out = self.rows.mapInArrow(run, "tree int, node string, cand int, class string, w double, o bigint, num double, cat bigint")
        out = out.groupBy("tree", "node", "cand", "class").agg(F.sum("w").alias("w"), F.min("o").alias("o"), *[F.min_by(c, "o").alias(c) for c in ("num", "cat")])
        v = F.struct("num", "cat", F.lit(None).cast("double").alias("num_b"), F.lit(None).cast("long").alias("cat_b"))
        return out.select("tree", "node", "cand", "class", "w", F.when(F.col("cand") >= 0, v).alias("v"))

    def sides(self, cuts: DataFrame, slots: int) -> DataFrame:
        """tree, node, cand, class: the weights left, right and missing by each candidate."""
        begin, n, k, nodes, total = self.walk.begin, len(self.walk.names) - self.walk.begin, len(self.classes), self.walk.arrays(), len(self.features)
        found = cuts.select("tree", "node", "cand", "ordinal", "threshold", "category").toArrow()
        at = np.array([self.walk.places[t, x] - begin for t, x in zip(found["tree"].to_pylist(), found["node"].to_pylist(), strict=True)], np.int64)
        slot, used = np.zeros(len(at), np.int64), np.zeros(n, np.int64)
        for i, a in enumerate(at):
            slot[i], used[a] = used[a], used[a] + 1
        cand, ordinal, by, equal = np.full((n, slots), -1), np.full((n, slots), -1), np.zeros((n, slots)), np.zeros((n, slots), bool)
        cand[at, slot] = found["cand"].to_numpy()
        ordinal[at, slot], by[at, slot], equal[at, slot] = cut_arrays(found, self.words)
        classes, start = pa.array(self.classes, pa.string()), self.walk.trees[0]
        tree, node = (pa.array(x) for x in self._named(np.arange(n)))
        schema = pa.schema([("tree", pa.int32()), ("node", pa.string()), ("cand", pa.int32()), ("class", pa.string()), ("l", pa.float64()), ("r", pa.float64()), ("m", pa.float64())])

        def run(batches):
            sums, seen = np.zeros(n * k * slots * 3), np.zeros(n * k * slots, bool)
            for block in blocks(batches, total):
                own, values, gaps = block.columns, block.values, block.gaps
                at = nodes.ends(own["tree"] - start, values, gaps) - begin
                rows = np.flatnonzero(at >= 0)
                rows = rows[used[at[rows]] > 0]
                at, klass, weight, table = at[rows], own["class"][rows], own["weight"][rows], np.stack(values)
                for s in range(slots):
                    o = ordinal[at, s]
                    side = 1 - holds(table[o, rows], by[at, s], equal[at, s])
                    for i, gap in enumerate(gaps):
                        if gap is not None:
                            side[(o == i) & gap[rows]] = 2
                    some = o >= 0
                    key = ((at * k + klass) * slots + s)[some]
                    add_to(sums, key * 3 + side[some], weight[some])
                    seen[key] = True
            sums = sums.reshape(-1, 3)
            there = np.flatnonzero(seen)
            at = there // slots // k
            yield _batch(schema, tree.take(at), node.take(at), cand[at, there % slots], classes.take(there // slots % k), *sums[there].T)

        out = self.rows.mapInArrow(run, "tree int, node string, cand int, class string, l double, r double, m double")
        return out.groupBy("tree", "node", "cand", "class").agg(*[F.sum(c).alias(c) for c in "lrm"])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A batch of arrays; None: a column without values."""
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else c.cast(f.type) if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)).cast(f.type) for f, c in zip(schema, columns, strict=True)], schema=schema)


def packed(ex: ExampleSet, bags: DataFrame, trees: range, missing: str, words: dict[int, list[str]]) -> Packed | None:
    """The rows of bags as arrays; None where they are few, ids aren't whole numbers from 0 on, or classes are too many."""
    if not whole_number(bags, "id"):
        return None
    least, none, n = bags.agg(F.min("id"), F.count(F.when(F.col("id").isNull(), 1)), F.count(F.lit(1))).first()
    if n < FEW or least is None or least < 0 or none:
        return None
    known = [r[0] for r in bags.select("class").distinct().limit(WORDS + 1).collect()]
    if len(known) > WORDS:
        return None
    own = bags.sparkSession.createDataFrame(pa.table({"_class": pa.array(known, pa.string()), "_code": pa.array(range(len(known)), pa.int32())}))
    rows = numbered(bags, ex.features, words).join(small(own, len(known)), F.col("class").eqNullSafe(F.col("_class")))
    rows = rows.select(F.col("tree").cast("int").alias("tree"), F.col("id").cast("bigint").alias("id"), among_equals(rows).alias("after"), F.col("_code").alias("class"), F.coalesce("weight", F.lit(0.0)).alias("weight"), *[f"x{f.ordinal}" for f in ex.features])
    return Packed(stored(in_blocks(rows, len(ex.features)), "packed", BLOCKS), ex.features, words, known, Walk(trees), missing)


def walked(nodes: pa.Table, trees: int, missing: str) -> tuple[Nodes, dict[int, list[str]], np.ndarray]:
    """The nodes of a model (tree, node, kind and its splits) as arrays, the words of their splits, and the places of the table's rows."""
    words = {}
    kind, names = nodes["kind"].to_pylist(), list(zip(nodes["tree"].to_pylist(), nodes["node"].to_pylist(), strict=True))
    for o, w in zip(nodes["ordinal"].to_pylist(), nodes["category"].to_pylist(), strict=True):
        if w is not None:
            words.setdefault(o, {})[w] = None
    words = {o: list(w) for o, w in words.items()}
    walk = Walk(range(1, trees + 1))
    inner = nodes.filter(pa.array([x == "node" for x in kind]))
    depth = np.array([len(n) for n in inner["node"].to_pylist()], np.int64)
    for d in range(1, int(depth.max(initial=0)) + 1):
        walk.add(inner.filter(pa.array(depth == d)), words, missing)
    order = np.array([walk.places[n] for n in names], np.int64)
    return walk.arrays(), words, order


def ended(df: DataFrame, keep: list[str], features: tuple[Feature, ...], nodes: Nodes, words: dict[int, list[str]], trees: int, give, schema: str) -> DataFrame:
    """What give() makes of the columns kept and of the nodes, a row for each example and a column for each tree, where examples end."""
    rows = numbered(df, features, {f.ordinal: words.get(f.ordinal, []) for f in features}).select(*keep, *[f"x{f.ordinal}" for f in features])
    total = len(features)

    def run(batches):
        for chunk in chunks(batches, ROWS // 4):
            values, gaps = columns_of(chunk, total)
            ends = [nodes.ends(np.full(len(chunk), t), values, gaps) for t in range(trees)]
            yield from give(chunk.select(keep), np.stack(ends, 1)).to_batches()

    return rows.mapInArrow(run, schema)


def kept(df: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
