"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees on binned features gives a lookup table for each feature and for some
pairs of features; a score is a sum of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: Features of a text, all from its own characters, words and lines.
FEATURES = (
    "log_chars", "log_words", "mean_word", "longest_word", "upper", "digit", "punct", "symbol", "pipe", "space",
    "other", "distinct_words", "adjacent_repeats", "capital_words", "line_words", "dup_lines", "ends_in_mark", "exclaim",
)
_CLASS = np.zeros(256, np.intp)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"#*$%&<>@^~=+_\\/{}[]`", b"|", b" \t\n\x0b\f\r", b"!")):
    _CLASS[list(_set)] = _i + 1
_CLASS[128:] = 8


def features(texts) -> np.ndarray:
    """A row for each text (null: as empty), a column for each of FEATURES."""
    out = np.zeros((len(texts), len(FEATURES)), np.float32)
    for row, text in zip(out, texts, strict=True):
        if not text:
            continue
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        n = np.bincount(_CLASS[raw], minlength=9) / len(raw)
        words = text.split()
        lines = [x for x in text.split("\n") if x.strip()]
        k, distinct = max(1, len(words)), set(words)
        row[:] = (
            np.log1p(len(text)), np.log1p(len(words)), len(text) / k, min(200, max(map(len, distinct), default=0)), n[1], n[2], n[3], n[4], n[5], n[6],
            n[8], len(distinct) / k, sum(map(str.__eq__, words, words[1:])) / k, sum(map(str.isupper, words)) / k, np.log1p(k / max(1, len(lines))),
            1 - len(set(lines)) / max(1, len(lines)), float(text.rstrip()[-1:] in ".?!"), n[7],
        )
    return out


@dataclass
class Model:
    """edges: bin edges of each feature; tables: values of each bin; pairs: (i, j, coarse edges, table)."""

    base: float
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for i, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, i], side="right")]
        for i, j, a, b, table in self.pairs:
            out += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))

    def scores(self, text: Column) -> Column:
        """The score of each text, between 0 and 1."""
        model = self

        def of(texts: pd.Series) -> pd.Series:
            return pd.Series(model.score(features(texts.tolist())))

        return F.pandas_udf(of, "double")(text)


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _step(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """The values of a tree of so many leaves over the bins with gradient sums g and curvature sums h."""
    parts, cg, ch = [(0, len(g))], np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    while len(parts) < leaves:
        best = (1e-9, None)
        for a, b in parts:
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gains = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                if (top := int(np.argmax(gains))) is not None and gains[top] > best[0]:
                    best = (gains[top], (a, int(cuts[top]), b))
        if best[1] is None:
            break
        a, c, b = best[1]
        parts.remove((a, b))
        parts += [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _step(cg[b] - cg[a], ch[b] - ch[a], ridge)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The gain and values of the best tree with one cut on each of two axes."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    r, c = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not r.size or not c.size:
        return 0.0, np.zeros_like(g)

    def quadrants(s):
        a, b, d = s[r, c], s[r, -1], s[-1, c]
        return np.broadcast_arrays(a, b - a, d - a, s[-1, -1] - b - d + a)

    qg, qh = quadrants(cg), quadrants(ch)
    gains = sum(x**2 / (y + ridge) for x, y in zip(qg, qh, strict=True)) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    at = np.unravel_index(int(np.argmax(gains)), gains.shape)
    v = [_step(x[at], y[at], ridge) for x, y in zip(qg, qh, strict=True)]
    out, i, j = np.zeros_like(g), at[0] + 1, at[1] + 1
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return float(gains[at]), out


def train(x: np.ndarray, y: np.ndarray, bins: int = 64, rounds: int = 150, rate: float = 0.1, n_pairs: int = 6, pair_rounds: int = 60, ridge: float = 4.0) -> Model:
    """Fit in numpy.  Without both labels the model is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [_edges(x[:, i], bins) for i in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, b in enumerate(binned):
            g, h = slopes()
            step = rate * _tree(np.bincount(b, g, len(model.tables[i])), np.bincount(b, h, len(model.tables[i])), ridge)
            model.tables[i] += step
            f += step[b]
    coarse = [_edges(x[:, i], 9) for i in range(x.shape[1])]
    small = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(coarse)]

    def sums(i, j, v):
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(small[i] * shape[1] + small[j], v, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((-_grid_tree(sums(i, j, g), sums(i, j, h), ridge)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)))[:n_pairs]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, _, _, table in model.pairs:
            g, h = slopes()
            step = rate * _grid_tree(sums(i, j, g), sums(i, j, h), ridge)[1]
            table += step
            f += step[small[i], small[j]]
    return model


def held_out(ident: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(ident.cast("string")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Model:
    """A model of the labelled rows that aren't held out.

    Of those, max_rows are used at most: the ones with the least hash of their id, so that runs agree.
    Labels other than 0 and 1, null ids, and ids labelled both ways are left out.  The ids of the sample
    are broadcast (max_rows bounds them), so the documents are read once and not shuffled.
    """
    ident = F.col(quoted(id_col))
    known = labels.select(ident.alias("x_id"), F.col(quoted(label_col)).cast("int").alias("x_label")).filter("x_label IN (0, 1) AND x_id IS NOT NULL")
    known = known.filter(~held_out(F.col("x_id"))).groupBy("x_id").agg(F.min("x_label").alias("x_label"), F.max("x_label").alias("x_most")).filter("x_label = x_most")
    sample = known.orderBy(F.xxhash64("x_id"), "x_id").limit(max_rows).select("x_id", "x_label")
    rows = docs.select(ident.alias("x_id"), F.col(quoted(text_col)).alias("x_text")).join(F.broadcast(sample), "x_id")

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(list(features(texts.tolist())))

    got = rows.select("x_id", "x_label", F.pandas_udf(of, "array<float>")("x_text").alias("x")).toPandas()
    if got.empty:
        return train(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort((*x.T, got["x_id"].to_numpy()))  # whatever order the rows came in
    return train(x[order], got["x_label"].to_numpy(np.float64)[order])
