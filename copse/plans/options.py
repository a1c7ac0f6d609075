"""Options of a forest: names, defaults and what is allowed."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

from copse.functions.measures import MEASURES

#: Branching policies that draw again where a node's best split is poor.
REDRAW = ("resample", "infinite-resample", "hellinger", "chisquare", "random-chisquare", "resquare", "chisquare-decrease", "sample-examples")
#: Those with pairs of features, and those with rules.
PAIRED, RULED = ("correlation", "combination"), ("rule", "random-rule", "choose-rule")
BRANCHES = ("subset", "random", "all", "random-subset", *REDRAW, *PAIRED, *RULED)
ALIASES = {"weka": "infinite-resample", "weka-resample": "infinite-resample", "partitionw": "wpartition"}
MISSING = ("weighted", "random", "randomw", "partition", "wpartition", "left", "right", "ignore", "proximity")
SAMPLING = ("bagging", "subagging", "nothing", "oversample", "undersample", "triangle-variance", "uniform-variance", "random")
THRESHOLDS, RULE_SCORES, DISTRIBUTE = ("random", "value", "exact"), ("laplace", "m", "purity"), ("default", "rulew")


@dataclass(frozen=True)
class Options:
    """An unknown name is an error.  These may be functions instead of names:

    score(counts, keys) gives keys, score, left and right of counts (keys, class, l, r); example_sampling(rows,
    seed) gives the rows of a tree; branch(grower, state, asked, n) gives the splits of the nodes asked (policies.py has
    parts of such); missing(left, right) the share of rows without a value that goes left, drawn row by row; threshold(x, y) where to
    cut between the values of two classes; distribute(value, by) the side, left or right, of a known value; features(total)
    how many features a node inspects; prune(chi2, left, right) whether a split stays.
    """

    trees: int = 10
    max_depth: int = 12
    min_examples: int = 1
    score: str | Callable = "info"
    features: str | int | Callable = "default"  # default, sqrt, all or a number
    branch: str | Callable = "subset"
    missing: str | Callable = "weighted"
    example_sampling: str | Callable = "bagging"
    threshold: str | Callable = "random"
    distribute: str | Callable = "default"  # rulew: rows of a rule node are dealt by the shares of its conditions
    rule_score: str = "laplace"
    rules: str | int = "ss"  # rules a node beside the first: ss (root of the features + 1), same, default or a number
    resamples: int = 6
    min_gain: float = 0.0
    sigma: float = 0.5  # chi-square under which a split is poor
    factor: float = 0.5  # share of nodes with pairs (combination) or rules (random-rule)
    prune: float | Callable | None = None  # chi-square under which a node stays a leaf
    variance: float = 2.0  # random-subset: how many features more or less
    variance_options: tuple[float, ...] | None = None  # of the variance samplings: threshold, low, high (and mode)
    share: float = 0.1  # sample-examples: of the rows, at first
    seed: int = 1
    groups: int = 1  # forests that grow in one plan: trees are numbered on from one to the next

    def __post_init__(self):
        for name in ("branch", "missing"):
            value = getattr(self, name)
            if isinstance(value, str):
                object.__setattr__(self, name, ALIASES.get(value, value))
        allowed = {"score": MEASURES, "branch": BRANCHES, "missing": MISSING, "example_sampling": SAMPLING, "threshold": THRESHOLDS, "distribute": DISTRIBUTE, "rule_score": RULE_SCORES}
        for name, names in allowed.items():
            value = getattr(self, name)
            if value not in names and not (callable(value) and name in ("score", "example_sampling", "branch", "missing", "threshold", "distribute")):
                raise ValueError(f"unknown {name.replace('_', ' ')}: {value!r}; one of {', '.join(names)}")
        if not (callable(self.features) or isinstance(self.features, int) and self.features > 0 or self.features in ("default", "sqrt", "all")):
            raise ValueError(f"unknown number of features: {self.features!r}")
        if not (isinstance(self.rules, int) and self.rules > 0 or self.rules in ("ss", "same", "default")):
            raise ValueError(f"unknown number of rules: {self.rules!r}")
        if self.trees < 1 or self.max_depth < 0 or self.resamples < 0 or not 0 < self.share <= 1:
            raise ValueError("trees must be 1 or more, depth and resamples 0 or more, share in (0, 1]")

    def n_features(self, total: int) -> int:
        if self.branch in ("random", "hellinger"):
            return 1
        if self.features == "all" or self.branch == "all":
            return total
        n = int(self.features(total)) if callable(self.features) else int(math.log2(total)) + 1 if self.features == "default" else int(math.sqrt(total)) if self.features == "sqrt" else int(self.features)
        return max(1, min(total, n))

    def n_rules(self, total: int) -> int:
        n = self.n_features(total)
        return {"ss": int(math.sqrt(total)) + 1, "same": n, "default": max(1, n // 2)}.get(self.rules, self.rules) + 1

    def as_dict(self) -> dict:
        """For a stored model: functions by their names."""
        return {k: getattr(v, "__name__", "function") if callable(v) else v for k, v in asdict(self).items()}
