"""Validation schemes, experiments and their results."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copse.operators import metrics, sampling
from copse.operators.examples import ExampleSet

from .forest import ForestModel, Options, fit, fit_groups
from .tables import stored

#: Columns of a written result, in order (fixed values).
COLUMNS = ("fold", "accuracy", "weighted auc", "average auc", "oob-base-accuracy", "base-accuracy", "strength", "margin-variance", "correlation", "c/s^2", "precision", "recall", "prc", "f-measure", "no-rules", "brier", "variance", "mse", "time")


#: Folds that are evaluated side by side.
AT_ONCE = 4


def evaluate(model: ForestModel, test: DataFrame, train: DataFrame | None = None, bags: DataFrame | None = None) -> dict[str, float]:
    votes = stored(model.votes(test), "votes")
    probs = stored(metrics.probabilities(votes, model.options.trees), "probs")
    pred = metrics.predicted(probs)
    per_class = per_class_of(probs, pred)
    auc = metrics.average_auc(metrics.auc(probs)).first()
    mac = metrics.macro(metrics.precision_recall(pred)).first()
    strength, corr, mse = metrics.strength(probs).first(), metrics.correlation(votes, probs).first(), metrics.mse(probs).first()
    oob = model.oob_accuracy(train, bags).agg(F.avg("accuracy")).first()[0] if bags is not None else None
    return {
        "accuracy": metrics.accuracy(pred).first()[0], "weighted auc": auc[0], "average auc": auc[1], "oob-base-accuracy": oob,
        "base-accuracy": metrics.base_accuracy(votes, probs).agg(F.avg("a")).first()[0], "strength": strength[0], "margin-variance": strength[1],
        "correlation": corr[0], "c/s^2": corr[1], "precision": mac[0], "recall": mac[1], "prc": metrics.prc(probs).agg(F.avg("prc")).first()[0],
        "f-measure": mac[2], "no-rules": float(model.n_rules().first()[0]), "brier": metrics.brier(probs).first()[0], "variance": mse[1], "mse": mse[0],
        "classes": per_class,
    }


def per_class_of(probs: DataFrame, pred: DataFrame) -> dict[str, dict[str, float]]:
    """auc, prc, precision, recall and f_measure of each class."""
    rows = metrics.auc(probs).select("class", "auc").join(metrics.prc(probs), "class").join(metrics.precision_recall(pred), "class", "left")
    return {r["class"]: {c: r[c] for c in ("auc", "prc", "precision", "recall", "f_measure")} for r in rows.collect()}  # a row for each class


def predictions(model: ForestModel, df: DataFrame) -> DataFrame:
    """id, actual, pred and probs: the share of trees for each class, the greatest first."""
    probs = model.transform(df)
    all_ = F.array_sort(F.collect_list(F.struct("rank", "class", "prob")))  # a struct for each voted class
    per = probs.groupBy("id", "actual").agg(F.transform(all_, lambda s: F.struct(s["class"].alias("class"), s["prob"].alias("prob"))).alias("probs"))
    return per.select("id", "actual", F.col("probs")[0]["class"].alias("pred"), "probs")


def write_predictions(rows: DataFrame, path: str) -> None:
    """predictions() as text, a line a row: id,actual,pred,class:prob,...  Written by all tasks."""
    probs = F.array_join(F.transform("probs", lambda s: F.concat(s["class"], F.lit(":"), F.format_string("%.4f", s["prob"]))), ",")
    rows.select(F.concat_ws(",", F.col("id").cast("string"), "actual", "pred", probs).alias("value")).write.mode("overwrite").text(path)


def _one(ex: ExampleSet, train: DataFrame, test: DataFrame, options: Options, processor=None) -> dict[str, float]:
    began = time.time()
    part = ex.with_df(train)
    part = processor(part) if processor else part
    model, bags = fit(part, options)
    return evaluate(model, test, part.df, bags) | {"time": time.time() - began}


def cross_validation(ex: ExampleSet, options: Options, folds: int = 10, seed=1, processor=None) -> list[dict]:
    """Folds grow in one plan and are evaluated side by side; with a processor, or missing values by proximity, one after the other."""
    dealt = stored(sampling.stratified_folds(ex.df, folds, seed), "folds")
    parts = [tuple(df.drop("fold") for df in sampling.merge_folds(dealt, fold)) for fold in range(1, folds + 1)]
    if processor or options.missing == "proximity":
        out = [{"fold": str(i)} | _one(ex, train, test, options, processor) for i, (test, train) in enumerate(parts, 1)]
    else:
        began = time.time()
        models = fit_groups(ex.with_df(dealt), "fold", folds, options)
        spent = (time.time() - began) / folds

        def one(i: int) -> dict:
            at, ((test, train), (model, bags)) = time.time(), (parts[i], models[i])
            return {"fold": str(i + 1)} | evaluate(model, test, train, bags) | {"time": spent + time.time() - at}

        with ThreadPoolExecutor(AT_ONCE) as pool:
            out = list(pool.map(one, range(folds)))
    mean = {k: sum(r[k] or 0.0 for r in out) / folds for k in out[0] if k not in ("fold", "classes")}
    names = sorted({c for r in out for c in r["classes"]})
    mean["classes"] = {c: {m: sum(r["classes"].get(c, {}).get(m) or 0.0 for r in out) / folds for m in ("auc", "prc", "precision", "recall", "f_measure")} for c in names}
    return [*out, {"fold": "average"} | mean]


def split_validation(ex: ExampleSet, options: Options, ratio: float = 0.66, seed=1, processor=None) -> list[dict]:
    rows = sampling.train_test_split(ex.df, ratio, seed)
    return [{"fold": f"split {ratio}"} | _one(ex, rows.filter("train").drop("train"), rows.filter("NOT train").drop("train"), options, processor)]


def in_sample_validation(ex: ExampleSet, options: Options, processor=None) -> list[dict]:
    return [{"fold": "in-sample"} | _one(ex, ex.df, ex.df, options, processor)]


def bootstrap_validation(ex: ExampleSet, options: Options, seed=1, processor=None) -> list[dict]:
    bag = stored(sampling.bootstrap(ex.df, seed), "bag")
    return [{"fold": "bootstrap"} | _one(ex, bag, sampling.out_of_bag(ex.df, bag), options, processor)]


EVALUATORS = {"cv": cross_validation, "sv": split_validation, "in": in_sample_validation, "bootstrap": bootstrap_validation}


def smote_processor(k: int = 5, times: int = 1, seed=1):
    """A processor that adds made-up rows of the minority class."""
    from copse.operators.neighbors import smote

    def run(ex: ExampleSet) -> ExampleSet:
        made = smote(ex.df, ex.features, seed, k=k, times=times)
        if ex.df.schema["id"].dataType.simpleString() == "string":
            ident = F.concat(F.col("from_id"), F.lit("#made-"), F.col("copy").cast("string"))
        else:  # above all ids
            low, high = ex.df.agg(F.min("id"), F.max("id")).first()
            ident = F.lit(high or 0) + (F.col("from_id") - F.lit(low or 0)) * times + F.col("copy")
        rows = made.select(ident.alias("id"), "class", F.lit(1.0).alias("weight"), *ex.names())
        return ex.with_df(stored(ex.df.unionByName(rows), "smote"))

    return run


def experiment(sets: dict[str, ExampleSet], options: Options, evaluator: str = "cv", iterations: int = 10, **settings) -> list[dict]:
    """Each data set, so many times with another seed."""
    from dataclasses import replace

    out = []
    for name, ex in sets.items():
        for i in range(1, iterations + 1):
            out += [{"dataset": name, "iteration": i} | r for r in EVALUATORS[evaluator](ex, replace(options, seed=options.seed + i), **settings)]
    return out


def as_csv(results: list[dict], header: bool = True) -> str:
    cell = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    lines = [",".join(COLUMNS)] if header else []
    return "\n".join([*lines, *[",".join(cell(r.get(c)) for c in COLUMNS) for r in results]]) + "\n"


def as_text(results: list[dict], importance: DataFrame | None = None, folds: bool = True) -> str:
    out = []
    for r in results if folds else results[-1:]:
        out += [f"** {r['fold']} **", *[f"  {c}: {r[c]:.4f}" for c in COLUMNS[1:] if r.get(c) is not None]]
        for name, of in sorted(r.get("classes", {}).items()):
            out.append(f"  class {name}: " + ", ".join(f"{m} {v:.4f}" for m, v in of.items() if v is not None))
    if importance is not None:
        out += ["variable importance", *[f"  {x['feature']}: {x['importance']:.4f}" for x in importance.orderBy(F.desc("importance"), "feature").limit(10).collect()]]
    return "\n".join(out) + "\n"
