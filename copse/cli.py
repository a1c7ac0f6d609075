"""Commands: test, deploy, employ, predict, predict-all, vi, rex, experiment, help."""

from __future__ import annotations

import argparse
import json
import logging
import os
import shlex
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from copse.operators.rules import extract_rules
from copse.plans import validate
from copse.plans.forest import ForestModel, Options, fit
from copse.sources import typed_csv

log = logging.getLogger("copse")
LEVELS = {"none": 100, "error": 40, "info": 20, "debug": 10}


def forest_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("rf", add_help=False)
    p.add_argument("-n", "--no-trees", type=int, default=10, dest="trees")
    p.add_argument("-c", "--cores", help="left to the cluster")
    p.add_argument("--progress", default="none", choices=("dots", "numeric", "none"), help="the session's progress bar shows it")
    p.add_argument("--score", default="info")
    p.add_argument("--rule-score", default="laplace")
    p.add_argument("--no-rules", default="ss", dest="rules", type=lambda x: int(x) if x.isdigit() else x)
    p.add_argument("-d", "--distribute", default="default")
    p.add_argument("--variance-options", default=None, type=lambda x: tuple(float(v) for v in x.split(",")))
    p.add_argument("--pre-prune", type=float, default=None, dest="prune")
    p.add_argument("--max-depth", type=int, default=12)
    p.add_argument("--min-examples", type=int, default=1)
    p.add_argument("--feature-sampling", default="subset", dest="branch")
    p.add_argument("-m", "--missing", default="weighted")
    p.add_argument("--example-sampling", default="bagging")
    p.add_argument("--no-features", default="default", dest="features", type=lambda x: int(x) if x.isdigit() else x)
    p.add_argument("--no-resample", type=int, default=6, dest="resamples")
    p.add_argument("--min-gain", type=float, default=0.0)
    p.add_argument("--weight-factor", type=float, default=0.5, dest="sigma")
    p.add_argument("--threshold", default="random")
    p.add_argument("--seed", type=int, default=1)
    return p


def forest_options(text: str) -> Options:
    """Options from a string such as: rf -n 100 --score gini"""
    words = shlex.split(text)
    if not words or words[0] != "rf":
        raise ValueError(f"unknown classifier: {text}")
    given = vars(forest_parser().parse_args(words[1:]))
    del given["cores"], given["progress"]
    return Options(**given, factor=given["sigma"])  # one option for both


def evaluator(text: str):
    """A function of an example set and options from a string such as: cv --folds 10"""
    words = shlex.split(text)
    p = argparse.ArgumentParser(words[0], add_help=False)
    p.add_argument("-p", "--processor", default=None)
    if words[0] == "cv":
        p.add_argument("-f", "--folds", type=int, default=10)
    elif words[0] == "sv":
        p.add_argument("--ratio", type=float, default=0.66)
    elif words[0] not in validate.EVALUATORS:
        raise ValueError(f"unknown evaluator: {words[0]}")
    args = vars(p.parse_args(words[1:]))
    if args["processor"]:
        q = argparse.ArgumentParser("smote", add_help=False)
        q.add_argument("-p", "--percent", type=int, default=1, dest="times")
        q.add_argument("-k", "--knn", type=int, default=5, dest="k")
        args["processor"] = validate.smote_processor(**vars(q.parse_args(shlex.split(args["processor"])[1:])))
    return lambda ex, options: validate.EVALUATORS[words[0]](ex, options, **args)


def outputs(text: str) -> list[str]:
    """Names of outputs; predictions may name the folder that they go to."""
    names = text.split(",")
    for name in names:
        if name not in ("default", "csv", "predictions", "vi") and not name.startswith("predictions:"):
            raise argparse.ArgumentTypeError(f"unknown output: {name}")
    return names


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("copse")
    top.add_argument("--log-level", default=None, choices=("none", "error", "info", "debug"))
    top.add_argument("--log-file", default=None)
    top.add_argument("--config", default=None, help="a JSON file of log-level and log-file")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, *options, **text):
        p = sub.add_parser(name, **text)
        for flags, kw in options:
            p.add_argument(*flags, **kw)

    data, model = (("-i", "--input"), {"required": True}), (("-m", "--model"), {"required": True})
    classifier, ev = (("-c", "--classifier"), {"default": "rf"}), (("-e", "--evaluator"), {"default": "cv --folds 10"})
    output = (("-o", "--output"), {"default": "default", "type": outputs, "help": "default, csv, predictions, predictions:PATH (written by all tasks) and vi, one or several with commas"})
    command("test", data, classifier, ev, output, help="evaluate a classifier on a data set")
    command("deploy", data, classifier, (("-o", "--output"), {"required": True}), help="train on all rows and save the model")
    command("employ", data, model, output, help="evaluate a saved model")
    command("predict", model, (("-i", "--input"), {"required": True, "help": "comma-separated numbers"}), help="predict one example")
    command("predict-all", data, model, (("-o", "--output"), {"default": None, "help": "a folder for the rows, which all tasks write"}), help="predict the rows of a file")
    command("vi", model, help="variable importance of a saved model")
    command("rex", data, classifier, (("--min-confidence",), {"type": float, "default": 0.7}), (("--min-coverage",), {"type": float, "default": 0.3}), help="extract rules")
    command("experiment", (("-d", "--datasets"), {"required": True}), (("-t", "--iterations"), {"type": int, "default": 10}), classifier, ev, help="all .txt files of a folder")
    command("help", (("topic",), {"nargs": "?"}), help="show help")
    return top


def _logging(args) -> None:
    """What the command line says, then the configuration file, then the defaults."""
    config = {}
    if args.config:
        with open(args.config) as file:
            config = json.load(file)
        if unknown := set(config) - {"log-level", "log-file"}:
            raise ValueError(f"unknown setting: {sorted(unknown)[0]}")
    level = args.log_level or config.get("log-level", "info")
    if level not in LEVELS:
        raise ValueError(f"unknown log level: {level}")
    logging.basicConfig(level=LEVELS[level], filename=args.log_file or config.get("log-file"), force=True)


def _results(results: list[dict], output: str) -> str:
    return validate.as_csv(results) if output == "csv" else validate.as_text(results)


def _importance(model: ForestModel) -> str:
    return "".join(f"{r['feature']},{r['importance']:.6f}\n" for r in model.importance().orderBy(F.desc("importance"), "feature").collect())  # a row for each feature


def main(argv: list[str] | None = None, spark: SparkSession | None = None, emit=None) -> str:
    """Runs a command and returns what it prints; rows of predictions go to emit one by one, where given."""
    args = parser().parse_args(argv)
    _logging(args)
    if args.command == "help":
        return help_of(args.topic)
    spark = spark or SparkSession.builder.appName("copse").getOrCreate()

    def each(model: ForestModel, df) -> str:
        line = lambda r: ",".join([str(r["id"]), r["actual"], r["pred"], *[f"{p['class']}:{p['prob']:.4f}" for p in r["probs"]]]) + "\n"
        rows = map(line, validate.predictions(model, df).orderBy("id").toLocalIterator())  # a partition at a time
        if emit is None:
            return "".join(rows)
        for row in rows:
            emit(row)
        return ""

    def dispatch(names: list[str], results, model, df) -> str:
        """Each output in turn; results() and model() are made once, where an output needs them."""
        made, out = {}, []
        for name in names:
            if name in ("default", "csv"):
                if "results" not in made:
                    made["results"] = results()
                out.append(_results(made["results"], name))
                continue
            made["model"] = made.get("model") or model()
            if name.startswith("predictions:"):
                validate.write_predictions(validate.predictions(made["model"], df), path := name.partition(":")[2])
                out.append(f"saved {path}\n")
            else:
                out.append(_importance(made["model"]) if name == "vi" else each(made["model"], df))
        return "".join(out)

    if args.command == "test":
        ex, options = typed_csv.read(spark, args.input), forest_options(args.classifier)
        log.info("loaded %s", args.input)
        return dispatch(args.output, lambda: evaluator(args.evaluator)(ex, options), lambda: fit(ex, options)[0], ex.df)
    if args.command == "deploy":
        fit(typed_csv.read(spark, args.input), forest_options(args.classifier))[0].save(args.output)
        return f"saved {args.output}\n"
    if args.command == "rex":
        ex = typed_csv.read(spark, args.input)
        model, _ = fit(ex, forest_options(args.classifier))
        rows = extract_rules(model.nodes, ex.df.count(), args.min_confidence, args.min_coverage).orderBy("tree", "node").collect()
        return "".join(f"{r['class']} <- {r['rule']} (confidence {r['confidence']:.3f}, coverage {r['coverage']:.3f})\n" for r in rows)
    if args.command == "experiment":
        files = sorted(f for f in os.listdir(args.datasets) if f.endswith(".txt"))
        out = []
        for i in range(1, args.iterations + 1):
            for f in files:
                out += evaluator(args.evaluator)(typed_csv.read(spark, os.path.join(args.datasets, f)), forest_options(f"{args.classifier} --seed {i}"))
        return validate.as_csv(out)
    model = ForestModel.load(spark, args.model)
    if args.command == "employ":
        df = typed_csv.read(spark, args.input).df
        return dispatch(args.output, lambda: [{"fold": "all"} | validate.evaluate(model, df)], lambda: model, df)
    if args.command == "vi":
        return _importance(model)
    if args.command == "predict":
        one = typed_csv.inline(spark, args.input)
        return model.transform(one.withColumnsRenamed({f"x{i}": f.name for i, f in enumerate(model.features)})).filter("rank = 1").first()["class"] + "\n"
    df = typed_csv.read(spark, args.input).df
    return dispatch([f"predictions:{args.output}" if args.output else "predictions"], None, lambda: model, df)


def help_of(topic: str | None) -> str:
    """All commands, or the options of one (rf: of the classifier)."""
    if topic == "rf":
        return forest_parser().format_help()
    commands = parser()._subparsers._group_actions[0].choices
    if topic is not None and topic not in commands:
        raise ValueError(f"unknown command: {topic}")
    return commands[topic].format_help() if topic else parser().format_help()


def run(argv: list[str] | None = None) -> int:
    """The process: prints, and maps errors of its input to a line and the code 1."""
    try:
        sys.stdout.write(main(argv, emit=sys.stdout.write))
    except (ValueError, FileNotFoundError, AnalysisException) as error:
        sys.stderr.write(f"error: {str(error).splitlines()[0]}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(run())
