"""Folds by user functions: what rows of a key say is added up in tasks, and the parts are merged after one shuffle."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a task has at hand before it passes their parts on.
AT_HAND = 50_000


@dataclass(frozen=True)
class Fold:
    """start() gives an empty part; add(part, value) and merge(part, part) give the part after; result(part) a tuple of schema.

    A value is a tuple of what is folded.  Parts are pickled between tasks and should stay small.
    """

    start: Callable
    add: Callable
    merge: Callable
    result: Callable
    schema: str


def _parts(keys: int, fold: Fold):
    def run(batches):
        at = {}

        def out():
            columns = [pa.array([k[i] for k in at], kinds[i]) for i in range(keys)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(p) for p in at.values()], pa.binary())], [*names, "_part"])

        for batch in batches:
            names, kinds = batch.schema.names[:keys], [batch.schema.field(i).type for i in range(keys)]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = row[:keys]
                at[key] = fold.add(at[key] if key in at else fold.start(), row[keys:])
            if len(at) >= AT_HAND:
                yield out()
                at = {}
        if at:
            yield out()

    return run


def _whole(keys: int, fold: Fold, schema: pa.Schema):
    def run(batches):
        """Rows sorted by key: a key's parts follow each other."""
        key = part = None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = pickle.loads(row[keys])
                if part is not None and row[:keys] == key:
                    part = fold.merge(part, own)
                    continue
                if part is not None:
                    done.append((*key, *fold.result(part)))
                key, part = row[:keys], own
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema=schema)
        if part is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, *fold.result(part)), strict=True))], schema=schema)

    return run


def folded(df: DataFrame, keys: list[str], values: list[str | Column], fold: Fold) -> DataFrame:
    """keys and the columns of the fold's schema: its result over the values of all rows of each key, in any order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    rows = df.select(*keys, *[(F.col(v) if isinstance(v, str) else v).alias(f"_v{i}") for i, v in enumerate(values)])
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    parts = rows.mapInArrow(_parts(len(keys), fold), f"{kinds}, _part binary").repartition(*keys).sortWithinPartitions(*keys)
    schema = f"{kinds}, {fold.schema}"
    return parts.mapInArrow(_whole(len(keys), fold, to_arrow_schema(StructType.fromDDL(schema))), schema)


def _count(part: dict, value: tuple) -> dict:
    part[value[0]] = part.get(value[0], 0) + 1
    return part


def _sum(a: dict, b: dict) -> dict:
    for k, n in b.items():
        a[k] = a.get(k, 0) + n
    return a


def majority(trees: int) -> Fold:
    """pred and prob of votes (pred): the most frequent class, the smallest of equals."""

    def result(part: dict) -> tuple:
        pred = min(part, key=lambda c: (-part[c], c))
        return pred, part[pred] / trees

    return Fold(dict, _count, _sum, result, "pred string, prob double")


def mean(name: str) -> Fold:
    """The mean of a number, and of how many."""
    return Fold(lambda: (0.0, 0), lambda p, v: (p[0] + v[0], p[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda p: (p[0] / p[1], p[1]), f"{name} double, n long")


def total(name: str) -> Fold:
    return Fold(float, lambda p, v: p + v[0], lambda a, b: a + b, lambda p: (p,), f"{name} double")
