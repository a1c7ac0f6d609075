"""The first rows of each key, kept bounded before, during and after the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts of a key whose first rows are found apart and merged.
PARTS = 32


def top(df: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str | None = None, parts: int = PARTS, by: Column | None = None) -> DataFrame:
    """The k first rows of each key by order; rank: a column of their places from 1.

    It merges: the first k of a union are the first k of the firsts of its parts.  Each task keeps k rows of a key before
    the shuffle (a limit that Spark puts below a ranking window), then each part of a key keeps k, then the key,
    so no task gets more than k rows of a key from each task or part.  by: what deals rows into parts, all columns if
    not given; with parts=1 a key isn't dealt.
    """
    part, place = "_part", "_place"
    out = df
    if parts > 1:
        deal = F.xxhash64(by) if by is not None else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        out = out.withColumn(part, F.pmod(deal, F.lit(parts)).cast("int"))
        out = out.withColumn(place, F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order))).filter(F.col(place) <= k).drop(part, place)
    out = out.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(place) <= k)
    return out.withColumn(rank, F.col(place).cast("bigint")).drop(place) if rank else out.drop(place)
