"""Random numbers from a hash of a seed and keys, equal on every engine and in every run; ranks and running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType
from pyspark.sql.window import Window

from copse.plans.tables import discard, stored

#: Rows of a piece that one task sorts, about, and the most pieces (a row each in the table of offsets).
PIECE, PIECES = 200_000, 100_000
#: Rows in all that one task may sort for running sums.
ALONE = 100_000


def u(seed, *keys) -> Column:
    """Uniform in [0, 1): the first 32 bits of the MD5 of seed:key:..., over 2 ** 32."""
    text = F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in (seed, *keys)])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def whole_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (ByteType, ShortType, IntegerType, LongType))


def among_equals(df: DataFrame) -> Column:
    """What orders the rows of df with equal draws, under 2 ** 31: the id, or its hash where it is no such whole number."""
    most = F.lit(2147483648)
    after = F.pmod(F.xxhash64("id"), most)
    return F.when((F.col("id") >= 0) & (F.col("id") < most), F.col("id").cast("bigint")).otherwise(after) if whole_number(df, "id") else after


def triangle(x: Column, low: float, high: float, mode: float) -> Column:
    """The value at x of the inverse distribution function of a triangle."""
    cut = (mode - low) / (high - low)
    return F.when(x < cut, low + F.sqrt(x * (high - low) * (mode - low))).otherwise(high - F.sqrt((1 - x) * (high - low) * (high - mode)))


def uniform_between(x: Column, low: float, high: float) -> Column:
    return low + x * (high - low + 1)


def ranked(df: DataFrame, by: Column, ident: str, within: list[str] | None = None, name: str = "rank", ahead: list[str] | None = None) -> DataFrame:
    """df with the rank (from 1) of each row in the order of by, in [0, 1), and ident.

    within: ranks start again for each value; ahead: columns that order before by.  Rows are sorted in
    pieces of about PIECE rows and offset by the counts before, so no task sorts them all.
    """
    within, ahead = within or [], ahead or []
    pieces = max(16, min(PIECES, df.count() // PIECE))
    rows = df.withColumn("_by", by).withColumn("_bucket", F.floor(F.col("_by") * pieces).cast("int"))
    counts = rows.groupBy(*within, *ahead, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over((Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy(*ahead, "_bucket")) - F.col("_n")
    counts = counts.withColumn("_before", before).drop("_n")
    order = Window.partitionBy(*within, *ahead, "_bucket").orderBy("_by", ident)
    rows = rows.withColumn("_own", F.row_number().over(order)).join(counts, [*within, *ahead, "_bucket"])
    return rows.withColumn(name, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_by", "_bucket", "_own", "_before")


def running(df: DataFrame, keys: list[str], by: str, sums: dict[str, str], following: str | None = None) -> DataFrame:
    """df with running sums (new column: summed column) within keys in the order of by; following: the next by.

    More than ALONE rows are dealt by range of keys and by into pieces; sums of the pieces before are added to those within a
    piece.  The table of offsets has a row for each piece and key that meet.
    """
    rows = stored(df, "rows")
    if rows.count() <= ALONE:  # a window of its own for each key
        order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(by)
        return rows.withColumns({new: F.sum(c).over(order) for new, c in sums.items()} | ({following: F.lead(by).over(order)} if following else {}))
    whole, rows = rows, stored(rows.repartitionByRange(*keys, by).withColumn("_piece", F.spark_partition_id()), "pieces")
    discard(whole)
    total = [F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())]
    heads = rows.groupBy(*keys, "_piece").agg(*total, F.min(by).alias("_first"))
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_piece")
    heads = heads.withColumns({f"_s{i}": F.sum(f"_s{i}").over(order) - F.col(f"_s{i}") for i in range(len(sums))} | {"_first": F.lead("_first").over(order)})
    within = Window.partitionBy(*keys, "_piece").orderBy(by)
    rows = rows.withColumns({new: F.sum(c).over(within) for new, c in sums.items()} | ({following: F.lead(by).over(within)} if following else {}))
    rows = rows.join(heads, [*keys, "_piece"])
    rows = rows.withColumns({new: F.col(new) + F.col(f"_s{i}") for i, new in enumerate(sums)} | ({following: F.coalesce(following, "_first")} if following else {}))
    return rows.drop("_piece", "_first", *[f"_s{i}" for i in range(len(sums))])
