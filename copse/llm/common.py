"""Helpers shared by the operators: words, tables in the shared folder, salted keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Salts of a key; a bitmap of those in use fits into a long.
SALTS = 64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _WRITES = threading.Lock(), {"now": 0, "before": "false"}


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, case aside."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns last; same-named columns of df go."""
    gone = {c.lower() for c in columns}
    return df.select(*[c for c in map(quoted, df.columns) if c.strip("`").lower() not in gone], *[v.alias(k) for k, v in columns.items()])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only a local session (tests) gets a temporary one where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="copse-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def _cleanup(spark: SparkSession):
    """Shuffle files go with the execution that wrote them, while a table is written.

    The setting is the session's: of writes at the same time, the first sets it and the last puts it back.
    """
    with _LOCK:
        if not _WRITES["now"]:
            _WRITES["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _WRITES["now"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITES["now"] -= 1
            if not _WRITES["now"]:
                spark.conf.set(CLEANUP, _WRITES["before"])


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
    with _cleanup(spark):  # nothing reads the shuffle files of this execution again
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that stored() wrote and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def salt(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def salt_bit(name: str) -> Column:
    return F.expr(f"shiftleft(1L, {quoted(name)})")


def salts_in(name: str) -> Column:
    """A row for each salt that the bitmap has."""
    return F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> (shiftrightunsigned({quoted(name)}, i) & 1L) = 1L)"))


def pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that the optimizer neither inlines nor computes again for a filter above."""
    return df.withColumn(name, F.explode(F.array(value)))


#: Bits of a filter of keys: LEAST_BITS for each key, to a power of two, at most MOST_BITS (16 MB, broadcast).
LEAST_BITS, MOST_BITS = 16, 1 << 27
_BUCKET = 32768  # bits of a row of the filter: those of bitmap_construct_agg


def perhaps(df: DataFrame, key: Column, keys: DataFrame, n: int, name: str) -> DataFrame:
    """df with name: whether key may be among the n values of the one column of keys.  True for all that are, and few others.

    Values are hashed to bits of a bitmap of a fixed size, which is broadcast; with very many keys it is true for all.
    """
    bits = _BUCKET
    while bits < min(MOST_BITS, LEAST_BITS * n):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    own = keys.select(place(F.col(quoted(keys.columns[0]))).alias("h")).select(F.bitmap_bucket_number("h").alias("x_bucket"), F.bitmap_bit_position("h").alias("at"))
    bitmap = F.broadcast(own.groupBy("x_bucket").agg(F.bitmap_construct_agg("at").alias("x_bitmap")))  # MOST_BITS / _BUCKET rows of 4 KB at most
    bucket, at = fresh(df, "x_bucket_of", "x_at_of")
    rows = df.withColumns({bucket: F.bitmap_bucket_number(place(key)), at: F.bitmap_bit_position(place(key))})
    rows = rows.join(bitmap, rows[bucket] == bitmap["x_bucket"], "left")
    byte = F.conv(F.hex(F.substring(bitmap["x_bitmap"], (F.floor(rows[at] / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2.0), rows[at] % 8)), F.lit(2)) == 1, F.lit(False))
    return rows.select(*[rows[quoted(c)] for c in df.columns], found.alias(name))


def perhaps_in(df: DataFrame, key: Column, keys: DataFrame, n: int) -> DataFrame:
    """The rows of df for which perhaps() is true."""
    (name,) = fresh(df, "x_perhaps")
    return perhaps(df, key, keys, n, name).filter(F.col(name)).select(*map(quoted, df.columns))
