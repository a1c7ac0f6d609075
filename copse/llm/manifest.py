"""Merkle manifest of a dataset: DuckDB hashes aligned buckets of leaves on the executors, Spark combines their roots."""

from __future__ import annotations

from functools import reduce

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from copse.plans.tables import small

from .common import quoted, stored

#: Children of a node, and levels of a bucket: a bucket has FAN ** DEEP leaves at most.
FAN, DEEP = 3, 6
#: Leaves that one statement takes at a time, about.
AT_ONCE = 20_000
STEP = "struct<left: string, right: string>"
ITEM = "struct<pos: bigint, node: string, payload: binary>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """- for null, else the bytes of UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


# The engine of a block: levels of all buckets at hand in one statement.


def _levels_sql(fan: int, deep: int) -> list[str]:
    """Tables l0 (the leaves) to l{deep}; buckets of fewer levels stay as they are once they are done."""
    ctes = ["l0 AS (SELECT bucket, pos, levels, node FROM leaves)"]
    for k in range(deep):
        up = f"SELECT bucket, pos // {fan} AS pos, any_value(levels) AS levels, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM l{k} WHERE levels > {k} GROUP BY bucket, pos // {fan}"
        ctes.append(f"l{k + 1} AS MATERIALIZED ({up} UNION ALL SELECT bucket, pos, levels, node FROM l{k} WHERE levels <= {k})")
    return ctes


def roots_sql(fan: int, deep: int) -> str:
    return f"WITH {', '.join(_levels_sql(fan, deep))} SELECT bucket, node FROM l{deep} ORDER BY bucket"


def paths_sql(fan: int, deep: int) -> str:
    """leaf (its place among those at hand) and path: what stands left and right of its node in the run of each level."""
    ctes = [*_levels_sql(fan, deep), "p0 AS (SELECT bucket, pos, leaf, []::STRUCT(\"left\" VARCHAR, \"right\" VARCHAR)[] AS path FROM leaves)"]
    for k in range(deep):
        ctes.append(f"r{k} AS MATERIALIZED (SELECT bucket, pos // {fan} AS run, list(node ORDER BY pos) AS nodes FROM l{k} WHERE levels > {k} GROUP BY ALL)")
        step = f"{{'left': array_to_string(nodes[1:pos % {fan}], ''), 'right': array_to_string(nodes[pos % {fan} + 2:], '')}}"
        ctes.append(f"p{k + 1} AS MATERIALIZED (SELECT p.bucket, pos // {fan} AS pos, leaf, CASE WHEN nodes IS NULL THEN path ELSE list_append(path, {step}) END AS path FROM p{k} p LEFT JOIN r{k} r ON p.bucket = r.bucket AND p.pos // {fan} = r.run)")
    return f"WITH {', '.join(ctes)} SELECT path FROM p{deep} ORDER BY leaf"


def _engine() -> duckdb.DuckDBPyConnection:
    """In memory, one thread, no folder to spill to."""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


def _groups(batches, items: str):
    """The batches in slices of whole buckets with AT_ONCE leaves or, if one bucket has more, that bucket."""
    for batch in batches:
        sizes, low = batch.column(items).value_lengths().to_pylist(), 0
        while low < len(sizes):
            high, n = low + 1, sizes[low]
            while high < len(sizes) and n + sizes[high] <= AT_ONCE:
                n, high = n + sizes[high], high + 1
            yield batch.slice(low, high - low)
            low = high


def _leaves(part: pa.RecordBatch, fan: int, deep: int) -> tuple[pa.Table, pa.StructArray, pa.Array]:
    """The leaves of buckets (items, levels) as a table with places inside of their buckets."""
    lists = part.column("items")
    flat, of = lists.flatten(), pc.list_parent_indices(lists)
    at = pc.subtract(flat.field("pos"), pc.multiply(part.column("bucket").take(of), fan**deep))
    return pa.table({"bucket": of, "pos": at, "levels": part.column("levels").take(of), "node": flat.field("node"), "leaf": pa.array(range(len(flat)), pa.int64())}), flat, of


def _with_roots(fan: int, deep: int):
    def run(batches):
        con, sql = _engine(), roots_sql(fan, deep)
        for part in _groups(batches, "items"):
            con.register("leaves", _leaves(part, fan, deep)[0])
            nodes = con.sql(sql).to_arrow_table().column("node").combine_chunks().cast(pa.string())
            con.unregister("leaves")
            yield pa.RecordBatch.from_arrays([*part.columns, nodes], [*part.schema.names, "root"])

    return run


def _with_paths(fan: int, deep: int):
    """A row for each leaf: key, pos, node, payload, inner (its path inside of the bucket) and what the bucket carries."""

    def run(batches):
        con, sql = _engine(), paths_sql(fan, deep)
        for part in _groups(batches, "items"):
            leaves, flat, of = _leaves(part, fan, deep)
            con.register("leaves", leaves)
            inner = con.sql(sql).to_arrow_table().column("path").combine_chunks()
            con.unregister("leaves")
            inner = inner.cast(pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
            yield pa.RecordBatch.from_arrays([part.column("key").take(of), flat.field("pos"), flat.field("node"), flat.field("payload"), inner, part.column("outer").take(of), part.column("carried").take(of)], ["key", "pos", "node", "payload", "inner", "outer", "carried"])

    return run


# Trees of all keys.


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (key, ...) with pos, from 0 within the key in the order of the columns, and total.

    Rows are dealt by range of key and order, so that a large key spreads; rows of a piece have rising numbers.
    """
    local = stored(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("at", F.monotonically_increasing_id()), "numbered")
    piece = F.shiftright("at", 33)
    heads = local.groupBy("key", piece.alias("piece")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("key")  # a row for each piece
    heads = stored(heads.select("key", "piece", (F.sum("n").over(of.orderBy("piece")) - F.col("n") - F.col("first")).alias("less"), F.sum("n").over(of).alias("total")), "heads")
    out = local.withColumn("piece", piece).join(small(heads, heads.count()), ["key", "piece"])
    return out.withColumn("pos", F.col("at") + F.col("less")).drop("at", "piece", "less")


def bucketed(items: DataFrame, fan: int, deep: int) -> DataFrame:
    """Items (key, pos, total, node, payload) in buckets: key, bucket, levels, buckets (of the key), items and root."""
    most = fan**deep
    levels = F.lit(deep)
    for k in reversed(range(deep)):
        levels = F.when(F.col("total") <= fan**k, k).otherwise(levels)
    own = items.select("key", F.floor(F.col("pos") / most).alias("bucket"), "total", F.struct("pos", "node", "payload").alias("item"))
    grouped = own.groupBy("key", "bucket").agg(F.first("total").alias("total"), F.array_sort(F.collect_list("item")).alias("items"))  # fan ** deep items at most
    rows = grouped.select("key", "bucket", levels.alias("levels"), F.ceil(F.col("total") / most).alias("buckets"), F.col("items").cast(f"array<{ITEM}>").alias("items"))
    return rows.mapInArrow(_with_roots(fan, deep), f"key string, bucket long, levels int, buckets long, items array<{ITEM}>, root string")


def climbed(items: DataFrame, fan: int, deep: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of stored buckets, each of the roots of the one before, and the top node of each key."""
    rounds, tops = [], []
    while True:
        rounds.append(stored(bucketed(items, fan, deep), "buckets"))
        tops.append(rounds[-1].filter("buckets = 1").select("key", F.col("root").alias("top")))
        more = rounds[-1].filter("buckets > 1")
        if more.isEmpty():
            return rounds, reduce(DataFrame.unionByName, tops)
        items = more.select("key", F.col("bucket").alias("pos"), F.col("buckets").alias("total"), F.col("root").alias("node"), F.lit(None).cast("binary").alias("payload"))


def descended(rounds: list[DataFrame], above: DataFrame, fan: int, deep: int) -> DataFrame:
    """key, pos, node, payload, path and carried of all leaves; above: outer and carried (a struct) of each key.

    From the last round down, the path of a bucket among the others goes on in the paths of its leaves.
    """
    kind, found = above.schema["carried"].dataType.simpleString(), None
    for b in reversed(rounds):
        rows = b.filter("buckets = 1").join(above, "key").select("key", "bucket", "levels", "items", "outer", "carried")
        if found is not None:
            outer = found.select("key", F.col("pos").alias("bucket"), F.col("path").alias("outer"), "carried")
            rows = rows.unionByName(b.filter("buckets > 1").join(outer, ["key", "bucket"]).select(*rows.columns))
        flat = rows.mapInArrow(_with_paths(fan, deep), f"key string, pos long, node string, payload binary, inner array<{STEP}>, outer array<{STEP}>, carried {kind}")
        found = flat.select("key", "pos", "node", "payload", F.concat("inner", "outer").alias("path"), "carried")
    return found


def manifest(df: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), altered: dict[str, Column] | None = None, alters: Column | None = None, fan: int = FAN, deep: int = DEEP) -> DataFrame:
    """id, leaf, subroot, root, proof (a path: what stands left and right of the node, level by level), altered leaf or null.

    The first column is the id, the second the source.  A leaf is the digest of the columns.  The leaves of a source,
    by id, and then the roots of the sources, null first, form trees: each fan neighbours become the digest of their own,
    the last ones of a level too, however few, while there are several.  altered: other values of columns for rows where
    alters is true; their leaves show what a check of the manifest would find.

    Leaves are dealt by range of (source, id), get their places, and go to aligned buckets of fan ** deep, a row
    each.  DuckDB makes the levels of whole buckets on the executors; bucket roots are leaves of the next round,
    and the sources' tops those of the outer tree.  Paths come back down by joins on (source, bucket), a row for each bucket.

    Nulls have their own mark; a null id comes first in its source and isn't altered.  Rows with an equal id go by
    their leaves; rows that repeat all columns are leaves of their own with the same values, each with its own path.  An empty df gives an empty result.
    Other columns don't matter.
    """
    cols = {c: F.col(quoted(c)) for c in columns}
    leaf = digest(*[field(v) for v in cols.values()])
    other = digest(*[field((altered or {}).get(c, v)) for c, v in cols.items()])
    wrong = F.when(F.coalesce(alters if alters is not None else F.lit(False), F.lit(False)), other)
    source = cols[columns[1]].cast("string")
    key = F.coalesce(F.concat(F.lit("1"), source), F.lit("0"))
    ident = df.schema[columns[0]].dataType.simpleString()
    rows = df.select(key.alias("key"), cols[columns[0]].alias("id"), leaf.alias("node"), wrong.alias("wrong"))
    rows = rows.withColumn("wrong", F.when(F.col("wrong") != F.col("node"), F.col("wrong")))
    items = numbered(rows, ["id", "node"])
    carry = F.to_json(F.struct("id", "wrong"), {"ignoreNullFields": "false"}).cast("binary").alias("payload")
    rounds, tops = climbed(items.select("key", "pos", "total", "node", carry), fan, deep)

    outer = numbered(tops.select(F.lit("").alias("key"), F.col("key").alias("of"), F.col("top").alias("node")), ["of"])
    outer_rounds, root = climbed(outer.select("key", "pos", "total", "node", F.col("of").cast("binary").alias("payload")), fan, deep)
    whole = root.select("key", F.array().cast(f"array<{STEP}>").alias("outer"), F.struct(F.col("top").alias("root")).alias("carried"))
    sources = descended(outer_rounds, whole, fan, deep)
    above = sources.select(F.col("payload").cast("string").alias("key"), F.col("path").alias("outer"), F.struct(F.col("node").alias("subroot"), F.col("carried.root").alias("root")).alias("carried"))
    found = descended(rounds, stored(above, "above"), fan, deep)
    own = F.from_json(F.col("payload").cast("string"), f"id {ident}, wrong string")
    return found.withColumn("own", own).select(F.col("own.id").alias("id"), F.col("node").alias("leaf"), "carried.subroot", "carried.root", F.col("path").alias("proof"), F.col("own.wrong").alias("altered"))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf gives with its path."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: F.array(s["left"], s["right"]))), ""), 256)


def verified(df: DataFrame, altered: dict[str, Column], alters: Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), fan: int = FAN, deep: int = DEEP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified: each row against the manifest, some altered first."""
    found = manifest(df, columns, altered, alters, fan, deep)
    found = found.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("proof")))
    return found.select(F.col("id").alias(columns[0]), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
