"""Shards of near-equal bytes by histogram sort."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, quoted, stored

#: A key is a pair of numbers of KEY_BITS bits: of the text, then of the id.
KEY_BITS = 60
#: Each round counts below 2 ** ROUND_BITS probes in each open interval.
ROUND_BITS = 10
#: Rows of the table of slot offsets, at most.
OFFSETS = 1 << 18


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def key_columns(text: Column, ident: Column) -> tuple[Column, Column]:
    top = 64 - KEY_BITS
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), top), F.shiftrightunsigned(F.xxhash64(ident), top)


def splitters(keys: DataFrame, n_shards: int, tolerance: float, of_group: float = 0.0) -> list[tuple[int, int]]:
    """n_shards - 1 lower bounds (h, k) of the shards after the first, in order.

    keys has h, k and size.  Round by round the exact bytes below evenly spaced probes are counted in
    the intervals that still hold a target.  An interval closes when a probe is within tolerance (a
    share of a shard) of its target, or when one row or one key is left in it; then the nearer edge
    counts.  The rows of one h are a group of equal texts: its nearer edge counts too if it is within of_group
    (a share of a shard), or within one row of the group, of the target.  The driver gets (n_shards - 1) * 2 ** ROUND_BITS counts a round, at most.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if total == 0:
        return [(1 << KEY_BITS, 0)] * (n_shards - 1)
    near, out = tolerance * total / n_shards, {}
    parts = KEY_BITS // ROUND_BITS
    open_: dict[tuple[int, int], list[int]] = {(0, 0): list(range(1, n_shards))}  # interval -> its targets
    below = {(0, 0): 0}
    for depth in range(2 * parts):
        in_h = depth < parts
        level = depth if in_h else depth - parts
        shift = KEY_BITS - ROUND_BITS * (level + 1)
        mask = (1 << ROUND_BITS) - 1
        if in_h:
            a, b = F.shiftrightunsigned("h", shift + ROUND_BITS), F.lit(0).cast("long")
            rows = keys if depth == 0 else keys.filter(a.isin([x for x, _ in open_]))
        else:
            a, b = F.col("h"), F.shiftrightunsigned("k", shift + ROUND_BITS)
            rows = keys.filter(a.isin(sorted({x for x, _ in open_})))
            if level:
                rows = rows.filter(F.struct(a.alias("a"), b.alias("b")).isin([F.struct(F.lit(x).cast("long").alias("a"), F.lit(y).cast("long").alias("b")) for x, y in open_]))
        digit = F.shiftrightunsigned("h" if in_h else "k", shift).bitwiseAND(F.lit(mask))
        counts: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}
        for x, y, d, size, n in rows.groupBy(a.alias("a"), b.alias("b"), digit.alias("d")).agg(F.sum("size"), F.count(F.lit(1))).collect():
            counts.setdefault((x, y), {})[d] = (size, n)
        next_open, next_below = {}, {}
        for at, targets in open_.items():
            bins, upto, edges = counts.get(at, {}), below[at], []
            for d in sorted(bins):
                edges.append((upto, upto + bins[d][0], d, bins[d][1]))
                upto += bins[d][0]
            for i in targets:
                goal = total * i / n_shards
                low, high, d, n = edges[max(0, bisect_left([e[1] for e in edges], goal))] if edges and edges[-1][1] >= goal else edges[-1]
                left = goal - low <= high - goal
                x, y = ((at[0] << ROUND_BITS | d) if in_h else at[0]), (0 if in_h else at[1] << ROUND_BITS | d)
                group = max(of_group * total / n_shards, (high - low) / n) if depth == parts - 1 else 0
                if min(goal - low, high - goal) <= max(near, group) or n == 1 or depth == 2 * parts - 1:
                    step = 0 if left else 1
                    out[i] = (x + step << shift, 0) if in_h else (x, y + step << shift)
                else:
                    next_open.setdefault((x, y), []).append(i)
                    next_below[x, y] = low
        open_, below = next_open, next_below
        if not open_:
            break
    return [out[i] for i in sorted(out)]


def shard_of(h: Column, k: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many of the sorted bounds are at or below the key: a binary search of nested conditions."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        x, y = (F.lit(v).cast("long") for v in bounds[mid])
        return F.when((h > x) | ((h == x) & (k >= y)), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(bounds)).cast("int")


def histogram_shards(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.01, of_group: float = 0.03) -> DataFrame:
    """df with size, shard (0 to n_shards - 1) and slot (0, 1, ... in each shard).

    Rows are in the order of a hash of the text and then of the id; shards are runs of that order with
    near-equal bytes, exact to tolerance of a shard or half a row; an edge moves by up to of_group of a
    shard, or by one row, to keep equal texts in one shard.  Only larger groups part, between ids.  After the rounds of counting, the rows
    are exchanged once, by shard and a part of the hash of the id, so no shard waits for one task.

    Nulls: a null text has the size 16; null ids have one hash.  Rows that repeat an id and a text have
    the same key and stay together.  Columns of df named size, shard or slot are replaced.  With fewer
    rows than shards some shards are empty; an empty df gives an empty result.
    """
    h, k, part, first = fresh(df, "x_h", "x_k", "x_part", "x_first")
    text, ident = F.col(quoted(text_col)), F.col(quoted(id_col))
    of_text, of_id = key_columns(text, ident)
    keys = stored(df.select(of_text.alias("h"), of_id.alias("k"), row_size(text).alias("size")), "keys")
    bounds = splitters(keys, n_shards, tolerance, of_group)
    per_shard = keys.count() // max(1, n_shards)
    bits = 6
    while (1 << bits) * 50_000 < per_shard and (2 << bits) * n_shards <= OFFSETS:
        bits += 1
    part_of = lambda c: F.shiftrightunsigned(c, KEY_BITS - bits).cast("int")

    counts = keys.groupBy(shard_of(F.col("h"), F.col("k"), bounds).alias("shard"), part_of(F.col("k")).alias(part)).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("shard", part, (F.sum("n").over(Window.partitionBy("shard").orderBy(part)) - F.col("n")).alias(first))
    taken = [c for c in df.columns if c.lower() in ("size", "shard", "slot") and c not in (id_col, text_col)]
    rows = df.withColumns({h: of_text, k: of_id}).drop(*taken)
    rows = rows.withColumns({"size": row_size(text), "shard": shard_of(F.col(h), F.col(k), bounds), part: part_of(F.col(k))})
    order = Window.partitionBy("shard", part).orderBy(k, h, F.col(quoted(id_col)))
    rows = rows.withColumn("slot", F.row_number().over(order))
    rows = rows.join(F.broadcast(offsets), ["shard", part])  # at most OFFSETS rows
    plain = [quoted(c) for c in df.columns if c not in taken]
    return rows.select(*plain, "size", "shard", (F.col("slot") - 1 + F.col(first)).cast("long").alias("slot"))
