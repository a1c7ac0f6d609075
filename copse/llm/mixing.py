"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, quoted, stored, word_count

#: Documents of a leaf, and residuals of a node, of the reduction tree, on average.
FAN_IN = 2048


def ranked(sources: DataFrame, name: str) -> DataFrame:
    """sources (one row each) with rank: from 0 in the order of code points, null last.

    The rows are dealt by range; ranks are offsets of the ranges plus ranks within them.
    """
    dealt = sources.repartitionByRange(F.asc_nulls_last(quoted(name))).withColumn("x_part", F.spark_partition_id())
    dealt = stored(dealt, "sources")
    before, offsets = 0, []
    for part, n in sorted(map(tuple, dealt.groupBy("x_part").count().collect())):  # one row a partition
        offsets += [F.lit(part), F.lit(before).cast("long")]
        before += n
    if not offsets:
        return dealt.withColumn("rank", F.lit(0).cast("long")).drop("x_part")
    within = F.row_number().over(Window.partitionBy("x_part").orderBy(F.asc_nulls_last(quoted(name))))
    return dealt.withColumn("rank", F.element_at(F.create_map(*offsets), F.col("x_part")) + within - 1).drop("x_part")


def source_targets(sizes: DataFrame, source_col: str, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target for the rows (source, x_size, x_n) of sizes.

    Targets are in proportion to the weights and sum to share of all sizes, but stop at most times
    their source's size; the excess is shared again until none is above (or all are at the stop).
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = sizes.groupBy(source_col).agg(F.sum(F.col("x_size") * F.col("x_n")).alias("source_size"))
    per = stored(ranked(per, source_col).withColumn("x_w", weight), "weights")
    total = float(per.agg(F.sum("source_size")).first()[0] or 0) * share
    # Sources with size * most / weight up to a level stop; the level rises until none else is above it.
    limit = F.col("source_size") * most
    level = -1.0
    while True:
        at_stop = limit / F.col("x_w") <= level
        fixed, free = per.agg(F.sum(F.when(at_stop, limit)), F.sum(F.when(~at_stop, F.col("x_w")))).first()
        rate = (total - (fixed or 0.0)) / free if free else level
        if not free or rate <= level:
            break
        if per.filter(~at_stop & (limit / F.col("x_w") < rate)).isEmpty():
            level = rate
            break
        level = rate
    return per.select(source_col, "source_size", F.least(limit, F.col("x_w") * max(level, 0.0)).alias("target"))


def _draw(seed: int, *key) -> float:
    return int.from_bytes(hashlib.blake2b(repr((seed, *key)).encode(), digest_size=7).digest(), "big") / 2**56


def pivot(key: list, mass: np.ndarray, p: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Rounds p in order; the index that stays fractional, or -1.

    Two fractional probabilities meet; mass goes from one to the other so that the sum of mass * p
    stays, one of them becomes 0 or 1, and each keeps its expectation.
    """
    p, at = p.astype(float).tolist(), -1
    for i, a in enumerate(mass.tolist()):
        if not 0 < p[i] < 1:
            continue
        if at < 0:
            at = i
            continue
        b = mass[at]
        up, down = min(1 - p[at], p[i] * a / b), min(p[at], (1 - p[i]) * a / b)
        move = up if _draw(seed, *key[i]) * (up + down) < down else -down
        x, y = p[at] + move, p[i] - move * b / a
        x, y = (0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x), (0.0 if y < 1e-9 else 1.0 if y > 1 - 1e-9 else y)
        p[at], p[i] = x, y
        at = at if 0 < x < 1 else i if 0 < y < 1 else -1
    return np.array(p), at


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per row of df: id, source, x_hash (of the text), size, source_size, target, copies, taken.

    A document of a source with target / source_size = c + p takes c copies and, with probability p, one
    more.  Leaves of about FAN_IN documents of a source round among themselves and leave one fractional
    document each; these meet in the nodes of a tree, until one is left per source and drawn alone.  So a
    source's taken words differ from its target by less than one document (or one set of repeated rows), but
    for rounding errors.  All draws are hashes of the seed, the id and the text: runs agree, whatever the partitions.

    Nulls: a null text has size 0; null sources are one source, ranked last; null ids are told apart by
    text.  Documents without words take no words.  Rows that repeat id, source and text share one draw.
    An empty df gives an empty result.
    """
    who, src = quoted(id_col), quoted(source_col)
    text = F.col(quoted(text_col))
    rows = df.select(F.col(who).alias("x_id"), F.col(src).alias("x_src"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("x_hash"), word_count(text).alias("x_size"))
    rows = stored(rows.groupBy("x_id", "x_src", "x_hash", "x_size").agg(F.count(F.lit(1)).alias("x_n")), "sizes")
    targets = stored(source_targets(rows, "x_src", weights, share, most), "targets")
    n_leaves = max(1, rows.count() // FAN_IN)
    same = [rows["x_src"].eqNullSafe(targets["x_src"])]
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = rows.join(targets, same).drop(targets["x_src"])
    units = units.withColumn("x_ratio", ratio).withColumn("x_base", F.floor("x_ratio"))
    units = units.withColumn("x_p", F.when(F.col("x_size") > 0, F.col("x_ratio") - F.col("x_base")).otherwise(F.lit(0.0)))
    units = units.withColumn("x_node", F.pmod(F.xxhash64("x_id", "x_hash"), F.lit(n_leaves)))
    kept = ["x_id", "x_src", "x_hash", "x_size", "x_n", "source_size", "target", "x_base", "x_p", "x_node"]
    schema = units.select(*kept).schema

    def of_node(last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["x_size", "x_hash", "x_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            key = [(None if pd.isna(i) else int(i) if isinstance(i, (int, np.integer, float)) else str(i), int(h)) for i, h in zip(pdf["x_id"], pdf["x_hash"], strict=True)]
            p, left = pivot(key, (pdf["x_size"] * pdf["x_n"]).to_numpy(float), pdf["x_p"].to_numpy(), seed)
            if last and left >= 0:
                p[left] = float(_draw(seed + 1, *key[left]) < p[left])
            pdf["x_p"] = p
            return pdf

        return run

    done, nodes = [], n_leaves
    while True:
        last = nodes == 1
        # A leaf and a node hold FAN_IN rows or so, whatever the source.
        out = stored(units.select(*kept).groupBy("x_src", "x_node").applyInPandas(of_node(last), schema), "rounded")
        open_ = (F.col("x_p") > 0) & (F.col("x_p") < 1)
        done.append(out.filter(~open_))
        if last:
            break
        nodes = -(-nodes // FAN_IN)
        units = out.filter(open_).withColumn("x_node", F.col("x_node") % nodes)
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    copies = (F.col("x_base") + F.col("x_p")).cast("long")
    result = result.withColumn("x_each", F.explode(F.array_repeat(F.lit(0), F.col("x_n").cast("int"))))
    return result.select(
        F.col("x_id").alias(id_col), F.col("x_src").alias(source_col), "x_hash", F.col("x_size").alias("size"), "source_size", "target",
        copies.alias("copies"), (copies * F.col("x_size")).alias("taken"),
    )


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of df as many times as mix() takes it, with df's columns."""
    decided = mix(df, id_col, text_col, source_col, **options).filter("copies > 0")
    decided = decided.select(F.col(quoted(id_col)).alias("x_id"), F.col(quoted(source_col)).alias("x_src"), "x_hash", F.col("copies").alias("x_times")).distinct()
    h, copies = fresh(df, "x_text_hash", "x_copies")
    rows = df.withColumn(h, F.xxhash64(F.coalesce(F.col(quoted(text_col)), F.lit(""))))
    on = rows[quoted(id_col)].eqNullSafe(decided["x_id"]) & rows[quoted(source_col)].eqNullSafe(decided["x_src"]) & (rows[h] == decided["x_hash"])
    out = rows.join(decided, on).withColumn(copies, F.explode(F.array_repeat(F.lit(0), decided["x_times"].cast("int"))))
    return out.select(*[rows[quoted(c)] for c in df.columns])
