"""SimHash near-duplicates: fingerprints in Gray orders, under a hierarchical index of shared bit patterns."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, quoted, salt, salt_bit, salts_in, stored
from .jaccard import components

#: Words of a shingle, and bits in which linked fingerprints differ at most.
SHINGLE, DIFFER = 4, 4
#: Rows of a block (one index), children of a node, and rows that search a block at once.
BLOCK, FAN, ASKED = 4096, 16, 512
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """Bit by bit the majority of the hashes of the k-word shingles, repeats included; A-Z count as a-z."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - k + 1)
    hashes = np.fromiter([_hash(joined[s:e]) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], np.uint64, n)
    ones = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):
        part = hashes[low : low + (1 << 16)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(len(part), 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _prints(k: int):
    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = np.array([fingerprint(t, k) for t in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64))], ["id", "print"])

    return run


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """id and print (a long, of 64 bits) of each row."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("binary")).mapInArrow(_prints(k), f"id {kind}, print long")


def segments(differ: int) -> list[tuple[int, int]]:
    """Start and width of differ + 1 segments of 64 bits: of two fingerprints that link, one at least is equal."""
    edges = [64 * i // (differ + 1) for i in range(differ + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def gray_rank(x: Column) -> Column:
    """The place of a 64-bit pattern in Gray order, as a long that sorts by it."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def gray_orders(prints: DataFrame, differ: int = DIFFER) -> DataFrame:
    """Each print in each order: order, rank and print.  Order i sorts by Gray rank with segment i first."""
    turned = [F.struct(F.lit(i).alias("order"), gray_rank(F.shiftleft("print", a).bitwiseOR(F.shiftrightunsigned("print", 64 - a))).alias("rank")) for i, (a, _) in enumerate(segments(differ))]
    return prints.select(F.explode(F.array(*turned)).alias("o"), "print").select("o.order", "o.rank", "print")


def _turned(prints: np.ndarray, shift: int) -> np.ndarray:
    s = np.uint64(shift)
    return prints if not shift else (prints << s) | (prints >> np.uint64(64 - shift))


def _tops(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the first bits in Gray order: it rises along sorted rows."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return (x >> np.uint64(64 - width)).astype(np.int64)


def index(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from the root down, each of a node's own mask, its bits, and the mask with those of the nodes above.

    x is in Gray order, so neighbours share most bits.  What all children of a node share moves up to it; a child
    keeps the rest.
    """
    levels, mask, bits = [], np.full(len(x), ALL), x
    while True:
        if len(x) == 1 or len(mask) == 1:
            levels.append((mask, bits & mask, mask))
            break
        cuts = np.arange(0, len(mask), FAN)
        both = np.bitwise_and.reduceat(mask, cuts) & ~(np.bitwise_or.reduceat(bits, cuts) ^ np.bitwise_and.reduceat(bits, cuts))
        above = np.repeat(both, FAN)[: len(mask)]
        levels.append((mask & ~above, bits & mask & ~above, mask))
        mask, bits = both, np.bitwise_and.reduceat(bits, cuts) & both
    return levels[::-1]


def search(levels, asked: np.ndarray, low: np.ndarray, high: np.ndarray, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, row) of the patterns asked and rows low[i] to high[i] that differ in few bits.

    A node adds the differences of its own pattern to those of the nodes above; past the bound, its group goes.
    """
    depth = len(levels) - 1
    i, node, sum_ = np.arange(len(asked)), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.uint8)
    for d, (mask, bits, _) in enumerate(levels):
        if d:
            node = (node[:, None] * FAN + np.arange(FAN)).ravel()
            i, sum_ = np.repeat(i, FAN), np.repeat(sum_, FAN)
            ok = node < len(mask)
            i, node, sum_ = i[ok], node[ok], sum_[ok]
        span = FAN ** (depth - d)
        ok = (node * span < high[i]) & ((node + 1) * span > low[i])
        i, node, sum_ = i[ok], node[ok], sum_[ok]
        sum_ = sum_ + np.bitwise_count((asked[i] ^ bits[node]) & mask[node])
        ok = sum_ <= differ
        i, node, sum_ = i[ok], node[ok], sum_[ok]
    return i, node


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a and b: the least place of each component so far."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != (up := label[label])).any():
            label = up


def _links(prints: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """A spanning star of each component: links of the same components as all pairs."""
    at = np.flatnonzero(label != np.arange(len(label)))
    prints = prints.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(prints[label[at]]), pa.array(prints[at])], ["a", "b"])


def _linked(a: np.ndarray, b: np.ndarray | None, order: int, differ: int) -> pa.RecordBatch:
    """Links within the block of prints a, or between the blocks a and b, under equal tops of the order."""
    shift, width = segments(differ)[order]
    x = _turned(a, shift)
    tops = _tops(x, width)
    rows = x if b is None else _turned(b, shift)
    of = tops if b is None else _tops(rows, width)
    low = np.arange(1, len(x) + 1) if b is None else np.searchsorted(of, tops, "left")
    high = np.searchsorted(of, tops, "right")
    levels, first = index(rows), 0 if b is None else len(a)
    label = np.arange(len(a) + (0 if b is None else len(b)))
    some = np.flatnonzero(low < high)
    for at in range(0, len(some), ASKED):
        own = some[at : at + ASKED]
        i, row = search(levels, x[own], low[own], high[own], differ)
        label = merged(label, own[i], row + first)
    return _links(a if b is None else np.r_[a, b], label)


BLOCKS = "block long, order int, prints binary, first int, last int, mask long, bits long"


def _blocks(differ: int):
    """Sorted rows (order, print), cut into blocks of one order: the prints, the first and last top, and the root's pattern."""

    def run(batches):
        n, order, rest = TaskContext.get().partitionId() << 32, None, np.zeros(0, np.uint64)

        def block(order, prints):
            nonlocal n
            n += 1
            shift, width = segments(differ)[order]
            x = _turned(prints, shift)
            tops = _tops(x[[0, -1]], width)
            mask = ~(np.bitwise_or.reduce(x) ^ np.bitwise_and.reduce(x))
            root = [int(v) for v in np.array([mask, mask & x[0]]).view(np.int64)]
            return {"block": n, "order": order, "prints": prints.tobytes(), "first": int(tops[0]), "last": int(tops[1]), "mask": root[0], "bits": root[1]}

        for batch in batches:
            orders, prints, out = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), []
            for own in np.split(np.arange(len(orders)), np.flatnonzero(np.diff(orders)) + 1):
                if not len(own):
                    continue
                if order is not None and order != orders[own[0]] and len(rest):
                    out.append(block(order, rest))
                    rest = rest[:0]
                order = int(orders[own[0]])
                rest = np.concatenate([rest, prints[own]])
                while len(rest) >= BLOCK:
                    out.append(block(order, rest[:BLOCK]))
                    rest = rest[BLOCK:]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
        if len(rest):
            yield pa.RecordBatch.from_pylist([block(order, rest)], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("block", pa.int64()), ("order", pa.int32()), ("prints", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("mask", pa.int64()), ("bits", pa.int64())])


def _search_blocks(differ: int):
    """Links of rows (order, a, b): prints of two blocks; those of one where b is null."""

    def run(batches):
        of = lambda x: np.frombuffer(x, np.uint64)
        for batch in batches:
            for r in batch.to_pylist():
                yield _linked(of(r["a"]), None if r["b"] is None else of(r["b"]), r["order"], differ)

    return run


def near_links(prints: DataFrame, differ: int = DIFFER) -> DataFrame:
    """Links (a, b) of distinct prints, of the same components as all pairs that differ in few bits.

    Each print is in differ + 1 Gray orders, one for each segment that it puts first.  A pair that links has
    an equal segment, and so the same top node in that order.  An order is sorted and cut into blocks of rows, each
    with an index.  Blocks search themselves, and those that share a top node search each other unless their roots'
    patterns differ too much; only the first and the last top of a block may be another's too.
    """
    blocks = gray_orders(prints, differ).repartitionByRange("order", "rank").sortWithinPartitions("order", "rank").select("order", "print")
    blocks = stored(blocks.mapInArrow(_blocks(differ), BLOCKS), "blocks")
    ends = blocks.select("block", "order", "mask", "bits", F.explode(F.array_distinct(F.array("first", "last"))).alias("top"))
    a, b = (ends.select("order", "top", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "mask", "bits")]) for x in "ab")
    apart = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b")).bitwiseAND(F.col("mask_a")).bitwiseAND(F.col("mask_b")))
    pairs = a.join(b, ["order", "top"]).filter((F.col("block_a") < F.col("block_b")) & (apart <= differ)).select("order", "block_a", "block_b").distinct()
    for x in "ab":
        pairs = pairs.join(blocks.select(F.col("block").alias(f"block_{x}"), F.col("prints").alias(x)), f"block_{x}")
    each = blocks.select("order", F.col("prints").alias("a"), F.lit(None).cast("binary").alias("b"))
    # Dealt out anew: few rows of large blocks, of which each takes as long as thousands of others.
    tasks = each.unionByName(pairs.select("order", "a", "b")).repartition(F.xxhash64("a", "b"))
    links = stored(tasks.mapInArrow(_search_blocks(differ), "a long, b long").distinct(), "links")
    discard(blocks)
    return links


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, differ: int = DIFFER) -> DataFrame:
    """id, fingerprint (hex) and component_id for each row of df; fingerprints link that differ in few bits.

    A fingerprint has the majority of each bit of the hashes (XXH64, seed 42) of k-word shingles, repeats
    included; fewer words are one shingle.  Equal fingerprints are one class.  Links of classes come from
    near_links(), components from the links.

    Nulls: a null or empty text has the fingerprint zero, which links like any other; a null id counts as a
    row of its own and names a component only if all its ids are null.  Rows that repeat an id keep their own
    fingerprints; rows that repeat both have the same result.  An empty df gives an empty result.  Other columns of
    df don't matter.
    """
    rows = stored(fingerprints(df, id_col, text_col, k), "prints")
    salted = rows.withColumn("salt", salt(F.col("id")))
    per = salted.groupBy("print", "salt").agg(F.min("id").alias("id")).groupBy("print").agg(F.min("id").alias("id"), F.bit_or(salt_bit("salt")).alias("salts"))
    per = stored(per, "print-classes")
    roots = components(near_links(per.select("print"), differ))
    per = per.join(roots.withColumnRenamed("cid", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = per.groupBy("root").agg(F.min("id").alias("component_id"))
    named = stored(per.join(least, "root").select("print", "component_id", "salts"), "named")
    out = salted.join(named.select("print", "component_id", salts_in("salts").alias("salt")), ["print", "salt"])
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
