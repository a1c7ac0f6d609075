"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact sorted-array intersection."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, discard, perhaps_in, quoted, salt, salt_bit, salts_in, stored

#: Two sets link when link * |A or B| <= 100 * |A and B|; the contract of the op3 query has words of SHINGLE and this link.
SHINGLE, LINK = 3, 90
#: Bit i of a bitmap is the parity of the members that hash to it.  Bits of the short one, which tiles hold, and of
#: the long one, which pairs are held against: half the members or more, to a power of two.
BITS, LEAST_BITS = 512, 512
#: Rows of a tile that isn't banded by size, and multiples of the prefix that are searched for common shingles.
SMALL_TILE, SEARCHED = 256, 4
#: Rows of a tile that a task compares with the tile's first one, about; of one side of a cell of a split tile; pairs at hand.
DEAL, CELL, PAIRS = 1024, 4096, 1_000_000
#: A shingle in more prefixes than this, and than 1 / MOST_COMMON of all, is common.
COMMON, MOST_COMMON = 50, 1_000_000
#: Shared shingles of a prefix that take part in each of the rounds that compare with a few rows of a tile only.
FIRST_ROUNDS = (3, 9)
SALT = f"cast(pmod(xxhash64(id), {SALTS}) as int)"
SALT_BIT = f"shiftleft(1L, {SALT})"


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct k-word shingles; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    w = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = (h ^ w[i : len(w) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def _among(u: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which members are in the sorted common ones."""
    if not len(common):
        return np.zeros(len(u), bool)
    return common[np.minimum(np.searchsorted(common, u), len(common) - 1)] == u


def least_overlap_share(n: int, link: int = LINK) -> int:
    return -(-link * n // 100)


def least_linked(link: int = LINK) -> int | None:
    """The members of the smallest set that links with another than its equals, n of n + 1; none at 100."""
    return -(-link // (100 - link)) if link < 100 else None


def prefix(u: np.ndarray, common: np.ndarray, link: int = LINK) -> np.ndarray:
    """The first members in the global order (common ones last, then by hash): linked sets share one.

    Sets of under least_linked() members (9 at a link of 90) link with equal ones only and need none.
    """
    least = least_linked(link)
    if least is None or len(u) < least:
        return u[:0]
    n = len(u) - least_overlap_share(len(u), link) + 1
    if len(common):
        late = _among(u, common)
        u = np.concatenate([u[~late], u[late]])
    return u[:n]


def bitmap(u: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount((u & np.uint64(bits - 1)).astype(np.intp), minlength=bits) & 1).astype(np.uint8))


def long_bitmap(u: np.ndarray) -> np.ndarray:
    return bitmap(u, max(LEAST_BITS, 1 << max(0, len(u) // 2 - 1).bit_length()))


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with fewer bytes."""
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


def _set_id(u: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(u.tobytes()) if len(u) else None


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _parts(batches, rows: int = 256):
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def _sketches(k: int, link: int, common):
    def run(batches):
        for part in _parts(batches):
            sets = [shingles(t, k) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2), pa.array([len(u) for u in sets], pa.int64()), pa.array(map(_set_id, sets), pa.binary()),
                    pa.array([bitmap(u, BITS).tobytes() for u in sets], pa.binary()), pa.array([long_bitmap(u).tobytes() for u in sets], pa.binary()),
                    _lists([prefix(u, common.value, link) for u in sets]),
                ],
                ["id", "key", "n", "node", "sig", "bits", "prefix"],
            )

    return run


def _counts(k: int, link: int, common=None):
    """How often shingles occur in prefixes; or, in texts with a common one there, in a few times the prefix."""

    def run(batches):
        for part in _parts(batches, 1024):
            found = []
            for text in part.column(1).to_pylist():
                u = shingles(text, k)
                p = prefix(u, u[:0], link)
                if common is None:
                    found.append(p)
                elif _among(p, common.value).any():
                    found.append(u[: SEARCHED * len(p)])
            token, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return run


def _common_of(counts: DataFrame) -> np.ndarray:
    """The tokens with n above the bounds, sorted: MOST_COMMON of them at most."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") > max(COMMON, total // MOST_COMMON)).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def _compatible(n, pos, bits, a, b, link: int) -> np.ndarray:
    """Whether the pairs of rows may link, from sizes and upper bounds of the overlap.

    If the tile's shingle is the first that a pair has in common, all that it has lies from there on; a
    pair that fails this in a later tile has been met in an earlier one.
    """
    x, y = n[a], n[b]
    ok = (100 * np.minimum(x, y) >= link * np.maximum(x, y)) & ((100 + link) * np.minimum(x - pos[a], y - pos[b]) >= link * (x + y))
    differ = np.bitwise_count(bits[a[ok]] ^ bits[b[ok]]).sum(1).astype(np.int64)  # at most |A xor B|
    both = (x + y)[ok]
    ok[ok] = (100 + link) * (both - differ) >= 2 * link * both
    return ok


def _changes(table: pa.Table) -> np.ndarray:
    """Where a row is of another tile than the one before."""
    return np.logical_or.reduce([x[1:] != x[:-1] for x in (table.column(c).to_numpy() for c in ("token", "band", "deal"))])


def _whole_tiles(batches):
    """The batches again, cut so that a tile (token, band, deal) is never in two."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        new = np.flatnonzero(_changes(table)) + 1
        if not len(new):
            rest = table
            continue
        rest = table.slice(new[-1])
        yield table.slice(0, new[-1])
    if rest is not None:
        yield rest


def _distinct_pairs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.zeros(0, np.int64), *[x[i] for x in pairs]]) for i in (0, 1))
    low, high = np.minimum(a, b), np.maximum(a, b)
    both = np.unique(np.stack([low, high], 1)[low != high], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])


def _with_first(link: int):
    """Candidates of the first rounds: each row with the first of its tile, the others with the next one."""

    def run(batches):
        for t in _whole_tiles(batches):
            n, cid, root, pos = (t.column(c).to_numpy() for c in ("n", "cid", "root", "pos"))
            bits = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(len(n), BITS // 64)
            tile, out, left = np.r_[0, np.cumsum(_changes(t))], [], np.arange(len(n))
            for _ in range(2):
                if len(left) < 2:
                    break
                lead = left[np.searchsorted(tile[left], tile[left])]
                own = (lead != left) & (root[lead] != root[left])
                a, b = lead[own], left[own]
                ok = _compatible(n, pos, bits, a, b, link)
                out.append((cid[a[ok]], cid[b[ok]]))
                left = b[~ok]  # those with the first one's component have no more to do here
            yield _distinct_pairs(out)

    return run


def _most_frequent_root(tile: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which rows have the root that most rows of their tile have."""
    order = np.lexsort((root, tile))
    new = np.r_[True, (tile[order][1:] != tile[order][:-1]) | (root[order][1:] != root[order][:-1])]
    run = np.cumsum(new) - 1
    size, of = np.bincount(run), tile[order][new]
    best = np.lexsort((-size, of))
    best = best[np.r_[True, of[best][1:] != of[best][:-1]]]
    out = np.zeros(len(tile), bool)
    out[order] = np.isin(run, best)
    return out


def _ranges(low: np.ndarray, high: np.ndarray):
    """Chunks of (i, j) with j from low[i] to high[i], of about PAIRS pairs each."""
    some = np.flatnonzero(low < high)
    upto = np.cumsum(high[some] - low[some])
    for part in np.split(some, np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS)) if len(upto) else []):
        size = high[part] - low[part]
        if size.sum():
            yield np.repeat(part, size), np.repeat(low[part], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _between_roots(link: int):
    """Candidates of the last round: rows of different components of a tile, the smaller of each pair first.

    In a pair that may link, the larger is no larger than what the smaller one's place in the tile allows, so
    rows whose place rules out all sets of their size or more start no pair.  Sorted by size, the partners of a row are
    a range.  Rows of the tile's most frequent component start pairs with other rows only.  Cells of a split tile have two
    sides: those that start pairs, and those that they meet.
    """

    def run(batches):
        for t in _whole_tiles(batches):
            visits, n, cid, root, pos, side, sides = (t.column(c).to_numpy(zero_copy_only=False) for c in ("visits", "n", "cid", "root", "pos", "side", "sides"))
            bits = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(len(n), BITS // 64)
            tile = np.r_[0, np.cumsum(_changes(t))]
            key = (2 * tile + side) << 40 | n  # rises: rows are sorted by tile, side and size
            largest = np.minimum((100 + link) * (n - pos) // link - n, 100 * n // link)
            frequent = _most_frequent_root(tile, root)
            out = []
            for first, second in ((~frequent, np.ones(len(n), bool)), (frequent, ~frequent)):
                start, at = np.flatnonzero(first & (largest >= n) & (side == 0)), np.flatnonzero(second)
                to, own = (2 * tile + (sides == 2))[start] << 40, key[at]
                low = np.searchsorted(own, to | n[start], "left")
                high = np.searchsorted(own, to | largest[start], "right")
                for i, j in _ranges(low, high):
                    a, b = start[i], at[j]
                    ok = (root[a] != root[b]) & ~(visits[a] & visits[b])
                    a, b = a[ok], b[ok]
                    ok = _compatible(n, pos, bits, a, b, link)
                    out.append((cid[a[ok]], cid[b[ok]]))
            yield _distinct_pairs(out)

    return run


def _close(link: int):
    """The pairs that may link by their long bitmaps."""

    def run(batches):
        for part in _parts(batches, 4096):
            keep = []
            for i, (x, y, p, q) in enumerate(zip(*(part.column(c).to_pylist() for c in range(2, 6)), strict=True)):
                size = min(len(p), len(q))
                differ = int(np.bitwise_count(folded(np.frombuffer(p, np.uint8), size) ^ folded(np.frombuffer(q, np.uint8), size)).sum())
                if (100 + link) * (x + y - differ) >= 2 * link * (x + y):
                    keep.append(i)
            yield part.take(pa.array(keep, pa.int32())).select(["a", "b"])

    return run


def _exact(link: int):
    """Sorted (a, deal, b): the set of a (b null) comes before the sets that it is compared with."""

    def run(batches):
        of, lead = None, None
        for part in _parts(batches):
            left, right = [], []
            flat, ends = part.column(3).values.to_numpy(), part.column(3).offsets.to_numpy()
            for i, (a, deal, b) in enumerate(zip(*(part.column(c).to_pylist() for c in range(3)), strict=True)):
                u = flat[ends[i] : ends[i + 1]].view(np.uint64)
                if b is None:
                    of, lead = (a, deal), u.copy()
                    continue
                assert of == (a, deal)
                at = np.minimum(np.searchsorted(lead, u), len(lead) - 1)
                both = int((lead[at] == u).sum())
                if 100 * both >= link * (len(lead) + len(u) - both):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def linked(pairs: DataFrame, sets: DataFrame, link: int = LINK) -> DataFrame:
    """The pairs (a, b) whose sets link.  The set of a goes once to each deal of its partners."""
    dealt = pairs.withColumn("deal", salt(F.col("b")))
    wanted = dealt.select("a", "deal", "b", F.col("b").alias("cid")).unionByName(dealt.select("a", "deal").distinct().select("a", "deal", F.lit(None).cast("long").alias("b"), F.col("a").alias("cid")))
    rows = wanted.join(sets, "cid").select("a", "deal", "b", "members")
    rows = rows.repartition("a", "deal").sortWithinPartitions("a", "deal", F.asc_nulls_first("b"))
    return stored(rows.mapInArrow(_exact(link), "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """cid and root (the same for all of a component) of the edges' ends, by hooking and pointer jumping."""
    maps, used = [], []
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), "parents")
        while True:
            nxt = stored(up.join(up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p", "left").select("a", F.coalesce("q", "p").alias("p"), (F.col("q") < F.col("p")).alias("moved")), "parents")
            discard(up)
            up = nxt
            if up.filter("moved").isEmpty():
                break
        maps.append(up)
        ends = edges.join(up, "a").select(F.col("p").alias("x"), F.col("b").alias("a")).join(up, "a").select("x", F.col("p").alias("y"))
        edges = stored(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        used += [up, edges]
        if edges.isEmpty():
            break
    out = maps[0].select(F.col("a").alias("cid"), F.col("p").alias("root"))
    for up in maps[1:]:
        out = out.join(up.select(F.col("a").alias("root"), "p"), "root", "left").select("cid", F.coalesce("p", "root").alias("root"))
    out = stored(out, "components")
    discard(*used)
    return out


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """cid and root of all linked so far, after more links: these are contracted onto the roots that there are."""
    if roots is None:
        return components(links)
    of = lambda c: roots.select(F.col("cid").alias(c), F.col("root").alias(f"root_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    ends = stored(ends.filter("a <> b").distinct(), "edges")
    if ends.isEmpty():
        return roots
    more = components(ends)
    moved = roots.join(more.select(F.col("cid").alias("root"), F.col("root").alias("to")), "root", "left").select("cid", F.coalesce("to", "root").alias("root"))
    out = stored(moved.unionByName(more.join(roots, "cid", "left_anti").select("cid", "root")), "components")
    discard(ends, more, roots)
    return out


def _classes(df: DataFrame, id_col: str, text_col: str, k: int, link: int) -> tuple[DataFrame, DataFrame]:
    """A row for each row of df (id, key, n, node: none without a set), and one for each class of equal sets (node, id, salts, root)."""
    spark = df.sparkSession
    text = F.col(quoted(text_col))
    texts = df.select(F.col(quoted(id_col)).alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"))
    kind = df.schema[id_col].dataType.simpleString()

    counted = lambda common: texts.mapInArrow(_counts(k, link, common), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    common = _common_of(stored(counted(None).filter(F.col("n") > COMMON), "common"))
    if len(common):
        more = stored(counted(spark.sparkContext.broadcast(common)).filter(F.col("n") > COMMON), "common")
        common = np.union1d(common, _common_of(more))
    sketches = texts.mapInArrow(_sketches(k, link, spark.sparkContext.broadcast(common)), f"id {kind}, key long, n long, node binary, sig binary, bits binary, prefix array<long>")
    sketches = stored(sketches, "sketches")
    rows = sketches.select("id", "key", "n", "node")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n", "sig", "bits", "prefix"))
    classes = sketches.filter("node IS NOT NULL").groupBy("node").agg(least.alias("r"), F.bit_or(F.expr(SALT_BIT)).alias("salts"))
    classes = stored(classes.select("node", "salts", "r.*").drop("none").withColumn("cid", F.monotonically_increasing_id()), "classes")

    # Tokens in more than one prefix, and in how many: counted by salt, and back to the salts in use.
    tokens = classes.select("cid", F.posexplode("prefix").alias("pos", "token")).withColumn("salt", salt(F.col("cid")))
    counts = tokens.groupBy("token", "salt").agg(F.count(F.lit(1)).alias("own")).groupBy("token").agg(F.sum("own").alias("times"), F.bit_or(salt_bit("salt")).alias("salts"))
    counts = counts.filter("times > 1").select("token", "times", salts_in("salts").alias("salt"))
    shared = tokens.join(counts, ["token", "salt"]).select("cid", "pos", "token", "times")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / link) * (1 + 1e-9) if link < 100 else 1.0)).cast("int")
    tiles = shared.join(classes.select("cid", "n", "sig"), "cid").withColumn("band", F.when(F.col("times") > SMALL_TILE, band).otherwise(F.lit(-1)))
    tiles = tiles.withColumn("nth", F.row_number().over(Window.partitionBy("cid").orderBy("pos")))
    tiles = stored(tiles, "tiles")

    def members(batches):
        for part in _parts(batches):
            sets = [shingles(t, k) for t in part.column(2).to_pylist()]
            keep = [i for i, (u, node) in enumerate(zip(sets, part.column(1).to_pylist(), strict=True)) if _set_id(u) == node]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int32())), _lists([sets[i] for i in keep])], ["cid", "members"])

    def links_of(rooted: DataFrame, round_: int) -> DataFrame | None:
        last = round_ == len(FIRST_ROUNDS)
        own = rooted.select("token", "band", F.lit(False).alias("visits"), "n", "pos", "cid", "root", "sig", "times")
        dealt = own.unionByName(own.filter("band >= 0").withColumns({"visits": F.lit(True), "band": F.col("band") + 1}))
        if last:  # a tile of one component has no pairs; large ones are split: blocks of rows that start pairs meet deals of all in cells
            dealt = dealt.withColumn("salt", salt(F.col("cid")))
            # Rows start pairs with larger ones only where their place allows a partner of their size; others must suit such a row.
            most = F.expr(f"({100 + link}L * (n - pos)) div {link}L - n")
            dealt = dealt.withColumn("starts", most >= F.col("n"))
            roots = dealt.groupBy("token", "band", "salt").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.when(F.col("starts"), F.col("n"))).alias("least"), F.max(F.when(F.col("starts"), most)).alias("most"))
            mixed = roots.groupBy("token", "band").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"), F.bit_or(salt_bit("salt")).alias("salts"))
            mixed = stored(mixed.filter("low < high AND least IS NOT NULL").select("token", "band", "least", "most", "salts"), "mixed")
            if mixed.isEmpty():
                discard(mixed)
                return None
            suits = F.col("starts") | F.col("n").between(F.col("least"), F.col("most"))
            dealt = dealt.join(mixed.select("token", "band", "least", "most", salts_in("salts").alias("salt")), ["token", "band", "salt"]).filter(suits).drop("least", "most")
            sizes = dealt.groupBy("token", "band", "salt").agg(F.count(F.lit(1)).alias("rows"), F.count_if("starts").alias("firsts"))
            sizes = sizes.groupBy("token", "band").agg(F.sum("rows").alias("rows"), F.sum("firsts").alias("firsts"), F.bit_or(salt_bit("salt")).alias("salts")).filter(F.col("rows") > CELL)
            sizes = sizes.select("token", "band", F.ceil(F.col("rows") / CELL).cast("int").alias("deals"), F.ceil(F.col("firsts") / CELL).cast("int").alias("blocks"), salts_in("salts").alias("salt"))
            dealt = dealt.join(sizes, ["token", "band", "salt"], "left").drop("salt")
            at = lambda n: F.pmod(F.xxhash64("cid"), n).cast("int")
            cell = lambda deal, side, sides: F.struct(deal.alias("deal"), F.lit(side).alias("side"), F.lit(sides).alias("sides"))
            upto = lambda n: F.sequence(F.lit(0), n - 1)
            second = F.transform(upto(F.col("blocks")), lambda b: cell(b * F.col("deals") + at(F.col("deals")), 1, 2))
            first = F.transform(upto(F.col("deals")), lambda d: cell(at(F.col("blocks")) * F.col("deals") + d, 0, 2))
            cells = F.when(F.col("deals").isNull(), F.array(cell(F.lit(0), 0, 1))).when(F.col("starts"), F.concat(second, first)).otherwise(second)
            dealt = dealt.withColumn("cell", F.explode(cells)).select("token", "band", "visits", "n", "pos", "cid", "root", "sig", "cell.*")
            dealt = dealt.repartition("token", "band", "deal").sortWithinPartitions("token", "band", "deal", "side", "n", "cid")
            candidates = _between_roots(link)
        else:  # large tiles fall into deals, each with the first row of the tile
            order = F.xxhash64("token", "cid", F.lit(round_))
            deals = F.when(F.col("times") > DEAL, F.ceil(F.col("times") / DEAL)).otherwise(F.lit(1)).cast("int")
            large = dealt.filter(F.col("times") > DEAL).withColumn("salt", salt(F.col("cid")))
            row = F.struct(*dealt.columns)
            first = large.groupBy("token", "band", "salt").agg(F.min_by(row, order).alias("r"), F.min(order).alias("o")).groupBy("token", "band").agg(F.min_by("r", "o").alias("r")).select("r.*")
            first = first.withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1)))
            dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("cid", F.lit(round_)), deals).cast("int")).unionByName(first)
            dealt = dealt.drop("times").repartition("token", "band", "deal").sortWithinPartitions("token", "band", "deal", order, "cid")
            candidates = _with_first(link)
        pairs = dealt.mapInArrow(candidates, "a long, b long").distinct()
        for c in "ab":
            pairs = pairs.join(classes.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")), c)
        pairs = stored(pairs.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_close(link), "a long, b long"), "pairs")
        # Only texts of the classes asked are shuffled to them, and theirs alone become sets again.
        asked = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct().join(classes.select("cid", "node", F.col("id").alias("x_id")), "cid")
        asked = stored(asked, "asked")
        n_asked = asked.count()
        some = perhaps_in(texts, F.col("id"), asked.select("x_id"), n_asked)
        found = some.join(asked.hint("merge"), some["id"].eqNullSafe(asked["x_id"])).select("cid", "node", "text")
        sets = stored(found.mapInArrow(members, "cid long, members array<long>"), "sets")
        used = [pairs, asked, sets]
        if sets.count() > n_asked:  # rows that repeat an id and a set
            sets = stored(sets.dropDuplicates(["cid"]), "sets")
            used.append(sets)
        out = linked(pairs, sets, link)
        discard(*used)
        return out

    roots, rooted = None, tiles.withColumn("root", F.col("cid"))
    for i, most in enumerate([*FIRST_ROUNDS, None]):
        found = links_of(rooted if most is None else rooted.filter(F.col("nth") <= most), i)
        if found is not None:
            roots = joined(roots, found)
            discard(found)
        rooted = tiles.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))

    per_class = stored(classes.join(roots, "cid", "left").select("node", "id", "salts", F.coalesce("root", "cid").alias("root")), "rooted")
    discard(tiles, classes, roots)
    return rows, per_class


def _components(df: DataFrame, id_col: str, text_col: str, k: int, link: int) -> DataFrame:
    """id, key (of the text), node (of the set), n, root and component_id of each row of df."""
    rows, per_class = _classes(df, id_col, text_col, k, link)
    least = per_class.groupBy("root").agg(F.min("id").alias("component_id"))
    per_class = stored(per_class.join(least, "root").select("node", "salts", "root", "component_id"), "per-class")
    named = per_class.select(F.col("node").alias("x_node"), "root", "component_id", salts_in("salts").alias("x_salt"))
    mine = rows.withColumn("salt", F.expr(SALT))
    out = mine.join(named, (F.col("node") == F.col("x_node")) & (F.col("salt") == F.col("x_salt")), "left")
    return out.select("id", "key", "node", "n", "root", F.coalesce("component_id", "id").alias("component_id"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, link: int = LINK) -> DataFrame:
    """id, set_id, n_shingles and component_id for each row of df; sets of k-word shingles, linked as at LINK.

    Rows with equal sets are one class.  Classes meet in tiles: a shingle of their prefixes, and a band
    of sizes (each class also visits the band above).  Within tiles, sizes and the difference of bitmap
    signatures bound the overlap from above; pairs that may link are compared exactly.  The first
    rounds compare each class with one or two others of a tile; what they link needs no more pairs, so a
    large group of near copies costs about its size.  There, a large tile falls into deals, each with the
    tile's first row.  The last round takes all pairs of different components, in tiles that have several.
    Shingles common in prefixes (a passage in many texts) come last in the global order, which keeps tiles
    small; any such order is exact.

    A set is known by 64-bit hashes of its members.  Nulls: a null or empty text has no set and is its own
    component; a null id counts as a row of its own and names a component only if all its ids are null.
    Rows that repeat an id keep their own sets; rows that repeat both have the same result.  An empty df
    gives an empty result.  Other columns of df don't matter.
    """
    out = _components(df, id_col, text_col, k, link)
    return out.select(F.col("id").alias(id_col), F.col("node").alias("set_id"), F.col("n").alias("n_shingles"), "component_id")


def one_per_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, link: int = LINK) -> DataFrame:
    """The rows of df that stay: of each component the one with the least id, and rows without a set.

    Rows are told apart by id and text: of rows with the least id and different texts, the one with the least
    hash of its text stays; rows that repeat both stay or go together.  Null ids stay only where a component
    has no other.
    """
    marked = _components(df, id_col, text_col, k, link).filter(F.col("id").eqNullSafe(F.col("component_id")))
    one = marked.filter("node IS NOT NULL").groupBy("root").agg(F.min(F.struct("id", "key")).alias("k")).select("k.id", "k.key")
    kept = one.unionByName(marked.filter("node IS NULL").select("id", "key").distinct()).select(F.col("id").alias("x_kept"), F.col("key").alias("x_key"))
    own = F.xxhash64(F.coalesce(F.col(quoted(text_col)), F.lit("")))
    return df.join(kept, F.col(quoted(id_col)).eqNullSafe(kept["x_kept"]) & (own == kept["x_key"]), "left_semi")
