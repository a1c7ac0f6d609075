"""Line deduplication by winnowing: passages of lines that occurred earlier are deleted."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, perhaps, put, quoted, salt, salt_bit, salts_in, stored

#: White space, as in words: a line of nothing else is blank.
SPACE = " \t\n\x0b\x0c\r"
#: Rows that a task handles together.
ROWS = 512


def hashed_lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and the numbers of words of the lines that aren't blank, without white space at their ends."""
    lines = [x for x in map(bytes.strip, (text or "").encode("utf-8", "surrogatepass").split(b"\n")) if x]
    sizes = np.array([len(x.split()) for x in lines], np.int32)
    return np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64), sizes


def ends_of(sizes: np.ndarray, least: int) -> np.ndarray:
    """Where the least run of lines from each line ends that has at least least words; beyond the last: none."""
    upto = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    return np.searchsorted(upto, upto[:-1] + least)


def starts_of(sizes: np.ndarray, least: int) -> np.ndarray:
    """Where the least such run that ends with each line starts; -1: none."""
    upto = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    return np.searchsorted(upto, upto[1:] - least, side="right") - 1


def minima(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The place of the least hash, the leftmost of equals, of the window from each line; -1: no window."""
    own, out, rising, upto = hashes.tolist(), np.full(len(hashes), -1, np.int64), deque(), 0
    for i, end in enumerate(ends.tolist()):
        if end > len(own):
            break
        while upto < end:
            while rising and own[rising[-1]] > own[upto]:
                rising.pop()
            rising.append(upto)
            upto += 1
        while rising[0] < i:
            rising.popleft()
        out[i] = rising[0]
    return out


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
    flat = np.concatenate([*arrays, np.zeros(0, kind.to_pandas_dtype())])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False)))


def _fingerprints(least: int):
    """Rows (id, key, text) to (id, key, hashes, sizes, ats): the lines and the places that windows select."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part, keep, found = batch.slice(low, ROWS), [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    hashes, sizes = hashed_lines(text)
                    if sizes.sum() >= least:
                        at = minima(hashes, ends_of(sizes, least))
                        keep.append(i)
                        found.append((hashes.view(np.int64), sizes, np.unique(at[at >= 0])))
                rows = part.take(pa.array(keep, pa.int32()))
                columns = [_lists([f[c] for f in found], kind) for c, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *columns], ["id", "key", "hashes", "sizes", "ats"])

    return run


def windows(hashes: np.ndarray, sizes: np.ndarray, shared: np.ndarray, least: int) -> list[tuple[bytes, int, int]]:
    """(content, first, n) of the least runs from each line whose selected place is shared, and of those that extend
    them: from the same line to a later one, by which a match grows to its last line."""
    ends, n, out = ends_of(sizes, least), len(hashes), set()
    at, starts = minima(hashes, ends), starts_of(sizes, least)
    good = np.isin(at, shared)
    for i in np.flatnonzero(good):
        out.add((int(i), int(ends[i])))
    for j in np.flatnonzero(starts >= 0):
        if good[starts[j]]:
            out.add((int(starts[j]), int(j) + 1))
    assert all(b <= n for _, b in out)
    return [(xxhash.xxh3_128_digest(hashes[a:b].tobytes()), a, b - a) for a, b in sorted(out)]


def _windows(least: int):
    """Rows (id, key, hashes, sizes, shared) to (id, key, run, first, n)."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part, of, out = batch.slice(low, ROWS), [], []
                flat = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (part.column(k) for k in (2, 3, 4))]
                for i in range(part.num_rows):
                    hashes, sizes, shared = (v[e[i] : e[i + 1]] for v, e in flat)
                    found = windows(hashes.view(np.uint64), sizes, shared, least)
                    of += [i] * len(found)
                    out += found
                run_, first, n = zip(*out, strict=True) if out else ((), (), ())
                rows = part.take(pa.array(of, pa.int32()))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(run_, pa.binary()), pa.array(first, pa.int32()), pa.array(n, pa.int32())], ["id", "key", "run", "first", "n"])

    return run


def cut(text: str | None, ranges) -> str | None:
    """text without the non-blank lines in the ranges (first, n), nor blank ones between two of them."""
    if text is None or not ranges:
        return text
    gone = {i for r in ranges for i in range(r["first"], r["first"] + r["n"])}
    out, k, dropping = [], 0, False
    for line in text.split("\n"):
        if line.strip(SPACE):
            dropping = k in gone
            k += 1
        if not dropping:
            out.append(line)
    return "\n".join(out)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50) -> DataFrame:
    """df with n_lines, n_removed and clean_text.

    Lines are compared without white space at their ends; blank ones don't count.  White space and words are
    those of ASCII: a line of other spaces isn't blank.  A line goes if it lies in a run of lines with at
    least least_words words that occurred before: in a row with a lesser id, or earlier in the same text
    without overlap.  (A line of so many words is such a run.)

    Winnowing: a window is the least run of so many words from a line; it selects the place of its least line
    hash.  Two places with a common run select a common hash, so only texts with a hash that was selected
    elsewhere go on.  There the windows of the shared places are joined, by a 128-bit hash of their content, to
    its first place.  Matches grow to the left by the windows that start earlier, to the right by the runs that
    end at each following line and start at a matched place; a later text loses the union.  Every step is
    dealt by hash and salt, so a passage in any share of the texts meets in no single task.

    Nulls: a null text stays null and counts no lines; null ids come first.  Rows that repeat an id are
    told apart, and ordered, by a hash of their text; rows that repeat both are one place.  Texts under
    least_words words and empty ones keep their lines; an empty df gives an empty result.  Columns of df
    named like the results are replaced.
    """
    who, key = quoted(id_col), F.xxhash64(F.coalesce(F.col(quoted(text_col)), F.lit("")))
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(who).alias("id"), key.alias("key"), F.col(quoted(text_col)).alias("text"))
    lines = stored(texts.mapInArrow(_fingerprints(least_words), f"id {kind}, key long, hashes array<long>, sizes array<int>, ats array<int>"), "lines")

    places = lines.select("id", "key", "hashes", F.explode("ats").alias("at"))
    places = places.select("id", "key", "at", F.element_at("hashes", F.col("at") + 1).alias("seed"), salt(F.col("id"), F.col("key"), F.col("at")).alias("salt"))
    place = F.struct("id", "key", "at")
    some = places.groupBy("seed", "salt").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    seeds = some.groupBy("seed").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or(salt_bit("salt")).alias("salts"))
    seeds = seeds.filter("NOT (low <=> high)").select("seed", salts_in("salts").alias("salt"))
    shared = stored(places.join(seeds, ["seed", "salt"]).groupBy("id", "key").agg(F.collect_set("at").alias("shared")), "shared")  # places of a text

    on = lines["id"].eqNullSafe(shared["id"]) & (lines["key"] == shared["key"])
    runs = lines.join(shared, on).select(lines["id"], lines["key"], "hashes", "sizes", "shared")
    runs = stored(runs.mapInArrow(_windows(least_words), f"id {kind}, key long, run binary, first int, n int"), "runs")
    runs_ = runs.withColumn("salt", salt(F.col("id"), F.col("key")))
    place = F.struct("id", "key", "first", "n")
    some = runs_.groupBy("run", "salt").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("times"))
    firsts = some.groupBy("run").agg(F.min("place").alias("place"), F.sum("times").alias("times"), F.bit_or(salt_bit("salt")).alias("salts"))
    firsts = firsts.filter("times > 1").select("run", "place", salts_in("salts").alias("salt"))
    later = runs_.join(firsts, ["run", "salt"]).filter("NOT (id <=> place.id AND key = place.key) OR first >= place.first + place.n")
    ranges = stored(later.groupBy("id", "key").agg(F.collect_set(F.struct("first", "n")).alias("ranges")), "ranges")  # two for each line at most
    discard(lines, shared, runs)

    # Only texts that may lose lines meet the ranges; the others stay where they are.
    hashed, found, maybe, of, its = fresh(df, "x_key", "x_ranges", "x_maybe", "x_of", "x_its")
    rows = df.withColumn(hashed, key)
    ranges = ranges.select(F.col("id").alias(of), F.col("key").alias(its), F.col("ranges").alias(found))
    rows = perhaps(rows, F.xxhash64(quoted(id_col), hashed), ranges.select(F.xxhash64(of, its).alias("k")), ranges.count(), maybe)
    touched, same = rows.filter(maybe).drop(maybe), rows.filter(~F.col(maybe)).drop(maybe)
    on = touched[who].eqNullSafe(ranges[of]) & (touched[hashed] == ranges[its])
    touched = touched.join(ranges.hint("merge"), on, "left").drop(of, its)
    rows = touched.unionByName(same.withColumn(found, F.lit(None).cast(ranges.schema[found].dataType)))

    def clean(text: pa.Array, ranges: pa.Array) -> pa.Array:
        return pa.array([cut(t, r) for t, r in zip(text.to_pylist(), ranges.to_pylist(), strict=True)], pa.string())

    text = F.col(quoted(text_col))
    rows = put(rows, clean_text=F.arrow_udf(clean, "string")(text, F.col(found))).drop(hashed, found)
    count = lambda c: F.coalesce(F.size(F.filter(F.split(c, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")), F.lit(0)).cast("long")
    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(count(text)).cast("long")
    n_kept = F.when(text.isNull(), F.lit(0)).otherwise(count(F.col("clean_text"))).cast("long")
    return put(rows, n_lines=n_lines, n_removed=n_lines - n_kept)
