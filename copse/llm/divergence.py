"""Divergence of the sources of a language by joint histograms of counts."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import quoted, stored

#: A term is kept that so many documents of its language have; ranks of terms go to the second number.
LEAST_DOCS, RANKS = 3, 200
#: Distinct (group, term) that a task counts before it passes them on.
AT_HAND = 400_000
#: A-Z to a-z, all else that is no letter of a term to a space: bytes of UTF-8.
_LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of a-z and characters from U+0080 on; A-Z count as a-z."""
    return text.translate(_LETTERS).split()


def _counts(batches):
    """Rows (lang, source, text): for each group and term its occurrences and documents, summed within the task."""
    groups, size = {}, 0

    def out():
        for (lang, source), (n, docs) in groups.items():
            keys = [pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), pa.repeat(source, len(n)), *keys], ["lang", "source", "term", "n", "docs"])

    for part in batches:
        for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            found = terms(text)
            n.update(found)
            docs.update(set(found))
            size += len(n)
            if size >= AT_HAND:
                yield from out()
                groups, size = {}, 0
    yield from out()


def kept_counts(rows: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n and lang_n of rows (lang, source, text) for kept terms; first marks one row of each (lang, term)."""
    counts = rows.select("lang", "source", F.col("text").cast("binary")).mapInArrow(_counts, "lang string, source string, term string, n long, docs long")
    # Summed within tasks already: rows go to their (lang, term) at once, a row for each task and source.
    counts = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of = Window.partitionBy("lang", "term")  # a row for each source
    wide = counts.withColumns({"in_docs": F.sum("docs").over(of), "lang_n": F.sum("n").over(of), "first": F.min("source").over(of) == F.col("source")})
    return wide.filter(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "first")


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(1e9 * (count + 1) / (total + kept)), in whole numbers."""
    return F.expr(f"1L + (1000000000BD * cast({count} + 1 AS decimal(20, 0))) div cast({total} + {kept} AS decimal(20, 0))")


def gap(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def tallies(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (sources, a before b), x, y and m: how many kept terms have the counts x in a and y in b, x or y or both 0 too.

    Cells of terms that both sources have are joined by term.  The others follow from the margins: terms with x in a
    count at (x, 0) less those that b has too, and the terms that neither has are all kept ones less the rest.
    """
    both = kept.select("lang", "term", F.col("source").alias("a"), F.col("n").alias("x")).join(kept.select("lang", "term", F.col("source").alias("b"), F.col("n").alias("y")), ["lang", "term"])
    both = both.filter("a < b").groupBy("lang", "a", "b", "x", "y").agg(F.count(F.lit(1)).alias("m"))
    zero = F.lit(0).cast("long")
    cell = lambda x, y, m: F.struct(x.alias("x"), y.alias("y"), m.alias("m"))
    met = both.select("lang", "a", "b", F.explode(F.array(cell(F.col("x"), F.col("y"), F.col("m")), cell(F.col("x"), zero, -F.col("m")), cell(zero, F.col("y"), -F.col("m")), cell(zero, zero, F.col("m")))).alias("c"))
    margins = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m"))
    pairs = groups.select("lang", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b"), "v"), "lang").filter("a < b")
    alone = []
    for s in "ab":  # what a source has alone, for each other source of the language
        own = margins.withColumnRenamed("source", s).join(pairs.select("lang", "a", "b"), ["lang", s])
        own = own.select("lang", "a", "b", F.explode(F.array(cell(F.col("n") if s == "a" else zero, F.col("n") if s == "b" else zero, F.col("m")), cell(zero, zero, -F.col("m")))).alias("c"))
        alone.append(own)
    rest = pairs.select("lang", "a", "b", cell(zero, zero, F.col("v")).alias("c"))
    cells = met.unionByName(alone[0]).unionByName(alone[1]).unionByName(rest).select("lang", "a", "b", "c.*")
    return cells.groupBy("lang", "a", "b", "x", "y").agg(F.sum("m").alias("m")).filter("m > 0")


def divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source of a language is from the others, and its own terms.

    A group (lang, source) and the language as a whole give each term that at least least_docs documents of the
    language have the share p = 1 + floor(1e9 * (count + 1) / (N + V)).  Part `pair` sums f = floor((p - q)^2 / q) over
    all kept terms, for each other source of the language.  Part `term` has the terms that a group has more of than
    its language, the greatest f first, to so many ranks.

    f is evaluated once for each combination of counts, times the terms that have it; the combinations of two sources,
    cells with zeros included, come from tallies().  For terms, combinations that can't reach the last rank go before
    any term is looked up.

    Nulls: a null text, lang or source counts as empty.  A language without kept terms has the value 0 for each pair and
    no terms.  Ties go by the item's UTF-8 bytes.  Repeated rows count each.  An empty df gives an empty result.  Other
    columns don't matter.
    """
    rows = df.select(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(name) for name, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    kept = stored(kept_counts(rows, least_docs), "kept")
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("v"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = stored(groups.na.fill(0, ["total", "lang_total", "v"]), "groups")

    def of(s: str) -> DataFrame:
        return groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), *(["v"] if s == "a" else []))

    cells = tallies(kept, groups).join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"])
    cells = cells.withColumns({"p": share("x", "total_a", "v"), "q": share("y", "total_b", "v")})
    sum_ = lambda f: F.sum(F.col("m").cast("decimal(20,0)") * f.cast("decimal(20,0)"))
    sums = cells.groupBy("lang", "a", "b").agg(sum_(gap("p", "q")).alias("ab"), sum_(gap("q", "p")).alias("ba"))
    side = lambda a, b, v: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), F.col(v).cast("long").alias("value"))
    found = sums.select("lang", F.explode(F.array(side("a", "b", "ab"), side("b", "a", "ba"))).alias("s")).select("lang", "s.*")
    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = pairs.join(found, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    combos = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count(F.lit(1)).alias("m")).join(groups, ["lang", "source"])
    combos = combos.withColumns({"p": share("n", "total", "v"), "q": share("lang_n", "lang_total", "v")}).filter("p > q").withColumn("value", gap("p", "q"))
    before = Window.partitionBy("lang", "source").orderBy(F.desc("value")).rangeBetween(Window.unboundedPreceding, -1)
    combos = combos.withColumn("ahead", F.coalesce(F.sum("m").over(before), F.lit(0))).filter(F.col("ahead") < ranks)
    top = kept.join(combos.select("lang", "source", "n", "lang_n", "value"), ["lang", "source", "n", "lang_n"])
    top = top.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    dealt = Window.partitionBy("lang", "source", "deal").orderBy(F.desc("value"), "item")
    top = top.withColumn("deal", F.pmod(F.xxhash64("item"), F.lit(16))).withColumn("nth", F.row_number().over(dealt)).filter(F.col("nth") <= ranks).drop("deal", "nth")

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = pairs.unionByName(top).withColumn("rank", F.row_number().over(order))
    return out.filter((F.col("part") == "pair") | (F.col("rank") <= ranks)).select("lang", "source", "part", "item", "value", "rank")
