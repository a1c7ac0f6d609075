"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, put, quoted, salt, salt_bit, salts_in, stored


def mark_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None) -> DataFrame:
    """df with keep_id, group_size, kept and text_sha256; one row per row of df.

    Three steps combine equal texts, each with the whole text in its key: within a task (partial
    aggregation), among the rows of a digest and salt, and among the salts of a digest.  A group of any
    size thus reaches no task with more rows than there are tasks or salts.  The winners go back to the
    rows by digest and salt.  Where a digest stands for several texts, those rows are joined by text.

    Nulls: a null text counts as empty.  A null id loses against any other; among null ids one row
    stays.  Rows that repeat an id and a text: one of them stays.  Columns of df named like the results
    are replaced.  An empty df gives an empty result.  digest: another digest of the text, for tests.
    """
    dig, s, t, who, mask, n = fresh(df, "x_digest", "x_salt", "x_text", "x_id", "x_mask", "x_n")
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    sha = F.sha2(text, 256)
    key: Column = F.unhex(sha) if digest is None else digest(text)
    ids = F.col(quoted(id_col))
    rows = df.withColumns({dig: key, s: salt(ids)})

    salted = rows.select(ids.alias(who), text.alias(t), dig, s).groupBy(dig, s, t).agg(F.max(who).alias(who), F.count(F.lit(1)).alias(n))
    winners = salted.groupBy(dig, t).agg(F.max(who).alias("keep_id"), F.sum(n).alias("group_size"), F.bit_or(salt_bit(s)).alias(mask))
    groups = stored(winners.groupBy(dig).agg(F.count(F.lit(1)).alias(n), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.bit_or(mask).alias(mask)), "groups")

    drop = [c for c in rows.columns if c.lower() in ("keep_id", "group_size", "kept", "text_sha256") and c not in (id_col, text_col)]
    rows = rows.drop(*drop)
    found = rows.join(groups.filter(F.col(n) == 1).select(dig, "keep_id", "group_size", salts_in(mask).alias(s)), [dig, s])
    if not groups.filter(F.col(n) > 1).isEmpty():  # one digest, several texts
        several = groups.filter(F.col(n) > 1).select(dig)
        by_text = winners.join(several, dig, "left_semi").select(dig, F.col(t), "keep_id", "group_size", salts_in(mask).alias(s))
        own = rows.join(several, dig, "left_semi").withColumn(t, text)
        found = found.unionByName(own.join(by_text, [dig, s, t]).drop(t))
    same = Window.partitionBy(dig, s, "keep_id").orderBy(F.desc_nulls_last(quoted(id_col)))
    kept = F.col(quoted(id_col)).eqNullSafe(F.col("keep_id")) & (F.row_number().over(same) == 1)
    out = put(found, keep_id=F.col("keep_id"), group_size=F.col("group_size"), kept=kept, text_sha256=F.lower(F.hex(dig)) if digest is None else sha)
    return out.drop(dig, s)


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that mark_duplicates keeps, with df's columns."""
    names = fresh(df, "keep_id", "group_size", "kept", "text_sha256")
    if names != ["keep_id", "group_size", "kept", "text_sha256"]:  # set aside columns with the results' names
        aside = {c: f"x_{i}_{c}" for i, c in enumerate(df.columns) if c.lower() in ("keep_id", "group_size", "kept", "text_sha256")}
        back = {v: k for k, v in aside.items()}
        out = drop_duplicates(df.withColumnsRenamed(aside), aside.get(id_col, id_col), aside.get(text_col, text_col))
        return out.withColumnsRenamed(back)
    return mark_duplicates(df, id_col, text_col).filter("kept").select(*map(quoted, df.columns))
