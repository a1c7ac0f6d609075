"""URL filters: a temporal join of captures with dated list entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import put, quoted, salt, salt_bit, salts_in, stored

#: Schema of list entries.  kind: domain (the host and its subdomains) or prefix (host and path, whole
#: segments); action: block, allow or remove (the entry ends).
ENTRIES = "kind string, pattern string, action string, day date"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^\.+", "")


def keys_of(url: Column) -> Column:
    """The patterns that can match: d: and each domain above the host, p: and each leading part of host and path."""
    path = F.regexp_extract(url, r"^\s*[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    labels, parts = F.split(host_of(url), r"\."), F.array_remove(F.split(path, "/"), "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(F.lit("p:"), F.array_join(F.concat(F.array(host_of(url)), F.slice(parts, 1, i)), "/")))
    return F.when(host_of(url) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """key and its versions in order: structs of start, end (not included; null: open) and action.

    The last of a day counts: of several actions on a pattern and day, block comes before allow and allow
    before remove.  A key has a version a day at most.  Runs of slashes in a path are one, as in keys_of().
    """
    pattern = F.regexp_replace(F.lower("pattern"), r"^[./]+|[./]+$", "")
    path = F.regexp_replace(F.regexp_extract("pattern", "/.*$", 0), "/+", "/")
    pattern = F.when(F.col("kind") == "prefix", F.regexp_replace(F.concat(F.regexp_extract(F.lower("pattern"), "^[^/]*", 0), path), r"/+$", "")).otherwise(pattern)
    key = F.concat(F.when(F.col("kind") == "prefix", "p:").otherwise("d:"), pattern)
    known = entries.filter("kind IN ('domain', 'prefix') AND action IN ('block', 'allow', 'remove') AND day IS NOT NULL AND pattern IS NOT NULL")
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    daily = known.groupBy(key.alias("key"), "day").agg(F.min_by("action", rank).alias("action"))
    nxt = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    version = F.struct(F.col("day").alias("start"), nxt.alias("end"), "action").alias("version")
    return daily.select("key", version).groupBy("key").agg(F.array_sort(F.collect_list("version")).alias("versions"))


def as_of(versions: Column, day: Column) -> Column:
    """The version that holds on the day: the last that starts at or before it; null if it is a removal or none is."""
    before = F.filter(versions, lambda v: v["start"] <= day)
    last = F.try_element_at(before, F.lit(-1))
    return F.when(last["action"] != "remove", last)


def judge_urls(pages: DataFrame, entries: DataFrame, url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """pages with host, n_active (entries active at fetch time that match), matched and verdict.

    Dated entries become intervals, in order for each pattern; an as-of join gives each capture, for each of
    its keys, the entry in force on its day.  The longest matching pattern decides, prefix before domain;
    without any the verdict is keep, as for allow.  Keys that no list has are dropped before the captures are
    joined; the others are joined by key and salt, so that a host with any share of the captures is spread.

    Nulls: a capture without url or day matches nothing and is kept; one without a host (an empty or
    malformed url) too.  Captures that repeat url and day have the same verdict.  An empty list keeps all; no
    pages give an empty result.  Columns of pages named like the results are replaced.
    """
    url, day = F.col(quoted(url_col)), F.col(quoted(fetched_col)).cast("date")
    cases = pages.select(url.alias("x_url"), day.alias("x_day")).filter("x_url IS NOT NULL AND x_day IS NOT NULL").distinct()
    asked = cases.withColumn("key", F.explode(keys_of(F.col("x_url")))).withColumn("salt", salt(F.col("x_url"), F.col("x_day")))
    listed = asked.groupBy("key").agg(F.bit_or(salt_bit("salt")).alias("salts")).join(intervals(entries), "key")
    listed = stored(listed, "listed").select("key", "versions", salts_in("salts").alias("salt"))
    active = asked.join(listed, ["key", "salt"]).select("x_url", "x_day", "key", as_of(F.col("versions"), F.col("x_day"))["action"].alias("action")).filter("action IS NOT NULL")
    order = F.struct(F.length("key"), F.col("key"))
    best = active.groupBy("x_url", "x_day").agg(F.count(F.lit(1)).alias("x_n"), F.max(F.struct(order.alias("o"), "key", "action")).alias("x_best"))
    rows = pages.join(best, (url == best["x_url"]) & (day == best["x_day"]), "left")
    action = F.coalesce(F.col("x_best.action"), F.lit("none"))
    out = put(
        rows, host=F.coalesce(host_of(url), F.lit("")), n_active=F.coalesce(F.col("x_n"), F.lit(0)).cast("long"),
        matched=F.substring(F.col("x_best.key"), 3, 1 << 20), verdict=F.when(action == "block", "drop").otherwise("keep"),
    )
    return out.drop("x_url", "x_day", "x_n", "x_best")
