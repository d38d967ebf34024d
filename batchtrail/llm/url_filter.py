"""URL filters by a temporal list join: the list entries that were active when a page was fetched decide.

Dated entries (pattern added or removed on a list) become validity intervals.
Captures become the patterns that could match them: the host, its parent
domains and the leading path segments under the host.  Both sides meet by
pattern *and* day: an interval is written once for each day that it touches and
on which some capture asks for its pattern, however long it is active.  So the
join is a plain equi-join whose hot hosts are spread over days, and the as-of
condition is a filter inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from batchtrail.llm.common import kept_columns


def url_host(url: Column) -> Column:
    """Lower-case host without scheme, user, port and final dot; null for null or a URL without a host."""
    rest = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    return F.when(F.length(bare) > 0, F.lower(bare))


def url_path(url: Column) -> Column:
    """Path segments, without empty ones, query and fragment."""
    path = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: F.length(s) > 0)


def deepest(entries: DataFrame) -> tuple[int, int]:
    """Most domain levels and most path segments of a pattern; no deeper part of a URL can match."""
    parts = F.split("pattern", "/")
    row = entries.agg(F.max(F.size(F.split(parts[0], r"\."))).alias("levels"), F.max(F.size(parts) - 1).alias("segments")).first()
    return row["levels"] or 0, row["segments"] or 0


def candidate_patterns(host: Column, path: Column, domain_levels: int, path_levels: int) -> Column:
    """Array of ``(pattern, specificity)``: domains from the top level down, then host/segment, host/segment/segment...

    Domains of at most ``domain_levels`` levels and the whole host, paths of at most ``path_levels`` segments.
    """
    labels = F.split(host, r"\.")
    depth = F.least(F.size(labels), F.lit(max(1, domain_levels)))
    domains = F.transform(F.sequence(F.lit(1), depth), lambda k: F.struct(
        F.concat_ws(".", F.slice(labels, F.size(labels) - k + 1, k)).alias("pattern"), k.alias("specificity")))
    whole = F.array(F.struct(host.alias("pattern"), (F.size(labels)).alias("specificity")))
    levels = F.least(F.size(path), F.lit(path_levels))
    prefixes = F.when(levels >= 1, F.transform(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), lambda k: F.struct(
        F.concat(host, F.lit("/"), F.concat_ws("/", F.slice(path, 1, k))).alias("pattern"), (k + 1000).alias("specificity"))))
    return F.array_distinct(F.concat(domains, whole, F.coalesce(prefixes, F.slice(whole, 1, 0))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """``entries(list, pattern, at, action)`` -> ``(list, pattern, valid_from, valid_to)``, the times on the list.

    ``action`` is 'add' or 'remove'; each change holds until the next change of the
    same list and pattern (``valid_to`` excluded, null while it still holds).  Of
    changes at the same moment a removal wins.  Entries with a null in any column
    say nothing.
    """
    clean = (entries.where("list is not null and pattern is not null and at is not null and action in ('add', 'remove')")
             .groupBy("list", F.lower("pattern").alias("pattern"), "at").agg(F.max("action").alias("action")))
    after = Window.partitionBy("list", "pattern").orderBy("at")
    return (clean.withColumn("valid_to", F.lead("at").over(after)).where("action = 'add'")
            .select("list", "pattern", F.col("at").alias("valid_from"), "valid_to"))


def matches(captures: DataFrame, entries: DataFrame, key: str, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """Every list entry active at each capture: ``(key, list, pattern, specificity, valid_from)``."""
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    levels, segments = deepest(entries)
    asked = (captures.where(F.col(time_col).isNotNull())
             .select(F.col(key).alias("__key"), F.col(time_col).alias("__t"), host.alias("__host"), path.alias("__path"))
             .where("__host is not null")
             .withColumn("__c", F.explode(candidate_patterns(F.col("__host"), F.transform("__path", F.lower), levels, segments)))
             .select("__key", "__t", F.to_date("__t").alias("__day"), F.col("__c.pattern").alias("pattern"),
                     F.col("__c.specificity").alias("specificity")))
    # an entry is written for those days alone on which some capture asks for its pattern, however long it is active
    days = asked.select("pattern", "__day").distinct()
    spans = (validity_intervals(entries).join(days, "pattern")
             .where((F.to_date("valid_from") <= F.col("__day")) & (F.col("valid_to").isNull() | (F.col("__day") <= F.to_date("valid_to")))))
    return (asked.join(spans, ["pattern", "__day"])
            .where((F.col("valid_from") <= F.col("__t")) & (F.col("valid_to").isNull() | (F.col("__t") < F.col("valid_to"))))
            .select(F.col("__key").alias(key), "list", "pattern", "specificity", "valid_from"))


def judge(captures: DataFrame, entries: DataFrame, allow: str = "allow", key: str = "page_id", url_col: str = "url",
          time_col: str = "fetched_at") -> DataFrame:
    """``captures`` with ``verdict, list, pattern, active``; rows and columns are kept, columns of these names replaced.

    The most specific active entry decides (a longer path before a shorter one,
    paths before hosts, hosts before domains); of equally specific ones the list
    ``allow`` wins, then the later, then the list's name.  ``verdict`` is 'allowed'
    or 'blocked' by an entry, 'unlisted' without one and 'unknown' where the URL
    has no host or the fetch time is null.  ``active`` counts the active entries.
    Rows that share a key are judged each; a null key is kept.  Empty lists leave
    all unlisted; empty captures give no rows.
    """
    # the columns of a capture travel in one struct, so that none can clash with those of the work
    numbered = captures.select(F.struct("*").alias("__all"), F.struct(F.col(key), F.col(url_col), F.col(time_col)).alias("__row"),
                               F.col(url_col).alias("__url"), F.col(time_col).alias("__time"))
    distinct = numbered.select("__row", "__url", "__time").distinct()
    rank = F.struct("specificity", (F.col("list") == allow).alias("allowed"), "valid_from", "list", "pattern")
    best = (matches(distinct, entries, "__row", "__url", "__time").groupBy("__row")
            .agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("active")))
    joined = numbered.join(best.withColumnRenamed("__row", "__of"), numbered["__row"].eqNullSafe(F.col("__of")), "left")
    usable = url_host(F.col("__url")).isNotNull() & F.col("__time").isNotNull()
    verdict = (F.when(~usable, "unknown").when(F.col("best").isNull(), "unlisted")
               .when(F.col("best.allowed"), "allowed").otherwise("blocked"))
    return joined.select(*kept_columns(captures.columns, "verdict", "list", "pattern", "active"), verdict.alias("verdict"), F.col("best.list").alias("list"),
                         F.col("best.pattern").alias("pattern"), F.coalesce("active", F.lit(0)).alias("active"))
