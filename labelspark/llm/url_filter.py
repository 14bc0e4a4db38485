"""URL filters: an as-of join of captures with dated list entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("domain", "host", "prefix")


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries (list, kind, pattern, action, at) as intervals (list, kind, pattern, since, until):
    an entry holds from an `add` until the next event of its list, kind and pattern; until is null while
    it holds. Of events at one time a `remove` wins. Entries with a null in list, kind, pattern,
    action or at are void."""
    whole = entries.select("list", "kind", "pattern", "action", "at").dropna()
    one = whole.groupBy("list", "kind", "pattern", "at").agg(F.max(F.col("action") == "remove").alias("removed"))
    order = Window.partitionBy("list", "kind", "pattern").orderBy("at")
    return (
        one.withColumn("until", F.lead("at").over(order)).filter(~F.col("removed"))
        .select("list", "kind", "pattern", F.col("at").alias("since"), "until")
    )


def url_keys(url: Column) -> Column:
    """Everything of a url that an entry can name, as (kind, pattern): the host, each of its domains
    with two labels or more, and host + path up to each slash."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)?", 1)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(steps)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))
    )
    of = lambda kind, items: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("pattern")))
    keys = F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern"))), of("domain", domains), of("prefix", prefixes))
    return F.when(host != "", F.array_distinct(keys))


def _months(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """One row per row of `captures`: page_id, url, fetched_at, n_active (entries that hold for the url
    at fetch time), lists (their lists, sorted), first_since (start of the oldest), blocked.

    Entries become validity intervals, cut by month, so the join is on (kind, pattern, month) and a
    capture meets only entries of its month; within it since <= fetched_at < until. A hot host meets
    its few entries in a join that Spark can split. Distinct (url, time) pairs are joined once.

    A capture with a null url, a url without host or a null time has n_active 0 and is not blocked.
    Repeated captures give a row each. Empty tables give an empty result or nothing blocked.
    """
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(at_col).alias("fetched_at"))
    keyed = rows.dropna(subset=["url", "fetched_at"]).select("url", "fetched_at").distinct().withColumn("month", _months(F.col("fetched_at")))
    keys = keyed.select("url", "fetched_at", "month", F.explode(url_keys(F.col("url"))).alias("k")).select("url", "fetched_at", "month", "k.*")
    span = validity(entries)
    # The months of the captures bound the intervals: two numbers.
    first, last = rows.agg(_months(F.min("fetched_at")), _months(F.max("fetched_at"))).first()
    since = F.greatest(_months(F.col("since")), F.lit(first))
    until = F.least(F.coalesce(_months(F.col("until")), F.lit(last)), F.lit(last))
    cut = span.filter(since <= until).withColumn("month", F.explode(F.sequence(since, until)))
    hits = keys.join(cut, ["kind", "pattern", "month"]).filter(
        (F.col("since") <= F.col("fetched_at")) & (F.col("until").isNull() | (F.col("fetched_at") < F.col("until")))
    )
    found = hits.groupBy("url", "fetched_at").agg(
        F.count(F.lit(1)).alias("n_active"), F.array_sort(F.collect_set("list")).alias("lists"), F.min("since").alias("first_since")
    )
    return rows.join(found, ["url", "fetched_at"], "left").select(
        "page_id", "url", "fetched_at", F.coalesce("n_active", F.lit(0).cast("long")).alias("n_active"),
        F.coalesce("lists", F.array().cast("array<string>")).alias("lists"), "first_since",
        F.coalesce(F.array_contains("lists", "block") & ~F.array_contains("lists", "allow"), F.lit(False)).alias("blocked"),
    )
