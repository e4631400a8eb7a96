"""Lookups and small reports: one address in detail, rendered pages, deferred queue, payloads, cache, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from crawlloom.functions.urls import path_key, without_query


def url_detail(url: str, pages: DataFrame, search: DataFrame, landing: DataFrame, speed: DataFrame, scored: DataFrame) -> DataFrame:
    """One row of what is known of an address: each side is filtered by the literal key before
    it is joined, so every scan is a point lookup that reaches the files."""
    one = lambda df, c, *keep: df.where(F.col(c) == url).select(F.lit(1).alias("k"), *keep).limit(1)
    key = pages.sparkSession.createDataFrame([(1, url)], "k int, url string").withColumn("path", path_key("url"))
    p = one(pages, "url", F.struct(*[c for c in pages.columns if c != "url"]).alias("page"))
    s = one(search, "page", F.struct("clicks", "impressions", "position").alias("search"))
    path = key.first()["path"]
    a = landing.where(path_key("path") == path).agg(F.sum("sessions").alias("sessions")).select(F.lit(1).alias("k"), "sessions")
    v = speed.where(F.col("url") == url).agg(F.collect_list(F.struct(*[c for c in speed.columns if c != "url"])).alias("speed")).select(F.lit(1).alias("k"), "speed")
    r = one(scored, "url", "priority_score", "action_group")
    return key.join(p, "k", "left").join(s, "k", "left").join(a, "k", "left").join(v, "k", "left").join(r, "k", "left").drop("k")


def rendered_diff(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """(url, title_changed, description_changed, canonical_changed, words_added, links_added)
    between the HTML as sent and as rendered; both (url, title, description, canonical, n_words, n_links)."""
    a, b = raw.alias("a"), rendered.alias("b")
    other = lambda c: ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    more = lambda c: F.coalesce(f"b.{c}", F.lit(0)) - F.coalesce(f"a.{c}", F.lit(0))
    return a.join(b, F.col("a.url") == F.col("b.url")).select("a.url", other("title").alias("title_changed"), other("description").alias("description_changed"), other("canonical").alias("canonical_changed"), more("n_words").alias("words_added"), more("n_links").alias("links_added"))


def deferred_summary(deferred: DataFrame, samples: int = 10) -> DataFrame:
    """(kind, n, samples): counts and the first addresses of each kind; the sample is cut
    before the shuffle."""
    from crawlloom.operators.graph import first_per_group

    some = first_per_group(deferred.select("kind", "url").distinct(), "kind", samples, F.col("url")).groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("samples"))
    return deferred.groupBy("kind").agg(F.count("*").alias("n")).join(some, "kind")


def summary_payload(issues: DataFrame, scored: DataFrame, n_issues: int = 20, n_pages: int = 15) -> DataFrame:
    """One JSON row: the gravest issues and first opportunities, addresses without queries."""
    a = issues.orderBy(F.desc("affected_count"), "issue_type").limit(n_issues).agg(F.sort_array(F.collect_list(F.struct("affected_count", "issue_type")), False).alias("issues"))
    b = scored.orderBy(F.desc("priority_score"), "url").limit(n_pages).agg(F.sort_array(F.collect_list(F.struct("priority_score", without_query("url").alias("url"))), False).alias("opportunities"))
    return a.join(b, F.lit(True)).select(F.to_json(F.struct("issues", "opportunities")).alias("payload"))


def inlinks_of(url: str, links: DataFrame) -> DataFrame:
    """The links whose target, normalised or as found, is ``url``: a filter that reaches the files."""
    return links.where((F.col("to_url_normalized") == url) | (F.col("to_url") == url))


# The tables of a crawl, in the order they are reported.
CRAWL_TABLES = ("pages", "links", "images", "headings", "schema_entries", "http_headers", "redirects", "external_link_status", "crawl_queue", "visited_urls")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of a crawl's tables; 0 for one that isn't there."""
    spark = SparkSession.getActiveSession() if not tables else next(iter(tables.values())).sparkSession
    every = spark.createDataFrame([(t,) for t in CRAWL_TABLES], "table_name string")
    counted = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items() if name in CRAWL_TABLES]
    if not counted:
        return every.withColumn("n_rows", F.lit(0).cast("long"))
    return every.join(F.broadcast(reduce(DataFrame.unionByName, counted)), "table_name", "left").select("table_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def next_in_queue(queue: DataFrame, n: int = 1) -> DataFrame:
    """The next n of a crawl queue (url, depth, priority, added_at): highest priority, then the
    oldest, then by url; what stays is the queue without them (left_anti on url)."""
    return queue.orderBy(F.desc("priority"), F.asc_nulls_last("added_at"), "url").limit(n)


def labelled(parts: dict[str, DataFrame], label: str = "issue") -> DataFrame:
    """One table of several, each row with the name of the one it comes from; columns that only
    some have are null in the others."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select(F.lit(name).alias(label), *df.columns) for name, df in parts.items()])


def metrics_snapshot(events: DataFrame, recent: int = 500) -> DataFrame:
    """One JSON row of metric events (at, kind, name, value): counters summed, the last value of
    gauges, count, total, mean, least and most of timings in hundredths, and the last events."""
    half = lambda c: F.floor(c * 100 + 0.5) / 100
    by = events.groupBy("kind", "name").agg(F.sum("value").alias("s"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.max_by("value", F.struct("at", "value")).alias("last"))
    entry = lambda kind, value: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", value))))
    timing = F.struct(F.col("n").alias("count"), half(F.col("s")).alias("total_ms"), half(F.col("s") / F.col("n")).alias("avg_ms"), half(F.col("lo")).alias("min_ms"), half(F.col("hi")).alias("max_ms")).alias("v")
    wide = by.agg(entry("counter", F.col("s").alias("v")).alias("c"), entry("gauge", F.col("last").alias("v")).alias("g"), entry("timing", timing).alias("t"))
    last = events.where("kind = 'event'").orderBy(F.desc("at"), "name").limit(recent).agg(F.array_sort(F.collect_list(F.struct("at", "name", "value"))).alias("recent_events"))
    table = lambda c: F.map_from_entries(c)
    return wide.join(last, F.lit(True)).select(F.to_json(F.struct(table("c").alias("counters"), table("g").alias("gauges"), table("t").alias("timings"), "recent_events")).alias("metrics"))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def cache_valid(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def observed(df: DataFrame, name: str, timing: str | None = None) -> tuple[DataFrame, Observation]:
    """A frame whose rows are counted (and whose column ``timing`` is summed up) as it is used."""
    o = Observation(name)
    more = [F.sum(timing).alias("total"), F.avg(timing).alias("mean"), F.min(timing).alias("least"), F.max(timing).alias("most")] if timing else []
    return df.observe(o, F.count(F.lit(1)).alias("n"), *more), o
