"""Technical index, unified report, opportunities and priorities, search and analytics joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlloom.functions.urls import path_key, segments

# Flags of a page in the order in which they are listed, their severity, and how
# hard and whose they are to mend.
SEVERITY = {"broken": 5.0, "noindex": 4.0, "missing_title": 3.0, "missing_meta": 2.0, "missing_h1": 2.0, "multiple_h1": 1.0, "orphan": 2.0, "thin": 1.5, "thin_critical": 2.5, "canonical_issue": 3.0, "404_with_inlinks": 5.0}
EASE = {
    "missing_title": ("easy", "content"), "missing_meta": ("easy", "content"), "missing_h1": ("easy", "content"), "multiple_h1": ("easy", "content"), "thin": ("moderate", "content"), "thin_critical": ("moderate", "content"),
    "orphan": ("moderate", "seo"), "canonical_issue": ("moderate", "developer"), "noindex": ("moderate", "developer"), "broken": ("hard", "developer"), "404_with_inlinks": ("hard", "developer"),
}
EASE_FACTOR = {"easy": 1.2, "moderate": 1.0, "hard": 0.85}
TYPE_WEIGHT = {"home": 3.0, "category": 2.5, "product": 2.0, "blog": 1.5, "static": 1.0, "other": 1.0}
GROUPS = ("do_now", "needs_content", "needs_developer", "needs_platform", "do_later", "low_impact")
SUPPORTED_PLATFORMS = ("zid", "salla", "shopify")


def table_of(values: dict[str, float | str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def half_up(c: Column, digits: int) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def page_type(url: Column | str, schema_types: Column | None = None) -> Column:
    """home, category, product, blog, static or other: by schema types, else by path segments."""
    segs = F.transform(segments(url), lambda s: F.lower(s))
    last = F.element_at(segs, -1)
    has = lambda names: F.arrays_overlap(segs, F.array(*map(F.lit, names.split())))
    by_path = (
        F.when(F.size(segs) == 0, "home")
        .when(has("product products p item items") & (F.size(segs) >= 2) & ~last.isin("products", "product"), "product")
        .when(has("category categories collection collections c cat tag tags") | last.isin("products", "product", "shop", "store"), "category")
        .when(has("blog blogs article articles news post posts"), "blog")
        .when(has("about contact privacy terms faq pages page policy"), "static")
        .otherwise("other")
    )
    if schema_types is None:
        return by_path
    low = F.transform(schema_types, lambda s: F.lower(s))
    any_of = lambda *names: F.arrays_overlap(low, F.array(*map(F.lit, names)))
    return F.when(any_of("product"), "product").when(any_of("article", "blogposting", "newsarticle"), "blog").when(any_of("collectionpage", "itemlist"), "category").otherwise(by_path)


def technical_index(pages: DataFrame, inlinked: DataFrame, thin: DataFrame, canonical: DataFrame, broken: DataFrame) -> DataFrame:
    """Pages with ``issues``, an array of flags in fixed order: those of the page row, then
    membership of the analyzers' results (each reduced to its urls before the join)."""
    mark = lambda df, name: df.select("url").distinct().withColumn(name, F.lit(True))
    p = pages.select("url", "status_code", F.coalesce("is_indexable", F.lit(False)).alias("is_indexable"), "title", "meta_description_length", "h1_count", "depth", "word_count", "internal_links_count")
    p = p.join(mark(inlinked.where("class = 'orphan'"), "orphan"), "url", "left").join(mark(thin.where("class = 'thin'"), "thin"), "url", "left").join(mark(thin.where("class = 'critical'"), "thin_critical"), "url", "left")
    p = p.join(mark(canonical.where("issue in ('loop', 'to_non_200', 'to_non_indexable', 'external', 'chain')"), "canonical_issue"), "url", "left").join(mark(broken, "b404"), "url", "left")
    s, h1 = F.coalesce("status_code", F.lit(0)), F.coalesce("h1_count", F.lit(0))
    ok = s == 200
    yes = lambda c: F.coalesce(c, F.lit(False))
    when = {
        "broken": s >= 400,
        "noindex": ok & ~F.col("is_indexable"),
        "missing_title": ok & (F.coalesce("title", F.lit("")) == ""),
        "missing_meta": ok & (F.coalesce("meta_description_length", F.lit(0)) == 0),
        "missing_h1": ok & (h1 == 0),
        "multiple_h1": ok & (h1 > 1),
        "orphan": yes("orphan"),
        "thin": yes("thin"),
        "thin_critical": yes("thin_critical"),
        "canonical_issue": yes("canonical_issue"),
        "404_with_inlinks": yes("b404"),
    }
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in when.items()]))
    return p.select("url", path_key("url").alias("path"), s.alias("status_code"), "is_indexable", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("internal_links_count", F.lit(0)).alias("internal_links_count"), issues.alias("issues"))


def by_path(landing: DataFrame) -> DataFrame:
    """(path, sessions, users, engagement_rate): sums by path, the rate weighted by sessions."""
    e = F.sum(F.col("engagement_rate") * F.col("sessions"))
    return landing.groupBy(path_key("path").alias("path")).agg(F.sum("sessions").alias("sessions"), F.sum("users").alias("users"), F.when(F.sum("sessions") > 0, half_up(e / F.sum("sessions"), 4)).otherwise(0.0).alias("engagement_rate"))


def unified(index: DataFrame, search: DataFrame, landing: DataFrame) -> DataFrame:
    """Index with clicks, impressions and position of search pages (page, clicks, impressions,
    position) by address, else by path (the first by address), and sessions by path. Missing is 0."""
    s = search.groupBy("page").agg(F.max_by(F.struct("clicks", "impressions", "position"), F.struct("impressions", "clicks")).alias("s"))
    p = search.groupBy(path_key("page").alias("path")).agg(F.min_by(F.struct("clicks", "impressions", "position"), "page").alias("sp"))
    j = index.join(s, F.col("url") == F.col("page"), "left").join(p, "path", "left").join(by_path(landing), "path", "left")
    pick = F.coalesce("s", "sp")
    z = lambda c, zero=0: F.coalesce(c, F.lit(zero))
    return j.select(*index.columns, z(pick["clicks"]).alias("clicks"), z(pick["impressions"]).alias("impressions"), z(pick["position"], 0.0).alias("position"), z(F.col("sessions")).alias("sessions"), z(F.col("users")).alias("users"), z(F.col("engagement_rate"), 0.0).alias("engagement_rate"))


def severity(issues: Column | str) -> Column:
    m = table_of(SEVERITY)
    return F.aggregate(issues, F.lit(0.0), lambda a, i: a + F.coalesce(F.try_element_at(m, i), F.lit(1.0)))


def top_fix(issues: Column | str) -> Column:
    """The gravest flag, the first of equals."""
    m = table_of(SEVERITY)
    weight = lambda i: F.coalesce(F.try_element_at(m, i), F.lit(1.0))
    return F.aggregate(issues, F.lit("").cast("string"), lambda a, i: F.when((a == "") | (weight(i) > weight(a)), i).otherwise(a))


def opportunities(rows: DataFrame) -> DataFrame:
    """Pages with issues by severity times log demand; without demand, by links inside."""
    raw = F.col("clicks") * 2 + F.col("impressions") * 0.05 + F.col("sessions")
    impact = F.when(raw > 0, F.log1p(raw)).otherwise(F.log1p(F.col("internal_links_count")) * 0.3)
    return rows.where(F.size("issues") > 0).select("url", half_up(impact * severity("issues"), 3).alias("priority_score"), F.size("issues").alias("n_issues"), F.array_join("issues", ", ").alias("technical_issues"), top_fix("issues").alias("top_fix"))


def priorities(rows: DataFrame, platform: str = "") -> DataFrame:
    """Pages with issues by severity x (demand + business + importance) x ease x confidence.

    The band is relative to the largest score: a one-row broadcast, no global window."""
    p = rows.where(F.size("issues") > 0).withColumn("page_type", page_type("url"))
    importance = half_up(F.greatest(F.lit(0.0), table_of(TYPE_WEIGHT)[F.col("page_type")] + F.least(F.lit(2.0), F.log1p(F.greatest(F.col("internal_links_count"), F.lit(0))) * 0.6) - F.least(F.lit(1.0), F.greatest(F.col("depth"), F.lit(0)) * 0.1)), 3)
    demand = F.log1p(F.col("clicks") * 2 + F.col("impressions") * 0.05)
    business = F.log1p(F.col("sessions") * (1 + F.col("engagement_rate") / 100))
    traffic = (F.col("clicks") > 0) | (F.col("impressions") > 0) | (F.col("sessions") > 0)
    confidence = half_up(F.least(F.lit(1.0), 0.7 + F.least(F.lit(0.2), F.size("issues") * 0.05) + F.when(traffic, 0.1).otherwise(0.0)), 3)
    rank = {"easy": 0, "moderate": 4, "hard": 8}
    authority = {"developer": 3, "platform": 2, "content": 1, "seo": 0}
    hardness = table_of({k: rank[d] + authority[o] for k, (d, o) in EASE.items()})
    hardest = F.greatest(F.lit(1), F.array_max(F.transform("issues", lambda i: F.coalesce(F.try_element_at(hardness, i), F.lit(7)))))
    p = p.withColumn("hardest", hardest).withColumn("ease", F.when(F.col("hardest") >= 8, "hard").when(F.col("hardest") >= 4, "moderate").otherwise("easy"))
    owner = F.when(F.col("hardest") % 4 == 3, "developer").when(F.col("hardest") % 4 == 2, "platform").when(F.col("hardest") % 4 == 1, "content").otherwise("seo")
    if platform.lower() in SUPPORTED_PLATFORMS:
        owner = F.when(F.array_contains("issues", "404_with_inlinks"), "platform_support").otherwise(owner)
    score = half_up(severity("issues") * (demand + business + importance) * table_of(EASE_FACTOR)[F.col("ease")] * confidence, 3)
    p = p.withColumn("owner", owner).withColumn("priority_score", score)
    best = F.broadcast(p.agg(F.max("priority_score").alias("best")))
    p = p.join(best, F.lit(True))
    ratio = F.when(F.col("best") > 0, F.col("priority_score") / F.col("best")).otherwise(0.0)
    p = p.withColumn("priority_band", F.when(ratio >= 0.5, "high").when(ratio >= 0.2, "medium").otherwise("low"))
    thin = F.arrays_overlap("issues", F.array(F.lit("thin"), F.lit("thin_critical")))
    group = F.when(F.col("priority_band") == "low", "low_impact").when(F.col("owner") == "platform_support", "needs_platform").when(F.col("owner") == "developer", "needs_developer").when((F.col("owner") == "content") & thin, "needs_content").when(F.col("priority_band") == "high", "do_now").otherwise("do_later")
    return p.select("url", "page_type", "priority_score", "owner", "ease", F.size("issues").alias("n_issues"), F.array_join("issues", ", ").alias("technical_issues"), top_fix("issues").alias("top_fix"), "priority_band", group.alias("action_group"))


def action_board(scored: DataFrame, n: int = 500) -> DataFrame:
    """The first n pages by group, then score, then url; unknown groups last."""
    at = F.array_position(F.array(*map(F.lit, GROUPS)), F.col("action_group"))
    rank = F.when(at == 0, 99).otherwise(at)
    return scored.orderBy(rank, F.desc("priority_score"), "url").limit(n).select("url", "action_group", "priority_score", "priority_band", "owner", "ease", "top_fix")


def cannibalised(rows: DataFrame, least_impressions: int = 10) -> DataFrame:
    """(query, n_pages, impressions, clicks) of queries that several pages answer."""
    return rows.groupBy("query").agg(F.count_distinct("page").alias("n_pages"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")).where((F.col("n_pages") >= 2) & (F.col("impressions") >= least_impressions))


def competing_pages(rows: DataFrame, queries: DataFrame, n: int = 10) -> DataFrame:
    """(query, page, clicks, impressions, rank): the pages of each such query, best first."""
    by_page = rows.groupBy("query", "page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")).join(queries.select("query"), "query", "left_semi")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("clicks"), "page"))
    return by_page.withColumn("rank", rank).where(F.col("rank") <= n)


def link_opportunities(search: DataFrame, inlinks: DataFrame, crawled: DataFrame, least_impressions: int = 100, most_inlinks: int = 2) -> DataFrame:
    """(page, impressions, n_inlinks, in_crawl): pages searched for but hardly linked."""
    n = F.coalesce("n_inlinks", F.lit(0))
    known = crawled.select(F.col("url").alias("page"), F.lit(True).alias("c")).distinct()
    j = search.where(F.col("impressions") >= least_impressions).join(inlinks.withColumnRenamed("url", "page"), "page", "left").where(n <= most_inlinks).join(known, "page", "left")
    return j.select("page", "impressions", n.alias("n_inlinks"), F.coalesce("c", F.lit(False)).alias("in_crawl"))


def search_summary(rows: DataFrame) -> DataFrame:
    """One row: clicks, impressions, click rate in percent, unweighted mean position."""
    return rows.agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), half_up(F.sum("clicks") / F.sum("impressions") * 100, 4).alias("ctr"), half_up(F.sum(F.col("position").cast("decimal(18,4)")).cast("double") / F.count("position"), 2).alias("position"))


def merge_keywords(pages: DataFrame, keywords: DataFrame, n: int = 5) -> DataFrame:
    """(url, n_keywords, traffic, top): keywords (url, keyword, volume, traffic) of each page."""
    totals = keywords.groupBy("url").agg(F.count("*").alias("n_keywords"), F.sum("traffic").alias("traffic"))
    best = keywords.withColumn("rn", F.row_number().over(Window.partitionBy("url").orderBy(F.desc("volume"), "keyword"))).where(F.col("rn") <= n)
    top = best.groupBy("url").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "keyword"))), lambda s: s["keyword"]), ", ").alias("top"))
    return pages.select("url").join(totals, "url", "left").join(top, "url", "left").select("url", F.coalesce("n_keywords", F.lit(0)).alias("n_keywords"), F.coalesce("traffic", F.lit(0)).alias("traffic"), F.coalesce("top", F.lit("")).alias("top"))


def search_totals(pages: DataFrame) -> DataFrame:
    """One row of search pages (clicks, impressions, position): sums, click rate in percent and
    unweighted mean position to two places, pages."""
    n, i = F.count("*"), F.sum("impressions")
    return pages.agg(F.sum("clicks").alias("total_clicks"), i.alias("total_impressions"), F.when(i > 0, half_up(F.sum("clicks") / i * 100, 2)).otherwise(0.0).alias("avg_ctr"), F.when(n > 0, half_up(F.sum(F.coalesce("position", F.lit(0.0)).cast("decimal(18,4)")).cast("double") / n, 2)).otherwise(0.0).alias("avg_position"), n.alias("pages_count"))


def search_top(pages: DataFrame, queries: DataFrame, n: int = 20) -> DataFrame:
    """(kind, name, clicks, impressions): the n pages and the n queries with most clicks."""
    first = lambda df, c, kind: df.select(F.lit(kind).alias("kind"), F.col(c).alias("name"), "clicks", "impressions").orderBy(F.desc("clicks"), "name").limit(n)
    return first(pages, "page", "page").unionByName(first(queries, "query", "query"))


def analytics_summary(landing: DataFrame, channels: DataFrame, n: int = 20) -> DataFrame:
    """(kind, name, sessions, users): one 'total' row named by nothing, the n landing pages with
    most sessions, and all channels (channel, sessions, users)."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    total = landing.agg(z("sessions"), z("users")).select(F.lit("total").alias("kind"), F.lit("").alias("name"), "sessions", "users")
    pages = landing.select(F.lit("landing").alias("kind"), F.col("path").alias("name"), "sessions", "users").orderBy(F.desc("sessions"), "name", F.desc("users")).limit(n)
    return total.unionByName(pages).unionByName(channels.select(F.lit("channel").alias("kind"), F.col("channel").alias("name"), "sessions", "users"))
