"""Language alternates, structured data, sitemaps, headers, resources, accessibility, spelling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlloom.functions.text import HREFLANG, hreflang_code


def hreflang_audit(tags: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, issue, detail) of tags (url, hreflang, href) against pages (url, status_code,
    is_indexable, language): invalid_code, duplicate_lang, missing_x_default, missing_self,
    to_non_200, to_noindex, language_mismatch, no_return. An alternate that was crawled and
    has no tag back, or no tags at all, is no_return."""
    t = tags.where("url is not null and href is not null").select("url", "href", F.coalesce("hreflang", F.lit("")).alias("raw"), hreflang_code(F.coalesce("hreflang", F.lit(""))).alias("code"))
    p = pages.select(F.col("url").alias("p_url"), "status_code", F.coalesce("is_indexable", F.lit(False)).alias("is_indexable"), "language")
    parts = [t.where(~F.col("code").rlike(HREFLANG)).select("url", F.lit("invalid_code").alias("issue"), F.col("raw").alias("detail"))]
    by_code = t.groupBy("url", F.lower("raw").alias("detail")).agg(F.count_distinct("href").alias("n")).where("n > 1")
    parts.append(by_code.select("url", F.lit("duplicate_lang").alias("issue"), "detail"))
    source = t.groupBy("url").agg(F.bool_or(F.col("code") == "x-default").alias("x"), F.bool_or(F.col("href") == F.col("url")).alias("self"))
    parts.append(source.where("not x").select("url", F.lit("missing_x_default").alias("issue"), F.lit("").alias("detail")))
    parts.append(source.where("not self").select("url", F.lit("missing_self").alias("issue"), F.lit("").alias("detail")))
    target = t.join(p, F.col("href") == F.col("p_url"))
    parts.append(target.where("status_code <> 200").select("url", F.lit("to_non_200").alias("issue"), F.col("href").alias("detail")))
    parts.append(target.where("status_code = 200 and not is_indexable").select("url", F.lit("to_noindex").alias("issue"), F.col("href").alias("detail")))
    said = F.lower(F.substring_index("code", "-", 1))
    is_lang = F.lower(F.regexp_extract(F.coalesce("language", F.lit("")), "^([A-Za-z]{2})(?:[-_].*)?$", 1))
    parts.append(target.where((F.col("code") != "x-default") & (is_lang != "") & (is_lang != said)).select("url", F.lit("language_mismatch").alias("issue"), F.col("href").alias("detail")))
    back = t.select(F.col("url").alias("href"), F.col("href").alias("url")).distinct()
    parts.append(target.where("href <> url").join(back, ["url", "href"], "left_anti").select("url", F.lit("no_return").alias("issue"), F.col("href").alias("detail")))
    return reduce(DataFrame.unionByName, parts).distinct()


# Required and recommended properties of rich results by type.
REQUIREMENTS = {
    "Product": ("name", "image"),
    "Offer": ("price", "priceCurrency", "availability"),
    "Organization": ("name",),
    "LocalBusiness": ("name", "address"),
    "BreadcrumbList": ("itemListElement",),
    "FAQPage": ("mainEntity",),
    "Article": ("headline", "image", "datePublished", "author"),
    "BlogPosting": ("headline", "image", "datePublished", "author"),
    "NewsArticle": ("headline", "image", "datePublished", "author"),
    "Recipe": ("name", "image", "recipeIngredient", "recipeInstructions"),
    "Review": ("itemReviewed", "reviewRating", "author"),
    "AggregateRating": ("ratingValue", "reviewCount"),
    "Event": ("name", "startDate", "location"),
    "VideoObject": ("name", "description", "thumbnailUrl", "uploadDate"),
    "Person": ("name",),
    "Course": ("name", "description", "provider"),
    "JobPosting": ("title", "description", "datePosted", "hiringOrganization", "jobLocation"),
    "SoftwareApplication": ("name", "operatingSystem", "applicationCategory"),
    "WebSite": ("name", "url"),
    "WebPage": (),
}
RECOMMENDATIONS = {
    "Product": ("description", "brand", "offers", "aggregateRating", "review", "sku"),
    "Offer": ("url", "validFrom", "priceValidUntil"),
    "Organization": ("url", "logo", "sameAs", "contactPoint", "address"),
    "LocalBusiness": ("telephone", "openingHours", "geo", "url", "image"),
    "Article": ("dateModified", "publisher", "mainEntityOfPage", "description"),
    "BlogPosting": ("dateModified", "publisher", "description"),
    "NewsArticle": ("dateModified", "publisher", "description"),
    "Recipe": ("nutrition", "totalTime", "recipeYield", "aggregateRating"),
    "Review": ("datePublished", "reviewBody"),
    "AggregateRating": ("bestRating", "worstRating"),
    "Event": ("endDate", "description", "image", "offers", "performer"),
    "VideoObject": ("duration", "contentUrl", "embedUrl"),
    "Person": ("image", "url", "jobTitle", "sameAs"),
    "Course": ("offers", "hasCourseInstance"),
    "JobPosting": ("validThrough", "employmentType", "baseSalary"),
    "SoftwareApplication": ("aggregateRating", "offers", "description"),
    "WebSite": ("potentialAction",),
    "WebPage": ("name", "description"),
}
# Types a site should have somewhere, and those that stand in for them.
EXPECTED_TYPES = (("Organization", ("Organization", "LocalBusiness")), ("BreadcrumbList", ("BreadcrumbList",)), ("WebSite", ("WebSite",)))


def falsy(json: Column) -> Column:
    """What a script takes for missing: absent, null, '', 0, false, [] and {}."""
    return json.isNull() | F.trim(json).isin("", "0", "0.0", "false", "null", "[]", "{}")


def schema_audit(entries: DataFrame) -> DataFrame:
    """(page_url, type, state, missing) of structured-data entries (page_url, type, raw_data as
    JSON): the first of several types counts; invalid lacks a required property, incomplete a
    recommended one, eligible neither; types without requirements are unknown."""
    kind = F.trim(F.substring_index(F.coalesce("type", F.lit("")), ",", 1))
    spread = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    e = entries.select("page_url", kind.alias("type"), F.from_json("raw_data", "map<string,string>").alias("m"))
    lacking = lambda names: F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: falsy(F.try_element_at(F.col("m"), n)))
    req, rec = lacking(F.try_element_at(spread(REQUIREMENTS), F.col("type"))), lacking(F.try_element_at(spread(RECOMMENDATIONS), F.col("type")))
    state = F.when(~F.col("type").isin(*REQUIREMENTS), "unknown").when(F.size(req) > 0, "invalid").when(F.size(rec) > 0, "incomplete").otherwise("eligible")
    return e.select("page_url", "type", state.alias("state"), F.array_join(F.when(F.size(req) > 0, req).otherwise(rec), ",").alias("missing"))


def schema_types(entries: DataFrame) -> DataFrame:
    """(type, n): how often each type occurs; an entry with several counts for each."""
    kinds = F.transform(F.split(F.coalesce("type", F.lit("")), ","), lambda t: F.trim(t))
    return entries.select(F.explode(kinds).alias("type")).where("type <> ''").groupBy("type").agg(F.count("*").alias("n"))


def schema_opportunities(entries: DataFrame) -> DataFrame:
    """(missing_type): types that a site should have and that no entry has; none without entries."""
    have = schema_types(entries).agg(F.collect_set(F.when(F.col("type").isin(*[t for _, ts in EXPECTED_TYPES for t in ts]), F.col("type"))).alias("have"), F.count("*").alias("n"))
    lacking = [F.when(~F.arrays_overlap("have", F.array(*map(F.lit, ts))), F.lit(name)) for name, ts in EXPECTED_TYPES]
    return have.where("n > 0").select(F.explode(F.array_compact(F.array(*lacking))).alias("missing_type"))


def sitemap_diff(sitemap: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, issue): not_crawled, in_sitemap_4xx, in_sitemap_redirect, in_sitemap_noindex,
    in_sitemap_canonicalised, not_in_sitemap, important_not_in_sitemap (depth <= 2): one full
    join. A page that doesn't say is indexable here."""
    s = sitemap.select("url").where("url is not null").distinct().withColumn("in_map", F.lit(True))
    p = pages.select("url", F.coalesce("status_code", F.lit(0)).alias("status"), F.coalesce("is_indexable", F.lit(True)).alias("ix"), F.coalesce("canonical", F.lit("")).alias("canonical"), F.coalesce("depth", F.lit(99)).alias("depth"), F.lit(True).alias("crawled"))
    j = s.join(p, "url", "full")
    both, only_page = F.col("in_map") & F.col("crawled"), F.col("in_map").isNull()
    fine = (F.col("status") == 200) & F.col("ix")
    issue = lambda name, when: F.when(when, F.lit(name))
    flags = F.array(
        issue("not_crawled", F.col("crawled").isNull()),
        issue("in_sitemap_4xx", both & F.col("status").between(400, 499)),
        issue("in_sitemap_redirect", both & F.col("status").between(300, 399)),
        issue("in_sitemap_noindex", both & (F.col("status") == 200) & ~F.col("ix")),
        issue("in_sitemap_canonicalised", both & fine & (F.col("canonical") != "") & (F.col("canonical") != F.col("url"))),
        issue("not_in_sitemap", only_page & fine),
        issue("important_not_in_sitemap", only_page & fine & (F.col("depth") <= 2)),
    )
    return j.select("url", F.explode(F.array_compact(flags)).alias("issue"))


def sitemap_coverage(sitemap: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: pages in the sitemap, crawled ones among them, and their share in percent."""
    s = sitemap.select("url").where("url is not null").distinct()
    j = s.join(pages.select("url", F.lit(True).alias("c")).distinct(), "url", "left")
    n, c = F.count("*"), F.count("c")
    return j.agg(n.alias("n_sitemap"), c.alias("n_crawled"), F.when(n > 0, F.floor(c / n * 10000 + 0.5) / 100).otherwise(0.0).alias("coverage"))


# Headers that a page should send, and how grave it is if not.
SECURITY_HEADERS = (("hsts_enabled", "high"), ("csp", "medium"), ("x_frame_options", "medium"), ("x_content_type_options", "low"), ("referrer_policy", "low"), ("permissions_policy", "low"))


def security_audit(pages: DataFrame, headers: DataFrame, mixed: DataFrame | None = None) -> DataFrame:
    """(url, issue, severity) of 200 pages: not_https, missing headers, and mixed_content for
    the pages of ``mixed`` (url); headers are joined on the raw address, and a page without a
    header row lacks them all."""
    h = headers.select(F.col("page_url").alias("h_url"), *[n for n, _ in SECURITY_HEADERS])
    j = pages.where("status_code = 200").join(h, F.col("url") == F.col("h_url"), "left")
    missing = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")).isin("", "false")
    one = lambda when, n, s: F.when(when, F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity")))
    flags = [one(~F.lower("url").startswith("https://"), "not_https", "high"), *[one(missing(n), f"missing_{n}", s) for n, s in SECURITY_HEADERS]]
    if mixed is not None:
        j = j.join(mixed.select("url", F.lit(True).alias("_mixed")).distinct(), "url", "left")
        flags.append(one(F.col("_mixed"), "mixed_content", "high"))
    flags = F.array(*flags)
    return j.select("url", F.explode(F.array_compact(flags)).alias("i")).select("url", "i.*")


def resource_inventory(resources: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """(resource_type, n, n_unique, n_internal, n_mixed, n_broken) of resources (page_url, url,
    resource_type, is_internal, is_mixed_content) with the status of each address where known."""
    r = resources
    r = r.join(statuses.select("url", "status_code"), "url", "left") if statuses is not None else r.withColumn("status_code", F.lit(None).cast("int"))
    return r.groupBy("resource_type").agg(F.count("*").alias("n"), F.count_distinct("url").alias("n_unique"), F.count_if("is_internal").alias("n_internal"), F.count_if("is_mixed_content").alias("n_mixed"), F.count_if(F.col("status_code") >= 400).alias("n_broken"))


IMPACTS = ("critical", "serious", "moderate", "minor")


def accessibility_summary(results: DataFrame) -> DataFrame:
    """(impact, n_violations, n_nodes, rank) of axe results (url, violations as JSON)."""
    v = F.from_json("violations", "array<struct<id:string,impact:string,help:string,nodes:array<string>>>")
    rows = results.select(F.explode(v).alias("v")).select(F.coalesce("v.impact", F.lit("minor")).alias("impact"), F.coalesce(F.size("v.nodes"), F.lit(0)).alias("n"))
    rank = F.array_position(F.array(*map(F.lit, IMPACTS)), F.col("impact")).cast("int")
    return rows.groupBy("impact").agg(F.count("*").alias("n_violations"), F.sum("n").alias("n_nodes")).withColumn("rank", rank)


SPELLING_LANGUAGES = ("en", "es", "fr", "pt", "de", "it", "ru", "nl")


def spelling(pages: DataFrame, dictionary: DataFrame, n: int = 30) -> DataFrame:
    """(lang, word, n_pages): the commonest words of titles, descriptions and first headings
    that the dictionary (lang, word) lacks, by language; a word counts once a page."""
    lang = F.lower(F.regexp_extract(F.coalesce("language", F.lit("")), "^([A-Za-z]{2})(?:[-_].*)?$", 1))
    text = F.concat_ws(" ", "title", "meta_description", F.get("h1_text", F.lit(0)))
    tokens = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z]{3,})"), 1), lambda w: F.lower(w)))
    rows = pages.select(lang.alias("lang"), F.explode(tokens).alias("word")).where(F.col("lang").isin(*SPELLING_LANGUAGES))
    counted = rows.groupBy("lang", "word").agg(F.count("*").alias("n_pages")).join(dictionary.select("lang", "word").distinct(), ["lang", "word"], "left_anti")
    return counted.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_pages"), "word"))).where(F.col("rn") <= n).drop("rn")


def pagination_audit(pages: DataFrame) -> DataFrame:
    """(url, issue) of pages (url, status_code, is_indexable, canonical, pagination_next,
    pagination_prev): first_page, non_self_canonical, next_not_ok, next_noindex,
    broken_sequence (the next page's prev is another), prev_not_ok."""
    p = pages.where("pagination_next is not null or pagination_prev is not null")
    side = lambda tag: pages.select(F.col("url").alias(f"{tag}_url"), F.col("status_code").alias(f"{tag}_status"), F.coalesce("is_indexable", F.lit(False)).alias(f"{tag}_ix"), F.col("pagination_prev").alias(f"{tag}_prev"))
    j = p.join(side("n"), F.col("pagination_next") == F.col("n_url"), "left").join(side("v"), F.col("pagination_prev") == F.col("v_url"), "left")
    known = F.col("n_url").isNotNull()
    issue = lambda name, when: F.when(when, F.lit(name))
    flags = F.array(
        issue("first_page", F.col("pagination_prev").isNull()),
        issue("non_self_canonical", (F.coalesce("canonical", F.lit("")) != "") & (F.col("canonical") != F.col("url"))),
        issue("next_not_ok", known & (F.col("n_status") != 200)),
        issue("next_noindex", known & (F.col("n_status") == 200) & ~F.col("n_ix")),
        issue("broken_sequence", known & (F.coalesce("n_prev", F.lit("")) != F.col("url"))),
        issue("prev_not_ok", F.col("v_url").isNotNull() & (F.col("v_status") != 200)),
    )
    return j.select("url", F.explode(F.array_compact(flags)).alias("issue"))


BLOCKED = (401, 403, 429)


def external_status(statuses: DataFrame) -> DataFrame:
    """(class, n): ok, broken (>= 400, but not blocked), blocked (401, 403, 429), error."""
    s = F.col("status_code")
    cls = F.when(F.col("error").isNotNull(), "error").when(s.isin(*BLOCKED), "blocked").when(s >= 400, "broken").otherwise("ok")
    return statuses.groupBy(cls.alias("class")).agg(F.count("*").alias("n"))


def broken_external(statuses: DataFrame) -> DataFrame:
    """The external addresses (url, status_code, error) that answer 400 or more without only
    barring crawlers, or that gave an error."""
    s = F.col("status_code")
    return statuses.where(((s >= 400) & ~s.isin(*BLOCKED)) | F.col("error").isNotNull())


def unchecked_external(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Distinct external http(s) targets without a known status (null-safe anti join)."""
    want = links.where("not is_internal and not is_special_link").select(F.col("to_url_normalized").alias("url")).where(F.col("url").rlike("^https?://")).distinct()
    return want.join(statuses.select("url"), "url", "left_anti")
