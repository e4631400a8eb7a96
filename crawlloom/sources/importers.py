"""Flattening of audit and API payloads landed as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlloom.functions.urls import host

AUDIT = "struct<id:string,title:string,score:string,scoreDisplayMode:string,displayValue:string,numericValue:double,details:string>"


def _lighthouse(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.lighthouseResult"), payload)


def _speed_columns() -> dict[str, Column]:
    j = _lighthouse(F.col("payload"))
    num = lambda path: F.get_json_object(j, path).cast("double")
    field = lambda k: F.get_json_object("payload", f"$.loadingExperience.metrics.{k}.percentile").cast("double")
    scores = {a: F.floor(num(f"$.categories.{k}.score") * 100 + 0.5).cast("int") for k, a in (("performance", "performance"), ("accessibility", "accessibility"), ("best-practices", "best_practices"), ("seo", "seo"))}
    lab = {a: num(f"$.audits.{k}.numericValue") for k, a in (("first-contentful-paint", "fcp"), ("largest-contentful-paint", "lcp"), ("total-blocking-time", "tbt"), ("cumulative-layout-shift", "cls"), ("speed-index", "speed_index"), ("interactive", "tti"))}
    real = {a: field(k) for k, a in (("LARGEST_CONTENTFUL_PAINT_MS", "field_lcp"), ("INTERACTION_TO_NEXT_PAINT", "field_inp"), ("CUMULATIVE_LAYOUT_SHIFT_SCORE", "field_cls"), ("FIRST_CONTENTFUL_PAINT_MS", "field_fcp"), ("EXPERIMENTAL_TIME_TO_FIRST_BYTE", "field_ttfb"))}
    return scores | lab | real | {"overall": F.get_json_object("payload", "$.loadingExperience.overall_category")}


def speed_metrics(raw: DataFrame) -> DataFrame:
    """(url, four scores in percent, lab and field metrics, overall category) of (url, payload)."""
    return raw.select("url", *[c.alias(n) for n, c in _speed_columns().items()])


def flatten_speed(raw: DataFrame) -> DataFrame:
    """The exported speed table of (url, payload): scores, three lab metrics, and the categories
    that the payload gives the field metrics ('' where there is none)."""
    c = _speed_columns()
    band = lambda k: F.coalesce(F.get_json_object("payload", f"$.loadingExperience.metrics.{k}.category"), F.lit(""))
    return raw.select(
        "url", *[c[n].alias(n) for n in ("performance", "accessibility", "best_practices", "seo")], c["lcp"].alias("lcp_lab_ms"), c["cls"].alias("cls_lab"), c["tbt"].alias("tbt_lab_ms"),
        F.coalesce(c["overall"], F.lit("")).alias("crux_overall"), band("LARGEST_CONTENTFUL_PAINT_MS").alias("lcp_field"), band("CUMULATIVE_LAYOUT_SHIFT_SCORE").alias("cls_field"), band("INTERACTION_TO_NEXT_PAINT").alias("inp_field"),
    )


def audits(raw: DataFrame) -> DataFrame:
    """(url, audit_id, title, score, mode, display_value): one row an audit."""
    m = F.from_json(F.get_json_object(_lighthouse(F.col("payload")), "$.audits"), f"map<string,{AUDIT}>")
    x = raw.select("url", F.explode(m).alias("k", "a"))
    return x.select("url", F.col("k").alias("audit_id"), F.col("a.title").alias("title"), F.expr("try_cast(a.score as double)").alias("score"), F.col("a.scoreDisplayMode").alias("mode"), F.col("a.displayValue").alias("display_value"))


def failed_audits(raw: DataFrame) -> DataFrame:
    return audits(raw).where("mode in ('binary', 'numeric') and score < 1")


def _items(raw: DataFrame, audit: str, path: str, item: str) -> DataFrame:
    j = F.get_json_object(_lighthouse(F.col("payload")), f"$.audits.{audit}.details.{path}")
    return raw.select("url", F.explode(F.from_json(j, f"array<{item}>")).alias("i"))


def network_requests(raw: DataFrame) -> DataFrame:
    x = _items(raw, "network-requests", "items", "struct<url:string,resourceType:string,statusCode:int,transferSize:bigint,mimeType:string>")
    return x.select("url", F.col("i.url").alias("request_url"), F.col("i.resourceType").alias("resource_type"), F.col("i.statusCode").alias("status_code"), F.col("i.transferSize").alias("transfer_size"), F.col("i.mimeType").alias("mime_type"))


def script_treemap(raw: DataFrame) -> DataFrame:
    """(url, script, bytes, unused_bytes, unused_pct): one decimal, 0 where there are no bytes."""
    x = _items(raw, "script-treemap-data", "nodes", "struct<name:string,resourceBytes:bigint,unusedBytes:bigint>")
    n, u = F.coalesce("i.resourceBytes", F.lit(0)), F.coalesce("i.unusedBytes", F.lit(0))
    return x.select("url", F.col("i.name").alias("script"), n.alias("bytes"), u.alias("unused_bytes"), F.when(n > 0, F.floor(u / n * 1000 + 0.5) / 10).otherwise(0.0).alias("unused_pct"))


def speed_opportunities(raw: DataFrame, n: int = 10) -> DataFrame:
    """(url, audit_id, savings_ms, rank): the audits that would save most, by page."""
    m = F.from_json(F.get_json_object(_lighthouse(F.col("payload")), "$.audits"), "map<string,struct<details:struct<type:string,overallSavingsMs:double>>>")
    kept = F.filter(F.map_entries(m), lambda e: (e["value"]["details"]["type"] == "opportunity") & (e["value"]["details"]["overallSavingsMs"] > 0))
    best = F.slice(F.array_sort(F.transform(kept, lambda e: F.struct((-e["value"]["details"]["overallSavingsMs"]).alias("s"), e["key"].alias("k")))), 1, n)
    return raw.select("url", F.posexplode(best).alias("p", "b")).select("url", F.col("b.k").alias("audit_id"), (-F.col("b.s")).alias("savings_ms"), (F.col("p") + 1).alias("rank"))


# History metrics and the names of their columns.
HISTORY = (("largest_contentful_paint", "lcp_p75_ms"), ("interaction_to_next_paint", "inp_p75_ms"), ("cumulative_layout_shift", "cls_p75"), ("first_contentful_paint", "fcp_p75_ms"), ("experimental_time_to_first_byte", "ttfb_p75_ms"))


def history(raw: DataFrame) -> DataFrame:
    """(origin, period_end, p75 of five metrics): one row a collection period."""
    date = "struct<year:int,month:int,day:int>"
    periods = F.from_json(F.get_json_object("payload", "$.record.collectionPeriods"), f"array<struct<firstDate:{date},lastDate:{date}>>")
    x = raw.select("origin", "payload", F.posexplode(periods).alias("i", "p"))
    p75 = lambda m: F.get(F.from_json(F.get_json_object("payload", f"$.record.metrics.{m}.percentilesTimeseries.p75s"), "array<string>"), F.col("i"))
    return x.select("origin", F.format_string("%04d-%02d-%02d", "p.lastDate.year", "p.lastDate.month", "p.lastDate.day").alias("period_end"), *[p75(m).try_cast("double").alias(a) for m, a in HISTORY])


def inspection(raw: DataFrame) -> DataFrame:
    """(url, verdict, coverage, robots, indexing, last_crawl, google_canonical, user_canonical)."""
    g = lambda k: F.get_json_object("payload", f"$.inspectionResult.indexStatusResult.{k}")
    return raw.select("url", *[g(k).alias(a) for k, a in (("verdict", "verdict"), ("coverageState", "coverage"), ("robotsTxtState", "robots"), ("indexingState", "indexing"), ("lastCrawlTime", "last_crawl"), ("googleCanonical", "google_canonical"), ("userCanonical", "user_canonical"))])


def search_rows(raw: DataFrame, *dimensions: str) -> DataFrame:
    """Rows of a search response (payload): keys by dimension, clicks, impressions, ctr in
    percent to four places, position to two."""
    x = raw.select(F.explode(F.from_json(F.get_json_object("payload", "$.rows"), "array<struct<keys:array<string>,clicks:bigint,impressions:bigint,ctr:double,position:double>>")).alias("r"))
    half = lambda c, d: F.floor(c * 10**d + 0.5) / 10**d
    return x.select(*[F.get("r.keys", F.lit(i)).alias(n) for i, n in enumerate(dimensions)], F.col("r.clicks").alias("clicks"), F.col("r.impressions").alias("impressions"), half(F.col("r.ctr") * 100, 4).alias("ctr"), half(F.col("r.position"), 2).alias("position"))


def search_sites(raw: DataFrame) -> DataFrame:
    """(site_url, permission_level) of a list of sites (payload); entries without address left out."""
    x = raw.select(F.explode(F.from_json(F.get_json_object("payload", "$.siteEntry"), "array<struct<siteUrl:string,permissionLevel:string>>")).alias("s"))
    return x.where("coalesce(s.siteUrl, '') <> ''").select(F.col("s.siteUrl").alias("site_url"), F.coalesce("s.permissionLevel", F.lit("")).alias("permission_level"))


def analytics_properties(raw: DataFrame) -> DataFrame:
    """(property_id, display_name, account, property_type) of account summaries (payload)."""
    kind = "array<struct<displayName:string,propertySummaries:array<struct<property:string,displayName:string,propertyType:string>>>>"
    x = raw.select(F.explode(F.from_json(F.get_json_object("payload", "$.accountSummaries"), kind)).alias("a")).select(F.col("a.displayName").alias("account"), F.explode("a.propertySummaries").alias("p"))
    z = lambda c: F.coalesce(c, F.lit(""))
    rows = x.select(F.substring_index(z("p.property"), "/", -1).alias("property_id"), z("p.displayName").alias("display_name"), z("account").alias("account"), z("p.propertyType").alias("property_type"))
    return rows.where("property_id <> ''")


def backlink_summary(raw: DataFrame) -> DataFrame:
    """(site_url, domain_rating, backlinks_total, referring_domains, organic_traffic) of overview
    payloads (site_url, payload), with or without a ``metrics`` level."""
    j = F.coalesce(F.get_json_object("payload", "$.metrics"), F.col("payload"))
    n = lambda k: F.get_json_object(j, f"$.{k}").try_cast("double")
    return raw.select("site_url", n("domain_rating").alias("domain_rating"), n("backlinks").cast("long").alias("backlinks_total"), n("refdomains").cast("long").alias("referring_domains"), n("traffic").cast("long").alias("organic_traffic"))


def backlink_domains(raw: DataFrame, n: int = 50) -> DataFrame:
    """(position, domain, domain_rating, backlinks, first_seen): the first n of each payload's referring
    domains, as they come."""
    x = raw.select("site_url", F.posexplode(F.slice(F.from_json(F.get_json_object("payload", "$.refdomains"), "array<struct<domain:string,domain_rating:double,backlinks:bigint,first_seen:string>>"), 1, n)).alias("at", "d"))
    return x.select("site_url", (F.col("at") + 1).alias("position"), "d.*")


def backlink_anchors(raw: DataFrame, n: int = 30) -> DataFrame:
    """(site_url, position, text, backlinks): the first n of each payload's anchors, as they come."""
    x = raw.select("site_url", F.posexplode(F.slice(F.from_json(F.get_json_object("payload", "$.anchors"), "array<struct<anchor:string,backlinks:bigint>>"), 1, n)).alias("at", "d"))
    return x.select("site_url", (F.col("at") + 1).alias("position"), F.col("d.anchor").alias("text"), F.col("d.backlinks").alias("backlinks"))


def domains_of_backlinks(rows: DataFrame, n: int = 50) -> DataFrame:
    """(domain, trust_flow_max, backlinks): the n referring domains of backlinks (source_url,
    trust_flow) by trust, then by links."""
    d = host("source_url")
    by = rows.where(d != "").groupBy(d.alias("domain")).agg(F.max(F.coalesce("trust_flow", F.lit(0))).alias("trust_flow_max"), F.count("*").alias("backlinks"))
    return by.orderBy(F.desc("trust_flow_max"), F.desc("backlinks"), "domain").limit(n)


def flatten_accessibility(results: DataFrame) -> DataFrame:
    """(url, violations, nodes, critical, serious, moderate, minor) of axe results (url, violations)."""
    v = F.coalesce(F.from_json("violations", "array<struct<id:string,impact:string,help:string,nodes:array<string>>>"), F.array().cast("array<struct<id:string,impact:string,help:string,nodes:array<string>>>"))
    of = lambda k: F.size(F.filter(v, lambda x: F.coalesce(x["impact"], F.lit("minor")) == k)).alias(k)
    nodes = F.aggregate(v, F.lit(0), lambda a, x: a + F.coalesce(F.size(x["nodes"]), F.lit(0)))
    return results.select("url", F.size(v).alias("violations"), nodes.alias("nodes"), *[of(k) for k in ("critical", "serious", "moderate", "minor")])
