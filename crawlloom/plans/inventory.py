"""Queries of lookups, headers, platforms, formats, importers and exports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlloom.functions import html, urls
from crawlloom.functions import text as tx
from crawlloom.operators import detail, graph, issues, logs, pages, scoring
from crawlloom.plans.audit import _ISS, AUTH, HALF, NOW, SPACE, _issues, _landing, _queries, _search, links, now
from crawlloom.plans.derived import CODE, _axe
from crawlloom.plans.problems import normal_form_sql
from crawlloom.session import scratch
from crawlloom.sources import importers, readers, sinks
from crawlloom.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Lookups


@query("SELECT * FROM links WHERE to_url_normalized = (SELECT min(url) FROM pages) OR to_url = (SELECT min(url) FROM pages)")
def inlinks_of(s, d):
    url = table(s, d, "pages", "url").agg(F.min("url")).first()[0]
    return detail.inlinks_of(url, table(s, d, "links"))


_COUNTED = ("pages", "links", "images", "headings")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, {f'(SELECT count(*) FROM {t})' if t in _COUNTED else '0'} AS n_rows" for t in detail.CRAWL_TABLES))
def table_counts(s, d):
    return detail.table_counts({t: table(s, d, t) for t in _COUNTED})


@query(f"WITH {NOW} SELECT url, status_code, CASE WHEN coalesce(crawl_error, '') <> '' THEN crawl_error ELSE coalesce(title, '') END AS note FROM latest WHERE coalesce(status_code, 0) >= 400 OR coalesce(crawl_error, '') <> '' ORDER BY url LIMIT 100")
def problem_pages(s, d):
    return pages.problem_pages(now(s, d, "status_code", "crawl_error", "title"))


@query("""WITH a AS (SELECT from_url AS url, count(*) FILTER (coalesce(is_internal, FALSE)) AS n_internal, count(*) FILTER (NOT coalesce(is_internal, FALSE)) AS n_external, count(*) FILTER (nofollow) AS n_nofollow FROM links WHERE from_url IS NOT NULL GROUP BY 1),
  b AS (SELECT page_url AS url, count(*) AS n_images, count(*) FILTER (coalesce(alt, '') = '') AS n_images_without_alt FROM images WHERE page_url IS NOT NULL GROUP BY 1)
  SELECT coalesce(a.url, b.url) AS url, coalesce(n_internal, 0) AS n_internal, coalesce(n_external, 0) AS n_external, coalesce(n_nofollow, 0) AS n_nofollow, coalesce(n_images, 0) AS n_images, coalesce(n_images_without_alt, 0) AS n_images_without_alt FROM a FULL JOIN b ON a.url = b.url""")
def page_rollups(s, d):
    return pages.rollups(table(s, d, "links", "from_url", "is_internal", "nofollow"), table(s, d, "images", "page_url", "alt"))


@query("SELECT to_url AS url, depth, priority, added_at FROM (SELECT to_url, min(link_position)::INT AS depth, count(*) AS priority, min(loaded_at) AS added_at FROM links WHERE to_url IS NOT NULL GROUP BY to_url) ORDER BY priority DESC, added_at, url LIMIT 25")
def next_in_queue(s, d):
    """The next batch of a queue stood in for by link targets: those linked most, then the oldest."""
    q = table(s, d, "links", "to_url", "link_position", "loaded_at").where("to_url is not null").groupBy(F.col("to_url").alias("url")).agg(F.min("link_position").cast("int").alias("depth"), F.count("*").alias("priority"), F.min("loaded_at").alias("added_at"))
    return detail.next_in_queue(q, 25)


@query(f"WITH {NOW} SELECT 'missing_title' AS issue, url, NULL AS status_code FROM latest WHERE coalesce(title, '') = '' UNION ALL SELECT 'broken', url, status_code FROM latest WHERE status_code >= 400")
def labelled_issues(s, d):
    p = now(s, d, "title", "status_code")
    return detail.labelled({"missing_title": p.where("coalesce(title, '') = ''").select("url"), "broken": p.where("status_code >= 400").select("url", "status_code")})


# Headers, platforms, indexability


_SIGNS = (("CF-Ray", "7d"), ("cf-cache-status", "HIT"), ("X-Amz-Cf-Pop", "FRA"), ("x-akamai-request-id", "1f"), ("X-Served-By", "cache-FASTLY-1"), ("X-Served-By", "cache-lon"), ("X-Sucuri-ID", "9"), ("X-Vercel-Id", "fra1"), ("x-nf-request-id", "01"))
_NETWORK = ("CloudFlare", "CloudFlare", "CloudFront", "Akamai", "Fastly", "", "Sucuri", "Vercel", "Netlify", "")


def _header_map(p):
    """A header map for every page row: a sign of a content network, and others by turns."""
    i = F.col("page_id")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), (F.lit(v) if isinstance(v, str) else v).alias("value"))
    pairs = [F.when(i % 10 == n, pair(k, v)) for n, (k, v) in enumerate(_SIGNS)]
    pairs.append(F.when(i % 10 == 6, pair("x-vercel-id", "2")))
    pairs.append(F.when(F.col("server").isNotNull(), pair("Server", F.col("server"))))
    pairs.append(F.when(i % 4 == 0, pair("X-Robots-Tag", "noindex, nofollow")).when(i % 4 == 1, pair("x-robots-tag", "NoFollow")))
    pairs.append(F.when(i % 3 == 0, pair("Content-Encoding", "gzip")).when(i % 3 == 1, pair("content-encoding", "identity")))
    pairs.append(F.when(i % 5 == 0, pair("Set-Cookie", "a=b")))
    pairs.append(F.when(i % 6 == 0, pair("Feature-Policy", "camera 'none'")))
    pairs.append(F.when(i % 7 == 0, pair("ETag", '"x"')))
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


@query(f"""SELECT page_id, coalesce(server, '') AS server, {list(_NETWORK)}[page_id % 10 + 1] AS cdn, page_id % 3 = 0 AS is_compressed, page_id % 4 = 0 AS header_noindex, page_id % 4 < 2 AS header_nofollow, page_id % 5 = 0 AS has_cookies,
  CASE WHEN page_id % 6 = 0 THEN 'camera ''none''' ELSE '' END AS permissions_policy, CASE WHEN page_id % 7 = 0 THEN '"x"' ELSE '' END AS etag, page_id % 7 = 0 AS has_cache_headers, FALSE AS hsts_enabled, '' AS csp FROM pages""")
def http_headers(s, d):
    p = table(s, d, "pages", "page_id", "server")
    h = p.select("page_id", *html.headers(_header_map(p)))
    return h.select("page_id", "server", "cdn", "is_compressed", "header_noindex", "header_nofollow", "has_cookies", "permissions_policy", "etag", "has_cache_headers", "hsts_enabled", "csp")


@query(f"""WITH p AS (SELECT page_id, status_code, canonical AS c, url || CASE WHEN page_id % 5 = 0 THEN '#top' ELSE '' END AS u, lower(coalesce(meta_robots, '') || ' ' || CASE page_id % 4 WHEN 0 THEN 'noindex, nofollow' WHEN 1 THEN 'nofollow' ELSE '' END) AS r FROM pages)
  SELECT page_id, coalesce(status_code, 0) = 200 AND NOT contains(r, 'noindex') AS is_indexable, CASE WHEN coalesce(status_code, 0) <> 200 THEN 'Non-200 status: ' || coalesce(status_code, 0) WHEN contains(r, 'noindex') THEN 'Noindex directive' WHEN coalesce(c, '') <> '' AND c <> u AND c <> {normal_form_sql("u")} THEN 'Canonicalised' ELSE 'Indexable' END AS reason FROM p""")
def indexability(s, d):
    p = table(s, d, "pages", "page_id", "url", "status_code", "meta_robots", "canonical", "server")
    p = p.withColumn("address", F.concat("url", F.when(F.col("page_id") % 5 == 0, F.lit("#top")).otherwise(F.lit(""))))
    x = p.withColumn("h", _header_map(p)).withColumn("normal", urls.normal_form_udf("address"))
    robots = html.header(F.col("h"), "x-robots-tag")
    return x.select("page_id", html.indexability(F.col("status_code"), F.col("meta_robots"), F.col("canonical"), F.col("address"), robots, F.col("normal")).alias("x")).select("page_id", "x.*")


_MARKS = ("<script src=//CDN.shopify.com/a.js>", "<img src=//s-cdn.net/i.png>", "zidapi", "/?wc-ajax=1", "/wp-content/x.css", '<meta name="generator" content="WordPress 6">', "", "", "", "", "", "")
_HAY = f"lower(coalesce(title, '') || ' ' || {list(_MARKS)}[page_id % 12 + 1]) || CASE WHEN page_id % 17 = 0 THEN ' x-shopid:12' ELSE '' END"


@query("WITH h AS (SELECT page_id, " + _HAY + " AS h FROM pages) SELECT page_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(h, '{n}')" for n in signs) + f" THEN '{name}'" for name, signs in html.PLATFORMS) + " ELSE 'unknown' END AS platform FROM h")
def platforms(s, d):
    p = table(s, d, "pages", "page_id", "title")
    markup = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.array(*map(F.lit, _MARKS))[(F.col("page_id") % 12).cast("int")])
    sent = F.when(F.col("page_id") % 17 == 0, F.create_map(F.lit("X-ShopId"), F.lit("12")))
    return p.select("page_id", html.platform(markup, sent).alias("platform"))


@query("WITH f AS (SELECT p, k FROM (VALUES ('zid', 'cart'), ('wordpress', 'tag')) t(p, k)) SELECT p AS platform, count(*) AS n_left_out FROM links CROSS JOIN f WHERE (p = 'zid' AND (contains(to_url, '/cart') OR contains(to_url, '/checkout') OR contains(to_url, '/account') OR contains(to_url, 'add-to-cart'))) OR (p = 'wordpress' AND (contains(to_url, '/wp-admin') OR contains(to_url, '/wp-login.php') OR contains(to_url, '/xmlrpc.php') OR contains(to_url, '/wp-json/') OR contains(to_url, '/feed') OR regexp_matches(to_url, '.replytocom=|&replytocom=|.attachment_id=|&attachment_id=|.p=|/author/|/tag/|/.s=|&s=', 's'))) GROUP BY p")
def preset_exclusions(s, d):
    """Links that a platform's preset leaves out of its crawl (a '?' of a pattern is any character)."""
    to = table(s, d, "links", "to_url")
    return to.agg(*[F.count_if(readers.matches_any("to_url", list(html.PRESETS[p]["exclude"]))).alias(p) for p in ("zid", "wordpress")]).select(F.explode(F.array(*[F.struct(F.lit(p).alias("platform"), F.col(p).alias("n_left_out")) for p in ("zid", "wordpress")])).alias("x")).select("x.*").where("n_left_out > 0")


@query(f"WITH {NOW} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '?l=1' WHEN page_id % 3 = 1 AND coalesce(canonical, '') <> '' THEN canonical ELSE coalesce(canonical, '') END AS canonical, CASE WHEN page_id % 3 = 0 THEN url ELSE '' END AS next_url FROM latest")
def link_headers(s, d):
    """Canonical and next address where a Link header may stand beside the markup."""
    p = now(s, d, "canonical")
    sent = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<"), "url", F.lit('>; rel="next", <'), "url", F.lit('?l=1>; title="a"; rel="canonical"'))).when(F.col("page_id") % 3 == 1, F.lit('</style.css>; rel="preload"'))
    return p.select("page_id", html.declared_canonical(sent, F.col("canonical")).alias("canonical"), html.link_header(sent, "next").alias("next_url"))


_OWN = f"SELECT list(DISTINCT array_to_string(string_split(regexp_replace({AUTH('url')}, ':\\d+$', ''), '.')[-2:], '.')) AS l FROM pages"


@query(f"WITH o AS ({_OWN}), t AS (SELECT DISTINCT to_url AS url, regexp_replace({AUTH('to_url')}, '^www\\.', '') AS h FROM links WHERE to_url IS NOT NULL) SELECT url, h = '' OR len(list_filter((SELECT l FROM o), lambda x: h = x OR suffix(h, '.' || x))) > 0 AS is_internal FROM t")
def internal_targets(s, d):
    """Whether each target lies in the domains of the crawl; a port makes another host."""
    own = [r[0] for r in table(s, d, "pages", "url").select(urls.registrable("url").alias("x")).distinct().collect()]  # a crawl's few sites
    t = table(s, d, "links", "to_url").where("to_url is not null").distinct()
    return t.select(F.col("to_url").alias("url"), urls.in_own_domains("to_url", F.array(*map(F.lit, sorted(own)))).alias("is_internal"))


# Formats


_CLEAN = f"regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '{SPACE}+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""WITH p AS (SELECT page_id, {_CLEAN} AS f, meta_description AS m, size_bytes * (1 + page_id % 5 * page_id % 7 * 40000) AS b, size_bytes % 100000 / 8.0::DOUBLE AS s FROM pages), q AS (SELECT *, CAST(round_even(s, 0) AS BIGINT) AS n FROM p)
  SELECT page_id, CASE WHEN substr(f, 1, 100) = '' THEN 'untitled' ELSE substr(f, 1, 100) END AS filename, CASE WHEN length(coalesce(m, '')) > 100 THEN substr(m, 1, 97) || '...' ELSE coalesce(m, '') END AS short,
  CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN printf('%.2f B', b::DOUBLE) WHEN b < 1024 ** 2 THEN printf('%.2f KB', b / 1024.0::DOUBLE) WHEN b < 1024 ** 3 THEN printf('%.2f MB', b / (1024 ** 2)::DOUBLE) WHEN b < 1024 ** 4 THEN printf('%.2f GB', b / (1024 ** 3)::DOUBLE) ELSE printf('%.2f TB', b / (1024 ** 4)::DOUBLE) END AS size,
  CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN n < 3600 THEN printf('%dm %ds', n // 60, n % 60) ELSE printf('%dh %dm %ds', n // 3600, n % 3600 // 60, n % 60) END AS duration FROM q""")
def formats(s, d):
    p = table(s, d, "pages", "page_id", "title", "meta_description", "size_bytes")
    b = F.col("size_bytes") * (1 + F.col("page_id") % 5 * F.col("page_id") % 7 * 40000)
    return p.select("page_id", tx.safe_filename("title").alias("filename"), tx.truncated("meta_description").alias("short"), tx.format_bytes(b).alias("size"), tx.format_duration(F.col("size_bytes") % 100000 / 8).alias("duration"))


_VARIANTS = "SELECT DISTINCT coalesce(language, '') || x AS raw FROM pages, (VALUES (''), ('-hant-hk'), ('-419'), (' '), ('_us'), ('-gb')) t(x) UNION SELECT 'X-Default'"


@query(f"WITH v AS ({_VARIANTS}) SELECT raw, {CODE('raw')} AS code FROM v")
def hreflang_codes(s, d):
    more = F.explode(F.array(*map(F.lit, ("", "-hant-hk", "-419", " ", "_us", "-gb"))))
    v = table(s, d, "pages", "language").distinct().select("language", more.alias("x")).select(F.concat(F.coalesce("language", F.lit("")), "x").alias("raw")).distinct()
    return v.unionAll(s.createDataFrame([("X-Default",)], "raw string")).select("raw", tx.hreflang_code("raw").alias("code"))


# Logs and metrics


def _shapes(s, d):
    """Log lines in all forms: combined, common, no protocol, a method in small letters, odd sizes."""
    e = table(s, d, "events", "event_id", "ts", "user_id", "event_type")
    head = F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit("  - ann ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "'))
    k = F.col("event_id") % 6
    tail = (
        F.when(k == 0, F.lit(' HTTP/1.1" 200 512 "-" "Applebot/1"')).when(k == 1, F.lit(' HTTP/1.0" 404 -')).when(k == 2, F.lit('" 200 5 "-" "x"')).when(k == 3, F.lit(' HTTP/2" 301 7 "http://r" "AdsBot-Google (+x)"')).when(k == 4, F.lit(' HTTP/2" 20 7')).otherwise(F.lit(' HTTP/1.1" 200 9'))
    )
    method = F.when(k == 5, F.lit("get ")).otherwise(F.lit("GET "))
    return e.select("event_id", F.concat(head, method, F.lit("/"), "event_type", tail).alias("value"))


@query("""SELECT event_type AS path, CASE event_id % 6 WHEN 0 THEN 'Applebot' WHEN 3 THEN 'AdsBot-Google' END AS bot, CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 ELSE 301 END AS status_code, count(*) AS n, sum(CASE event_id % 6 WHEN 0 THEN 512 WHEN 1 THEN 0 ELSE 7 END)::BIGINT AS bytes, count(DISTINCT user_id % 250) AS n_ips
  FROM events WHERE event_id % 6 IN (0, 1, 3) GROUP BY ALL""")
def log_lines(s, d):
    hits = logs.parsed(_shapes(s, d))
    return hits.groupBy(F.expr("substring(path, 2)").alias("path"), "bot", "status_code").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_distinct("ip").alias("n_ips"))


_LEVELS = ("INFO", "WARNING", "ERROR", "DEBUG", "CRITICAL", "SUCCESS")


def _run_log(s, d):
    e = table(s, d, "events", "event_id", "event_type")
    level = F.array(*map(F.lit, _LEVELS))[(F.col("event_id") % 6).cast("int")]
    return e.select(F.col("event_id").alias("at"), F.when(F.col("event_id") % 50 == 7, F.lit("Traceback (most recent call last):")).otherwise(F.concat(F.lit("10:00 | "), level, F.lit(" | "), "event_type")).alias("value"))


_RUNLOG = f"run AS (SELECT event_id AS \"at\", CASE WHEN event_id % 50 = 7 THEN 'Traceback (most recent call last):' ELSE '10:00 | ' || {list(_LEVELS)}[event_id % 6 + 1] || ' | ' || event_type END AS value, CASE WHEN event_id % 50 <> 7 THEN {list(_LEVELS)}[event_id % 6 + 1] END AS level FROM events)"


@query(f"WITH {_RUNLOG} SELECT level, count(*) AS n FROM run WHERE level IS NOT NULL GROUP BY level")
def run_log_levels(s, d):
    return logs.run_log_levels(_run_log(s, d))


@query(f"WITH {_RUNLOG} SELECT \"at\", value FROM run WHERE level IS NULL OR level IN ('ERROR', 'CRITICAL') ORDER BY \"at\" DESC, value LIMIT 20")
def run_log_important(s, d):
    return logs.important_lines(_run_log(s, d))


@query()
def metrics_snapshot(s, d):
    e = table(s, d, "events", "event_id", "event_type", "value")
    kind = F.array(*map(F.lit, ("counter", "gauge", "timing", "event")))[(F.col("event_id") % 4).cast("int")]
    return detail.metrics_snapshot(e.select(F.col("event_id").alias("at"), kind.alias("kind"), F.col("event_type").alias("name"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")))


# Search, analytics, issues


@query(f"WITH s AS (SELECT page_id % 23 AS clicks, page_id % 997 AS impressions, page_id % 50 AS position FROM pages WHERE coalesce(title, '') <> '') SELECT sum(clicks)::BIGINT AS total_clicks, sum(impressions)::BIGINT AS total_impressions, {HALF('sum(clicks)::DOUBLE / sum(impressions) * 100', 2)} AS avg_ctr, {HALF('sum(position)::DOUBLE / count(*)', 2)} AS avg_position, count(*) AS pages_count FROM s")
def search_totals(s, d):
    return scoring.search_totals(_search(s, d))


@query("""WITH q AS (SELECT c_mktsegment || '/' || c_nationkey AS name, sum(o_orderkey % 7)::BIGINT AS clicks, sum(o_orderkey % 90)::BIGINT AS impressions FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), s AS (SELECT url AS name, page_id % 23 AS clicks, page_id % 997 AS impressions FROM pages WHERE coalesce(title, '') <> ''),
  p AS (SELECT name, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions FROM s GROUP BY name) (SELECT 'page' AS kind, name, clicks, impressions FROM p ORDER BY clicks DESC, name LIMIT 20) UNION ALL (SELECT 'query', name, clicks, impressions FROM q ORDER BY clicks DESC, name LIMIT 20)""")
def search_top(s, d):
    q = _queries(s, d).groupBy(F.concat("query", F.lit("/"), F.element_at(F.split("page", "/"), -1)).alias("query")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    p = _search(s, d).groupBy("page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))
    return scoring.search_top(p, q)


_PATH = "regexp_extract(url, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"


@query(f"""WITH l AS (SELECT {_PATH} AS name, page_id % 41 AS sessions, page_id % 17 AS users FROM pages WHERE status_code = 200), c AS (SELECT event_type AS name, count(*) AS sessions, count(DISTINCT user_id) AS users FROM events GROUP BY 1)
  SELECT 'total' AS kind, '' AS name, sum(sessions)::BIGINT AS sessions, sum(users)::BIGINT AS users FROM l UNION ALL (SELECT 'landing', name, sessions, users FROM l ORDER BY sessions DESC, name, users DESC LIMIT 20) UNION ALL SELECT 'channel', name, sessions, users FROM c""")
def analytics_summary(s, d):
    channels = table(s, d, "events", "event_type", "user_id").groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("sessions"), F.count_distinct("user_id").alias("users"))
    return scoring.analytics_summary(_landing(s, d), channels)


@query(_ISS + " SELECT * FROM iss ORDER BY CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END, affected_count DESC, issue_type LIMIT 3")
def top_issues(s, d):
    return issues.top_issues(_issues(now(s, d), s, d))


@query("SELECT 'https://r.example/' || page_id AS from_url, 'https://r.example/' || page_id AS to_url FROM pages WHERE FALSE UNION SELECT DISTINCT to_url, 'https://' || substr(to_url, 8) FROM links WHERE to_url LIKE 'http://%' AND is_internal")
def protocol_upgrades(s, d):
    """Redirects that only add TLS, among redirects of every internal target to https and to itself."""
    t = table(s, d, "links", "to_url", "is_internal").where("is_internal and to_url is not null")
    hops = t.select(F.col("to_url").alias("from_url"), F.regexp_replace("to_url", "^http://", "https://").alias("to_url")).unionAll(t.select(F.col("to_url").alias("from_url"), F.concat("to_url", F.lit("#x")).alias("to_url")))
    return graph.protocol_upgrades(hops)


@query(f"WITH {NOW}, b AS (SELECT *, page_id % 3 AS k FROM latest) SELECT url, k = 0 AS title_changed, k = 1 AND coalesce(meta_description, '') <> 'x' AS description_changed, FALSE AS canonical_changed, coalesce(word_count, 0) - coalesce(word_count, 0) // 2 AS words_added, 3 AS links_added FROM b")
def rendered_diff(s, d):
    p = now(s, d, "title", "meta_description", "canonical", "word_count")
    k = F.col("page_id") % 3
    z = F.coalesce("word_count", F.lit(0))
    raw = p.select("url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("meta_description", F.lit("")).alias("description"), "canonical", F.floor(z / 2).cast("int").alias("n_words"), F.lit(1).alias("n_links"))
    seen = p.select("url", F.when(k == 0, F.concat(F.coalesce("title", F.lit("")), F.lit("!"))).otherwise(F.coalesce("title", F.lit(""))).alias("title"), F.when(k == 1, "x").otherwise(F.coalesce("meta_description", F.lit(""))).alias("description"), "canonical", z.alias("n_words"), F.lit(4).alias("n_links"))
    return detail.rendered_diff(raw, seen)


# Importers


def _payloads(s, d, **parts):
    n = table(s, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    return n.select(F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/")).alias("site_url"), F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()])).alias("payload"))


@query("SELECT 'https://' || lower(n_name) || '.example/' AS site_url, CASE WHEN n_nationkey % 2 = 0 THEN 'owner' ELSE '' END AS permission_level FROM nation WHERE n_nationkey % 5 <> 4")
def search_sites(s, d):
    url = F.when(F.col("n_nationkey") % 5 != 4, F.concat(F.lit("https://"), F.lower("n_name"), F.lit(".example/")))
    return importers.search_sites(_payloads(s, d, siteEntry=F.array(F.struct(url.alias("siteUrl"), F.when(F.col("n_nationkey") % 2 == 0, "owner").alias("permissionLevel")))))


@query("SELECT n_nationkey::VARCHAR || k AS property_id, n_name AS display_name, 'r' || n_regionkey AS account, CASE WHEN k = 1 THEN 'ORDINARY' ELSE '' END AS property_type FROM nation, (VALUES (1), (2)) t(k)")
def analytics_properties(s, d):
    key = F.col("n_nationkey").cast("string")
    one = lambda k, t: F.struct(F.concat(F.lit("properties/"), key, F.lit(k)).alias("property"), F.col("n_name").alias("displayName"), t.alias("propertyType"))
    none = F.struct(F.lit("").alias("property"), F.lit("none").alias("displayName"), F.lit("x").alias("propertyType"))
    account = F.struct(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("displayName"), F.array(one("1", F.lit("ORDINARY")), one("2", F.lit(None).cast("string")), none).alias("propertySummaries"))
    return importers.analytics_properties(_payloads(s, d, accountSummaries=F.array(account)))


@query("SELECT 'https://' || lower(n_name) || '.example/' AS site_url, n_nationkey / 2.0::DOUBLE AS domain_rating, n_nationkey * 100 AS backlinks_total, n_nationkey AS referring_domains, NULL::BIGINT AS organic_traffic FROM nation")
def backlink_summary(s, d):
    k = F.col("n_nationkey")
    return importers.backlink_summary(_payloads(s, d, metrics=F.struct((k / 2).alias("domain_rating"), (k * 100).alias("backlinks"), k.alias("refdomains"))))


@query("SELECT 'https://' || lower(n_name) || '.example/' AS site_url, i AS position, 'd' || i || '.example' AS domain, i / 2.0::DOUBLE AS domain_rating, n_nationkey * i AS backlinks, '2025-01-01' AS first_seen FROM nation, generate_series(1, 50) t(i)")
def backlink_domains(s, d):
    item = lambda i: F.struct(F.concat(F.lit("d"), i.cast("string"), F.lit(".example")).alias("domain"), (i / 2).alias("domain_rating"), (F.col("n_nationkey") * i).alias("backlinks"), F.lit("2025-01-01").alias("first_seen"))
    return importers.backlink_domains(_payloads(s, d, refdomains=F.transform(F.sequence(F.lit(1), F.lit(60)), item)))


@query("SELECT 'https://' || lower(n_name) || '.example/' AS site_url, i AS position, 'anchor ' || i AS text, n_nationkey + i AS backlinks FROM nation, generate_series(1, 30) t(i)")
def backlink_anchors(s, d):
    item = lambda i: F.struct(F.concat(F.lit("anchor "), i.cast("string")).alias("anchor"), (F.col("n_nationkey") + i).alias("backlinks"))
    return importers.backlink_anchors(_payloads(s, d, anchors=F.transform(F.sequence(F.lit(1), F.lit(40)), item)))


@query(f"SELECT domain, max(t) AS trust_flow_max, count(*) AS backlinks FROM (SELECT regexp_replace({AUTH('from_url')}, ':\\d+$', '') AS domain, coalesce(link_position, 0) AS t FROM links) WHERE domain <> '' GROUP BY domain ORDER BY trust_flow_max DESC, backlinks DESC, domain LIMIT 50")
def domains_of_backlinks(s, d):
    return importers.domains_of_backlinks(table(s, d, "links", "from_url", "link_position").select(F.col("from_url").alias("source_url"), F.col("link_position").alias("trust_flow")))


@query("SELECT url, 1 AS violations, page_id % 4 AS nodes, (page_id % 3 = 0)::INT AS critical, (page_id % 3 = 1)::INT AS serious, 0 AS moderate, (page_id % 3 = 2)::INT AS minor FROM pages")
def accessibility_pages(s, d):
    return importers.flatten_accessibility(_axe(s, d))


def _speed(s, d):
    p = table(s, d, "pages", "page_id", "url")
    i = F.col("page_id")
    num = lambda c: F.struct(c.cast("double").alias("numericValue"))
    field = lambda c, t: F.struct(c.alias("percentile"), t.alias("category"))
    band = F.when(i % 2 == 0, "FAST").otherwise("SLOW")
    cats = F.struct(*[F.struct(((i + k) % 101 / 100).alias("score")).alias(n) for k, n in enumerate(("performance", "accessibility", "best-practices", "seo"))])
    audits = F.struct(num(i % 4000).alias("largest-contentful-paint"), num(i % 7).alias("cumulative-layout-shift"), num(i % 900).alias("total-blocking-time"), num(i % 3000).alias("first-contentful-paint"), num(i % 5000).alias("speed-index"), num(i % 6000).alias("interactive"))
    real = F.struct(field(i % 3000, band).alias("LARGEST_CONTENTFUL_PAINT_MS"), field(i % 30, F.lit("AVERAGE")).alias("CUMULATIVE_LAYOUT_SHIFT_SCORE"))
    return p.select("url", F.to_json(F.struct(F.struct(cats.alias("categories"), audits.alias("audits")).alias("lighthouseResult"), F.struct(real.alias("metrics"), F.when(i % 3 == 0, "FAST").alias("overall_category")).alias("loadingExperience"))).alias("payload"))


_SCORES = ", ".join(f"CAST(floor(((page_id + {k}) % 101) / 100.0::DOUBLE * 100 + 0.5) AS INT) AS {n}" for k, n in enumerate(("performance", "accessibility", "best_practices", "seo")))


@query(f"SELECT url, {_SCORES}, (page_id % 4000)::DOUBLE AS lcp_lab_ms, (page_id % 7)::DOUBLE AS cls_lab, (page_id % 900)::DOUBLE AS tbt_lab_ms, CASE WHEN page_id % 3 = 0 THEN 'FAST' ELSE '' END AS crux_overall, CASE WHEN page_id % 2 = 0 THEN 'FAST' ELSE 'SLOW' END AS lcp_field, 'AVERAGE' AS cls_field, '' AS inp_field FROM pages")
def speed_table(s, d):
    return importers.flatten_speed(_speed(s, d))


@query(f"SELECT url, {_SCORES}, (page_id % 3000)::DOUBLE AS fcp, (page_id % 4000)::DOUBLE AS lcp, (page_id % 900)::DOUBLE AS tbt, (page_id % 7)::DOUBLE AS cls, (page_id % 5000)::DOUBLE AS speed_index, (page_id % 6000)::DOUBLE AS tti, (page_id % 3000)::DOUBLE AS field_lcp, NULL::DOUBLE AS field_inp, (page_id % 30)::DOUBLE AS field_cls, NULL::DOUBLE AS field_fcp, NULL::DOUBLE AS field_ttfb, CASE WHEN page_id % 3 = 0 THEN 'FAST' END AS overall FROM pages")
def speed_full(s, d):
    return importers.speed_metrics(_speed(s, d))


def _tables_payload(s, d):
    """Network requests, script sizes and savings of every page."""
    p = table(s, d, "pages", "page_id", "url")
    i = F.col("page_id")
    req = F.struct(F.array(F.struct(F.concat("url", F.lit("a.js")).alias("url"), F.lit("Script").alias("resourceType"), (200 + i % 3).alias("statusCode"), (i % 5000).alias("transferSize"), F.lit("text/javascript").alias("mimeType"))).alias("items"))
    tree = F.struct(F.array(F.struct(F.lit("a.js").alias("name"), (i % 1000).alias("resourceBytes"), (i % 500).alias("unusedBytes"))).alias("nodes"))
    save = lambda k: F.struct(F.struct(F.lit("opportunity").alias("type"), (i % k).cast("double").alias("overallSavingsMs")).alias("details"))
    audits = F.struct(F.struct(req.alias("details")).alias("network-requests"), F.struct(tree.alias("details")).alias("script-treemap-data"), save(700).alias("unused-css"), save(300).alias("unused-javascript"))
    return p.select("url", F.to_json(F.struct(F.struct(audits.alias("audits")).alias("lighthouseResult"))).alias("payload"))


@query("SELECT url, url || 'a.js' AS request_url, 'Script' AS resource_type, (200 + page_id % 3)::INT AS status_code, page_id % 5000 AS transfer_size, 'text/javascript' AS mime_type FROM pages")
def network_requests(s, d):
    return importers.network_requests(_tables_payload(s, d))


@query(f"SELECT url, 'a.js' AS script, page_id % 1000 AS bytes, page_id % 500 AS unused_bytes, CASE WHEN page_id % 1000 > 0 THEN {HALF('(page_id % 500)::DOUBLE / (page_id % 1000) * 100', 1)} ELSE 0.0 END AS unused_pct FROM pages")
def script_treemap(s, d):
    return importers.script_treemap(_tables_payload(s, d))


@query("""WITH x AS (SELECT page_id, url, 'unused-css' AS audit_id, (page_id % 700)::DOUBLE AS savings_ms FROM pages UNION ALL SELECT page_id, url, 'unused-javascript', (page_id % 300)::DOUBLE FROM pages)
  SELECT url, audit_id, savings_ms, row_number() OVER (PARTITION BY page_id ORDER BY savings_ms DESC, audit_id) AS rank FROM x WHERE savings_ms > 0""")
def speed_opportunities(s, d):
    return importers.speed_opportunities(_tables_payload(s, d))


@query("SELECT url, 'PASS' AS verdict, 'Indexed' AS coverage, CASE WHEN page_id % 2 = 0 THEN 'ALLOWED' END AS robots, NULL::VARCHAR AS indexing, '2025-01-01' AS last_crawl, canonical AS google_canonical, url AS user_canonical FROM pages")
def index_inspection(s, d):
    p = table(s, d, "pages", "page_id", "url", "canonical")
    r = F.struct(F.lit("PASS").alias("verdict"), F.lit("Indexed").alias("coverageState"), F.when(F.col("page_id") % 2 == 0, "ALLOWED").alias("robotsTxtState"), F.lit("2025-01-01").alias("lastCrawlTime"), F.col("canonical").alias("googleCanonical"), F.col("url").alias("userCanonical"))
    return importers.inspection(p.select("url", F.to_json(F.struct(F.struct(r.alias("indexStatusResult")).alias("inspectionResult"))).alias("payload")))


@query(f"SELECT url AS page, page_id % 9 AS clicks, page_id % 90 AS impressions, {HALF('(page_id % 16) / 16.0::DOUBLE * 100', 4)} AS ctr, {HALF('(page_id % 64) / 8.0::DOUBLE', 2)} AS position FROM pages")
def search_rows(s, d):
    p = table(s, d, "pages", "page_id", "url")
    i = F.col("page_id")
    row = F.struct(F.array("url").alias("keys"), (i % 9).alias("clicks"), (i % 90).alias("impressions"), (i % 16 / 16).alias("ctr"), (i % 64 / 8).alias("position"))
    return importers.search_rows(p.select(F.to_json(F.struct(F.array(row).alias("rows"))).alias("payload")), "page")


# Exports: written and read back


@query(f"WITH {NOW} SELECT url, CASE WHEN regexp_matches(title, '^[\\s\\x{{200b}}-\\x{{200d}}\\x{{feff}}]*[=+\\-@]') THEN '''' || title ELSE title END AS title, status_code::VARCHAR AS status_code FROM latest WHERE coalesce(title, '') <> ''")
def csv_round_trip(s, d):
    """Pages written as CSV and read back: a byte-order mark before the header, cells made safe."""
    path = scratch(s, "csv")
    p = now(s, d, "title", "status_code").where("coalesce(title, '') <> ''").select("url", "title", "status_code")
    sinks.write_csv(p, path)
    return readers.exported_csv(s, path)


@query("SELECT 'excluded_urls' AS name, 0 AS n WHERE FALSE UNION ALL SELECT 'deferred_urls', count(*) FROM (SELECT DISTINCT url FROM pages WHERE depth > 4) HAVING count(*) > 0 UNION ALL SELECT 'resource_status', count(*) FROM images HAVING count(*) > 0")
def conditional_exports(s, d):
    """Rows of the conditional tables that were written; tables without rows aren't."""
    p = table(s, d, "pages", "url", "depth")
    tables = {"excluded_urls": p.where("depth < 0").select("url"), "deferred_urls": p.where("depth > 4").select("url").distinct(), "resource_status": table(s, d, "images", "id", "src")}
    found = [s.read.csv(path, header=True).agg(F.count("*").cast("long").alias("n")).select(F.lit(name).alias("name"), "n") for name, path in sinks.export_conditional(tables, scratch(s, "export")).items()]
    empty = s.createDataFrame([], "name string, n long")
    for f in found:
        empty = empty.unionAll(f)
    return empty


@query("SELECT 'audit' AS part, 1 AS n, '{\"mode\":\"audit\"}' AS least UNION ALL SELECT 'pages', count(*), min('{\"page_id\":' || page_id || '}') FROM pages UNION ALL SELECT 'links', 1, '{\"omitted\":' || count(*) || '}' FROM links")
def audit_document(s, d):
    """Parts of the audit file, written and read back; raw arrays are only counted."""
    path = scratch(s, "audit")
    sinks.write_audit({"pages": table(s, d, "pages", "page_id"), "links": table(s, d, "links", "id")}, path)
    return s.read.text(path).groupBy("part").agg(F.count("*").alias("n"), F.min("value").alias("least"))
