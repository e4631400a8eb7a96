"""Queries of the crawl analyzers over the crawl tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlloom.functions import text as tx
from crawlloom.functions import urls
from crawlloom.operators import detail, graph, issues, pages, scoring
from crawlloom.plans.problems import normal_form_sql
from crawlloom.sources import sinks
from crawlloom.tables import table

PAGE = ("page_id", "url", "status_code", "content_type", "title", "title_length", "meta_description", "meta_description_length", "meta_robots", "h1_count", "h1_text", "canonical", "word_count", "text_to_html_ratio", "language", "content_hash", "internal_links_count", "is_indexable", "depth", "crawl_error", "crawled_at", "response_time_ms")


def now(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Latest pages with the columns asked for."""
    keep = [*dict.fromkeys((*(columns or PAGE), "url", "crawled_at", "page_id"))]
    return pages.latest(table(spark, d, "pages", *keep), *[c for c in keep if c != "url"])


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "links", "id", "from_url", "to_url", "to_url_normalized", "is_internal", "is_special_link", "anchor_text")


SPACE = tx.SPACE
NOW = "latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC, page_id DESC) AS rn FROM pages WHERE url IS NOT NULL) WHERE rn = 1)"
SQUEEZE = lambda c: f"regexp_replace(regexp_replace({c}, '{SPACE}+', ' ', 'g'), '^{SPACE}+|{SPACE}+$', '', 'g')"
AUTH = lambda c: f"lower(regexp_extract({c}, '^(?:[^:/?#]+:)?//([^/?#]*)', 1))"
HOST = lambda c: f"regexp_replace({AUTH(c)}, ':\\d+$', '')"
PATH = lambda c: f"regexp_extract({c}, '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)', 1)"
PATHKEY = lambda c: f"CASE WHEN regexp_replace(lower({PATH(c)}), '/+$', '') = '' THEN '/' ELSE regexp_replace(lower({PATH(c)}), '/+$', '') END"
QUERY = lambda c: f"list_filter(string_split(regexp_extract({c}, '\\?([^#]*)', 1), '&'), lambda x: x <> '')"
SITE2 = lambda c: f"array_to_string(string_split({HOST(c)}, '.')[-2:], '.')"
SEGS = lambda c: f"list_filter(string_split({PATH(c)}, '/'), lambda x: x <> '')"
OK = "crawl_error IS NULL AND status_code = 200 AND coalesce(is_indexable, FALSE)"
HALF = lambda c, n: f"floor(({c}) * 1e{n} + 0.5) / 1e{n}"

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DUP = " UNION ALL ".join(f"SELECT '{k}' AS kind, {(SQUEEZE(f'nfc_normalize({e})') if k != 'content' else e)} AS k0, url FROM latest WHERE {OK}" for k, e in (("title", "title"), ("meta_description", "meta_description"), ("h1", "h1_text[1]"), ("content", "content_hash")))
_DUPS = f"WITH {NOW}, rows0 AS ({_DUP}), rows1 AS (SELECT kind, CASE WHEN kind = 'content' THEN k0 ELSE lower(k0) END AS dup_key, url FROM rows0 WHERE k0 <> ''), dups AS (SELECT kind, dup_key, count(*) OVER (PARTITION BY kind, dup_key) AS n_pages, url FROM rows1 QUALIFY n_pages > 1)"


@query(_DUPS + " SELECT * FROM dups")
def duplicate_pages(s, d):
    return pages.duplicates(now(s, d))


@query(_DUPS + " SELECT kind, count(DISTINCT dup_key) AS n_groups, count(*) AS pages_affected FROM dups GROUP BY kind")
def duplicate_summary(s, d):
    return pages.duplicate_summary(pages.duplicates(now(s, d)))


_THIN = f"""{NOW}, thin AS (SELECT url, coalesce(word_count, 0) AS word_count, coalesce(text_to_html_ratio, 0.0) AS text_to_html_ratio,
  CASE WHEN coalesce(word_count, 0) > 0 AND coalesce(word_count, 0) < 100 THEN 'critical' WHEN coalesce(word_count, 0) < 300 THEN 'thin' ELSE 'ok' END AS class,
  coalesce(text_to_html_ratio, 0) > 0 AND coalesce(text_to_html_ratio, 0) < 10 AS is_low_ratio FROM latest WHERE crawl_error IS NULL AND status_code = 200 AND contains(lower(content_type), 'html'))"""


@query(f"WITH {_THIN} SELECT * FROM thin WHERE class <> 'ok' OR is_low_ratio")
def thin_content(s, d):
    return pages.thin_content(now(s, d))


@query(f"WITH {NOW} SELECT url, status_code, CASE WHEN status_code < 500 THEN '4xx' ELSE '5xx' END AS class FROM latest WHERE status_code BETWEEN 400 AND 599")
def broken_pages(s, d):
    return pages.broken_pages(now(s, d, "status_code"))


_B404 = f"{NOW}, b404 AS (SELECT l.to_url_normalized AS url, count(*) AS n_inlinks, coalesce(array_to_string(list_sort(list(DISTINCT from_url) FILTER (from_url <> ''))[1:10], ' '), '') AS linking_urls FROM links l JOIN latest p ON p.url = l.to_url_normalized AND p.status_code = 404 GROUP BY 1)"


@query(f"WITH {_B404} SELECT * FROM b404")
def broken_with_inlinks(s, d):
    return pages.broken_with_inlinks(now(s, d, "status_code"), links(s, d))


@query("SELECT count(*) AS n_links, count(DISTINCT to_url_normalized) AS n_targets FROM links WHERE NOT is_internal AND NOT is_special_link")
def external_links(s, d):
    return pages.external_links(links(s, d))


@query("SELECT to_url_normalized AS url, count(*) AS n_inlinks FROM links WHERE is_internal AND to_url_normalized IS NOT NULL GROUP BY 1")
def inlink_counts(s, d):
    return pages.inlink_counts(links(s, d))


_INL = f"""{NOW}, inl AS (SELECT p.url, count(l.from_url) AS n_inlinks FROM latest p LEFT JOIN (SELECT from_url, to_url_normalized FROM links WHERE is_internal AND NOT is_special_link AND to_url_normalized <> from_url) l ON l.to_url_normalized = p.url
  WHERE p.status_code = 200 AND coalesce(p.is_indexable, FALSE) GROUP BY p.url)"""


@query(f"WITH {_INL} SELECT url, n_inlinks, CASE WHEN n_inlinks = 0 THEN 'orphan' WHEN n_inlinks <= 2 THEN 'low' ELSE 'ok' END AS class FROM inl")
def orphan_pages(s, d):
    return pages.inlinked_pages(now(s, d, "status_code", "is_indexable"), links(s, d))


@query(f"WITH {_INL} SELECT url, n_inlinks FROM inl ORDER BY n_inlinks DESC, url LIMIT 20")
def most_linked(s, d):
    return graph.top(pages.inlinked_pages(now(s, d, "status_code", "is_indexable"), links(s, d)), 20, F.desc("n_inlinks"), F.col("url")).select("url", "n_inlinks")


@query(f"WITH {_INL} SELECT url, n_inlinks FROM inl ORDER BY n_inlinks, url LIMIT 20")
def least_linked(s, d):
    return graph.top(pages.inlinked_pages(now(s, d, "status_code", "is_indexable"), links(s, d)), 20, F.col("n_inlinks"), F.col("url")).select("url", "n_inlinks")


_CAN = f"""{NOW}, p AS (SELECT url, status_code, coalesce(is_indexable, FALSE) AS ix, coalesce(canonical, '') AS c FROM latest),
  j AS (SELECT p.*, t.url AS tu, t.status_code AS ts, t.ix AS ti, t.c AS tc FROM p LEFT JOIN p t ON p.c = t.url),
  canon AS (SELECT url, unnest(list_filter([CASE WHEN c = '' AND status_code = 200 AND ix THEN 'missing' END, CASE WHEN c <> '' AND c <> url THEN 'canonicalised' END, CASE WHEN c <> '' AND {AUTH('c')} <> '' AND NOT (regexp_replace({AUTH('c')}, '^www\\.', '') = {SITE2('url')} OR suffix(regexp_replace({AUTH('c')}, '^www\\.', ''), '.' || {SITE2('url')})) THEN 'external' END,
   CASE WHEN c <> '' AND tu IS NOT NULL AND ts <> 200 THEN 'to_non_200' END, CASE WHEN c <> '' AND tu IS NOT NULL AND ts = 200 AND NOT ti THEN 'to_non_indexable' END, CASE WHEN c <> '' AND c <> url AND tu IS NOT NULL AND tc = url THEN 'loop' END,
   CASE WHEN c <> '' AND c <> url AND tu IS NOT NULL AND tc <> '' AND tc <> c AND tc <> url THEN 'chain' END], lambda x: x IS NOT NULL)) AS issue, c AS canonical FROM j)"""


@query(f"WITH {_CAN} SELECT * FROM canon")
def canonical_audit(s, d):
    return pages.canonical_audit(now(s, d, "status_code", "is_indexable", "canonical"))


_HYG = f"""{NOW}, ok AS (SELECT url FROM latest WHERE coalesce(status_code, 0) < 400), keyed AS (SELECT url, {HOST('url')} AS h, {PATHKEY('url')} AS p FROM ok),
  hyg AS (SELECT url, unnest(list_filter([CASE WHEN length(url) > 115 THEN 'long' END, CASE WHEN regexp_matches({PATH('url')}, '[A-Z]') THEN 'uppercase' END, CASE WHEN contains({PATH('url')}, '_') THEN 'underscore' END,
   CASE WHEN len({QUERY('url')}) > 5 THEN 'many_params' END, CASE WHEN list_has_any(list_transform({QUERY('url')}, lambda x: lower(string_split(x, '=')[1])), ['utm_source','utm_medium','utm_campaign','utm_content','utm_term','fbclid','gclid','msclkid','ref','ref_src']) THEN 'tracking' END,
   CASE WHEN regexp_extract(url, '#(.*)$', 1) <> '' THEN 'fragment' END, CASE WHEN regexp_matches(url, '[^\\x00-\\x7f]') THEN 'non_ascii' END], lambda x: x IS NOT NULL)) AS issue FROM ok
   UNION ALL SELECT url, 'duplicate_path' FROM keyed WHERE (h, p) IN (SELECT (h, p) FROM keyed GROUP BY h, p HAVING count(DISTINCT url) > 1))"""


@query(f"WITH {_HYG} SELECT * FROM hyg")
def url_hygiene(s, d):
    return pages.url_hygiene(now(s, d, "status_code"))


_IMG = """img AS (SELECT id, src, NOT coalesce(has_alt, FALSE) AS no_alt, coalesce(has_alt, FALSE) AND (coalesce(alt_is_empty, FALSE) OR coalesce(alt, '') = '') AS empty_alt,
  coalesce(coalesce(has_alt, FALSE) AND NOT (coalesce(alt_is_empty, FALSE) OR coalesce(alt, '') = '') AND length(alt) > 125, FALSE) AS long_alt, NOT coalesce(has_explicit_dimensions, FALSE) AS no_dimensions,
  lower(coalesce(file_extension, '')) IN ('jpg','jpeg','png','gif') AS legacy_format, NOT coalesce(is_lazy_loaded, FALSE) AS not_lazy FROM images),
  uni AS (SELECT * FROM img WHERE src IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src ORDER BY id) = 1)"""
_PCT = lambda c: f"CASE WHEN count(*) > 0 THEN {HALF(f'count(*) FILTER ({c})::DOUBLE / count(*) * 100', 2)} ELSE 0.0 END AS {c}_pct"
_FAULTS = ("no_alt", "empty_alt", "long_alt", "no_dimensions", "legacy_format", "not_lazy")


@query(f"WITH {_IMG} SELECT * FROM (SELECT count(*) AS n_images, {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in _FAULTS)} FROM img), (SELECT count(*) AS n_unique, {', '.join(f'count(*) FILTER ({c}) AS unique_{c}' for c in _FAULTS)} FROM uni), (SELECT {', '.join(_PCT(c) for c in _FAULTS)} FROM img)")
def image_audit(s, d):
    return pages.image_audit(table(s, d, "images"))


@query("SELECT lower(coalesce(file_extension, '')) AS extension, count(*) AS n_images FROM images GROUP BY 1")
def image_formats(s, d):
    return pages.image_formats(table(s, d, "images", "file_extension"))


@query("SELECT lower(trim(alt, ' ')) AS alt_key, count(*) AS n_images, count(DISTINCT src) AS n_sources FROM images WHERE length(trim(alt, ' ')) > 3 GROUP BY 1 HAVING count(DISTINCT src) > 1")
def repeated_alts(s, d):
    return pages.repeated_alts(table(s, d, "images", "alt", "src"))


@query("SELECT page_url, run_id, position, level, pl AS previous_level FROM (SELECT *, lag(level) OVER (PARTITION BY page_url, run_id ORDER BY position, id) AS pl FROM headings) WHERE level > pl + 1")
def heading_skips(s, d):
    return pages.skipped_levels(table(s, d, "headings", "id", "page_url", "run_id", "position", "level"))


@query(f"WITH {NOW} SELECT unnest(['2xx','3xx','4xx','5xx','indexable','failed','pages']) AS metric, unnest([count(*) FILTER (status_code BETWEEN 200 AND 299), count(*) FILTER (status_code BETWEEN 300 AND 399), count(*) FILTER (status_code BETWEEN 400 AND 499), count(*) FILTER (status_code BETWEEN 500 AND 599), count(*) FILTER (coalesce(is_indexable, FALSE)), count(*) FILTER (crawl_error IS NOT NULL), count(*)]) AS value FROM latest")
def status_overview(s, d):
    return pages.status_overview(now(s, d, "status_code", "is_indexable", "crawl_error"))


@query("SELECT url, status_code FROM pages WHERE status_code BETWEEN 300 AND 399")
def status_range(s, d):
    return table(s, d, "pages", "url", "status_code").where(F.col("status_code").between(300, 399))


@query(f"""WITH {NOW}, a AS (SELECT {HOST('url')} AS site, count(*) AS n_pages, count(*) FILTER (coalesce(is_indexable, FALSE)) AS n_indexable, count(*) FILTER (status_code BETWEEN 400 AND 499) AS n_4xx, sum(coalesce(word_count, 0)) AS w FROM latest GROUP BY 1),
  b AS (SELECT {HOST('from_url')} AS site, count(*) AS n FROM links GROUP BY 1), c AS (SELECT {HOST('page_url')} AS site, count(*) AS n FROM images GROUP BY 1)
  SELECT site, n_pages, n_indexable, n_4xx, coalesce(b.n, 0) AS n_links, coalesce(c.n, 0) AS n_images, {HALF('w::DOUBLE / n_pages', 2)} AS mean_words FROM a LEFT JOIN b USING (site) LEFT JOIN c USING (site)""")
def site_comparison(s, d):
    return pages.site_comparison(now(s, d, "status_code", "is_indexable", "word_count"), links(s, d), table(s, d, "images", "page_url"))


@query(f"WITH {NOW} SELECT CASE WHEN depth >= 0 THEN depth ELSE -1 END AS depth, count(*) AS n_pages, count(*) FILTER (status_code >= 400) AS n_4xx FROM latest GROUP BY 1")
def depth_histogram(s, d):
    return pages.depth_histogram(now(s, d, "depth", "status_code"))


@query(f"""WITH {NOW}, seg AS (SELECT {HOST('url')} AS site, {SEGS('url')} AS s, CASE WHEN status_code >= 400 THEN status_code ELSE 0 END AS bad FROM latest),
  pre AS (SELECT site, bad, unnest(list_transform(generate_series(0, len(s)), lambda i: '/' || array_to_string(s[1:i], '/'))) AS prefix FROM seg) SELECT site, prefix, count(*) AS n_pages, max(bad) AS worst_status FROM pre GROUP BY site, prefix""")
def path_tree(s, d):
    return pages.path_tree(now(s, d, "status_code"))


@query(f"WITH {NOW} SELECT url, status_code, content_type, title, title_length, meta_description, h1_count, word_count, depth, canonical, is_indexable, internal_links_count, response_time_ms FROM latest WHERE status_code BETWEEN 200 AND 299 AND depth >= 2 AND coalesce(meta_description, '') = ''")
def explorer(s, d):
    return pages.explorer(now(s, d), status=(200, 299), least_depth=2, lacking=("meta",))


_T = f"SELECT DISTINCT to_url FROM links WHERE regexp_matches(lower(to_url), '^https?://')"


@query(f"WITH t AS ({_T}) SELECT to_url AS url, {normal_form_sql('to_url')} AS normal FROM t")
def url_normalize(s, d):
    t = table(s, d, "links", "to_url").where(F.lower("to_url").rlike("^https?://")).distinct()
    return t.select(F.col("to_url").alias("url"), urls.normal_form_udf("to_url").alias("normal"))


@query(f"WITH t AS ({_T} AND NOT regexp_matches(to_url, '/\\.\\.?/')) SELECT to_url AS url, {normal_form_sql('to_url')} AS normal FROM t")
def url_normalize_native(s, d):
    t = table(s, d, "links", "to_url").where(F.lower("to_url").rlike("^https?://") & ~F.col("to_url").rlike(r"/\.\.?/")).distinct()
    return t.select(F.col("to_url").alias("url"), urls.native_normal_form("to_url").alias("normal"))


@query(f"WITH {NOW} SELECT url, {HOST('url')} AS host, {SITE2('url')} AS domain, {PATHKEY('url')} AS path, len({SEGS('url')}) AS url_depth, len({QUERY('url')}) AS n_params FROM latest")
def url_parts(s, d):
    return now(s, d, "status_code").select("url", urls.host("url").alias("host"), urls.registrable("url").alias("domain"), urls.path_key("url").alias("path"), urls.depth("url").alias("url_depth"), F.size(urls.query_pairs("url")).alias("n_params"))


_TYPE = f"""CASE WHEN len({SEGS('lower(url)')}) = 0 THEN 'home'
  WHEN list_has_any({SEGS('lower(url)')}, ['product','products','p','item','items']) AND len({SEGS('lower(url)')}) >= 2 AND {SEGS('lower(url)')}[-1] NOT IN ('product','products') THEN 'product'
  WHEN list_has_any({SEGS('lower(url)')}, ['category','categories','collection','collections','c','cat','tag','tags']) OR {SEGS('lower(url)')}[-1] IN ('products','product','shop','store') THEN 'category'
  WHEN list_has_any({SEGS('lower(url)')}, ['blog','blogs','article','articles','news','post','posts']) THEN 'blog' WHEN list_has_any({SEGS('lower(url)')}, ['about','contact','privacy','terms','faq','pages','page','policy']) THEN 'static' ELSE 'other' END"""


@query(f"WITH {NOW} SELECT url, {_TYPE} AS page_type FROM latest")
def url_page_type(s, d):
    return now(s, d, "status_code").select("url", scoring.page_type("url").alias("page_type"))


_VALS = f"list_filter({QUERY('url')}, lambda x: x NOT LIKE '%=' AND contains(x, '='))"
_KEYS = f"list_transform({_VALS}, lambda x: lower(string_split(x, '=')[1]))"


@query(f"""WITH {NOW} SELECT kind, count(*) AS n FROM (SELECT CASE
  WHEN regexp_matches({PATH('lower(url)')}, '^(/auth/|/login|/signin|/sign-in|/sign_in|/customer/account/login|/account/login|/wp-login.php)') THEN 'redirect_wrapper'
  WHEN len(list_filter({_VALS}, lambda x: lower(string_split(x, '=')[1]) IN ('page','p','pg','pageno','page_no') AND try_cast(string_split(x, '=')[2] AS INT) > 3)) > 0 THEN 'pagination_deep'
  WHEN len(list_filter({_KEYS}, lambda k: k LIKE 'filter%' OR k LIKE '%[]' OR k IN ('category','brand','tag','color','size','price'))) > 1 THEN 'filter_combination' ELSE 'other' END AS kind FROM latest) GROUP BY kind""")
def url_kinds(s, d):
    return now(s, d, "status_code").groupBy(urls.kind("url").alias("kind")).agg(F.count("*").alias("n"))


@query(f"WITH {NOW} SELECT {HOST('url')} AS host, min(url) AS url, count(*) AS n_pages FROM latest GROUP BY 1")
def host_sample(s, d):
    return now(s, d, "status_code").groupBy(urls.host("url").alias("host")).agg(F.min("url").alias("url"), F.count("*").alias("n_pages"))


_W = "coalesce(title, '')"


@query(f"""WITH {NOW} SELECT url, CAST(floor((30 * len(regexp_extract_all({_W}, '[ilIj .,]')) + 40 * len(regexp_extract_all({_W}, '[tfال]')) + 70 * len(regexp_extract_all({_W}, '[م]')) + 90 * len(regexp_extract_all({_W}, '[wm]')) + 100 * len(regexp_extract_all({_W}, 'M')) + 110 * len(regexp_extract_all({_W}, 'W'))
  + 55 * len(regexp_extract_all({_W}, '[\\x{{0600}}-\\x{{06FF}}]')) - 55 * len(regexp_extract_all({_W}, '[الم]'))
  + 60 * (length({_W}) - len(regexp_extract_all({_W}, '[ilIj .,tfwmMW]')) - len(regexp_extract_all({_W}, '[\\x{{0600}}-\\x{{06FF}}]')))) * 13 / 100.0) AS INT) AS pixels FROM latest""")
def title_pixel_width(s, d):
    return now(s, d, "title").select("url", tx.pixel_width("title").alias("pixels"))


@query(f"SELECT doc_id, CASE WHEN coalesce({SQUEEZE('lower(text)')}, '') = '' THEN '' ELSE md5({SQUEEZE('lower(text)')}) END AS content_hash FROM documents")
def doc_content_hash(s, d):
    return table(s, d, "documents", "doc_id", "text").select("doc_id", tx.content_hash("text").alias("content_hash"))


_A, _L = "len(regexp_extract_all(text, '[\\x{0600}-\\x{06FF}]'))", "len(regexp_extract_all(text, '[A-Za-z]'))"


@query(f"SELECT doc_id, CASE WHEN text IS NULL OR {_A} + {_L} = 0 THEN 'unknown' WHEN {_A} > ({_A} + {_L}) * 0.7 THEN 'ar' WHEN {_L} > ({_A} + {_L}) * 0.7 THEN 'en' ELSE 'mixed' END AS script FROM documents")
def doc_script(s, d):
    return table(s, d, "documents", "doc_id", "text").select("doc_id", tx.script_language("text").alias("script"))


_RAW = f"list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\x{{0600}}-\\x{{06FF}}\\s]', ' ', 'g'), '{SPACE}+'), lambda w: w <> '')"


@query(f"SELECT doc_id, len({_RAW}) AS word_count, length(coalesce(text, '')) AS character_count, len(regexp_extract_all(coalesce(text, ''), '[.!?؟،]')) AS sentence_count, greatest(1, CAST(floor(len({_RAW}) / 200.0 + 0.5) AS INT)) AS reading_minutes FROM documents")
def doc_text_stats(s, d):
    return table(s, d, "documents", "doc_id", "text").select("doc_id", *tx.text_stats("text"))


@query("SELECT id, CASE WHEN regexp_matches(anchor_text, '^[=+\\-@\\t\\r]') THEN '''' || anchor_text ELSE anchor_text END AS cell FROM links")
def csv_safe_cells(s, d):
    return links(s, d).select("id", tx.formula_safe("anchor_text").alias("cell"))


@query(f"WITH {NOW} SELECT url AS loc, strftime(max(crawled_at), '%Y-%m-%d') AS lastmod FROM latest WHERE status_code = 200 AND coalesce(is_indexable, FALSE) AND (coalesce(canonical, '') = '' OR regexp_replace(canonical, '/+$', '') = regexp_replace(url, '/+$', '')) GROUP BY url")
def sitemap_eligible(s, d):
    return sinks.sitemap_entries(now(s, d, "status_code", "is_indexable", "canonical", "crawled_at"))


def _edges(s, d):
    return links(s, d).where("is_internal and not is_special_link and to_url_normalized is not null").select(F.col("from_url").alias("src"), F.col("to_url_normalized").alias("dst"))


_E = f"{NOW}, n AS MATERIALIZED (SELECT url FROM latest), k AS MATERIALIZED (SELECT count(*)::DOUBLE AS c FROM n), e AS MATERIALIZED (SELECT DISTINCT from_url AS src, to_url_normalized AS dst FROM links WHERE is_internal AND NOT is_special_link AND from_url <> to_url_normalized AND from_url IN (SELECT url FROM n) AND to_url_normalized IN (SELECT url FROM n)), o AS MATERIALIZED (SELECT src, count(*) AS od FROM e GROUP BY src), i AS MATERIALIZED (SELECT dst, count(*) AS idg FROM e GROUP BY dst), r0 AS MATERIALIZED (SELECT url, 1.0::DOUBLE / c AS pr, od FROM n CROSS JOIN k LEFT JOIN o ON o.src = n.url)"
_R = "".join(f", s{t} AS MATERIALIZED (SELECT e.dst, sum(r.pr / r.od) AS got FROM e JOIN r{t - 1} r ON r.url = e.src GROUP BY e.dst), r{t} AS MATERIALIZED (SELECT r.url, 0.15 / k.c + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(pr), 0) FROM r{t - 1} WHERE od IS NULL) / k.c) AS pr, r.od FROM r{t - 1} r CROSS JOIN k LEFT JOIN s{t} g ON g.dst = r.url)" for t in range(1, 31))


@query(f"WITH {_E}{_R} SELECT r.url, {HALF('pr / (SELECT max(pr) FROM r30) * 100', 2)} AS score, {HALF('pr', 8)} AS raw, coalesce(i.idg, 0) AS in_degree, coalesce(r.od, 0) AS out_degree FROM r30 r LEFT JOIN i ON i.dst = r.url")
def link_score(s, d):
    return graph.link_score(now(s, d, "status_code"), _edges(s, d))


@query(f"""WITH RECURSIVE {NOW}, e AS MATERIALIZED (SELECT DISTINCT from_url AS src, to_url_normalized AS dst FROM links WHERE is_internal AND NOT is_special_link AND from_url IS NOT NULL AND to_url_normalized IS NOT NULL),
  w(url, depth) USING KEY (url) AS (SELECT url, 0 FROM latest WHERE depth = 0 UNION SELECT e.dst, min(w.depth) + 1 FROM w JOIN e ON e.src = w.url WHERE e.dst NOT IN (SELECT url FROM recurring.w) GROUP BY e.dst) SELECT url, depth FROM w""")
def reachability(s, d):
    return graph.reachable(_edges(s, d), now(s, d, "depth").where("depth = 0"))


def _hops(s, d):
    p = table(s, d, "pages", "page_id")
    n = lambda k: F.concat(F.lit("https://r.example/"), F.col("page_id").cast("string"), F.lit(k))
    one = p.select(n("").alias("original_url"), n("").alias("from_url"), n("/a").alias("to_url"), F.lit(301).alias("status_code"))
    two = p.where("page_id % 2 = 0").select(n("").alias("original_url"), n("/a").alias("from_url"), n("/b").alias("to_url"), F.lit(302).alias("status_code"))
    three = p.where("page_id % 12 = 0").select(n("").alias("original_url"), n("/b").alias("from_url"), n("").alias("to_url"), F.lit(301).alias("status_code"))
    return three.unionAll(two).unionAll(one)


@query("""WITH p AS (SELECT 'https://r.example/' || page_id AS u, page_id FROM pages) SELECT u AS original_url, u || ' > ' || u || '/a' || CASE WHEN page_id % 2 = 0 THEN ' > ' || u || '/b' ELSE '' END || CASE WHEN page_id % 12 = 0 THEN ' > ' || u ELSE '' END AS chain,
  CASE WHEN page_id % 12 = 0 THEN u WHEN page_id % 2 = 0 THEN u || '/b' ELSE u || '/a' END AS final_url, 1 + (page_id % 2 = 0)::INT + (page_id % 12 = 0)::INT AS n_hops, page_id % 2 = 0 AS is_chain, page_id % 12 = 0 AS is_loop, (page_id % 2 = 0)::INT AS n_temporary FROM p""")
def redirect_chains(s, d):
    return graph.redirect_chains(_hops(s, d))


def mixed_content(s, d):
    """Pages (url, severity) over https with something over http: images (passive), and, standing
    in for scripts and forms that the tables lack, image links (active) and footer links (form)."""
    bad = lambda page, target: F.col(page).startswith("https://") & F.col(target).startswith("http://")
    of_images = table(s, d, "images", "page_url", "src").where(bad("page_url", "src")).select(F.col("page_url").alias("url"), F.lit("passive").alias("severity"))
    li = table(s, d, "links", "from_url", "to_url", "is_image_link", "in_footer").where(bad("from_url", "to_url") & (F.col("is_image_link") | F.col("in_footer")))
    return of_images.unionAll(li.select(F.col("from_url").alias("url"), F.when(F.col("is_image_link"), "active").otherwise("form").alias("severity"))).distinct()


_MIXED = "mixed AS (SELECT page_url AS url, 'passive' AS severity FROM images WHERE page_url LIKE 'https://%' AND src LIKE 'http://%' UNION SELECT from_url, CASE WHEN is_image_link THEN 'active' ELSE 'form' END FROM links WHERE from_url LIKE 'https://%' AND to_url LIKE 'http://%' AND (is_image_link OR in_footer))"


def _issues(p, s, d):
    li, im = links(s, d), table(s, d, "images")
    canon, hyg, thin = pages.canonical_audit(p), pages.url_hygiene(p), pages.thin_content(p)
    inl = pages.inlinked_pages(p, li)
    dup = pages.duplicates(p)
    img = pages.image_audit(im)
    chains, mixed = graph.redirect_chains(_hops(s, d)), mixed_content(s, d)
    one = lambda c: img.select(F.col(c).alias("affected_count"))
    return issues.collect_issues(
        p,
        {
            "Canonical Loops": canon.where("issue = 'loop'"), "Canonical to Non-200 URL": canon.where("issue = 'to_non_200'"), "Canonical to Non-Indexable URL": canon.where("issue = 'to_non_indexable'"), "External Canonicals": canon.where("issue = 'external'"), "Canonical Chains": canon.where("issue = 'chain'"),
            "Long URLs": hyg.where("issue = 'long'"), "Noisy or Duplicate URL Patterns": hyg.where("issue in ('many_params', 'tracking', 'duplicate_path')"), "404 Pages with Inlinks": pages.broken_with_inlinks(p, li), "Duplicate Titles": dup.where("kind = 'title'"),
            "Orphan Pages": inl.where("class = 'orphan'"), "Low Internal Linking": inl.where("class = 'low'"), "Critical Thin Content": thin.where("class = 'critical'"), "Thin Content": thin.where("class = 'thin'"),
            "Images Without Alt": one("unique_no_alt"), "Images Without Dimensions": one("unique_no_dimensions"), "Legacy Image Formats": one("unique_legacy_format"), "Images Without Lazy Loading": one("unique_not_lazy"),
            "Redirect Chains": chains.where("is_chain"), "Redirect Loops": chains.where("is_loop"), "Active Mixed Content": mixed.where("severity = 'active'"), "Passive Mixed Content": mixed.where("severity = 'passive'"), "Insecure Form Submission (Mixed Content)": mixed.where("severity = 'form'"),
        },
    )


def _rules_sql() -> str:
    ok, ix = "status_code = 200", "coalesce(is_indexable, FALSE)"
    n = lambda c: f"coalesce({c}, 0)"
    rules = {
        "Server Errors (5xx)": "status_code BETWEEN 500 AND 599",
        "NoIndex on Important Pages": f"{ok} AND NOT {ix} AND contains(lower(coalesce(meta_robots, '')), 'noindex') AND {n('depth')} <= 2",
        "Missing Title": f"{ok} AND {ix} AND coalesce(title, '') = ''",
        "Missing Meta Description": f"{ok} AND {ix} AND coalesce(meta_description, '') = ''",
        "Missing H1": f"{ok} AND {ix} AND {n('h1_count')} = 0",
        "Multiple H1": f"{ok} AND {n('h1_count')} > 1",
        "Title Too Long": f"{ok} AND {n('title_length')} > 60",
        "Title Too Short": f"{ok} AND {n('title_length')} BETWEEN 1 AND 29",
        "Description Too Long": f"{ok} AND {n('meta_description_length')} > 160",
        "Description Too Short": f"{ok} AND {n('meta_description_length')} BETWEEN 1 AND 69",
        "Deep Pages": f"{ok} AND {n('depth')} > 4",
    }
    parts = [f"SELECT '{k}' AS issue_type, count(*) FILTER ({c}) AS affected_count FROM latest" for k, c in rules.items()]
    more = {
        "Canonical Loops": "canon WHERE issue = 'loop'", "Canonical to Non-200 URL": "canon WHERE issue = 'to_non_200'", "Canonical to Non-Indexable URL": "canon WHERE issue = 'to_non_indexable'", "External Canonicals": "canon WHERE issue = 'external'", "Canonical Chains": "canon WHERE issue = 'chain'",
        "Long URLs": "hyg WHERE issue = 'long'", "Noisy or Duplicate URL Patterns": "hyg WHERE issue IN ('many_params', 'tracking', 'duplicate_path')", "404 Pages with Inlinks": "b404", "Duplicate Titles": "dups WHERE kind = 'title'",
        "Orphan Pages": "inl WHERE n_inlinks = 0", "Low Internal Linking": "inl WHERE n_inlinks BETWEEN 1 AND 2", "Critical Thin Content": "thin WHERE class = 'critical'", "Thin Content": "thin WHERE class = 'thin'",
        "Images Without Alt": "uni WHERE no_alt", "Images Without Dimensions": "uni WHERE no_dimensions", "Legacy Image Formats": "uni WHERE legacy_format", "Images Without Lazy Loading": "uni WHERE not_lazy",
        "Redirect Chains": "pages WHERE page_id % 2 = 0", "Redirect Loops": "pages WHERE page_id % 12 = 0", "Active Mixed Content": "mixed WHERE severity = 'active'", "Passive Mixed Content": "mixed WHERE severity = 'passive'", "Insecure Form Submission (Mixed Content)": "mixed WHERE severity = 'form'",
    }
    parts += [f"SELECT '{k}', count(*) FROM {c}" for k, c in more.items()]
    known = ", ".join(f"('{n}', '{sv}', '{c}', {least})" for n, sv, c, least in issues.RULES)
    strip = lambda c: c[len(NOW) + 2 :]
    ctes = ", ".join([NOW, strip(_CAN), strip(_HYG), strip(_B404), strip(_INL), strip(_THIN), _IMG, _MIXED, _DUPS[len("WITH ") + len(NOW) + 2 :]])
    return f"WITH {ctes}, found AS ({' UNION ALL '.join(parts)}), rules(issue_type, severity, category, least) AS (VALUES {known}), iss AS (SELECT issue_type, severity, category, affected_count FROM found JOIN rules USING (issue_type) WHERE affected_count >= least)"


_ISS = _rules_sql()


@query(_ISS + " SELECT * FROM iss")
def seo_issues(s, d):
    return _issues(now(s, d), s, d)


@query(_ISS + " SELECT severity, category, count(*) AS n_issues, sum(affected_count) AS n_affected FROM iss GROUP BY ALL")
def issues_by_severity(s, d):
    return issues.by_severity(_issues(now(s, d), s, d))


def _hint_sql() -> str:
    has = lambda words: " OR ".join("contains(lower(issue_type), '" + w + "')" for w in words)
    case = lambda values, other: "CASE " + " ".join("WHEN " + has(h[0]) + " THEN '" + v.replace("'", "''") + "'" for h, v in zip(issues.HINTS, values)) + f" ELSE {other} END"
    w = lambda c: f"CASE {c} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
    imp = case([h[1] for h in issues.HINTS], "CASE WHEN severity IN ('critical', 'high') THEN 'high' WHEN severity = 'low' THEN 'low' ELSE 'medium' END")
    eff = case([h[2] for h in issues.HINTS], "'medium'")
    why, how = (case([a[i] for a in issues.ADVICE], "''") for i in (0, 1))
    ratio = HALF("(" + w("impact") + ")::DOUBLE / (" + w("effort") + ")", 2)
    return f", hin AS (SELECT *, {imp} AS impact, {eff} AS effort, {why} AS why, {how} AS how FROM iss) SELECT *, {ratio} AS hint_score FROM hin"


@query(_ISS + _hint_sql())
def issues_with_hints(s, d):
    return issues.with_hints(_issues(now(s, d), s, d))


@query(_ISS + """, w AS (SELECT coalesce(sum(affected_count) FILTER (severity = 'critical'), 0) AS critical, coalesce(sum(affected_count) FILTER (severity = 'high'), 0) AS high, coalesce(sum(affected_count) FILTER (severity = 'medium'), 0) AS medium, coalesce(sum(affected_count) FILTER (severity = 'low'), 0) AS low FROM iss),
  sc AS (SELECT *, CAST(greatest(0, least(100, floor(100 - (critical * 3 + high * 2 + medium + low * 0.25) / (SELECT count(*) FROM latest) * 8 + 0.5))) AS INT) AS score FROM w) SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' WHEN score >= 25 THEN 'poor' ELSE 'critical' END AS band FROM sc""")
def health_score(s, d):
    p = now(s, d)
    return issues.health(_issues(p, s, d), p.count())


_RUN = lambda r: f"SELECT DISTINCT regexp_replace(url, '/+$', '') AS url FROM pages WHERE url IS NOT NULL AND run_id = {r}"


@query(f"WITH a AS ({_RUN(0)}), b AS ({_RUN(1)}) SELECT url, 'added' AS state FROM b WHERE url NOT IN (SELECT url FROM a) UNION ALL SELECT url, 'removed' FROM a WHERE url NOT IN (SELECT url FROM b)")
def crawl_compare_pages(s, d):
    p = table(s, d, "pages", "url", "run_id")
    return issues.compare_pages(p.where("run_id = 0"), p.where("run_id = 1"))


_AT = lambda r: f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC, page_id DESC) AS rn FROM pages WHERE url IS NOT NULL AND run_id <= {r}) WHERE rn = 1"


def _compare_sql() -> str:
    start = _ISS.index("found AS (") + len("found AS (")
    rules = " UNION ALL ".join(_ISS[start:].split(" UNION ALL ")[: _ISS.count("AS affected_count FROM latest")])
    side = lambda t: f"SELECT * FROM ({rules.replace('FROM latest', f'FROM {t}')}) WHERE affected_count > 0"
    return f"WITH p0 AS ({_AT(0)}), p1 AS ({_AT(12)}), a AS ({side('p0')}), b AS ({side('p1')}) SELECT coalesce(a.issue_type, b.issue_type) AS issue_type, coalesce(a.affected_count, 0) AS old_count, coalesce(b.affected_count, 0) AS new_count, coalesce(b.affected_count, 0) - coalesce(a.affected_count, 0) AS delta, CASE WHEN b.issue_type IS NULL THEN 'fixed' WHEN a.issue_type IS NULL THEN 'new' ELSE 'persisting' END AS state FROM a FULL JOIN b ON a.issue_type = b.issue_type"


@query(_compare_sql())
def crawl_compare_issues(s, d):
    p = table(s, d, "pages", *PAGE, "run_id")
    one = lambda r: issues.collect_issues(pages.latest(p.where(F.col("run_id") <= r), *[c for c in PAGE if c != "url"]))
    return issues.compare_issues(one(0), one(12))


_FLAGS = f"""idx AS (SELECT p.url, {PATHKEY('p.url')} AS path, coalesce(status_code, 0) AS status_code, coalesce(is_indexable, FALSE) AS is_indexable, coalesce(depth, 0) AS depth, coalesce(internal_links_count, 0) AS internal_links_count,
  list_filter([CASE WHEN coalesce(status_code, 0) >= 400 THEN 'broken' END, CASE WHEN status_code = 200 AND NOT coalesce(is_indexable, FALSE) THEN 'noindex' END, CASE WHEN status_code = 200 AND coalesce(title, '') = '' THEN 'missing_title' END, CASE WHEN status_code = 200 AND coalesce(meta_description_length, 0) = 0 THEN 'missing_meta' END,
  CASE WHEN status_code = 200 AND coalesce(h1_count, 0) = 0 THEN 'missing_h1' END, CASE WHEN status_code = 200 AND coalesce(h1_count, 0) > 1 THEN 'multiple_h1' END, CASE WHEN p.url IN (SELECT url FROM inl WHERE n_inlinks = 0) THEN 'orphan' END, CASE WHEN p.url IN (SELECT url FROM thin WHERE class = 'thin') THEN 'thin' END,
  CASE WHEN p.url IN (SELECT url FROM thin WHERE class = 'critical') THEN 'thin_critical' END, CASE WHEN p.url IN (SELECT url FROM canon WHERE issue IN ('loop', 'to_non_200', 'to_non_indexable', 'external', 'chain')) THEN 'canonical_issue' END, CASE WHEN p.url IN (SELECT url FROM b404) THEN '404_with_inlinks' END], lambda x: x IS NOT NULL) AS iss FROM latest p)"""
_IDX = f"WITH {NOW}, {_CAN[len(NOW) + 2 :]}, {_B404[len(NOW) + 2 :]}, {_INL[len(NOW) + 2 :]}, {_THIN[len(NOW) + 2 :]}, {_FLAGS}"


def _index(s, d):
    p, li = now(s, d), links(s, d)
    return scoring.technical_index(p, pages.inlinked_pages(p, li), pages.thin_content(p), pages.canonical_audit(p), pages.broken_with_inlinks(p, li))


@query(_IDX + " SELECT url, path, status_code, is_indexable, depth, internal_links_count, array_to_string(iss, ',') AS issues FROM idx")
def technical_index(s, d):
    return _index(s, d).withColumn("issues", F.array_join("issues", ","))


def _search(s, d):
    """Search rows stood in for by numbers derived from the crawl: a row for each page row with a
    title, so that pages without one have none."""
    p = table(s, d, "pages", "page_id", "url", "title").where("coalesce(title, '') <> ''")
    return p.select(F.col("url").alias("page"), (F.col("page_id") % 23).alias("clicks"), (F.col("page_id") % 997).alias("impressions"), (F.col("page_id") % 50).cast("double").alias("position"))


def _landing(s, d):
    p = table(s, d, "pages", "page_id", "url", "status_code").where("status_code = 200")
    return p.select(urls.part("url", "path").alias("path"), (F.col("page_id") % 41).alias("sessions"), (F.col("page_id") % 17).alias("users"), ((F.col("page_id") % 8) / 8).alias("engagement_rate"))


_SEARCH = "search AS (SELECT url AS page, page_id % 23 AS clicks, page_id % 997 AS impressions, (page_id % 50)::DOUBLE AS position FROM pages WHERE coalesce(title, '') <> '')"
_LAND = f"landing AS (SELECT {PATH('url')} AS path, page_id % 41 AS sessions, page_id % 17 AS users, (page_id % 8) / 8.0::DOUBLE AS er FROM pages WHERE status_code = 200), bp AS (SELECT {PATHKEY('path')} AS path, sum(sessions) AS sessions, sum(users) AS users, CASE WHEN sum(sessions) > 0 THEN {HALF('sum(er * sessions) / sum(sessions)', 4)} ELSE 0.0 END AS engagement_rate FROM landing GROUP BY 1)"
_UNI = f"""{_SEARCH}, {_LAND}, sp AS (SELECT page, arg_max(struct_pack(c := clicks, i := impressions, p := position), struct_pack(a := impressions, b := clicks)) AS s FROM search GROUP BY page),
  spp AS (SELECT {PATHKEY('page')} AS path, arg_min(struct_pack(c := clicks, i := impressions, p := position), page) AS s, min(page) AS page FROM search GROUP BY 1),
  uni2 AS (SELECT idx.*, coalesce(coalesce(sp.s, spp.s).c, 0) AS clicks, coalesce(coalesce(sp.s, spp.s).i, 0) AS impressions, coalesce(bp.sessions, 0) AS sessions, coalesce(bp.engagement_rate, 0.0) AS er FROM idx LEFT JOIN sp ON sp.page = idx.url LEFT JOIN spp ON spp.path = idx.path LEFT JOIN bp ON bp.path = idx.path)"""


def _unified(s, d):
    first = _search(s, d).groupBy("page").agg(F.max_by(F.struct("clicks", "impressions", "position"), F.struct("impressions", "clicks")).alias("r")).select("page", "r.*")
    return scoring.unified(_index(s, d), first, _landing(s, d))


@query(f"WITH {_LAND} SELECT * FROM bp")
def analytics_by_path(s, d):
    return scoring.by_path(_landing(s, d))


_SEV = "CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.SEVERITY.items()) + " ELSE 1.0 END"
_HARD = "CASE x " + " ".join(f"WHEN '{k}' THEN {({'easy': 0, 'moderate': 4, 'hard': 8}[e] + {'developer': 3, 'platform': 2, 'content': 1, 'seo': 0}[o])}" for k, (e, o) in scoring.EASE.items()) + " ELSE 7 END"
_SUM = f"list_sum(list_transform(iss, lambda x: ({_SEV})::DOUBLE))"
_TOP = f"list_reduce(iss, lambda m, y: CASE WHEN ({_SEV.replace('CASE x', 'CASE y')}) > ({_SEV.replace('CASE x', 'CASE m')}) THEN y ELSE m END)"
_UNIFIED = f"{_IDX}, {_UNI}"
_OPP = f"""opp AS (SELECT url, {HALF(f"(CASE WHEN clicks * 2 + impressions * 0.05::DOUBLE + sessions > 0 THEN ln(1 + clicks * 2 + impressions * 0.05::DOUBLE + sessions) ELSE ln(1 + internal_links_count) * 0.3::DOUBLE END) * {_SUM}", 3)} AS priority_score,
  len(iss)::INT AS n_issues, array_to_string(iss, ', ') AS technical_issues, {_TOP} AS top_fix FROM uni2 WHERE len(iss) > 0)"""
_PRI = f"""typed AS (SELECT *, {_TYPE} AS page_type, greatest(1, list_max(list_transform(iss, lambda x: {_HARD}))) AS hardest FROM uni2 WHERE len(iss) > 0),
  fac AS (SELECT *, CASE WHEN hardest >= 8 THEN 'hard' WHEN hardest >= 4 THEN 'moderate' ELSE 'easy' END AS ease, CASE hardest % 4 WHEN 3 THEN 'developer' WHEN 2 THEN 'platform' WHEN 1 THEN 'content' ELSE 'seo' END AS owner,
   {HALF("greatest(0.0::DOUBLE, (CASE page_type WHEN 'home' THEN 3.0 WHEN 'category' THEN 2.5 WHEN 'product' THEN 2.0 WHEN 'blog' THEN 1.5 ELSE 1.0 END)::DOUBLE + least(2.0::DOUBLE, ln(1 + greatest(internal_links_count, 0)) * 0.6::DOUBLE) - least(1.0::DOUBLE, greatest(depth, 0) * 0.1::DOUBLE))", 3)} AS importance,
   ln(1 + clicks * 2 + impressions * 0.05::DOUBLE) AS demand, ln(1 + sessions * (1 + er / 100)) AS business, {HALF("least(1.0::DOUBLE, 0.7::DOUBLE + least(0.2::DOUBLE, len(iss) * 0.05::DOUBLE) + CASE WHEN clicks > 0 OR impressions > 0 OR sessions > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)", 3)} AS confidence FROM typed),
  sco AS (SELECT *, {HALF(f"{_SUM} * (demand + business + importance) * (CASE ease WHEN 'easy' THEN 1.2 WHEN 'moderate' THEN 1.0 ELSE 0.85 END)::DOUBLE * confidence", 3)} AS priority_score FROM fac),
  ban AS (SELECT *, CASE WHEN best > 0 AND priority_score / best >= 0.5 THEN 'high' WHEN best > 0 AND priority_score / best >= 0.2 THEN 'medium' ELSE 'low' END AS priority_band FROM (SELECT *, max(priority_score) OVER () AS best FROM sco)),
  pri AS (SELECT url, page_type, priority_score, owner, ease, len(iss)::INT AS n_issues, array_to_string(iss, ', ') AS technical_issues, {_TOP} AS top_fix, priority_band, CASE WHEN priority_band = 'low' THEN 'low_impact' WHEN owner = 'developer' THEN 'needs_developer' WHEN owner = 'content' AND list_has_any(iss, ['thin', 'thin_critical']) THEN 'needs_content' WHEN priority_band = 'high' THEN 'do_now' ELSE 'do_later' END AS action_group FROM ban)"""


@query(f"WITH {_UNIFIED[5:]} SELECT url, path, status_code, is_indexable, depth, internal_links_count, array_to_string(iss, ',') AS issues, clicks, impressions, sessions, er AS engagement_rate FROM uni2")
def unified_report(s, d):
    return _unified(s, d).withColumn("issues", F.array_join("issues", ",")).drop("position", "users")


@query(f"WITH {_UNIFIED[5:]}, {_OPP} SELECT * FROM opp")
def opportunities(s, d):
    return scoring.opportunities(_unified(s, d))


@query(f"WITH {_UNIFIED[5:]}, {_PRI} SELECT * FROM pri")
def priorities(s, d):
    return scoring.priorities(_unified(s, d))


@query(f"WITH {_UNIFIED[5:]}, {_PRI} SELECT action_group, priority_band, count(*) AS n_pages FROM pri GROUP BY ALL")
def priority_summary(s, d):
    return scoring.priorities(_unified(s, d)).groupBy("action_group", "priority_band").agg(F.count("*").alias("n_pages"))


@query(f"WITH {_UNIFIED[5:]}, {_PRI} SELECT url, action_group, priority_score, priority_band, owner, ease, top_fix FROM pri ORDER BY list_position(['do_now','needs_content','needs_developer','needs_platform','do_later','low_impact'], action_group), priority_score DESC, url LIMIT 500")
def action_board(s, d):
    return scoring.action_board(scoring.priorities(_unified(s, d)))


def _queries(s, d):
    """Search rows by query: the segment of a customer asks, the nation's page answers."""
    o = table(s, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    c = table(s, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(F.col("c_mktsegment").alias("query"), F.concat(F.lit("/n/"), F.col("c_nationkey").cast("string")).alias("page"), (F.col("o_orderkey") % 7).alias("clicks"), (F.col("o_orderkey") % 90).alias("impressions"), (F.col("o_orderkey") % 40).cast("double").alias("position"))


_QR = "qr AS (SELECT c_mktsegment AS query, '/n/' || c_nationkey AS page, o_orderkey % 7 AS clicks, o_orderkey % 90 AS impressions, (o_orderkey % 40)::DOUBLE AS position FROM orders JOIN customer ON o_custkey = c_custkey), can AS (SELECT query, count(DISTINCT page) AS n_pages, sum(impressions) AS impressions, sum(clicks) AS clicks FROM qr GROUP BY query HAVING count(DISTINCT page) >= 2 AND sum(impressions) >= 10)"


@query(f"WITH {_QR} SELECT * FROM can")
def cannibalization(s, d):
    return scoring.cannibalised(_queries(s, d))


@query(f"WITH {_QR} SELECT query, page, clicks, impressions, rank FROM (SELECT query, page, sum(clicks) AS clicks, sum(impressions) AS impressions, row_number() OVER (PARTITION BY query ORDER BY sum(clicks) DESC, page) AS rank FROM qr WHERE query IN (SELECT query FROM can) GROUP BY query, page) WHERE rank <= 10")
def competing_pages(s, d):
    q = _queries(s, d)
    return scoring.competing_pages(q, scoring.cannibalised(q))


@query(f"WITH {_QR} SELECT sum(clicks) AS clicks, sum(impressions) AS impressions, {HALF('sum(clicks)::DOUBLE / sum(impressions) * 100', 4)} AS ctr, {HALF('sum(position) / count(position)', 2)} AS position FROM qr")
def search_summary(s, d):
    return scoring.search_summary(_queries(s, d))


@query(f"WITH {NOW}, {_SEARCH}, inc AS (SELECT to_url_normalized AS url, count(*) AS n FROM links WHERE is_internal AND to_url_normalized IS NOT NULL GROUP BY 1) SELECT page, impressions, coalesce(inc.n, 0) AS n_inlinks, page IN (SELECT url FROM latest) AS in_crawl FROM search LEFT JOIN inc ON inc.url = page WHERE impressions >= 100 AND coalesce(inc.n, 0) <= 2")
def link_opportunities(s, d):
    return scoring.link_opportunities(_search(s, d), pages.inlink_counts(links(s, d)), now(s, d, "status_code"))


@query("""WITH k AS (SELECT l_partkey AS url, 's' || l_suppkey AS keyword, sum(l_quantity)::BIGINT AS volume, count(*) AS traffic FROM lineitem GROUP BY 1, 2), t AS (SELECT url, count(*) AS n_keywords, sum(traffic) AS traffic FROM k GROUP BY url),
  b AS (SELECT url, string_agg(keyword, ', ' ORDER BY rn) AS top FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY volume DESC, keyword) AS rn FROM k) WHERE rn <= 5 GROUP BY url)
  SELECT p_partkey AS url, coalesce(n_keywords, 0) AS n_keywords, coalesce(t.traffic, 0) AS traffic, coalesce(top, '') AS top FROM part LEFT JOIN t ON t.url = p_partkey LEFT JOIN b ON b.url = p_partkey""")
def keyword_merge(s, d):
    k = table(s, d, "lineitem", "l_partkey", "l_suppkey", "l_quantity").groupBy(F.col("l_partkey").alias("url"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("keyword")).agg(F.sum("l_quantity").cast("long").alias("volume"), F.count("*").alias("traffic"))
    return scoring.merge_keywords(table(s, d, "part").select(F.col("p_partkey").alias("url")), k)


@query(f"WITH {NOW}, k AS (SELECT url, CASE WHEN depth > 4 THEN 'deep' WHEN contains(url, '?') THEN 'query' ELSE 'other' END AS kind FROM latest), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY url) AS rn FROM k) SELECT kind, count(*) AS n, string_agg(url, ' ' ORDER BY url) FILTER (rn <= 10) AS samples FROM r GROUP BY kind")
def deferred_summary(s, d):
    p = now(s, d, "depth")
    return detail.deferred_summary(p.select("url", F.when(F.col("depth") > 4, "deep").when(F.col("url").contains("?"), "query").otherwise("other").alias("kind")))


@query(f"""WITH {_UNIFIED[5:]}, {_PRI}, u AS (SELECT min(url) AS url FROM latest) SELECT u.url, {PATHKEY('u.url')} AS path, p.status_code, p.title, sp.s.c AS clicks, sp.s.i AS impressions, bp.sessions, 1 AS n_speed, pri.priority_score, pri.action_group
  FROM u JOIN latest p ON p.url = u.url LEFT JOIN sp ON sp.page = u.url LEFT JOIN bp ON bp.path = {PATHKEY('u.url')} LEFT JOIN pri ON pri.url = u.url""")
def url_detail(s, d):
    p = now(s, d, "status_code", "title")
    url = p.agg(F.min("url")).first()[0]
    search = _search(s, d).groupBy("page").agg(F.max_by(F.struct("clicks", "impressions", "position"), F.struct("impressions", "clicks")).alias("r")).select("page", "r.*")
    x = detail.url_detail(url, p, search, _landing(s, d), p.select("url", "status_code"), scoring.priorities(_unified(s, d)))
    return x.select("url", "path", "page.status_code", "page.title", "search.clicks", "search.impressions", "sessions", F.size("speed").alias("n_speed"), "priority_score", "action_group")


@query(f"""{_ISS}, {_FLAGS}, {_UNI}, {_PRI}, a AS (SELECT affected_count, issue_type FROM iss ORDER BY affected_count DESC, issue_type LIMIT 20), b AS (SELECT priority_score, regexp_replace(url, '[?#].*$', '') AS url FROM (SELECT * FROM pri ORDER BY priority_score DESC, url LIMIT 15))
  SELECT CAST(to_json(struct_pack(issues := (SELECT list(struct_pack(affected_count := affected_count, issue_type := issue_type) ORDER BY affected_count DESC, issue_type DESC) FROM a), opportunities := (SELECT list(struct_pack(priority_score := priority_score, url := url) ORDER BY priority_score DESC, url DESC) FROM b))) AS VARCHAR) AS payload""")
def summary_payload(s, d):
    p = now(s, d)
    return detail.summary_payload(_issues(p, s, d), scoring.priorities(_unified(s, d)))
