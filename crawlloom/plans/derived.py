"""Queries whose inputs (headers, tags, logs, payloads, markup) are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlloom.functions import html, urls
from crawlloom.functions.text import HREFLANG
from crawlloom.operators import content, logs, similarity
from crawlloom.plans.audit import _MIXED, HALF, HOST, NOW, PATH, PATHKEY, SQUEEZE, links, mixed_content, now
from crawlloom.plans.problems import normal_form_sql
from crawlloom.sources import importers, readers
from crawlloom.session import scratch
from crawlloom.sources.safety import is_safe
from crawlloom.streaming import logs as streams
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


# Language alternates: pages name themselves under their label and their canonical as x-default,
# so that pages without label or without canonical lack the one or the other.
CODE = lambda c: f"(CASE WHEN lower(trim({c})) = 'x-default' THEN 'x-default' ELSE array_to_string(list_transform(string_split(trim({c}), '-'), lambda p, i: CASE WHEN i = 1 THEN lower(p) WHEN regexp_full_match(p, '\\p{{L}}{{4}}') THEN upper(p[1]) || lower(p[2:]) ELSE upper(p) END), '-') END)"
_TAGS = f"{NOW}, tags AS (SELECT *, {CODE('hreflang')} AS code FROM (SELECT url, language AS hreflang, url AS href FROM latest WHERE language IS NOT NULL UNION ALL SELECT url, 'x-default', canonical FROM latest WHERE canonical IS NOT NULL))"
_IS = "lower(regexp_extract(coalesce(p.language, ''), '^([A-Za-z]{2})(?:[-_].*)?$', 1))"
_HREF = f"""{_TAGS}, src AS (SELECT url, bool_or(code = 'x-default') AS x, bool_or(href = url) AS s FROM tags GROUP BY url), tgt AS (SELECT t.url, t.href, t.code, p.status_code, coalesce(p.is_indexable, FALSE) AS ix, {_IS} AS is_lang FROM tags t JOIN latest p ON p.url = t.href),
  aud AS (SELECT url, 'missing_x_default' AS issue, '' AS detail FROM src WHERE NOT x UNION SELECT url, 'missing_self', '' FROM src WHERE NOT s UNION SELECT url, 'to_non_200', href FROM tgt WHERE status_code <> 200 UNION SELECT url, 'to_noindex', href FROM tgt WHERE status_code = 200 AND NOT ix
   UNION SELECT url, 'no_return', href FROM tgt WHERE href <> url AND (href, url) NOT IN (SELECT (url, href) FROM tags) UNION SELECT url, 'invalid_code', hreflang FROM tags WHERE NOT regexp_matches(code, '{HREFLANG}')
   UNION SELECT url, 'duplicate_lang', lower(hreflang) FROM tags GROUP BY url, lower(hreflang) HAVING count(DISTINCT href) > 1 UNION SELECT url, 'language_mismatch', href FROM tgt WHERE code <> 'x-default' AND is_lang <> '' AND is_lang <> lower(string_split(code, '-')[1]))"""


def _tags(s, d):
    p = now(s, d, "language", "canonical")
    own = p.where("language is not null").select("url", F.col("language").alias("hreflang"), F.col("url").alias("href"))
    return own.unionAll(p.where("canonical is not null").select("url", F.lit("x-default").alias("hreflang"), F.col("canonical").alias("href")))


@query(f"WITH {_HREF} SELECT issue, count(*) AS n FROM aud GROUP BY issue")
def hreflang_summary(s, d):
    return content.hreflang_audit(_tags(s, d), now(s, d, "status_code", "is_indexable", "language")).groupBy("issue").agg(F.count("*").alias("n"))


@query(f"WITH {_HREF} SELECT * FROM aud")
def hreflang_audit(s, d):
    return content.hreflang_audit(_tags(s, d), now(s, d, "status_code", "is_indexable", "language"))


def _entries(s, d):
    p = table(s, d, "pages", "page_id", "url", "title", "meta_description")
    kind = F.when(F.col("page_id") % 3 == 0, "Article").when(F.col("page_id") % 3 == 1, "Product").otherwise("Thing,Person")
    doc = F.struct(F.col("title").alias("name"), F.col("title").alias("headline"), F.when(F.col("page_id") % 4 == 0, F.lit("i.png")).alias("image"), F.col("meta_description").alias("description"), F.lit("2025-01-01").alias("datePublished"), F.lit("x").alias("author"))
    return p.select(F.col("url").alias("page_url"), kind.alias("type"), F.to_json(doc).alias("raw_data"))


_LACK = lambda names: "list_filter([" + ", ".join(f"CASE WHEN coalesce({e}, '') IN ('', '0', '0.0', 'false', 'null', '[]', '{{}}') THEN '{n}' END" for n, e in names) + "], lambda x: x IS NOT NULL)"
_HAS = {"name": "t", "headline": "t", "image": "im", "description": "m", "datePublished": "'2025-01-01'", "author": "'x'"}
_OF = lambda which, kind: _LACK([(n, _HAS.get(n, "''")) for n in which[kind]])
_CASES = lambda which: "CASE type " + " ".join(f"WHEN '{k}' THEN {_OF(which, k)}" for k in ("Article", "Product")) + " ELSE [] END"


@query(f"""WITH e AS (SELECT CASE page_id % 3 WHEN 0 THEN 'Article' WHEN 1 THEN 'Product' ELSE 'Thing' END AS type, trim(title, ' ') AS t, trim(meta_description, ' ') AS m, CASE WHEN page_id % 4 = 0 THEN 'i.png' END AS im FROM pages),
  f AS (SELECT type, {_CASES(content.REQUIREMENTS)} AS req, {_CASES(content.RECOMMENDATIONS)} AS rec FROM e)
  SELECT type, CASE WHEN type = 'Thing' THEN 'unknown' WHEN len(req) > 0 THEN 'invalid' WHEN len(rec) > 0 THEN 'incomplete' ELSE 'eligible' END AS state, array_to_string(CASE WHEN len(req) > 0 THEN req ELSE rec END, ',') AS missing, count(*) AS n FROM f GROUP BY ALL""")
def schema_validation(s, d):
    return content.schema_audit(_entries(s, d)).groupBy("type", "state", "missing").agg(F.count("*").alias("n"))


@query("SELECT type, count(*) AS n FROM (SELECT unnest(CASE page_id % 3 WHEN 0 THEN ['Article'] WHEN 1 THEN ['Product'] ELSE ['Thing', 'Person'] END) AS type FROM pages) GROUP BY type")
def schema_types(s, d):
    return content.schema_types(_entries(s, d))


@query("SELECT unnest(['Organization', 'BreadcrumbList', 'WebSite']) AS missing_type FROM (SELECT count(*) AS n FROM pages) WHERE n > 0")
def schema_opportunities(s, d):
    return content.schema_opportunities(_entries(s, d))


# A sitemap of the pages that have a description or didn't answer 200, and of all canonicals.
_SM = "sm AS (SELECT DISTINCT url FROM latest WHERE coalesce(meta_description, '') <> '' OR status_code <> 200 UNION SELECT canonical FROM latest WHERE canonical IS NOT NULL)"


def _sitemap(s, d):
    p = now(s, d, "status_code", "meta_description", "canonical")
    return p.where("coalesce(meta_description, '') <> '' or status_code <> 200").select("url").unionAll(p.where("canonical is not null").select(F.col("canonical").alias("url")))


@query(f"""WITH {NOW}, {_SM}, j AS (SELECT coalesce(sm.url, p.url) AS url, sm.url AS su, p.url AS pu, coalesce(status_code, 0) AS st, coalesce(is_indexable, TRUE) AS ix, coalesce(canonical, '') AS c, coalesce(depth, 99) AS depth FROM sm FULL JOIN latest p ON p.url = sm.url)
  SELECT url, unnest(list_filter([CASE WHEN pu IS NULL THEN 'not_crawled' END, CASE WHEN su IS NOT NULL AND pu IS NOT NULL AND st BETWEEN 400 AND 499 THEN 'in_sitemap_4xx' END, CASE WHEN su IS NOT NULL AND pu IS NOT NULL AND st BETWEEN 300 AND 399 THEN 'in_sitemap_redirect' END, CASE WHEN su IS NOT NULL AND pu IS NOT NULL AND st = 200 AND NOT ix THEN 'in_sitemap_noindex' END,
   CASE WHEN su IS NOT NULL AND pu IS NOT NULL AND st = 200 AND ix AND c <> '' AND c <> url THEN 'in_sitemap_canonicalised' END, CASE WHEN su IS NULL AND st = 200 AND ix THEN 'not_in_sitemap' END, CASE WHEN su IS NULL AND st = 200 AND ix AND depth <= 2 THEN 'important_not_in_sitemap' END], lambda x: x IS NOT NULL)) AS issue FROM j""")
def sitemap_diff(s, d):
    return content.sitemap_diff(_sitemap(s, d), now(s, d, "status_code", "is_indexable", "canonical", "depth"))


@query(f"WITH {NOW}, {_SM} SELECT count(*) AS n_sitemap, count(p.url) AS n_crawled, {HALF('count(p.url)::DOUBLE / count(*) * 100', 2)} AS coverage FROM sm LEFT JOIN latest p ON p.url = sm.url")
def sitemap_coverage(s, d):
    return content.sitemap_coverage(_sitemap(s, d), now(s, d, "status_code"))


def _headers(s, d):
    p = now(s, d, "server").where("server is not null")  # no headers were kept where no server is named
    on = lambda k: F.when(F.col("page_id") % k == 0, F.lit("on"))
    return p.select(F.col("url").alias("page_url"), (F.col("page_id") % 2 == 0).alias("hsts_enabled"), on(3).alias("csp"), on(5).alias("x_frame_options"), on(7).alias("x_content_type_options"), on(2).alias("referrer_policy"), F.lit("").alias("permissions_policy"))


@query(f"""WITH {NOW}, {_MIXED}, p AS (SELECT url, page_id, server IS NOT NULL AS h FROM latest WHERE status_code = 200), x AS (SELECT url, unnest(list_filter([CASE WHEN lower(url) NOT LIKE 'https://%' THEN 'not_https|high' END, CASE WHEN NOT (h AND page_id % 2 = 0) THEN 'missing_hsts_enabled|high' END, CASE WHEN NOT (h AND page_id % 3 = 0) THEN 'missing_csp|medium' END,
  CASE WHEN NOT (h AND page_id % 5 = 0) THEN 'missing_x_frame_options|medium' END, CASE WHEN NOT (h AND page_id % 7 = 0) THEN 'missing_x_content_type_options|low' END, CASE WHEN NOT (h AND page_id % 2 = 0) THEN 'missing_referrer_policy|low' END, 'missing_permissions_policy|low', CASE WHEN url IN (SELECT url FROM mixed) THEN 'mixed_content|high' END], lambda x: x IS NOT NULL)) AS i FROM p)
  SELECT url, string_split(i, '|')[1] AS issue, string_split(i, '|')[2] AS severity FROM x""")
def security_headers(s, d):
    return content.security_audit(now(s, d, "status_code"), _headers(s, d), mixed_content(s, d))


def _resources(s, d):
    i = table(s, d, "images", "page_url", "src", "file_extension")
    return i.select("page_url", F.col("src").alias("url"), F.coalesce("file_extension", F.lit("")).alias("resource_type"), (urls.host("src") == urls.host("page_url")).alias("is_internal"), (F.col("page_url").startswith("https://") & F.col("src").startswith("http://")).alias("is_mixed_content"))


@query(f"SELECT coalesce(file_extension, '') AS resource_type, count(*) AS n, count(DISTINCT src) AS n_unique, count(*) FILTER ({HOST('src')} = {HOST('page_url')}) AS n_internal, count(*) FILTER (page_url LIKE 'https://%' AND src LIKE 'http://%') AS n_mixed, count(*) FILTER (length(src) % 7 = 0) AS n_broken FROM images GROUP BY 1")
def resource_inventory(s, d):
    status = F.when(F.char_length("url") % 7 == 0, 404).otherwise(200).alias("status_code")
    return content.resource_inventory(_resources(s, d), _resources(s, d).select("url").distinct().select("url", status))


def _axe(s, d):
    p = table(s, d, "pages", "page_id", "url")
    v = F.array(F.struct(F.lit("a").alias("id"), F.when(F.col("page_id") % 3 == 0, "critical").when(F.col("page_id") % 3 == 1, "serious").alias("impact"), F.lit("h").alias("help"), F.array_repeat(F.lit("n"), (F.col("page_id") % 4).cast("int")).alias("nodes")))
    return p.select("url", F.to_json(v).alias("violations"))


@query("SELECT CASE page_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' ELSE 'minor' END AS impact, count(*) AS n_violations, sum(page_id % 4) AS n_nodes, CASE page_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS rank FROM pages GROUP BY 1, 4")
def accessibility_summary(s, d):
    return content.accessibility_summary(_axe(s, d))


@query(f"""WITH {NOW}, tok AS (SELECT DISTINCT url, lower(regexp_extract(coalesce(language, ''), '^([A-Za-z]{{2}})(?:[-_].*)?$', 1)) AS lang, lower(unnest(regexp_extract_all(concat_ws(' ', title, meta_description, h1_text[1]), '[A-Za-z]{{3,}}'))) AS word FROM latest),
  cnt AS (SELECT lang, word, count(*) AS n_pages FROM tok WHERE lang IN ('en','es','fr','pt','de','it','ru','nl') GROUP BY lang, word), dict AS (SELECT lang, word FROM cnt WHERE n_pages >= 40)
  SELECT lang, word, n_pages FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_pages DESC, word) AS rn FROM cnt WHERE (lang, word) NOT IN (SELECT (lang, word) FROM dict)) WHERE rn <= 30""")
def spelling_top(s, d):
    p = now(s, d, "language", "title", "meta_description", "h1_text")
    common = content.spelling(p, p.sparkSession.createDataFrame([], "lang string, word string"), 1 << 30).where("n_pages >= 40")
    return content.spelling(p, common)


def _paged(s, d):
    p = now(s, d, "status_code", "is_indexable", "canonical")
    n = p.select(F.col("page_id").alias("i"), F.col("url").alias("u"))
    a = p.join(n.select((F.col("i") - 1).alias("a"), F.col("u").alias("pagination_next")), F.col("page_id") == F.col("a"), "left")
    return a.join(n.select((F.col("i") + 1).alias("b"), F.col("u").alias("pagination_prev")), (F.col("page_id") == F.col("b")) & (F.col("page_id") % 5 != 0), "left").drop("a", "b")


@query(f"""WITH {NOW}, pg AS (SELECT p.url, p.status_code, coalesce(p.is_indexable, FALSE) AS ix, coalesce(p.canonical, '') AS c, n.url AS nx, v.url AS pv FROM latest p LEFT JOIN latest n ON n.page_id = p.page_id + 1 LEFT JOIN latest v ON v.page_id = p.page_id - 1 AND p.page_id % 5 <> 0),
  j AS (SELECT a.*, b.url AS nu, b.status_code AS ns, b.ix AS ni, b.pv AS np, e.url AS vu, e.status_code AS vs FROM pg a LEFT JOIN pg b ON b.url = a.nx LEFT JOIN pg e ON e.url = a.pv WHERE a.nx IS NOT NULL OR a.pv IS NOT NULL)
  SELECT url, unnest(list_filter([CASE WHEN pv IS NULL THEN 'first_page' END, CASE WHEN c <> '' AND c <> url THEN 'non_self_canonical' END, CASE WHEN nu IS NOT NULL AND ns <> 200 THEN 'next_not_ok' END, CASE WHEN nu IS NOT NULL AND ns = 200 AND NOT ni THEN 'next_noindex' END, CASE WHEN nu IS NOT NULL AND coalesce(np, '') <> url THEN 'broken_sequence' END, CASE WHEN vu IS NOT NULL AND vs <> 200 THEN 'prev_not_ok' END], lambda x: x IS NOT NULL)) AS issue FROM j""")
def pagination_audit(s, d):
    return content.pagination_audit(_paged(s, d))


def _statuses(s, d):
    """Statuses of external targets, known for those that were linked in the first twenty runs."""
    t = table(s, d, "links", "id", "run_id", "to_url_normalized", "is_internal", "is_special_link").where("not is_internal and not is_special_link and to_url_normalized is not null")
    t = t.groupBy(F.col("to_url_normalized").alias("url")).agg(F.min("id").alias("id"), F.min("run_id").alias("run")).where("run < 20")
    codes = F.array(*map(F.lit, (200, 200, 404, 403, 500, 429, 301)))
    return t.select("url", codes[(F.col("id") % 7).cast("int")].alias("status_code"), F.when(F.col("id") % 11 == 0, F.lit("timeout")).alias("error"))


_ST = "st AS (SELECT url, [200,200,404,403,500,429,301][(id % 7) + 1] AS status_code, CASE WHEN id % 11 = 0 THEN 'timeout' END AS error FROM (SELECT to_url_normalized AS url, min(id) AS id, min(run_id) AS run FROM links WHERE NOT is_internal AND NOT is_special_link AND to_url_normalized IS NOT NULL GROUP BY 1) WHERE run < 20)"


@query(f"WITH {_ST} SELECT CASE WHEN error IS NOT NULL THEN 'error' WHEN status_code IN (401, 403, 429) THEN 'blocked' WHEN status_code >= 400 THEN 'broken' ELSE 'ok' END AS class, count(*) AS n FROM st GROUP BY 1")
def external_status(s, d):
    return content.external_status(_statuses(s, d))


@query(f"WITH {_ST} SELECT * FROM st WHERE (status_code >= 400 AND status_code NOT IN (401, 403, 429)) OR error IS NOT NULL")
def broken_external(s, d):
    return content.broken_external(_statuses(s, d))


@query(f"WITH {_ST} SELECT DISTINCT to_url_normalized AS url FROM links WHERE NOT is_internal AND NOT is_special_link AND regexp_matches(to_url_normalized, '^https?://') AND to_url_normalized NOT IN (SELECT url FROM st)")
def external_unchecked(s, d):
    return content.unchecked_external(links(s, d), _statuses(s, d))


# Access-log lines rendered from events: five kinds of path, users as agents.
def _lines(s, d):
    e = table(s, d, "events", "event_id", "ts", "user_id", "event_type")
    agent = F.when(F.col("user_id") % 5 == 0, "Mozilla/5.0 (compatible; Googlebot/2.1)").when(F.col("user_id") % 5 == 1, "bingbot/2.0").otherwise("Mozilla/5.0")
    status = F.array(*map(F.lit, (200, 200, 301, 404, 503, 410)))[(F.col("event_id") % 6).cast("int")]
    return e.select(F.concat(F.lit("10.0.0.1 - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), "event_type", F.lit("/"), (F.col("user_id") % 20).cast("string"), F.lit('?q=1 HTTP/1.1" '), status.cast("string"), F.lit(' 512 "-" "'), agent, F.lit('"')).alias("value"))


_HITS = "hits AS (SELECT '/' || event_type || '/' || (user_id % 20) AS path, strftime(date_trunc('second', ts), '%d/%b/%Y:%H:%M:%S') || ' +0000' AS ts_text, date_trunc('second', ts) AS ts, [200,200,301,404,503,410][(event_id % 6) + 1] AS st, CASE user_id % 5 WHEN 0 THEN 'Googlebot' WHEN 1 THEN 'Bingbot' END AS bot FROM events)"
_BUD = "bud AS (SELECT path, count(*) AS hits, count(*) FILTER (bot = 'Googlebot') AS googlebot_hits, arg_max(ts_text, ts) AS last_seen, count(*) FILTER (st = 200) AS n_200, count(*) FILTER (st BETWEEN 300 AND 399) AS n_3xx, count(*) FILTER (st = 404) AS n_404, count(*) FILTER (st BETWEEN 400 AND 499 AND st <> 404) AS n_4xx_other, count(*) FILTER (st >= 500) AS n_5xx FROM hits GROUP BY path)"


@query(f"WITH {_HITS}, {_BUD} SELECT * FROM bud")
def log_budget(s, d):
    return logs.budget(logs.parsed(_lines(s, d)))


@query(f"WITH {_HITS} SELECT bot, count(*) AS hits FROM hits WHERE bot IS NOT NULL GROUP BY bot ORDER BY hits DESC LIMIT 10")
def log_top_bots(s, d):
    return logs.top_bots(logs.parsed(_lines(s, d)))


@query(f"WITH {NOW}, {_HITS}, {_BUD} SELECT path, hits FROM bud WHERE path NOT IN (SELECT {PATHKEY('url')} FROM latest)")
def log_orphans(s, d):
    return logs.orphan_paths(logs.budget(logs.parsed(_lines(s, d))), now(s, d, "status_code"))


_SCORED = "sc AS (SELECT 'https://e.example/' || event_type || '/' || (user_id % 20) AS url, (min(event_id) % 90)::DOUBLE AS priority_score FROM events GROUP BY 1)"


@query(f"WITH {_HITS}, {_BUD}, {_SCORED}, j AS (SELECT url, path, hits, n_404 + n_4xx_other + n_5xx > 0 AS wasted, {HALF('priority_score + 10 * log10(hits + 1)', 2)} AS boosted_score FROM sc JOIN bud ON {PATH('url')} = path) SELECT *, boosted_score >= 50 AND hits >= 10 AS high_value FROM j")
def log_board(s, d):
    e = table(s, d, "events", "event_id", "user_id", "event_type")
    scored = e.groupBy(F.concat(F.lit("https://e.example/"), "event_type", F.lit("/"), (F.col("user_id") % 20).cast("string")).alias("url")).agg((F.min("event_id") % 90).cast("double").alias("priority_score"))
    return logs.log_board(logs.budget(logs.parsed(_lines(s, d))), scored)


_FP = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_\\x{0600}-\\x{06FF}]+'), lambda x: x <> '') AS w FROM documents),
  sh AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w WHERE len(w) >= 10), h AS (SELECT doc_id, ('0x' || substr(md5(s), 17, 16))::UBIGINT AS h FROM sh),
  bits AS (SELECT doc_id, i, CASE WHEN sum((h >> i::UBIGINT) & 1) * 2 > count(*) THEN 1 ELSE 0 END AS b FROM h, generate_series(0, 63) t(i) GROUP BY doc_id, i), fp AS (SELECT doc_id, sum(b::HUGEINT << i::INT)::UBIGINT AS f FROM bits GROUP BY doc_id), cls AS (SELECT f, min(doc_id) AS class_id FROM fp GROUP BY f)"""


@query(f"WITH {_FP} SELECT a.class_id AS class_a, b.class_id AS class_b, bit_count(xor(a.f, b.f))::INT AS distance, {HALF('(64 - bit_count(xor(a.f, b.f))) / 64.0::DOUBLE * 100', 1)} AS similarity FROM cls a JOIN cls b ON a.class_id < b.class_id AND bit_count(xor(a.f, b.f)) <= 3")
def near_duplicate_docs(s, d):
    """Pairs of classes of near-equal texts; see also near_duplicate_members."""
    return similarity.near_duplicates(table(s, d, "documents", "doc_id", "text"), "doc_id", "text")[0]


@query(f"WITH {_FP} SELECT doc_id, class_id FROM fp JOIN cls USING (f)")
def near_duplicate_members(s, d):
    return similarity.near_duplicates(table(s, d, "documents", "doc_id", "text"), "doc_id", "text")[1]


def _markup(s, d):
    """A small document for every page: title, description, canonical, links, image, paragraphs."""
    p = now(s, d, "title", "meta_description", "canonical")
    esc = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    t, m, c = esc(F.col("title")), esc(F.col("meta_description")), esc(F.col("canonical"))
    page = F.concat(*[F.lit(x) if x not in ("T", "M", "C") else {"T": t, "M": m, "C": c}[x] for x in _PIECES])
    return p.select("page_id", "url", page.alias("html"))


# A document in pieces; T, M and C stand for title, description and canonical.
_PIECES = (
    "<html><head><title>", "T", '</title><meta name="description" content="', "M", '"><link rel="canonical" href="', "C", '"></head><body><nav><a href="/x?utm_source=a">Home</a></nav><h1>', "T",
    '</h1><p>One.</p><script>var a = "</p>";</script><img src="a.png" alt=""><p>Two.</p><footer><a href="mailto:a@b.example" rel="nofollow">Mail</a></footer></body></html>',
)
_ESC = lambda c: f"replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '\"', '&quot;')"
_BYTES = "strlen(" + " || ".join({"T": _ESC("title"), "M": _ESC("meta_description"), "C": _ESC("canonical")}.get(x, f"'{x}'") for x in _PIECES) + ")"
_TITLE, _DESC = SQUEEZE("coalesce(title, '')"), SQUEEZE("coalesce(meta_description, '')")
_TEXT = f"'Home ' || CASE WHEN {_TITLE} = '' THEN '' ELSE {_TITLE} || ' ' END || 'One. Two. Mail'"


@query(f"WITH {NOW} SELECT page_id, {_TITLE} AS title, 2 AS n_paragraphs, CASE WHEN {_TITLE} = '' THEN 0 ELSE 1 END AS n_headings, 2 AS n_links, 1 AS n_images, trim(coalesce(meta_description, '')) AS description, {_TEXT} AS text, CASE WHEN coalesce(canonical, '') <> '' THEN {normal_form_sql('canonical')} END AS canonical FROM latest")
def html_extract(s, d):
    x = html.extract(_markup(s, d))
    return x.select("page_id", "title", "n_paragraphs", F.size("headings").alias("n_headings"), F.size("links").alias("n_links"), F.size("images").alias("n_images"), F.col("meta")["description"].alias("description"), "text", "canonical")


@query(f"WITH {NOW}, t AS (SELECT page_id, {_TEXT} AS t, {_BYTES} AS b FROM latest) SELECT page_id, strlen(t) AS text_bytes, b AS html_bytes, {HALF('strlen(t)::DOUBLE / b * 100', 2)} AS text_to_html_ratio, substr(t, 1, 500) AS preview, 2 AS n_paragraphs FROM t")
def html_content(s, d):
    return html.measured(_markup(s, d)).select("page_id", "text_bytes", "html_bytes", "text_to_html_ratio", "preview", "n_paragraphs")


@query(f"WITH {NOW} SELECT page_id, lower(regexp_extract(url, '^([^:]+://)', 1)) || {HOST('url')} || '/x' AS to_url, 'Home' AS anchor, TRUE AS in_navigation FROM latest")
def html_links(s, d):
    return html.children(html.extract(_markup(s, d)), "links").where("not is_special").select("page_id", "to_url", "anchor", "in_navigation")


@query(f"WITH {NOW} SELECT page_id, lower(regexp_extract(url, '^([^:]+://)', 1)) || {HOST('url')} || regexp_extract({PATH('url')}, '^(.*/)', 1) || 'a.png' AS src, '' AS alt, TRUE AS has_alt, FALSE AS has_dimensions, FALSE AS is_lazy, 'png' AS extension FROM latest")
def html_images(s, d):
    return html.children(html.extract(_markup(s, d)), "images").select("page_id", "src", "alt", "has_alt", "has_dimensions", "is_lazy", "extension")


def _payload(s, d):
    p = table(s, d, "pages", "page_id", "url")
    audit = lambda score, mode: F.struct(F.lit("t").alias("title"), score.alias("score"), F.lit(mode).alias("scoreDisplayMode"))
    a = F.struct(audit((F.col("page_id") % 100) / 100.0, "numeric").alias("speed"), audit(F.lit(1.0), "binary").alias("https"), audit(F.lit(None).cast("double"), "informative").alias("note"))
    c = F.struct(F.struct(((F.col("page_id") % 100) / 100.0).alias("score")).alias("performance"))
    return p.select("url", "page_id", F.to_json(F.struct(F.struct(c.alias("categories"), a.alias("audits")).alias("lighthouseResult"))).alias("payload"))


@query("SELECT url, 'speed' AS audit_id, (page_id % 100) / 100.0::DOUBLE AS score, 'numeric' AS mode FROM pages")
def lighthouse_failed(s, d):
    return importers.failed_audits(_payload(s, d)).select("url", "audit_id", "score", "mode")


@query("SELECT url, (page_id % 100)::INT AS performance FROM pages")
def speed_metrics(s, d):
    return importers.speed_metrics(_payload(s, d)).select("url", "performance")


def _crux(s, d):
    n = table(s, d, "nation", "n_nationkey")
    day = lambda k: F.struct(F.lit(2025).alias("year"), F.lit(k).alias("month"), F.lit(7).alias("day"))
    per = F.array(*[F.struct(day(k).alias("firstDate"), day(k).alias("lastDate")) for k in (1, 2, 3)])
    p75 = F.array(F.col("n_nationkey") * 10, F.col("n_nationkey") * 10 + 1, F.lit(None).cast("int"))
    m = F.struct(F.struct(F.struct(p75.alias("p75s")).alias("percentilesTimeseries")).alias("largest_contentful_paint"))
    return n.select(F.col("n_nationkey").cast("string").alias("origin"), F.to_json(F.struct(F.struct(per.alias("collectionPeriods"), m.alias("metrics")).alias("record")), {"ignoreNullFields": "false"}).alias("payload"))


@query("SELECT n_nationkey::VARCHAR AS origin, printf('2025-%02d-07', k) AS period_end, CASE k WHEN 1 THEN n_nationkey * 10.0 WHEN 2 THEN n_nationkey * 10 + 1.0 END::DOUBLE AS lcp FROM nation, (VALUES (1), (2), (3)) t(k)")
def crux_series(s, d):
    return importers.history(_crux(s, d)).select("origin", "period_end", F.col("lcp_p75_ms").alias("lcp"))


@query("SELECT to_url AS url, count(*) AS n FROM links WHERE contains(to_url, '/sale') OR contains(to_url, '.html') OR regexp_matches(to_url, '/p[0-9]') GROUP BY 1")
def pattern_filter(s, d):
    fits = readers.matches_any("to_url", ["/sale", "*.html", "/p[0-9]"])
    return table(s, d, "links", "to_url").where(fits).groupBy(F.col("to_url").alias("url")).agg(F.count("*").alias("n"))


# Literal addresses from customer keys, so that every reserved range occurs.
_FIRST = (10, 127, 172, 192, 169, 8, 100, 224, 0, 203)


@query(f"""WITH ip AS (SELECT {list(_FIRST)}[c_custkey % {len(_FIRST)} + 1] AS a, (c_custkey // {len(_FIRST)}) % 256 AS b FROM customer)
  SELECT DISTINCT to_url AS url, coalesce(regexp_matches(lower(to_url), '^https?://[^/?#]'), FALSE) AS safe FROM links UNION SELECT 'http://' || a || '.' || b || '.0.1/', NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127)) FROM ip""")
def safe_addresses(s, d):
    key = table(s, d, "customer", "c_custkey").select("c_custkey", F.array(*map(F.lit, _FIRST))[(F.col("c_custkey") % len(_FIRST)).cast("int")].alias("a"))
    literal = key.select(F.concat(F.lit("http://"), F.col("a").cast("string"), F.lit("."), (F.floor(F.col("c_custkey") / len(_FIRST)) % 256).cast("string"), F.lit(".0.1/")).alias("url"))
    return table(s, d, "links", "to_url").select(F.col("to_url").alias("url")).unionAll(literal).distinct().select("url", is_safe(F.col("url")).alias("safe"))


@query(f"WITH {_HITS}, {_BUD} SELECT * FROM bud")
def log_stream(s, d):
    """The crawl budget as a stream over files of lines, read until they are used up."""
    root = scratch(s, "log-stream")
    _lines(s, d).repartition(4).write.text(f"{root}/lines")
    out = streams.running_budget(streams.log_lines(s, f"{root}/lines", 2)).writeStream.outputMode("complete").option("checkpointLocation", f"{root}/state")
    out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/budget")).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{root}/budget")


_STEP = "CASE WHEN st = 429 OR st >= 500 THEN 2.0 WHEN ms > 3000 THEN 1.0 ELSE -0.25 END"


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT (user_id % 40)::VARCHAR AS host, event_id, [200,200,429,503,404][event_id % 5 + 1] AS st, coalesce(value, 0) * 50 AS ms, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS rn FROM events),
  r AS (SELECT host, event_id, rn, least(30.0, greatest(0.5, 0.5 + {_STEP}))::DOUBLE AS delay FROM e WHERE rn = 1 UNION ALL SELECT e.host, e.event_id, e.rn, least(30.0, greatest(0.5, r.delay + {_STEP}))::DOUBLE FROM r JOIN e ON e.host = r.host AND e.rn = r.rn + 1) SELECT host, event_id, delay FROM r""")
def throttle_state(s, d):
    """Delay after every event of a host, the events arriving as a stream."""
    root = scratch(s, "throttle")
    e = table(s, d, "events", "event_id", "user_id", "value")
    codes = F.array(*map(F.lit, (200, 200, 429, 503, 404)))
    e.select((F.col("user_id") % 40).cast("string").alias("host"), "event_id", codes[(F.col("event_id") % 5).cast("int")].alias("status_code"), (F.coalesce("value", F.lit(0.0)) * 50).alias("ms")).write.parquet(f"{root}/events")
    rows = s.readStream.schema("host string, event_id long, status_code int, ms double").parquet(f"{root}/events")
    out = streams.throttled(rows).writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").format("parquet").option("path", f"{root}/delays")
    out.trigger(availableNow=True).start().awaitTermination()
    return s.read.schema("host string, event_id long, delay double").parquet(f"{root}/delays")
