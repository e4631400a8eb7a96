"""Page analyzers: duplicates, thin content, broken links, orphans, canonicals, hygiene, images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlloom.functions.text import duplicate_key
from crawlloom.functions.urls import HYGIENE_TRACKING, depth, host, in_own_domains, part, path_key, query_pairs, registrable


def latest(pages: DataFrame, *columns: str) -> DataFrame:
    """The current row of each url (greatest crawled_at, then page_id): what an upsert would
    have kept. Combined before the shuffle, so a url fetched very often is no hot task."""
    keep = [c for c in (columns or pages.columns) if c != "url"]
    return pages.where("url is not null").groupBy("url").agg(F.max_by(F.struct(*keep), F.struct("crawled_at", "page_id")).alias("r")).select("url", "r.*")


def status_of(c: Column | str) -> Column:
    """Leading integer of a status, 0 if there is none."""
    return F.coalesce(F.try_to_number(F.regexp_extract((F.col(c) if isinstance(c, str) else c).cast("string"), r"^\s*(\d{1,9})", 1), F.lit("999999999")).cast("int"), F.lit(0))


def eligible() -> Column:
    """Pages that count for duplicates: fetched, 200 and indexable."""
    return F.col("crawl_error").isNull() & (F.col("status_code") == 200) & F.coalesce("is_indexable", F.lit(False))


DUPLICATE_FIELDS = {"title": "title", "meta_description": "meta_description", "h1": "get(h1_text, 0)", "content": "content_hash"}


def duplicates(pages: DataFrame) -> DataFrame:
    """(kind, dup_key, n_pages, url): eligible pages that share a title, description, first H1
    or content hash with another: one row per page with its class; null and empty are none."""
    parts = [pages.where(eligible()).select(F.lit(kind).alias("kind"), (F.expr(e) if kind == "content" else duplicate_key(F.expr(e))).alias("dup_key"), "url") for kind, e in DUPLICATE_FIELDS.items()]
    rows = reduce(DataFrame.unionAll, parts).where("dup_key <> ''")
    shared = rows.groupBy("kind", "dup_key").agg(F.count("*").alias("n_pages")).where("n_pages > 1")
    return rows.join(shared, ["kind", "dup_key"]).select("kind", "dup_key", "n_pages", "url")


def duplicate_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count_distinct("dup_key").alias("n_groups"), F.count("*").alias("pages_affected"))


def thin_content(pages: DataFrame, thin: int = 300, critical: int = 100, low_ratio: float = 10.0) -> DataFrame:
    """(url, word_count, text_to_html_ratio, class, is_low_ratio) of HTML pages that are thin,
    critically thin or low in text; a word count of 0 is thin, not critical."""
    html = pages.where(F.col("crawl_error").isNull() & (F.col("status_code") == 200) & F.lower("content_type").contains("html"))
    n, r = F.coalesce("word_count", F.lit(0)), F.coalesce("text_to_html_ratio", F.lit(0.0))
    cls = F.when((n > 0) & (n < critical), "critical").when(n < thin, "thin").otherwise("ok")
    return html.select("url", n.alias("word_count"), r.alias("text_to_html_ratio"), cls.alias("class"), ((r > 0) & (r < low_ratio)).alias("is_low_ratio")).where("class <> 'ok' or is_low_ratio")


def broken_pages(pages: DataFrame) -> DataFrame:
    """(url, status_code, class): pages that answered 4xx or 5xx."""
    cls = F.when(F.col("status_code").between(400, 499), "4xx").when(F.col("status_code").between(500, 599), "5xx")
    return pages.select("url", "status_code", cls.alias("class")).where("class is not null")


def broken_with_inlinks(pages: DataFrame, links: DataFrame, samples: int = 10) -> DataFrame:
    """(url, n_inlinks, linking_urls): 404 pages that links lead to, with the first linking
    addresses; the rank limit is applied before the shuffle, so a hot target stays small."""
    bad = pages.where("status_code = 404").select("url")
    into = links.select(F.col("to_url_normalized").alias("url"), "from_url").join(bad, "url", "left_semi")
    counts = into.groupBy("url").agg(F.count("*").alias("n_inlinks"))
    first = into.where("from_url <> ''").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("url").orderBy("from_url"))).where(F.col("rn") <= samples)
    some = first.groupBy("url").agg(F.array_join(F.array_sort(F.collect_list("from_url")), " ").alias("linking_urls"))
    return counts.join(some, "url", "left").select("url", "n_inlinks", F.coalesce("linking_urls", F.lit("")).alias("linking_urls"))


def external_links(links: DataFrame) -> DataFrame:
    """(n_links, n_targets) of external links."""
    return links.where("not is_internal and not is_special_link").agg(F.count("*").alias("n_links"), F.count_distinct("to_url_normalized").alias("n_targets"))


def inlink_counts(links: DataFrame) -> DataFrame:
    """(url, n_inlinks): internal links by normalised target."""
    return links.where("is_internal and to_url_normalized is not null").groupBy(F.col("to_url_normalized").alias("url")).agg(F.count("*").alias("n_inlinks"))


def inlinked_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(url, n_inlinks, class) of indexable 200 pages: occurrences of internal links from
    other pages; 'orphan' for none, 'low' for one or two, else 'ok'."""
    others = links.where("is_internal and not is_special_link and to_url_normalized <> from_url")
    n = F.coalesce("n_inlinks", F.lit(0))
    good = pages.where((F.col("status_code") == 200) & F.coalesce("is_indexable", F.lit(False))).select("url")
    return good.join(inlink_counts(others), "url", "left").select("url", n.alias("n_inlinks"), F.when(n == 0, "orphan").when(n <= 2, "low").otherwise("ok").alias("class"))


def canonical_audit(pages: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """(url, issue, canonical): missing, canonicalised, external, to_non_200, to_non_indexable,
    loop, chain. A page without canonical has only 'missing'. A self canonical of a page that
    isn't 200 is to_non_200 too. External means outside the crawl's ``domains``; without them,
    as in a crawl of many sites, outside the page's own domain."""
    p = pages.select("url", "status_code", F.coalesce("is_indexable", F.lit(False)).alias("is_indexable"), F.coalesce("canonical", F.lit("")).alias("canonical"))
    t = p.select(F.col("url").alias("t_url"), F.col("status_code").alias("t_status"), F.col("is_indexable").alias("t_indexable"), F.col("canonical").alias("t_canonical"))
    j = p.join(t, p["canonical"] == t["t_url"], "left")
    has, other, found = F.col("canonical") != "", F.col("canonical") != F.col("url"), F.col("t_url").isNotNull()
    own = F.array(*map(F.lit, domains)) if domains is not None else F.array(registrable("url"))
    issue = lambda name, when: F.when(when, F.lit(name))
    flags = F.array(
        issue("missing", ~has & (F.col("status_code") == 200) & F.col("is_indexable")),
        issue("canonicalised", has & other),
        issue("external", has & ~in_own_domains("canonical", own)),
        issue("to_non_200", has & found & (F.col("t_status") != 200)),
        issue("to_non_indexable", has & found & (F.col("t_status") == 200) & ~F.col("t_indexable")),
        issue("loop", has & other & found & (F.col("t_canonical") == F.col("url"))),
        issue("chain", has & other & found & (F.col("t_canonical") != "") & (F.col("t_canonical") != F.col("canonical")) & (F.col("t_canonical") != F.col("url"))),
    )
    return j.select("url", F.explode(F.array_compact(flags)).alias("issue"), "canonical")


def url_hygiene(pages: DataFrame, longest: int = 115, most_params: int = 5) -> DataFrame:
    """(url, issue) of pages below 400: long, uppercase, underscore, many_params, tracking,
    fragment, non_ascii, duplicate_path (its path, in lower case, is that of another url)."""
    ok = pages.where("coalesce(status_code, 0) < 400").select("url")
    path, pairs = part("url", "path"), query_pairs("url")
    issue = lambda name, when: F.when(when, F.lit(name))
    flags = F.array(
        issue("long", F.char_length("url") > longest),
        issue("uppercase", path.rlike("[A-Z]")),
        issue("underscore", path.contains("_")),
        issue("many_params", F.size(pairs) > most_params),
        issue("tracking", F.arrays_overlap(F.transform(pairs, lambda p: F.lower(p["k"])), F.array(*map(F.lit, HYGIENE_TRACKING)))),
        issue("fragment", part("url", "fragment") != ""),
        issue("non_ascii", F.col("url").rlike(r"[^\x00-\x7f]")),
    )
    flagged = ok.select("url", F.explode(F.array_compact(flags)).alias("issue"))
    keyed = ok.select("url", host("url").alias("h"), path_key("url").alias("p"))
    twice = keyed.groupBy("h", "p").agg(F.count_distinct("url").alias("n")).where("n > 1")
    return flagged.unionAll(keyed.join(twice, ["h", "p"], "left_semi").select("url", F.lit("duplicate_path").alias("issue")))


LEGACY_FORMATS = ("jpg", "jpeg", "png", "gif")


def image_audit(images: DataFrame) -> DataFrame:
    """One row: occurrences, distinct sources and percentages of images by fault; images without
    srcset where that column is there. Alt states exclude each other."""
    no_alt = ~F.coalesce("has_alt", F.lit(False))
    empty = ~no_alt & (F.coalesce("alt_is_empty", F.lit(False)) | (F.coalesce("alt", F.lit("")) == ""))
    faults = {
        "no_alt": no_alt,
        "empty_alt": empty,
        "long_alt": ~no_alt & ~empty & (F.char_length("alt") > 125),
        "no_dimensions": ~F.coalesce("has_explicit_dimensions", F.lit(False)),
        "legacy_format": F.lower(F.coalesce("file_extension", F.lit(""))).isin(*LEGACY_FORMATS),
        "not_lazy": ~F.coalesce("is_lazy_loaded", F.lit(False)),
    }
    marked = images.select("id", "src", *[c.alias(n) for n, c in faults.items()])
    first = marked.where("src is not null").groupBy("src").agg(*[F.min_by(n, "id").alias(n) for n in faults])
    a = marked.agg(F.count("*").alias("n_images"), *[F.count_if(n).alias(n) for n in faults])
    b = first.agg(F.count("*").alias("n_unique"), *[F.count_if(n).alias(f"unique_{n}") for n in faults])
    if "srcset" in images.columns:
        a = a.join(F.broadcast(images.agg(F.count_if(F.coalesce("srcset", F.lit("")) == "").alias("no_srcset"))), F.lit(True))
    both = a.join(F.broadcast(b), F.lit(True))  # one row beside one row
    share = lambda n, of: F.when(F.col(of) > 0, F.floor(F.col(n) / F.col(of) * 10000 + 0.5) / 100).otherwise(0.0)
    return both.select("*", *[share(n, "n_images").alias(f"{n}_pct") for n in faults])


def image_formats(images: DataFrame) -> DataFrame:
    return images.groupBy(F.lower(F.coalesce("file_extension", F.lit(""))).alias("extension")).agg(F.count("*").alias("n_images"))


def repeated_alts(images: DataFrame) -> DataFrame:
    """(alt_key, n_images, n_sources) of alternative texts longer than 3 on several sources."""
    key = F.lower(F.trim("alt"))
    return images.where(F.char_length(F.trim("alt")) > 3).groupBy(key.alias("alt_key")).agg(F.count("*").alias("n_images"), F.count_distinct("src").alias("n_sources")).where("n_sources > 1")


def skipped_levels(headings: DataFrame) -> DataFrame:
    """(page_url, run_id, position, level, previous_level) where a heading skips levels."""
    before = F.lag("level").over(Window.partitionBy("page_url", "run_id").orderBy("position", "id"))
    return headings.withColumn("previous_level", before).where("level > previous_level + 1").select("page_url", "run_id", "position", "level", "previous_level")


def status_overview(pages: DataFrame) -> DataFrame:
    """(metric, value): counts by status class, indexability and fetch errors."""
    s = F.coalesce("status_code", F.lit(0))
    parts = {f"{k}xx": s.between(k * 100, k * 100 + 99) for k in (2, 3, 4, 5)} | {"indexable": F.coalesce("is_indexable", F.lit(False)), "failed": F.col("crawl_error").isNotNull(), "pages": F.lit(True)}
    wide = pages.agg(*[F.count_if(c).alias(n) for n, c in parts.items()])
    return wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, parts)), F.array(*parts))).alias("metric", "value"))


def problem_pages(pages: DataFrame, n: int = 100) -> DataFrame:
    """(url, status_code, note): the first n pages, by url, that answered 400 or more or failed;
    the note is the error, else the title."""
    bad = pages.where((F.coalesce("status_code", F.lit(0)) >= 400) | (F.coalesce("crawl_error", F.lit("")) != ""))
    note = F.when(F.coalesce("crawl_error", F.lit("")) != "", F.col("crawl_error")).otherwise(F.coalesce("title", F.lit("")))
    return bad.select("url", "status_code", note.alias("note")).orderBy("url").limit(n)


def rollups(links: DataFrame, images: DataFrame) -> DataFrame:
    """(url, n_internal, n_external, n_nofollow, n_images, n_images_without_alt) by page; an
    empty alternative text counts as none, and a link that doesn't say is external."""
    inside = F.coalesce("is_internal", F.lit(False))
    a = links.where("from_url is not null").groupBy(F.col("from_url").alias("url")).agg(F.count_if(inside).alias("n_internal"), F.count_if(~inside).alias("n_external"), F.count_if(F.coalesce("nofollow", F.lit(False))).alias("n_nofollow"))
    b = images.where("page_url is not null").groupBy(F.col("page_url").alias("url")).agg(F.count("*").alias("n_images"), F.count_if(F.coalesce("alt", F.lit("")) == "").alias("n_images_without_alt"))
    return a.join(b, "url", "full").select("url", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_internal", "n_external", "n_nofollow", "n_images", "n_images_without_alt")])


def site_comparison(pages: DataFrame, links: DataFrame, images: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """(site, n_pages, n_indexable, n_4xx, n_links, n_images, mean_words) by host, and n_schema
    with structured-data entries (page_url)."""
    h = lambda c: host(c).alias("site")
    p = pages.groupBy(h("url")).agg(F.count("*").alias("n_pages"), F.count_if(F.coalesce("is_indexable", F.lit(False))).alias("n_indexable"), F.count_if(F.col("status_code").between(400, 499)).alias("n_4xx"), F.sum(F.coalesce("word_count", F.lit(0))).alias("w"))
    li = links.groupBy(h("from_url")).agg(F.count("*").alias("n_links"))
    im = images.groupBy(h("page_url")).agg(F.count("*").alias("n_images"))
    j, more = p.join(li, "site", "left").join(im, "site", "left"), []
    if schema is not None:
        j = j.join(schema.groupBy(h("page_url")).agg(F.count("*").alias("n_schema")), "site", "left")
        more = [F.coalesce("n_schema", F.lit(0)).alias("n_schema")]
    return j.select(
        "site", "n_pages", "n_indexable", "n_4xx", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_images", F.lit(0)).alias("n_images"), *more, (F.floor(F.col("w") / F.col("n_pages") * 100 + 0.5) / 100).alias("mean_words")
    )


def depth_histogram(pages: DataFrame) -> DataFrame:
    """(depth, n_pages, n_4xx); a missing or negative depth counts as -1."""
    d = F.when(F.col("depth") >= 0, F.col("depth")).otherwise(-1)
    return pages.groupBy(d.alias("depth")).agg(F.count("*").alias("n_pages"), F.count_if(F.col("status_code") >= 400).alias("n_4xx"))


def path_tree(pages: DataFrame) -> DataFrame:
    """(site, prefix, n_pages, worst_status): pages below each path prefix and the worst
    status (400 and above) among them; 0 if there is none."""
    segs = F.filter(F.split(part("url", "path"), "/"), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(segs)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(segs, 1, i), "/")))
    rows = pages.select(host("url").alias("site"), F.explode(prefixes).alias("prefix"), F.when(F.col("status_code") >= 400, F.col("status_code")).otherwise(0).alias("bad"))
    return rows.groupBy("site", "prefix").agg(F.count("*").alias("n_pages"), F.max("bad").alias("worst_status"))


def explorer(pages: DataFrame, contains: str | None = None, status: tuple[int, int] | None = None, indexable: bool | None = None, least_depth: int | None = None, lacking: tuple[str, ...] = ()) -> DataFrame:
    """The interactive page list: thirteen columns and the filters a user can set."""
    df = pages.select("url", "status_code", "content_type", "title", "title_length", "meta_description", "h1_count", "word_count", "depth", "canonical", "is_indexable", "internal_links_count", "response_time_ms")
    if contains:
        df = df.where(F.lower("url").contains(contains.lower()) | F.lower("content_type").contains(contains.lower()))
    if status:
        df = df.where(F.col("status_code").between(*status))
    if indexable is not None:
        df = df.where(F.coalesce("is_indexable", F.lit(False)) == indexable)
    if least_depth is not None:
        df = df.where(F.col("depth") >= least_depth)
    empty = {"title": "coalesce(title, '') = ''", "meta": "coalesce(meta_description, '') = ''", "canonical": "coalesce(canonical, '') = ''", "h1": "coalesce(h1_count, 0) = 0"}
    for what in lacking:
        df = df.where(empty[what])
    return df


def url_depths(pages: DataFrame) -> DataFrame:
    return pages.select("url", depth("url").alias("url_depth"))
