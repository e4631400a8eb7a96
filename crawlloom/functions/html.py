"""One-pass extraction of crawled HTML: each page is parsed once and gives all its child rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from crawlloom.functions.urls import normal_form

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript iframe head".split())
SPECIAL = ("javascript:", "mailto:", "tel:", "#")
IMAGE_TYPES = frozenset("jpg jpeg png gif webp avif svg ico bmp tiff".split())

SCHEMA = (
    "page_id long, url string, title string, meta map<string,string>, canonical string, prev_url string, next_url string, text string, n_paragraphs int, n_bytes int, "
    "headings array<struct<level:int,text:string,position:int>>, "
    "links array<struct<href:string,to_url:string,anchor:string,rel:string,is_special:boolean,nofollow:boolean,is_image:boolean,position:int,in_navigation:boolean,in_footer:boolean,in_header:boolean,in_main:boolean>>, "
    "images array<struct<src:string,alt:string,has_alt:boolean,has_dimensions:boolean,is_lazy:boolean,extension:string,position:int>>, "
    "hreflang array<struct<code:string,href:string>>, schema array<struct<format:string,type:string,raw:string>>, "
    "resources array<struct<url:string,kind:string,is_mixed:boolean>>, mixed array<struct<url:string,severity:string>>"
)


class Page(HTMLParser):
    """Collects what a page declares. Unclosed elements end with their ancestors; text inside
    script and style is data, so markup in it opens nothing."""

    def __init__(self, url: str) -> None:
        super().__init__(convert_charrefs=True)
        self.url = url
        self.open: list[str] = []
        self.title: str | None = None
        self.meta: dict[str, str] = {}
        self.canonical = self.prev = self.next = None
        self.headings: list[dict] = []
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.hreflang: dict[tuple, dict] = {}
        self.schema: list[dict] = []
        self.resources: dict[tuple, dict] = {}
        self.mixed: list[dict] = []
        self.texts: list[str] = []
        self.paragraphs = self.heading_at = self.link_at = self.image_at = 0
        self.taking: list[tuple[str, list[str], dict | None]] = []

    def absolute(self, href: str) -> str:
        try:
            return urljoin(self.url, href.strip())
        except ValueError:
            return href

    def resource(self, kind: str, ref: str | None, severity: str) -> None:
        if not ref:
            return
        full = self.absolute(ref)
        bad = self.url.startswith("https://") and ref.strip().lower().startswith("http://")
        if kind != "form":
            self.resources.setdefault((kind, full), {"url": full, "kind": kind, "is_mixed": bad})
        if bad:
            self.mixed.append({"url": full, "severity": severity})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        rel = a.get("rel", "").lower().split()
        if tag == "meta":
            name = a.get("name") or a.get("property") or (a.get("http-equiv") and f"http-equiv:{a['http-equiv'].lower()}") or ("charset" if "charset" in a else None)
            if name:
                self.meta.setdefault(name, a.get("charset", a.get("content", "")) if name == "charset" else a.get("content", "").strip())
        elif tag == "link" and a.get("href"):
            href = a["href"]
            if "canonical" in rel and self.canonical is None:
                self.canonical = normal_form(href, self.url)
            if "prev" in rel and self.prev is None:
                self.prev = normal_form(href, self.url)
            if "next" in rel and self.next is None:
                self.next = normal_form(href, self.url)
            if "alternate" in rel and a.get("hreflang"):
                full = self.absolute(href)
                self.hreflang.setdefault((a["hreflang"].lower(), full), {"code": a["hreflang"], "href": full})
            if "stylesheet" in rel:
                self.resource("css", href, "active")
            elif "icon" in rel:
                self.resource("image", href, "passive")
            elif a.get("as") == "font":
                self.resource("font", href, "active")
        elif tag == "a" and a.get("href", "").strip():
            self.link_at += 1
            href = a["href"].strip()
            special = href.lower().startswith(SPECIAL)
            row = {"href": href, "to_url": href if special else normal_form(href, self.url), "anchor": "", "rel": " ".join(rel) or None, "is_special": special, "nofollow": "nofollow" in rel, "is_image": False, "position": self.link_at}
            row |= {f"in_{k}": t in self.open for k, t in (("navigation", "nav"), ("footer", "footer"), ("header", "header"), ("main", "main"))}
            self.links.append(row)
            self.taking.append(("a", [], row))
        elif tag == "img":
            self.image_at += 1
            src = a.get("src") or a.get("data-src")
            for _, _, row in self.taking:
                if row is not None and "is_image" in row:
                    row["is_image"] = True
            if src:
                ext = re.split(r"[?#]", src)[0].rpartition(".")[2].lower()
                full = self.absolute(src)
                self.images.append({"src": full, "alt": a.get("alt"), "has_alt": "alt" in a, "has_dimensions": bool(a.get("width") and a.get("height")), "is_lazy": a.get("loading", "").lower() == "lazy" or "data-src" in a, "extension": ext if ext in IMAGE_TYPES else "", "position": self.image_at})
                self.resource("image", src, "passive")
        elif tag == "script":
            self.resource("js", a.get("src"), "active")
            if a.get("type", "").lower() == "application/ld+json":
                self.taking.append(("script", [], {"ld": True}))
        elif tag == "iframe":
            self.resource("iframe", a.get("src"), "active")
        elif tag in ("video", "audio", "source"):
            self.resource("media", a.get("src"), "passive")
        elif tag == "form":
            self.resource("form", a.get("action"), "form")
        elif tag == "title" and self.title is None:
            self.taking.append(("title", [], None))
        elif re.fullmatch("h[1-6]", tag):
            self.heading_at += 1
            row = {"level": int(tag[1]), "text": "", "position": self.heading_at}
            self.taking.append((tag, [], row))
        elif tag == "p":
            self.close("p")
            self.taking.append(("p", [], {"p": True}))
        if "itemscope" in a and "schema.org" in a.get("itemtype", ""):
            kind = a["itemtype"].rstrip("/").rpartition("/")[2]
            self.schema.append({"format": "microdata", "type": kind, "raw": "{}"})
        if tag not in VOID:
            self.open.append(tag)

    def close(self, tag: str) -> None:
        for i in range(len(self.taking) - 1, -1, -1):
            name, parts, row = self.taking[i]
            if name != tag:
                continue
            del self.taking[i]
            text = " ".join("".join(parts).split())
            if tag == "title":
                self.title = text
            elif tag == "a" and row is not None:
                row["anchor"] = text
                row["is_image"] = row["is_image"] and not text
            elif tag == "p":
                self.paragraphs += bool(text)
            elif tag == "script":
                self.structured("".join(parts))
            elif row is not None and text:
                row["text"] = text
                self.headings.append(row)
            return

    def handle_endtag(self, tag: str) -> None:
        self.close(tag)
        if tag in self.open:
            while self.open and self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        for _, parts, _ in self.taking:
            parts.append(data)
        if not HIDDEN.intersection(self.open) and data.strip():
            self.texts.append(data.strip())

    def structured(self, raw: str) -> None:
        try:
            todo = [json.loads(raw)]
        except ValueError:
            return
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo = x + todo
            elif isinstance(x, dict):
                if "@graph" in x:
                    todo = [x["@graph"], *todo]
                kind = x.get("@type")
                if kind:
                    self.schema.append({"format": "json-ld", "type": ",".join(map(str, kind)) if isinstance(kind, list) else str(kind), "raw": json.dumps(x, ensure_ascii=False)})


def extract(pages: DataFrame) -> DataFrame:
    """``SCHEMA`` of pages (page_id, url, html); null HTML gives empty lists. Persist or stage
    the result: its lists explode into the child tables."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, u, h in zip(b["page_id"], b["url"], b["html"]):
                p = Page(u or "")
                if h:
                    p.feed(h)
                    p.close("title")
                    p.close("p")
                rows.append((i, u, p.title, p.meta, p.canonical, p.prev, p.next, " ".join(" ".join(p.texts).split()), p.paragraphs, len((h or "").encode("utf-8", "surrogatepass")), p.headings, p.links, p.images, list(p.hreflang.values()), p.schema, list(p.resources.values()), p.mixed))
            yield pd.DataFrame(rows, columns=[c.strip().split(" ")[0] for c in re.split(r", (?=[a-z_]+ (?:long|string|int|map|array))", SCHEMA)])

    return pages.select("page_id", "url", "html").mapInPandas(body, SCHEMA)


def measured(pages: DataFrame, preview: int = 500) -> DataFrame:
    """(page_id, url, text_bytes, html_bytes, text_to_html_ratio, preview, n_paragraphs) of pages
    (page_id, url, html): the ratio in percent, 0 without markup."""
    n = F.octet_length("text")
    ratio = F.when(F.col("n_bytes") > 0, F.floor(n / F.col("n_bytes") * 10000 + 0.5) / 100).otherwise(0.0)
    return extract(pages).select("page_id", "url", n.alias("text_bytes"), F.col("n_bytes").alias("html_bytes"), ratio.alias("text_to_html_ratio"), F.substring("text", 1, preview).alias("preview"), "n_paragraphs")


def children(extracted: DataFrame, name: str) -> DataFrame:
    """One row for each element of a list column: links, images, headings, hreflang, schema, resources, mixed."""
    return extracted.select("page_id", "url", F.explode(name).alias("x")).select("page_id", "url", "x.*")


def custom_regex(html: Column | str, rules: dict[str, tuple[str, int]]) -> list[Column]:
    """Extraction rules name -> (pattern, group), case-insensitive over lines; '' where nothing
    matches; rules that don't compile are left out."""
    c = F.col(html) if isinstance(html, str) else html
    out = []
    for name, (pattern, group) in rules.items():
        try:
            re.compile(pattern)
        except re.error:
            continue
        out.append(F.coalesce(F.regexp_extract(c, f"(?is){pattern}", group), F.lit("")).alias(name))
    return out


_STEP = re.compile(r"([\w-]+|\*)?((?:#[\w-]+|\.[\w-]+|\[[\w-]+(?:=[\"']?[^\]\"']*[\"']?)?\])*)$")
_PART = re.compile(r"#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]")


def selector(css: str) -> list | None:
    """Steps of a selector of tags, #ids, .classes, [attributes] and descendants; None if it is another."""
    out = []
    for step in css.split():
        m = _STEP.match(step)
        if not m:
            return None
        out.append(((m.group(1) or "*").lower(), [p.groups() for p in _PART.finditer(m.group(2) or "")]))
    return out or None


class Selected(HTMLParser):
    """Text, or an attribute, of the elements that a selector picks."""

    def __init__(self, steps: list, attribute: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.steps, self.attribute = steps, attribute
        self.open: list[tuple[str, dict]] = []
        self.taking: list[tuple[int, list[str]]] = []
        self.found: list[str] = []

    @staticmethod
    def fits(step: tuple, tag: str, a: dict) -> bool:
        if step[0] not in ("*", tag):
            return False
        return all(a.get("id") == i if i else c in a.get("class", "").split() if c else k in a and (v is None or a[k] == v) for i, c, k, v in step[1])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        if self.fits(self.steps[-1], tag, a):
            want = list(self.steps[:-1])
            for t, b in reversed(self.open):
                if want and self.fits(want[-1], t, b):
                    want.pop()
            if not want:
                if self.attribute:
                    self.found.append(a.get(self.attribute, ""))
                elif tag not in VOID:
                    self.taking.append((len(self.open), []))
        if tag not in VOID:
            self.open.append((tag, a))

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.open]:
            return
        while self.open:
            gone = self.open.pop()[0]
            while self.taking and self.taking[-1][0] == len(self.open):
                self.found.append(" ".join("".join(self.taking.pop()[1]).split()))
            if gone == tag:
                return

    def handle_data(self, data: str) -> None:
        for _, parts in self.taking:
            parts.append(data)


def custom_css(html: Column | str, css: str, attribute: str | None = None, every: bool = False) -> Column:
    """The first element's text or attribute, or all joined by ' | '; '' where there is none or
    the selector is of another kind."""
    steps = selector(css)

    @F.pandas_udf(StringType())
    def picked(pages: pd.Series) -> pd.Series:
        def one(h: str | None) -> str:
            if not h or not steps:
                return ""
            p = Selected(steps, attribute)
            p.feed(h)
            for t in reversed([t for t, _ in p.open]):
                p.handle_endtag(t)
            got = [x for x in p.found if x]
            return (" | ".join(got) if every else got[0]) if got else ""

        return pages.map(one)

    return picked(F.col(html) if isinstance(html, str) else html)


# Response headers kept as they are, and the names of their columns.
PLAIN_HEADERS = (
    ("server", "server"), ("x-powered-by", "powered_by"), ("cache-control", "cache_control"), ("expires", "expires"), ("etag", "etag"), ("last-modified", "last_modified"), ("age", "age"),
    ("content-encoding", "content_encoding"), ("strict-transport-security", "hsts"), ("x-frame-options", "x_frame_options"), ("x-content-type-options", "x_content_type_options"), ("content-security-policy", "csp"),
    ("referrer-policy", "referrer_policy"), ("x-robots-tag", "x_robots_tag"), ("content-type", "content_type"), ("content-length", "content_length"), ("content-language", "content_language"), ("vary", "vary"),
)


def header(h: Column, name: str) -> Column:
    """A header of a map by its name in lower case, whatever case the map has; of several names
    that differ in case only, the last; null where there is none."""
    named = F.filter(F.map_entries(h), lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(named, F.lit(-1))["value"]


def headers(h: Column | str) -> list[Column]:
    """Columns from a header map<string,string>, names in any case; '' where a header is missing."""
    m = F.col(h) if isinstance(h, str) else h
    get = lambda n: F.coalesce(header(m, n), F.lit(""))
    has = lambda n, v: F.lower(get(n)).contains(v)
    cached = (get("cache-control") != "") | (get("expires") != "") | (get("etag") != "")
    return [
        *[get(n).alias(a) for n, a in PLAIN_HEADERS],
        F.when(get("permissions-policy") != "", get("permissions-policy")).otherwise(get("feature-policy")).alias("permissions_policy"),
        F.coalesce(cdn(m), F.lit("")).alias("cdn"),
        F.coalesce(cached, F.lit(False)).alias("has_cache_headers"),
        ((get("content-encoding") != "") & (get("content-encoding") != "identity")).alias("is_compressed"),
        (get("strict-transport-security") != "").alias("hsts_enabled"),
        has("x-robots-tag", "noindex").alias("header_noindex"),
        has("x-robots-tag", "nofollow").alias("header_nofollow"),
        (get("set-cookie") != "").alias("has_cookies"),
    ]


# Headers that give a content network away, in the order they are tried.
NETWORKS = (("CloudFlare", ("cf-ray", "cf-cache-status")), ("CloudFront", ("x-amz-cf-id", "x-amz-cf-pop")), ("Akamai", ("x-akamai-request-id",)), ("Fastly", ()), ("Sucuri", ("x-sucuri-id",)), ("Vercel", ("x-vercel-id",)), ("Netlify", ("x-nf-request-id",)))


def cdn(h: Column) -> Column:
    """Content network by the names of a header map, the first that fits; null if none does.
    Fastly is told by the value of x-served-by."""
    has = lambda signs: F.exists(F.map_keys(h), lambda k: F.lower(k).isin(*signs))
    out = None
    for name, signs in NETWORKS:
        when = has(signs) if signs else F.lower(F.coalesce(header(h, "x-served-by"), F.lit(""))).contains("fastly")
        out = F.when(when, name) if out is None else out.when(when, name)
    return out


def link_header(header: Column | str, rel: str) -> Column:
    """The address that an HTTP Link header gives for a relation; '' if it gives none."""
    c = F.coalesce(F.col(header) if isinstance(header, str) else header, F.lit(""))
    return F.trim(F.regexp_extract(c, f'(?i)<([^>]*)>\\s*(?:;[^,<]*)?;\\s*rel="?{rel}"?(?=\\s*(?:[;,]|$))', 1))


def declared_canonical(header: Column, html: Column) -> Column:
    """The canonical address as written: that of the Link header wins over the page's own."""
    h = link_header(header, "canonical")
    return F.when(h != "", h).otherwise(F.coalesce(html, F.lit("")))


def indexability(status: Column, robots: Column, canonical: Column, url: Column, x_robots: Column | None = None, normal: Column | None = None) -> Column:
    """struct<is_indexable, reason>: other status, noindex (in the page or in x-robots-tag),
    canonicalised, or indexable. A canonical that is the address itself, or its normal form
    (``normal``), changes nothing."""
    said = F.lower(F.concat_ws(" ", F.coalesce(robots, F.lit("")), F.coalesce(x_robots if x_robots is not None else F.lit(""), F.lit(""))))
    out = lambda ok, why: F.struct(F.lit(ok).alias("is_indexable"), why.alias("reason"))
    c = F.coalesce(canonical, F.lit(""))
    elsewhere = (c != "") & (c != url) & ((c != normal) if normal is not None else F.lit(True))
    return (
        F.when(F.coalesce(status, F.lit(0)) != 200, out(False, F.concat(F.lit("Non-200 status: "), F.coalesce(status, F.lit(0)).cast("string"))))
        .when(said.contains("noindex"), out(False, F.lit("Noindex directive")))
        .when(elsewhere, out(True, F.lit("Canonicalised")))
        .otherwise(out(True, F.lit("Indexable")))
    )


# What gives a platform away in markup or headers, in the order they are tried.
PLATFORMS = (
    ("shopify", ("cdn.shopify.com", "myshopify.com", "shopify", "x-shopid", "x-shopify")),
    ("salla", ("salla.sa", "cdn.salla", "s-cdn.net", "salla")),
    ("zid", ("zid.store", "cdn.zid", "x-zid", "zidapi", "zid")),
    ("woocommerce", ("woocommerce", "wp-content/plugins/woocommerce", "wc-ajax", "wc_")),
    ("wordpress", ("wp-content/", "wp-includes/", "/wp-json/", 'generator" content="wordpress')),
)


def platform(html: Column | str, headers: Column | None = None) -> Column:
    """Shop or blog platform of a page by its markup and its header map; 'unknown' if none."""
    seen = F.lower(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")))
    if headers is not None:
        named = F.transform(F.map_entries(headers), lambda e: F.concat(F.lit(" "), F.lower(e["key"]), F.lit(":"), F.lower(F.coalesce(e["value"], F.lit("")))))
        seen = F.concat(seen, F.coalesce(F.array_join(named, ""), F.lit("")))
    out = None
    for name, signs in PLATFORMS:
        when = seen.contains(signs[0])
        for sign in signs[1:]:
            when = when | seen.contains(sign)
        out = F.when(when, name) if out is None else out.when(when, name)
    return out.otherwise("unknown")


# Addresses that a platform's crawl leaves out, and parameters that only sort or filter.
PRESETS = {
    "zid": {"exclude": ("*/cart*", "*/checkout*", "*/account*", "*add-to-cart*"), "strip": ("sort_by", "sort", "order_by", "order", "view")},
    "salla": {"exclude": ("*/cart*", "*/checkout*", "*/profile*", "*/login*", "*add-to-cart*"), "strip": ("sort", "order", "view")},
    "shopify": {"exclude": ("*/cart*", "*/checkout*", "*/account*", "*/collections/*/products.json", "*add-to-cart*"), "strip": ("sort_by", "sortBy", "view")},
    "woocommerce": {"exclude": ("*/cart*", "*/checkout*", "*/my-account*", "*add-to-cart*", "*/wp-admin*"), "strip": ("orderby", "order", "min_price", "max_price")},
    "wordpress": {
        "exclude": ("*/wp-admin*", "*/wp-login.php*", "*/xmlrpc.php*", "*/wp-json/*", "*/feed/*", "*/feed", "*/comments/feed/*", "*/tag/*/feed/*", "*/category/*/feed/*", "*/author/*/feed/*", "*?replytocom=*", "*&replytocom=*", "*?attachment_id=*", "*&attachment_id=*", "*?p=*", "*/author/*", "*/tag/*", "*/?s=*", "*&s=*"),
        "strip": ("replytocom", "attachment_id", "unapproved", "moderation-hash", "preview", "preview_id", "preview_nonce"),
    },
}
