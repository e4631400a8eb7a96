"""Address functions: normal form, host, path, depth, internality and kinds."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlparse, urlunparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Query parameters that only track a visitor; compared with case.
TRACKING_PARAMS = frozenset(
    """utm_source utm_medium utm_campaign utm_content utm_term utm_id utm_source_platform utm_creative_format
    utm_marketing_tactic gclid dclid gclsrc gbraid wbraid _ga _gid _gac msclkid fbclid _fb fb_action_ids
    fb_action_types fb_ref ttclid twclid li_fat_id epik mc_cid mc_eid igshid yclid ref ref_src ref_url referrer
    source src affiliate aff aff_id affiliate_id""".split()
)
# Tracking parameters of the address hygiene report; compared in lower case.
HYGIENE_TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "gclid", "msclkid", "ref", "ref_src")

_DEFAULT_PORT = {"http": ":80", "https": ":443"}
_SLASHES = re.compile("/{2,}")


def normal_form(address: str | None, base: str | None = None, strip: frozenset[str] = frozenset()) -> str | None:
    """The one spelling of an address.

    Lower-case scheme and host, no default port, one slash where there were several, dot
    segments resolved, tracking and blank parameters gone, the rest sorted, no fragment; a
    slash at the end stays. ``strip`` has further parameters in lower case. None stays None;
    what can't be parsed is returned as it came.
    """
    if address is None:
        return None
    try:
        u = urlparse(urljoin(base, address) if base else address)
    except ValueError:
        return address
    scheme, host = u.scheme.lower(), u.netloc.lower()
    host = host.removesuffix(_DEFAULT_PORT.get(scheme, "\0"))
    path = _SLASHES.sub("/", u.path) or "/"
    if "./" in path or path.endswith("."):
        closed = path.endswith("/") and len(path) > 1
        path = posixpath.normpath(path)
        path += "/" if closed and not path.endswith("/") else ""
    kept = sorted(kv for kv in parse_qsl(u.query) if kv[0] not in TRACKING_PARAMS and kv[0].lower() not in strip)
    return urlunparse((scheme, host, path, u.params, urlencode(kept), ""))


@F.pandas_udf(StringType())
def normal_form_udf(address: pd.Series) -> pd.Series:
    """``normal_form`` by Arrow batches; equal addresses of a batch are done once."""
    seen: dict = {None: None}
    return pd.Series([seen[a] if a in seen else seen.setdefault(a, normal_form(a)) for a in address.where(address.notna(), None)], dtype=object)


@F.pandas_udf(StringType())
def normal_form_on_udf(address: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([normal_form(a, b) for a, b in zip(address.where(address.notna(), None), base.where(base.notna(), None))], dtype=object)


# RFC 3986, appendix B.
_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column | str, which: str) -> Column:
    """scheme, authority, path, query or fragment of an address; '' where there is none."""
    at = ("scheme", "authority", "path", "query", "fragment").index(which) + 1
    return F.regexp_extract(F.col(url) if isinstance(url, str) else url, _PARTS, at)


def host(url: Column | str) -> Column:
    """Host in lower case, without port."""
    return F.regexp_replace(F.lower(part(url, "authority")), r":\d+$", "")


def bare_host(url: Column | str) -> Column:
    """Host without port and without one leading ``www.``."""
    return F.regexp_replace(host(url), r"^www\.", "")


def registrable(url: Column | str) -> Column:
    """The last two labels of the host (no public suffix list is at hand)."""
    return F.substring_index(host(url), ".", -2)


def segments(url: Column | str) -> Column:
    return F.filter(F.split(part(url, "path"), "/"), lambda s: s != "")


def depth(url: Column | str) -> Column:
    """Number of path segments that aren't empty."""
    return F.size(segments(url))


def path_key(url: Column | str) -> Column:
    """Path in lower case, without slashes at the end, '/' for the root; for joins by path."""
    p = F.regexp_replace(F.lower(part(url, "path")), "/+$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def is_internal(url: Column | str, domains: list[str]) -> Column:
    """True for relative addresses and for hosts equal to, or below, one of ``domains``."""
    h = bare_host(url)
    inside = F.lit(False)
    for d in domains:
        d = d.lower().removeprefix("www.")
        inside = inside | (h == d) | h.endswith("." + d)
    return (part(url, "authority") == "") | inside


def in_own_domains(url: Column | str, domains: Column) -> Column:
    """The variant for canonical addresses, with the domains as an array: the port stays part of
    the host, relative addresses are inside, and nothing else is without domains."""
    h = F.regexp_replace(F.lower(part(url, "authority")), r"^www\.", "")
    clean = F.transform(F.filter(domains, lambda d: F.coalesce(d, F.lit("")) != ""), lambda d: F.regexp_replace(F.lower(d), r"^www\.", ""))
    return (h == "") | F.exists(clean, lambda d: (h == d) | h.endswith(F.concat(F.lit("."), d)))


def query_pairs(url: Column | str) -> Column:
    """array<struct<k,v>> of the query, in order, blanks kept, not percent-decoded."""
    pieces = F.filter(F.split(part(url, "query"), "&"), lambda s: s != "")
    return F.transform(pieces, lambda s: F.struct(F.substring_index(s, "=", 1).alias("k"), F.regexp_extract(s, "^[^=]*=(.*)$", 1).alias("v")))


def without_query(url: Column | str) -> Column:
    return F.regexp_replace(F.col(url) if isinstance(url, str) else url, r"[?#].*$", "")


def native_normal_form(url: Column | str) -> Column:
    """The normal form as one JVM expression, for http(s) addresses without dot segments,
    path parameters or escapes in the query; stays inside whole-stage code generation."""
    scheme = F.lower(part(url, "scheme"))
    authority = F.lower(part(url, "authority"))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":80$", "")).when(scheme == "https", F.regexp_replace(authority, ":443$", "")).otherwise(authority)
    path = F.regexp_replace(part(url, "path"), "/{2,}", "/")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    tracked = F.array(*[F.lit(p) for p in sorted(TRACKING_PARAMS)])
    kept = F.array_sort(F.filter(query_pairs(url), lambda p: (p["v"] != "") & ~F.array_contains(tracked, p["k"])))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    return F.concat(scheme, F.lit("://"), authority, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


# Paths that only lead to a login, paging parameters, and parameters that filter.
WRAPPERS = ("/auth/", "/login", "/signin", "/sign-in", "/sign_in", "/customer/account/login", "/account/login", "/wp-login.php")
PAGING = ("page", "p", "pg", "pageno", "page_no")
FILTERS = ("category", "brand", "tag", "color", "size", "price")


def kind(url: Column | str, in_sitemap: Column | None = None, in_navigation: Column | None = None) -> Column:
    """sitemap, navigation, redirect_wrapper, pagination_deep (beyond page 3),
    filter_combination (several filters) or other, the first that holds; blank values don't count."""
    p = F.lower(part(url, "path"))
    pairs = F.filter(query_pairs(url), lambda x: x["v"] != "")
    key = lambda x: F.lower(x["k"])
    wrapper = F.lit(False)
    for w in WRAPPERS:
        wrapper = wrapper | p.startswith(w)
    deep = F.exists(pairs, lambda x: key(x).isin(*PAGING) & (F.coalesce(x["v"].try_cast("int"), F.lit(0)) > 3))
    filters = F.filter(pairs, lambda x: key(x).startswith("filter") | key(x).endswith("[]") | key(x).isin(*FILTERS))
    no = F.lit(False)
    return (
        F.when(no if in_sitemap is None else in_sitemap, "sitemap")
        .when(no if in_navigation is None else in_navigation, "navigation")
        .when(wrapper, "redirect_wrapper")
        .when(deep, "pagination_deep")
        .when(F.size(filters) > 1, "filter_combination")
        .otherwise("other")
    )
