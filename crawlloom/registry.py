"""Analyzers by name, and which of them each mode runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from crawlloom.operators import content, pages

Tables = dict[str, DataFrame]

ANALYZERS: dict[str, Callable[[Tables], DataFrame]] = {
    "duplicates": lambda t: pages.duplicates(t["pages"]),
    "thin_content": lambda t: pages.thin_content(t["pages"]),
    "broken": lambda t: pages.broken_pages(t["pages"]),
    "broken_with_inlinks": lambda t: pages.broken_with_inlinks(t["pages"], t["links"]),
    "orphans": lambda t: pages.inlinked_pages(t["pages"], t["links"]),
    "canonical": lambda t: pages.canonical_audit(t["pages"]),
    "url_issues": lambda t: pages.url_hygiene(t["pages"]),
    "images": lambda t: pages.image_audit(t["images"]),
    "security": lambda t: content.security_audit(t["pages"], t["headers"]),
    "hreflang": lambda t: content.hreflang_audit(t["hreflang"], t["pages"]),
    "schema": lambda t: content.schema_audit(t["schema"]),
    "sitemap": lambda t: content.sitemap_diff(t["sitemap"], t["pages"]),
    "pagination": lambda t: content.pagination_audit(t["pages"]),
}

MODES = {
    "audit": tuple(ANALYZERS),
    "competitor": ("duplicates", "thin_content", "images", "schema"),
    "compare": ("duplicates", "thin_content", "broken", "canonical"),
}


def run(mode: str, tables: Tables) -> dict[str, DataFrame]:
    """Results of a mode's analyzers for which the tables are there; nothing runs until used."""
    out = {}
    for name in MODES[mode]:
        try:
            out[name] = ANALYZERS[name](tables)
        except KeyError:
            continue
    return out
