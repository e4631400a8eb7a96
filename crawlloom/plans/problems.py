"""Queries of the general problems (p4, p5, p6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlloom.operators.hierarchy import descendants, hierarchy
from crawlloom.operators.hotkeys import target_stats
from crawlloom.operators.orphans import latest_parents, orphan_cascade, orphan_report
from crawlloom.tables import table

PAGE_REFS = ("page_id", "run_id", "url", "canonical", "crawled_at", "ingested_at", "removed_at")


def _references(spark: SparkSession, d: str) -> list[DataFrame]:
    return [
        table(spark, d, "pages", *PAGE_REFS),
        table(spark, d, "links", "id", "run_id", "from_url", "to_url", "to_url_normalized", "is_internal", "is_special_link", "loaded_at"),
        table(spark, d, "headings", "id", "run_id", "page_url", "loaded_at"),
        table(spark, d, "images", "id", "run_id", "page_url", "loaded_at"),
    ]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphan_cascade(*_references(spark, d))
    return found.where("kind = 'direct' and ref_field in ('from_url', 'to_url_normalized', 'page_url')").select("table_name", "record_id", "ref_field")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(*_references(spark, d))


def _solved(spark: SparkSession, d: str, with_path: bool) -> DataFrame:
    return hierarchy(latest_parents(table(spark, d, "pages", *PAGE_REFS)).select("url", "parent"), with_path)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    solved = _solved(spark, d, False).where("depth <> 0")
    return solved.select(F.col("node").alias("url"), F.when(F.col("looped"), F.lit("")).otherwise(F.col("root")).alias("root_url"), "depth")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every url with its root, depth and path to the root, and whether it ends in a cycle."""
    return _solved(spark, d, True).select(F.col("node").alias("url"), F.col("root").alias("root_url"), "depth", F.array_join("path", " > ").alias("path"), "looped")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_solved(spark, d, True))


def p6_target_stats(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "links", "to_url", "from_url", "in_navigation")
    return target_stats(links, table(spark, d, "pages", "url", "status_code", "crawled_at", "page_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_target_stats(spark, d).where("n_links * 50 >= n_rows and to_url is not null").select("to_url")


QUERIES = {f.__name__: f for f in (p4_found, p4_report, p5_found, p5_paths, p5_descendants, p6_found, p6_target_stats)}

_LIVE = "EXISTS (SELECT 1 FROM pages p WHERE p.url = r.ref AND p.ingested_at <= r.t AND (p.removed_at IS NULL OR p.removed_at > r.t))"
# The normal form without Python: enough for http(s) addresses whose query needs no re-encoding.
_TRACKING = "['utm_source','utm_medium','utm_campaign','utm_content','utm_term','utm_id','utm_source_platform','utm_creative_format','utm_marketing_tactic','gclid','dclid','gclsrc','gbraid','wbraid','_ga','_gid','_gac','msclkid','fbclid','_fb','fb_action_ids','fb_action_types','fb_ref','ttclid','twclid','li_fat_id','epik','mc_cid','mc_eid','igshid','yclid','ref','ref_src','ref_url','referrer','source','src','affiliate','aff','aff_id','affiliate_id']"


def normal_form_sql(c: str) -> str:
    auth = f"lower(regexp_extract({c}, '^[^:/?#]+://([^/?#]*)', 1))"
    scheme = f"lower(regexp_extract({c}, '^([^:/?#]+):', 1))"
    auth = f"CASE WHEN {scheme} = 'http' THEN regexp_replace({auth}, ':80$', '') WHEN {scheme} = 'https' THEN regexp_replace({auth}, ':443$', '') ELSE {auth} END"
    path = f"regexp_replace(regexp_replace(regexp_extract({c}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/(\\./)+', '/', 'g'), '/+', '/', 'g')"
    path = f"regexp_replace(regexp_replace({path}, '/(\\./)+', '/', 'g'), '/[^/.]+/\\.\\./', '/', 'g')"
    query = f"list_sort(list_filter(string_split(regexp_extract({c}, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND x NOT LIKE '%=' AND contains(x, '=') AND NOT list_contains({_TRACKING}, string_split(x, '=')[1])))"
    return f"({scheme} || '://' || ({auth}) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END)"


_PARENTS = f"""latest AS (SELECT url, arg_max(struct_pack(c := canonical), struct_pack(a := crawled_at, b := page_id)).c AS canonical FROM pages WHERE url IS NOT NULL GROUP BY url),
  normed AS (SELECT url, CASE WHEN canonical IS NULL OR canonical = '' THEN NULL ELSE {normal_form_sql('canonical')} END AS parent FROM latest),
  parents AS (SELECT url, CASE WHEN parent = url THEN NULL ELSE parent END AS parent FROM normed)"""
_WALK = f"""WITH RECURSIVE {_PARENTS},
  walk AS (SELECT url, parent AS up, 1 AS depth, [parent] AS path, FALSE AS looped FROM parents WHERE parent IS NOT NULL
    UNION ALL SELECT w.url, p.parent, w.depth + 1, list_append(w.path, p.parent), list_contains(w.path, p.parent)
    FROM walk w JOIN parents p ON p.url = w.up WHERE p.parent IS NOT NULL AND NOT w.looped),
  ends AS (SELECT url, arg_max(up, depth) AS root, max(depth) AS depth, arg_max(path, depth) AS path, bool_or(looped) AS looped FROM walk GROUP BY url)"""

_CASCADE = f"""WITH RECURSIVE newest AS (SELECT url, arg_max(struct_pack(c := canonical, t := ingested_at, run := run_id), struct_pack(a := crawled_at, b := page_id)) AS r FROM pages WHERE url IS NOT NULL GROUP BY url),
  par0 AS MATERIALIZED (SELECT url, CASE WHEN r.c IS NULL OR r.c = '' THEN NULL ELSE {normal_form_sql('r.c')} END AS parent, r.t AS t, r.run AS run_id FROM newest), par AS MATERIALIZED (SELECT url, parent AS ref, t, run_id FROM par0 WHERE parent <> url),
  first AS MATERIALIZED (SELECT url FROM par r WHERE NOT {_LIVE}), orph AS (SELECT url, 1 AS level FROM first UNION ALL SELECT p.url, o.level + 1 FROM par p JOIN orph o ON p.ref = o.url WHERE p.url NOT IN (SELECT url FROM first)),
  refs AS (SELECT 'links' AS table_name, run_id, 'from_url' AS ref_field, from_url AS ref, loaded_at AS t FROM links UNION ALL SELECT 'links', run_id, 'to_url_normalized', coalesce(to_url_normalized, {normal_form_sql('to_url')}), loaded_at FROM links WHERE is_internal AND NOT is_special_link
    UNION ALL SELECT 'headings', run_id, 'page_url', page_url, loaded_at FROM headings UNION ALL SELECT 'images', run_id, 'page_url', page_url, loaded_at FROM images),
  told AS (SELECT *, NOT {_LIVE} AS direct, ref IN (SELECT url FROM orph) AS heir FROM refs r WHERE ref IS NOT NULL)
  SELECT table_name, run_id, ref_field, count(*) AS n_refs, count(*) FILTER (direct) AS n_direct, count(*) FILTER (NOT direct AND heir) AS n_inherited FROM told GROUP BY ALL
  UNION ALL SELECT 'pages', run_id, 'canonical', count(*), count(*) FILTER (level = 1), count(*) FILTER (level > 1) FROM par LEFT JOIN orph USING (url) GROUP BY run_id"""

ORACLE = {
    "p4_report": _CASCADE,
    "p4_found": f"""SELECT 'links' AS table_name, record_id, ref_field FROM (
        SELECT id AS record_id, from_url AS ref, loaded_at AS t, 'from_url' AS ref_field FROM links
        UNION ALL SELECT id, coalesce(to_url_normalized, {normal_form_sql('to_url')}), loaded_at, 'to_url_normalized' FROM links WHERE is_internal AND NOT is_special_link) r WHERE ref IS NOT NULL AND NOT {_LIVE}
      UNION ALL SELECT 'headings', id, 'page_url' FROM (SELECT id, page_url AS ref, loaded_at AS t FROM headings) r WHERE ref IS NOT NULL AND NOT {_LIVE}
      UNION ALL SELECT 'images', id, 'page_url' FROM (SELECT id, page_url AS ref, loaded_at AS t FROM images) r WHERE ref IS NOT NULL AND NOT {_LIVE}""",
    "p5_found": f"{_WALK} SELECT url, CASE WHEN looped THEN '' ELSE root END AS root_url, CASE WHEN looped THEN -1 ELSE depth END AS depth FROM ends",
    "p5_paths": f"""{_WALK} SELECT url, CASE WHEN looped THEN NULL ELSE root END AS root_url, CASE WHEN looped THEN -1 ELSE depth END AS depth, CASE WHEN looped THEN '' ELSE array_to_string(path, ' > ') END AS path, looped FROM ends
      UNION ALL SELECT url, url, 0, '', FALSE FROM parents WHERE parent IS NULL""",
    "p5_descendants": f"{_WALK} SELECT unnest(path) AS url, url AS descendant, unnest(generate_series(1, len(path))) AS distance FROM ends WHERE NOT looped",
    "p6_found": "SELECT to_url FROM links WHERE to_url IS NOT NULL GROUP BY to_url HAVING count(*) * 50 >= (SELECT count(*) FROM links)",
    "p6_target_stats": """SELECT l.to_url, count(*) AS n_links, count(*) FILTER (in_navigation) AS n_nav_links, count(DISTINCT from_url) AS n_sources, any_value(t.s) AS target_status, (SELECT count(*) FROM links) AS n_rows
      FROM links l LEFT JOIN (SELECT url, arg_max(status_code, struct_pack(a := crawled_at, b := page_id)) AS s FROM pages GROUP BY url) t ON t.url = l.to_url GROUP BY l.to_url""",
}
