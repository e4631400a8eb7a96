"""Sinks: CSV, JSON, XML, sitemaps and keep-latest tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from crawlloom.functions.text import cell

PER_SITEMAP = 50_000


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, and text cells safe for spreadsheets."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            out.append(F.to_json(c).alias(f.name))
        elif f.dataType.typeName() == "string":
            out.append(cell(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV in UTF-8 with a byte-order mark before the header of every file; a frame without rows
    gives the single heading no_data."""
    out = flat(df)
    if out.isEmpty():
        out = df.sparkSession.createDataFrame([("",)], "no_data string").where(F.lit(False)).coalesce(1)
    out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    out.write.mode("overwrite").csv(path, header=True, encoding="UTF-8", escape='"')


# The tables that are exported only where they have rows.
CONDITIONAL = tuple(
    """excluded_urls deferred_urls redirect_chains redirect_loops redirect_issues security_issues custom_extraction lighthouse_import resources resource_issues
    resource_status pagination pagination_issues hreflang_issues js_diff accessibility accessibility_issues gsc_pages gsc_queries ga4_landing_pages ga4_channels gsc_index_status
    priority_opportunities page_priority action_board link_score near_duplicates keyword_cannibalization internal_link_opportunities pagespeed pagespeed_opportunities crux_history
    ai_recommendations pagespeed_audits pagespeed_network_requests pagespeed_js_treemap pagespeed_failed_audits""".split()
)


def export_conditional(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write each of the ``CONDITIONAL`` tables that is there and has rows as <folder>/<name>.csv;
    the paths written, by name."""
    written = {}
    for name in CONDITIONAL:
        if name in tables and not tables[name].isEmpty():
            written[name] = f"{folder.rstrip('/')}/{name}.csv"
            write_csv(tables[name], written[name])
    return written


#: Tables too large for the audit file unless it is asked for in full.
RAW_ARRAYS = ("links", "images", "headings")


def audit_document(tables: dict[str, DataFrame], mode: str = "audit", full: bool = False) -> DataFrame:
    """(part, document): the audit as JSON, a row a table with its rows counted and listed. Raw
    arrays are only counted unless ``full``. Each row of a table is a line of its own part
    (part, document), so that no task or row holds a whole table."""
    spark = next(iter(tables.values())).sparkSession
    head = spark.createDataFrame([("audit", mode)], "part string, mode string").select("part", F.to_json(F.struct("mode")).alias("document"))
    out = [head]
    for name, df in tables.items():
        if name in RAW_ARRAYS and not full:
            out.append(df.agg(F.count("*").alias("omitted")).select(F.lit(name).alias("part"), F.to_json(F.struct("omitted")).alias("document")))
        else:
            out.append(df.select(F.lit(name).alias("part"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("document")))
    return reduce(DataFrame.unionByName, out)


def write_audit(tables: dict[str, DataFrame], path: str, mode: str = "audit", full: bool = False) -> None:
    """The audit as JSON lines in one folder a part: <path>/part=<table>."""
    audit_document(tables, mode, full).write.mode("overwrite").partitionBy("part").text(path)


def write_metrics(snapshot: DataFrame, path: str) -> None:
    """metrics.json: the one row of a metrics snapshot."""
    snapshot.select("metrics").coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_xml(df: DataFrame, path: str, root: str = "rows", row: str = "row") -> None:
    df.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", row).save(path)


def sitemap_entries(pages: DataFrame) -> DataFrame:
    """(loc, lastmod): 200, indexable, and without canonical or with itself as canonical
    (a slash at the end makes no difference); each url once."""
    trim = lambda c: F.regexp_replace(c, "/+$", "")
    own = (F.coalesce("canonical", F.lit("")) == "") | (trim(F.col("canonical")) == trim(F.col("url")))
    good = pages.where((F.col("status_code") == 200) & F.coalesce("is_indexable", F.lit(False)) & own)
    return good.groupBy(F.col("url").alias("loc")).agg(F.substring(F.max("crawled_at").cast("string"), 1, 10).alias("lastmod"))


def numbered(entries: DataFrame, per_file: int = PER_SITEMAP, parts: int = 64) -> DataFrame:
    """Entries with ``file``: ranges of loc of at most ``per_file``. Entries are ranked inside
    range partitions and shifted by the partitions before, so no task holds them all."""
    ranged = entries.repartitionByRange(parts, "loc").withColumn("part", F.spark_partition_id())
    sizes = ranged.groupBy("part").count()
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    at = F.row_number().over(Window.partitionBy("part").orderBy("loc")) - 1
    return ranged.withColumn("at", at).join(F.broadcast(before), "part").select("loc", "lastmod", F.floor((F.col("at") + F.col("before")) / per_file).cast("int").alias("file"))


def write_sitemaps(pages: DataFrame, path: str) -> None:
    """sitemap files under path/file=<n> with rootTag urlset, one group of rows a file."""
    numbered(sitemap_entries(pages)).write.mode("overwrite").partitionBy("file").format("xml").option("rootTag", 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"').option("rowTag", "url").save(path)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Keep-latest union: the row of each key with the greatest ``order``; new wins a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c != "_new"]
    return both.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*cols), F.struct(order, "_new")).alias("r")).select("r.*")
