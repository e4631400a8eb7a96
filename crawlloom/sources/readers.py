"""Sources: crawl tables, sitemaps, robots rules, access logs, exports and audit files."""

from __future__ import annotations

import re
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from crawlloom.operators.logs import parsed

ENTRY = "loc string, lastmod string, changefreq string, priority string"


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url, lastmod, changefreq, priority, source_sitemap) of a sitemap or index of sitemaps;
    gzip and namespaces don't matter; indexes are followed until no file is new, each once.
    Only addresses of sitemap files pass through the driver, never those of pages."""
    todo, seen, found = [path], set(), []
    while todo:
        here = [p for p in dict.fromkeys(todo) if p not in seen]
        seen.update(here)
        todo = []
        for p in here:
            kids = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(p)
            todo += [r["loc"].strip() for r in kids.where("loc is not null").collect()]  # files to open next
            found.append(spark.read.format("xml").option("rowTag", "url").schema(ENTRY).load(p).withColumn("source_sitemap", F.lit(p)))
    every = found[0]
    for f in found[1:]:
        every = every.unionAll(f)
    priority = F.expr("try_cast(priority as double)")
    return every.where("loc is not null").select(F.trim("loc").alias("url"), F.trim("lastmod").alias("lastmod"), F.trim("changefreq").alias("changefreq"), priority.alias("priority"), "source_sitemap")


def robots_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_extract("value", r"(?i)^\s*sitemap:\s*(\S+)", 1).alias("url")).where("url <> ''").distinct()


def can_fetch(robots: str, url: Column, agent: str = "*") -> Column:
    """Whether robots rules (text) let an agent fetch an address; no rules allow everything."""

    @F.pandas_udf(BooleanType())
    def allowed(urls: pd.Series) -> pd.Series:
        rules = RobotFileParser()
        rules.parse(robots.splitlines())
        return urls.map(lambda u: None if u is None else rules.can_fetch(agent, u))

    return allowed(url)


def crawl_delay(robots: str, agent: str = "*") -> float | None:
    rules = RobotFileParser()
    rules.parse(robots.splitlines())
    got = rules.crawl_delay(agent)
    return float(got) if got is not None else None


def access_log(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8 if every line of the file is valid in it, else UTF-16 if any line has a zero byte,
    else windows-1252. Lines are read as bytes, so the whole file is judged, in parallel."""
    lines = spark.read.text(path)
    if lines.where(~F.is_valid_utf8("value")).isEmpty():
        return "UTF-8"
    return "windows-1252" if lines.where(F.col("value").contains("\x00")).isEmpty() else "UTF-16"


# Characters of windows-1252 where ISO 8859-1 has controls.
_C1 = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(128, 160)}


def exported_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header in whatever of UTF-8, UTF-16 and windows-1252 the file is; names stripped
    of spaces and a byte-order mark, all rows."""
    encoding = encoding_of(spark, path)
    df = spark.read.csv(path, header=True, encoding="ISO-8859-1" if encoding == "windows-1252" else encoding, multiLine=True, escape='"')
    names = df.columns
    if encoding == "windows-1252":
        old, new = "".join(k for k, v in _C1.items() if v), "".join(_C1.values())
        df = df.select(*[F.translate(F.col(f"`{c}`"), old, new).alias(c) for c in names])
        names = [c.translate(str.maketrans(old, new)) for c in names]
    return df.toDF(*[c.strip().lstrip("\ufeff").strip('"') for c in names])


# The exports that a folder may hold, by file name.
EXPORTS = ("backlinks", "keywords", "referring_domains", "top_pages", "site_audit")


def exported(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """One of ``EXPORTS`` from <folder>/<name>.csv; None if the file isn't there."""
    if name not in EXPORTS:
        raise ValueError(f"no such export: {name}")
    path = f"{folder.rstrip('/')}/{name}.csv"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    return exported_csv(spark, path) if there else None


def audit_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def lighthouse(spark: SparkSession, folder: str) -> DataFrame:
    """(url, performance, accessibility, best_practices, seo) of report files in either layout:
    the report itself, or under lighthouseResult; scores in percent."""
    raw = spark.read.text(folder, wholetext=True)
    j = F.coalesce(F.get_json_object("value", "$.lighthouseResult"), F.col("value"))
    url = F.coalesce(F.get_json_object(j, "$.finalUrl"), F.get_json_object(j, "$.requestedUrl"))
    score = lambda k: F.floor(F.expr("1") * F.get_json_object(j, f"$.categories.{k}.score").cast("double") * 100 + 0.5).cast("int")
    return raw.select(url.alias("url"), score("performance").alias("performance"), score("accessibility").alias("accessibility"), score("best-practices").alias("best_practices"), score("seo").alias("seo")).where("url is not null")


def phase_two_seeds(deferred: DataFrame, seeds: DataFrame) -> DataFrame:
    """Deferred addresses that aren't seeds yet and are safe to fetch."""
    from crawlloom.sources.safety import is_safe

    return deferred.select("url").where(is_safe(F.col("url"))).distinct().join(seeds.select("url"), "url", "left_anti")


GLOB = re.compile(r"[*?\[]")


def glob_to_regex(pattern: str) -> str:
    import fnmatch

    return fnmatch.translate(pattern).replace("\\Z", "$").replace("\\z", "$")


def matches_any(url: Column | str, patterns: list[str]) -> Column:
    """Whether a pattern fits: a glob (also with * around it) if it has wild cards, else a substring."""
    c = F.col(url) if isinstance(url, str) else url
    out = F.lit(False)
    for p in patterns:
        out = out | (c.rlike(glob_to_regex(p)) | c.rlike(glob_to_regex(f"*{p}*")) if GLOB.search(p) else c.contains(p))
    return out
