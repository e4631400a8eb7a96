"""Access logs: parsing, crawl budget, and joins with the crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlloom.functions.text import bot
from crawlloom.functions.urls import path_key

# Fixed value: a line of the common or combined log format; referrer and agent are optional,
# the method is in capitals and the protocol must be there.
LINE = r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([A-Z]+)\s+([^"\s]+)\s+(\S+)"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?'


def parsed(lines: DataFrame) -> DataFrame:
    """(ip, ts_text, ts, method, path, status_code, bytes, referrer, agent, bot) of lines
    (value); lines of another form are dropped. ts ignores the zone."""
    g = lambda i: F.regexp_extract("value", LINE, i)
    rows = lines.where(F.col("value").rlike(LINE))
    return rows.select(
        g(1).alias("ip"),
        g(3).alias("ts_text"),
        F.try_to_timestamp(F.substring(g(3), 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss")).alias("ts"),
        g(4).alias("method"),
        F.regexp_replace(g(5), r"[?#].*$", "").alias("path"),
        g(7).cast("int").alias("status_code"),
        F.coalesce(g(8).try_cast("long"), F.lit(0).cast("long")).alias("bytes"),
        g(9).alias("referrer"),
        g(10).alias("agent"),
        bot(g(10)).alias("bot"),
    )


def budget(hits: DataFrame) -> DataFrame:
    """(path, hits, googlebot_hits, last_seen, n_200, n_3xx, n_404, n_4xx_other, n_5xx) by path,
    as map-side sums; last_seen is the text of the latest time whatever the order."""
    s = F.col("status_code")
    return hits.groupBy("path").agg(
        F.count("*").alias("hits"),
        F.count_if(F.col("bot") == "Googlebot").alias("googlebot_hits"),
        F.max_by("ts_text", "ts").alias("last_seen"),
        F.count_if(s == 200).alias("n_200"),
        F.count_if(s.between(300, 399)).alias("n_3xx"),
        F.count_if(s == 404).alias("n_404"),
        F.count_if(s.between(400, 499) & (s != 404)).alias("n_4xx_other"),
        F.count_if(s >= 500).alias("n_5xx"),
    )


def top_bots(hits: DataFrame, n: int = 10) -> DataFrame:
    return hits.where("bot is not null").groupBy("bot").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "bot").limit(n)


def orphan_paths(paths: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, hits): what bots ask for and the crawl doesn't know (anti join on paths)."""
    known = pages.select(path_key("url").alias("p")).distinct()
    return paths.join(known, F.regexp_replace(F.lower("path"), "(?<=.)/+$", "") == F.col("p"), "left_anti").select("path", "hits")


def log_board(paths: DataFrame, scored: DataFrame) -> DataFrame:
    """(url, path, hits, wasted, boosted_score, high_value): pages with scores (url,
    priority_score) beside their log lines; the boost is 10 * log10(hits + 1)."""
    p = paths.select(F.regexp_replace(F.lower("path"), "(?<=.)/+$", "").alias("path"), "hits", (F.col("n_404") + F.col("n_4xx_other") + F.col("n_5xx")).alias("errors")).groupBy("path").agg(F.sum("hits").alias("hits"), F.sum("errors").alias("errors"))
    score: Column = F.floor((F.col("priority_score") + 10 * F.log10(F.col("hits") + 1)) * 100 + 0.5) / 100
    j = scored.select("url", path_key("url").alias("path"), "priority_score").join(p, "path")
    return j.select("url", "path", "hits", (F.col("errors") > 0).alias("wasted"), score.alias("boosted_score"), ((score >= 50) & (F.col("hits") >= 10)).alias("high_value"))


def important_lines(lines: DataFrame, n: int = 20) -> DataFrame:
    """(at, value): the last n lines (at, value) of level ERROR or CRITICAL, or that begin a
    traceback, in order; each task sends its own last n."""
    level = F.regexp_extract("value", r"\|\s*(DEBUG|INFO|SUCCESS|WARNING|ERROR|CRITICAL)\s*\|", 1)
    kept = level.isin("ERROR", "CRITICAL") | (level == "") & F.col("value").contains("Traceback (most recent call last)")
    return lines.where(kept).orderBy(F.desc("at"), "value").limit(n).orderBy("at", "value")


def run_log_levels(lines: DataFrame) -> DataFrame:
    """(level, n) of '... | LEVEL | ...' lines."""
    level = F.regexp_extract("value", r"\|\s*(DEBUG|INFO|SUCCESS|WARNING|ERROR|CRITICAL)\s*\|", 1)
    return lines.where(level != "").groupBy(level.alias("level")).agg(F.count("*").alias("n"))
