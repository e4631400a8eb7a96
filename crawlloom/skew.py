"""Joins and assignments that stay even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlloom.session import stage


def url_key(col: Column | str, prefix: str = "k") -> list[Column]:
    """96 bits of a string as two numbers, which shuffle in 12 bytes instead of a whole address.

    Among ten thousand million addresses the chance of any collision is below 1e-9.
    Nulls hash like a constant, so callers drop them first.
    """
    c = F.col(col) if isinstance(col, str) else col
    return [F.xxhash64(c).alias(f"{prefix}1"), F.hash(c).alias(f"{prefix}2")]


def hot_keys(df: DataFrame, keys: list[str], fraction: float = 1 / 256, rows_per_salt: int = 250_000, least: int = 20_000) -> DataFrame:
    """Keys with more than ``fraction`` of all rows and how often to split each (``_salts``).

    At most 1/fraction keys can qualify, so the result is bounded whatever the data and may
    be broadcast. Counts are combined before the shuffle. The result never changes what a
    join returns, only how its rows are spread.
    """
    counts = df.groupBy(*keys).count()
    counts = stage(counts, "loads")
    rows = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    floor = max(int(rows * fraction), least)
    return counts.where(F.col("count") > floor).select(
        *keys, F.greatest(F.ceil(F.col("count") / min(rows_per_salt, max(floor, 1))), F.lit(2)).cast("int").alias("_salts")
    )


def split(df: DataFrame, keys: list[str], hot: DataFrame, spread_by: str) -> DataFrame:
    """``df`` with a ``_salt``: rows of hot keys are spread over the parts by ``spread_by``."""
    marked = df.join(F.broadcast(hot), keys, "left")
    return marked.withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread_by), F.col("_salts"))).cast("int")).drop("_salts")


def repeat(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``df`` with a ``_salt``: rows of hot keys once for each part."""
    marked = df.join(F.broadcast(hot), keys, "left")
    return marked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")


def salted(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread_by: str) -> tuple[DataFrame, DataFrame]:
    """Give both sides a ``_salt``: hot keys of ``left`` are split by ``spread_by``, and only
    their rows of ``right`` are repeated, once for each part."""
    return split(left, keys, hot, spread_by), repeat(right, keys, hot)
