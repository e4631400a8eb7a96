"""Near duplicates by SimHash bands."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlloom.functions.text import hamming, simhash
from crawlloom.session import stage


def band_count(bands: int, distance: int, bits: int = 64) -> int:
    """Bands that find every pair within ``distance``: more than it, and a divisor of the bits."""
    wanted = bands if bands > distance else distance + 1
    return next(b for b in range(wanted, bits + 1) if bits % b == 0)


def bucket_keys(print_: str, distance: int, bands: int) -> Column:
    """array<struct<band, value>>: two fingerprints within ``distance`` share one of these.

    Up to distance 4 the bits are cut into distance + 3 blocks, three of which must agree: keys
    of some 32 bits, so buckets stay small among thousands of millions of texts. Beyond that,
    bands by the pigeonhole principle.
    """

    def bits(lo: int, hi: int) -> Column:
        return F.shiftrightunsigned(print_, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))

    if distance <= 4:
        n = distance + 3
        cuts = [i * 64 // n for i in range(n + 1)]
        agree = list(combinations(range(n), 3))
        values = [F.xxhash64(*[bits(cuts[i], cuts[i + 1]) for i in c]) for c in agree]
    else:
        n = band_count(bands, distance)
        values = [bits(i * (64 // n), (i + 1) * (64 // n)) for i in range(n)]
    return F.array(*[F.struct(F.lit(i).alias("band"), v.alias("value")) for i, v in enumerate(values)])


def near_duplicates(docs: DataFrame, key: str, text: str, distance: int = 3, bands: int = 4) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of near-duplicate texts.

    Equal fingerprints are one class whose representative is the least key, so a text copied a
    million times is one row of the join: members has (key, class_id). pairs has (class_a,
    class_b, distance, similarity) of different classes within ``distance`` bits, each once,
    whichever bands match. No bucket is capped. Both sides of the join are shuffled: a broadcast
    is planned by the size of the classes, which the keys then multiply by up to twenty.
    """
    prints = stage(simhash(docs.select(key, text), key, text).where("simhash is not null"), "prints")
    classes = stage(prints.groupBy("simhash").agg(F.min(key).alias("class_id")), "classes")
    members = prints.join(classes, "simhash").select(key, "class_id")
    cuts = bucket_keys("simhash", distance, bands)
    cut = classes.select("class_id", "simhash", F.explode(cuts).alias("c")).select("class_id", "simhash", "c.*")
    a, b = cut.alias("a"), cut.alias("b")
    near = a.join(b.hint("merge"), (F.col("a.band") == F.col("b.band")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.class_id") < F.col("b.class_id")) & (hamming("a.simhash", "b.simhash") <= distance))
    pairs = near.select(F.col("a.class_id").alias("class_a"), F.col("b.class_id").alias("class_b"), hamming("a.simhash", "b.simhash").alias("distance")).distinct()
    return pairs.withColumn("similarity", F.floor((64 - F.col("distance")) / 64 * 1000 + 0.5) / 10), members
