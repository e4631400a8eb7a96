"""Mixing sources to target weights (p9).

Method: Sainte-Lague apportionment. The mixture is cut into equal blocks of tokens; blocks go
to sources by the highest quotients share / (2k + 1), one after the other, which gives every
source, and every shard of the output, an integer quota. Documents of a source stand in a
seeded order; its k-th block is the k-th stretch of that order, which starts again from the
front where a source is repeated. A document belongs to the block its middle falls in, so a
source misses its quota by half a document at most.

A shard's quota is what the blocks it was given add up to. Documents are as long as several
blocks, so shards are filled by size: from the longest class of sizes to the shortest, each class of
a source goes to the shards that lack most, of that source and in all, and short documents even
out what long ones leave. Which documents of a class go where is a matter of their seeded order.

The driver sees the number of tokens of each source, of each bucket of a source and of each class
of sizes of a source; running sums and ranks are taken within a bucket and shifted by the buckets
before, so a source that holds most documents is many tasks.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlloom.session import stage

#: Classes of sizes in a doubling, and how much more a shard's lack in all counts than that of a source.
CLASSES, IN_ALL = 64, 4.0
#: Most sources; with the number of blocks, the bound of what is broadcast.
MOST_SOURCES = 2_000


def sainte_lague(shares: dict[str, float], seats: int, caps: dict[str, int]) -> list[str]:
    """Who gets each seat, in order of quotients; ties go to the smaller name. A source stops
    at its cap, and the rest goes on among the others; fewer seats come back if all stop."""
    heap = [(-w, name, 0) for name, w in shares.items() if w > 0 and caps.get(name, 0) > 0]
    heapq.heapify(heap)
    won: list[str] = []
    while heap and len(won) < seats:
        _, name, k = heapq.heappop(heap)
        won.append(name)
        if k + 1 < caps[name]:
            heapq.heappush(heap, (-shares[name] / (2 * k + 3), name, k + 1))
    return won


def filled(lack: np.ndarray, n: int, size: float) -> np.ndarray:
    """How many of n documents of a size each shard gets, so that what the worst shard lacks is
    least: as many as bring all that get any to one level, the rest to those that lack most."""
    order = np.argsort(-lack, kind="stable")
    level = (np.cumsum(lack[order]) - n * size) / np.arange(1, len(lack) + 1)
    last = int(np.flatnonzero(lack[order] > level)[-1]) if (lack[order] > level).any() else 0
    out = np.zeros(len(lack), dtype=np.int64)
    out[order[: last + 1]] = np.maximum(0, np.floor((lack[order[: last + 1]] - level[last]) / size + 1e-9)).astype(np.int64)
    while out.sum() > n:  # rounding
        out[np.argmax(out)] -= 1
    for _ in range(n - int(out.sum())):  # fewer than there are shards
        out[int(np.argmax(lack - out * size))] += 1
    return out


def shares_of_classes(classes: list[tuple[str, int, int, int]], wanted: dict[str, np.ndarray]) -> list[tuple[str, int, list[int]]]:
    """(source, class, ranks at which the next shard begins) for classes (source, class, documents,
    tokens) and the tokens that each shard wants of each source."""
    lack = {s: w.astype(float) for s, w in wanted.items()}
    in_all = np.sum(list(lack.values()), axis=0)
    out = []
    for source, cls, n, tokens in sorted(classes, key=lambda c: (-c[1], c[0])):
        size = tokens / n
        got = filled(lack[source] + IN_ALL * in_all, n, size)
        lack[source] -= got * size
        in_all -= got * size
        out.append((source, cls, np.cumsum(got).tolist()))
    return out


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 17, blocks: int = 2_000, shards: int = 16, total_tokens: int | None = None, items_per_bucket: int = 50_000) -> DataFrame:
    """(shard, block, source, doc_id, pass, n_tokens): one row for each use of a document.

    ``sizes`` has (doc_id, source, n_tokens). Without ``total_tokens`` the mixture is as large
    as it can be with every source at its share: the least of available tokens times
    max_repeats over share. Left out: rows without a source or one not in ``targets``, and
    documents without tokens. A target whose source has no tokens is dropped and the others'
    shares are taken relative to each other. Duplicate targets of a source: the first by
    share. Repeated rows are documents of their own.
    """
    spark = sizes.sparkSession
    empty = "shard int, block int, source string, doc_id long, pass int, n_tokens long"
    rows = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.min_by("max_repeats", "target_share").alias("reps"), F.min("target_share").alias("share")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not rows:
        return spark.createDataFrame([], empty)
    wanted = F.broadcast(spark.createDataFrame([(r["source"],) for r in rows], "source string"))
    docs = stage(sizes.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n")).where("n > 0").join(wanted, "source", "left_semi"), "sources")
    n_buckets = max(1, min(4096, docs.count() // items_per_bucket + 1))
    order = F.xxhash64("doc_id", F.lit(seed))
    docs = docs.withColumn("h", order).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 32), F.lit(n_buckets)).cast("int"))
    sums = stage(docs.groupBy("source", "bucket").agg(F.sum("n").alias("n")), "buckets")
    have = {r["source"]: int(r["n"]) for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    share = {r["source"]: float(r["share"]) for r in rows if r["source"] in have}
    reps = {r["source"]: int(r["reps"]) for r in rows}
    if not share:
        return spark.createDataFrame([], empty)
    whole = sum(share.values())
    share = {s: w / whole for s, w in share.items()}
    total = total_tokens or int(min(have[s] * reps[s] / w for s, w in share.items()))
    block = max(1, -(-total // blocks))
    seats = max(1, total // block)
    won = sainte_lague(share, seats, {s: have[s] * reps[s] // block or 1 for s in share})
    taken: dict[str, int] = {}
    quota = []
    for i, s in enumerate(won):
        quota.append((s, taken.get(s, 0), i, i * shards // len(won)))
        taken[s] = taken.get(s, 0) + 1
    seat = F.broadcast(spark.createDataFrame([(s, k, i) for s, k, i, _ in quota], "source string, k int, block int"))
    facts = F.broadcast(spark.createDataFrame([(s, have[s], reps[s], taken.get(s, 0)) for s in share], "source string, have long, reps int, quota int"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = docs.withColumn("upto", F.sum("n").over(within)).join(offsets, ["source", "bucket"]).withColumn("start", F.col("before") + F.col("upto") - F.col("n"))
    uses = placed.join(facts, "source").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("reps") - 1)))
    uses = uses.withColumn("k", F.expr(f"cast((pass * have + start + n div 2) div {block} as int)")).where("k < quota")
    uses = stage(uses.select("source", "bucket", "doc_id", "h", "n", "pass", "k", F.floor(F.log2("n") * CLASSES).cast("int").alias("cls")), "uses")
    counted = stage(uses.groupBy("source", "cls", "bucket").agg(F.count("*").alias("count"), F.sum("n").alias("n")), "classes")
    classes = [(r["source"], r["cls"], r["count"], int(r["n"])) for r in counted.groupBy("source", "cls").agg(F.sum("count").alias("count"), F.sum("n").alias("n")).collect()]  # sources x classes
    used = {s: sum(n for x, _, _, n in classes if x == s) for s in share}
    wanted = {s: np.zeros(shards) for s in share}
    for s, _, _, i in quota:
        wanted[s][i] += used[s] / taken[s]
    plan = F.broadcast(spark.createDataFrame(shares_of_classes(classes, wanted), "source string, cls int, ends array<long>"))
    earlier = Window.partitionBy("source", "cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("source", "cls", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "cls", "bucket").orderBy("h", "doc_id", "pass")) - 1
    ranked = uses.withColumn("rank", rank).join(offsets, ["source", "cls", "bucket"]).withColumn("at", F.col("before") + F.col("rank"))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("at"))).cast("int").alias("shard")
    return ranked.join(plan, ["source", "cls"]).join(seat, ["source", "k"]).select(shard, "block", "source", "doc_id", "pass", F.col("n").alias("n_tokens"))


def shard_sizes(mixed: DataFrame) -> DataFrame:
    """(shard, n_uses, n_tokens, off_by): what each shard holds, and by how many tokens that misses
    an equal share of the mixture."""
    by = mixed.groupBy("shard").agg(F.count("*").alias("n_uses"), F.sum("n_tokens").alias("n_tokens"))
    mean = F.broadcast(by.agg(F.avg("n_tokens").alias("mean")))
    return by.join(mean, F.lit(True)).select("shard", "n_uses", "n_tokens", F.rint(F.col("n_tokens") - F.col("mean")).cast("long").alias("off_by"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, n_uses, most_uses) of every target; shares
    of all tokens in the mixture, to six places."""
    used = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("uses"), (F.max("pass") + 1).alias("passes")).groupBy("source").agg(F.sum("n").alias("n_tokens"), F.sum("uses").alias("n_uses"), F.max("passes").alias("most_uses"))
    of_all = used.withColumn("all", F.sum("n_tokens").over(Window.partitionBy()))
    return targets.select("source", "target_share").where("source is not null").distinct().join(of_all, "source", "left").select(
        "source", "target_share", F.coalesce(F.floor(F.col("n_tokens") / F.col("all") * 1e6 + 0.5) / 1e6, F.lit(0.0)).alias("actual_share"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_uses", F.lit(0)).alias("n_uses"), F.coalesce("most_uses", F.lit(0)).alias("most_uses")
    )
