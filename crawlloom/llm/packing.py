"""Filling fixed-capacity containers with items (p8).

Method: bulk-synchronous best fit. Items and gaps are sorted by size and kept as runs: all
items of one size are one run, all containers with the same room left are one run. A
superstep takes the next run of items, sweeps the sorted gaps for the successor (the
smallest gap that holds the size), settles by rank which items get which containers, updates
the gaps, and repeats until the run is placed; what no gap holds opens new containers. Taking
runs from large to small, this gives exactly best-fit decreasing.

There are at most ``capacity`` sizes, so a sweep handles a number of runs bounded by the
capacity whatever the number of documents. The sweeps of the limits run side by side as tasks,
each over its histogram of sizes; neither documents nor histogram nor plan pass through the
driver. Counting, ranking within a size and the placement of each document are distributed; ranks
are taken within (size, part), so that a size which a third of all documents share is no hot task,
and documents find their run by an equal join on chunks of ranks.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlloom.session import stage

#: Ranks of a size that are joined with the runs they may belong to at once.
CHUNK = 1_000
#: Most rows pack_limits may have, and the largest capacity: bounds of a sweep's histogram.
MOST_LIMITS, LARGEST_CAPACITY = 64, 1 << 20


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Place ``counts[size]`` items of each size into containers of ``capacity``.

    Returns the runs (size, first rank, items, first container, items a container) and the
    number of containers: the r-th item of a run goes to first container + r // items a container.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # sorted room of the runs of open containers
    held: dict[int, list[tuple[int, int]]] = {}  # room -> [(first container, containers)]
    opened = 0

    def keep(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in held:
                held[room] = []
                bisect.insort(gaps, room)
            held[room].append((first, n))

    for size in sorted(counts, reverse=True):
        need, rank = counts[size], 0
        while need > 0:
            i = bisect.bisect_left(gaps, size)
            if i < len(gaps):
                room = gaps[i]
                first, n = held[room].pop()
                if not held[room]:
                    del held[room]
                    gaps.pop(i)
            else:
                room, first = capacity, opened
                n = -(-need // (capacity // size))
                opened += n
            each = room // size
            whole = min(n, need // each)
            if whole:
                runs.append((size, rank, whole * each, first, each))
                rank, need = rank + whole * each, need - whole * each
                keep(room - each * size, first, whole)
            if need and whole < n:
                runs.append((size, rank, need, first + whole, need))
                keep(room - need * size, first + whole, 1)
                rank, need, whole = rank + need, 0, whole + 1
            keep(room, first + whole, n - whole) if room < capacity or whole < n else None
    return runs, opened


PLAN = "lane int, rest long, rank long, items long, first long, many long"


def _sweep(histogram: pd.DataFrame) -> pd.DataFrame:
    """``best_fit`` of one lane (rows lane, rest, n, cap), where the rows of the lane lie."""
    if not len(histogram):
        return pd.DataFrame(columns=[c.split()[0] for c in PLAN.split(", ")])
    runs, _ = best_fit(dict(zip(map(int, histogram["rest"]), map(int, histogram["n"]))), int(histogram["cap"].iloc[0]))
    out = pd.DataFrame(runs, columns=["rest", "rank", "items", "first", "many"])
    out.insert(0, "lane", int(histogram["lane"].iloc[0]))
    return out


def pack(sizes: DataFrame, limits: DataFrame, items_per_part: int = 50_000) -> DataFrame:
    """(limit_id, container, doc_id, piece, start, n_tokens): which tokens of a document go where.

    ``sizes`` has (doc_id, n_tokens). Only documents above the capacity are cut: into pieces
    of the capacity, which fill containers 'd<doc_id>.<piece>', and a rest that is packed like
    any document into containers 'c<number>'. Documents without tokens take no room and have
    container null. Limits with a null or non-positive capacity are left out; equal sizes are
    told apart by doc_id, so repeated rows with one doc_id are items of their own.
    """
    spark = sizes.sparkSession
    caps = [(r["limit_id"], int(r["capacity_tokens"])) for r in limits.where("capacity_tokens > 0").distinct().orderBy("limit_id", "capacity_tokens").limit(MOST_LIMITS + 1).collect()]
    if len(caps) > MOST_LIMITS or any(c > LARGEST_CAPACITY for _, c in caps):
        raise ValueError(f"more than {MOST_LIMITS} limits, or a capacity above {LARGEST_CAPACITY}")
    if not caps:
        return spark.createDataFrame([], "limit_id int, container string, doc_id long, piece int, start long, n_tokens long")
    sizes = stage(sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n")), "sizes")
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("lane"), F.lit(k).cast("int").alias("limit_id"), F.lit(c).cast("long").alias("cap")) for i, (k, c) in enumerate(caps)]))
    by_lane = sizes.select("doc_id", "n", each.alias("c")).select("doc_id", "n", "c.*")
    rest = F.when(F.col("n") <= F.col("cap"), F.col("n")).otherwise(F.col("n") % F.col("cap"))
    parts = max(1, min(1024, sizes.count() // items_per_part + 1))
    items = by_lane.withColumn("rest", rest).where("rest > 0").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    counted = stage(items.groupBy("lane", "rest", "part").agg(F.count("*").alias("count"), F.first("cap").alias("cap")), "histogram")
    by_size = counted.groupBy("lane", "rest").agg(F.sum("count").alias("n"), F.first("cap").alias("cap"))
    plan = stage(by_size.groupBy("lane").applyInPandas(_sweep, PLAN), "plan")
    # Runs are cut where chunks of ranks end, so that a place is found by an equal join and no
    # item meets more runs than begin in its chunk, whatever the number of runs or items of a size.
    last = F.col("rank") + F.col("items") - 1
    chunks = F.sequence(F.floor(F.col("rank") / CHUNK), F.floor(last / CHUNK))
    runs = plan.select("lane", "rest", "rank", last.alias("last"), "first", "many", F.explode(chunks).alias("chunk"))

    before = Window.partitionBy("lane", "rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count", "cap")
    ranked = items.withColumn("in_part", F.row_number().over(Window.partitionBy("lane", "rest", "part").orderBy("doc_id")) - 1)
    at = ranked.join(offsets, ["lane", "rest", "part"]).withColumn("at", (F.col("before") + F.col("in_part")).cast("long"))
    placed = at.withColumn("chunk", F.floor(F.col("at") / CHUNK)).join(runs, ["lane", "rest", "chunk"]).where("at between rank and last")
    number = F.col("first") + F.floor((F.col("at") - F.col("rank")) / F.col("many"))
    start = F.col("n") - F.col("rest")
    packed = placed.select(
        "limit_id",
        F.concat(F.lit("c"), number.cast("string")).alias("container"),
        "doc_id",
        (start / F.col("cap")).cast("int").alias("piece"),
        start.alias("start"),
        F.col("rest").alias("n_tokens"),
    )
    cut = by_lane.where("n > cap").select("*", F.explode(F.sequence(F.lit(0), F.expr("cast(n div cap as int)") - 1)).alias("piece"))
    full = cut.select("limit_id", F.concat(F.lit("d"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("."), F.col("piece").cast("string")).alias("container"), "doc_id", "piece", (F.col("piece") * F.col("cap")).alias("start"), F.col("cap").alias("n_tokens"))
    none = by_lane.where("n <= 0").select("limit_id", F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"))
    return packed.unionByName(full).unionByName(none)


def fill(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, capacity_tokens, n_containers, n_tokens, least_containers, fill_bp) by capacity.

    least_containers is no packing's to beat; fill_bp is the share of the room used, in
    hundredths of a percent.
    """
    used = packed.where("container is not null").groupBy("limit_id", "container").agg(F.sum("n_tokens").alias("n")).groupBy("limit_id").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"))
    room = F.col("n_containers") * F.col("capacity_tokens")
    return used.join(F.broadcast(limits.where("capacity_tokens > 0").distinct()), "limit_id").select(
        "limit_id", "capacity_tokens", "n_containers", "n_tokens", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), F.floor(F.col("n_tokens") * 10000 / room).cast("long").alias("fill_bp")
    )
