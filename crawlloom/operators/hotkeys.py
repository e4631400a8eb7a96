"""Per-key results when a few keys hold most records (p6).

Method: fragment-replicate by estimated load. Loads come from counts combined before the
shuffle; keys above a share of one task are cut into proportionate shards, the rest falls
into a fixed number of buckets; shards and buckets are bin-packed to tasks, largest first;
each row goes straight to its task, and rows of the matching side only to the tasks that
hold a shard of their key.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlloom.session import parallelism, stage
from crawlloom.skew import url_key

BUCKETS_PER_TASK = 8


def plan_tasks(loads: DataFrame, key: str, tasks: int) -> tuple[DataFrame, DataFrame, int]:
    """(shards, buckets, rows): where each shard of a large key and each bucket of small keys goes.

    ``loads`` has (key, load); the key is a number. A key is large if it holds over a quarter
    of a task's even share, so there are at most 4 * tasks of them, and 8 * tasks buckets:
    what reaches the driver is bounded by the number of tasks, not by the data.
    """
    spark = loads.sparkSession
    total = loads.agg(F.coalesce(F.sum("load"), F.lit(0)).alias("n")).first()["n"]
    piece = max(1, total // (4 * tasks))
    n_buckets = BUCKETS_PER_TASK * tasks
    large: dict = {}
    for r in loads.where(F.col("load") > piece).select(key, "load").collect():
        large[r[key]] = large.get(r[key], 0) + int(r["load"])
    rest = loads.where(F.col("load") <= piece).groupBy(F.pmod(F.col(key), F.lit(n_buckets)).alias("b")).agg(F.sum("load").alias("n"))
    small = {int(r["b"]): int(r["n"]) for r in rest.collect()}
    items: list[tuple[int, tuple]] = [(small.get(b, 0), (b,)) for b in range(n_buckets)]
    for k, n in large.items():
        shards = -(-n // piece)
        items += [(n // shards, (k, s, shards)) for s in range(shards)]
    heap = [(0, t) for t in range(tasks)]
    shards_at, buckets_at = [], []
    for load, what in sorted(items, key=lambda x: (-x[0], x[1])):
        n, t = heapq.heappop(heap)
        heapq.heappush(heap, (n + load, t))
        if len(what) == 3:
            shards_at.append((what[0], what[1], what[2], t))
        else:
            buckets_at.append((what[0], t))
    a = spark.createDataFrame(shards_at, f"{key} long, _shard int, _shards int, _task int")
    b = spark.createDataFrame(buckets_at, "_bucket long, _task int")
    return a, b, total


def assign(df: DataFrame, key: str, spread_by: list[str], plan: tuple[DataFrame, DataFrame, int], tasks: int) -> DataFrame:
    """Rows with their ``_shard``, at their task ``_to``; equal (key, spread_by) stay together.

    Both broadcast tables have a number of rows bounded by the number of tasks.
    """
    shards, buckets, _ = plan
    at = F.map_from_entries(F.collect_list(F.struct("_shard", "_task"))).alias("_at")
    marked = df.join(F.broadcast(shards.groupBy(key).agg(F.first("_shards").alias("_shards"), at)), key, "left")
    shard = F.when(F.col("_shards").isNotNull(), F.pmod(F.xxhash64(*spread_by), F.col("_shards")).cast("int")).otherwise(F.lit(-1))
    marked = marked.withColumn("_shard", shard).withColumn("_bucket", F.pmod(F.col(key), F.lit(BUCKETS_PER_TASK * tasks)))
    placed = marked.join(F.broadcast(buckets), "_bucket", "left")
    task = F.when(F.col("_shard") >= 0, F.col("_at")[F.col("_shard")]).otherwise(F.col("_task"))
    return placed.select(*df.columns, "_shard", task.alias("_to")).repartitionById(tasks, F.col("_to"))


def replicate(df: DataFrame, key: str, plan: tuple[DataFrame, DataFrame, int], tasks: int) -> DataFrame:
    """The matching side: one row for each shard of its key, small keys once, at the same tasks."""
    shards, buckets, _ = plan
    at = F.broadcast(shards.groupBy(key).agg(F.collect_list(F.struct("_shard", "_task")).alias("_places")))
    marked = df.join(at, key, "left").withColumn("_bucket", F.pmod(F.col(key), F.lit(BUCKETS_PER_TASK * tasks))).join(F.broadcast(buckets), "_bucket", "left")
    places = F.coalesce("_places", F.array(F.struct(F.lit(-1).alias("_shard"), F.col("_task"))))
    return marked.withColumn("_place", F.explode(places)).select(*df.columns, F.col("_place._shard").alias("_shard"), F.col("_place._task").alias("_to")).repartitionById(tasks, F.col("_to"))


def target_stats(links: DataFrame, pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """(to_url, n_links, n_nav_links, n_sources, target_status, n_rows) per to_url as found.

    n_rows is the number of all rows of links. target_status is the status of the latest row
    of ``pages`` with that url, the matching side, joined where the shards of the target are.
    A null to_url is a key of its own; null sources count as links, not as sources; a null
    in_navigation counts as false. Repeated rows count as often as they occur.
    """
    tasks = tasks or parallelism(links.sparkSession)
    loads = stage(links.groupBy("to_url").agg(F.count("*").alias("load")).select("to_url", *url_key("to_url"), "load"), "loads")
    plan = plan_tasks(loads, "k1", tasks)
    rows = links.select(*url_key("to_url"), *url_key("from_url", "f"), F.col("from_url").isNotNull().alias("known"), F.coalesce("in_navigation", F.lit(False)).alias("nav"))
    # Rows of one target and source are in one task, so distinct sources add up over shards.
    by_source = assign(rows, "k1", ["f1", "f2"], plan, tasks).groupBy("_to", "k1", "k2", "_shard", "f1", "f2", "known").agg(F.count("*").alias("n"), F.count_if("nav").alias("nav"))
    parts = by_source.groupBy("_to", "k1", "k2", "_shard").agg(F.sum("n").alias("n"), F.sum("nav").alias("nav"), F.count_if("known").alias("sources"))
    target = pages.where("url is not null").groupBy("url").agg(F.max_by("status_code", F.struct("crawled_at", "page_id")).alias("target_status")).select(*url_key("url"), "target_status")
    parts = parts.join(replicate(target, "k1", plan, tasks), ["_to", "k1", "k2", "_shard"], "left")
    done = parts.groupBy("k1", "k2").agg(F.sum("n").alias("n_links"), F.sum("nav").alias("n_nav_links"), F.sum("sources").alias("n_sources"), F.max("target_status").alias("target_status"))
    return done.join(loads.select("to_url", "k1", "k2"), ["k1", "k2"]).select("to_url", "n_links", "n_nav_links", "n_sources", "target_status", F.lit(plan[2]).cast("long").alias("n_rows"))
