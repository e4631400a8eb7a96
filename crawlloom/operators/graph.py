"""Link graph and redirect chains."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlloom.session import bucketed, stage
from crawlloom.skew import hot_keys

#: Levels of a breadth-first search after which what is known is written as one.
MERGED = 16
#: Rounds of link_score written together.
AT_ONCE = 6


def rounded(c: Column, digits: int) -> Column:
    """Half up on the scaled double: the same in any engine with IEEE arithmetic."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def link_score(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """(url, score, raw, in_degree, out_degree): PageRank of ``nodes`` (url) over ``edges``
    (src, dst): edges once, without self links, between nodes only; the mass of nodes without
    out-links is spread evenly; score is relative to the largest, in hundredths of a percent.

    The ranks are the same as of ``rounds`` power iterations, put together from walks: with A the
    damped transition matrix, v(k) = A v(k-1), v(0) = 1, every iterate is a weighted sum of the
    v(k), and the weights follow from what each v(k) leaves at nodes without out-links. So a round
    is one join and one sum and needs no number from the driver. Edges are written once in buckets
    by source and each v(k) in the same buckets by address: joins stay where the rows lie, and
    only sums by target, combined before, are shuffled. AT_ONCE rounds are one job, in which each
    round's shuffle serves the next round and the result. The few sources that hold large shares of
    the edges would fill their buckets: their edges lie apart, and their values (one a hot source)
    are broadcast. A lost executor costs AT_ONCE rounds of its part.
    """
    nodes = stage(nodes.select("url").where("url is not null").distinct(), "nodes")
    n = nodes.count()
    if n == 0:
        return nodes.select("url", F.lit(0.0).alias("score"), F.lit(0.0).alias("raw"), F.lit(0).cast("long").alias("in_degree"), F.lit(0).cast("long").alias("out_degree"))
    known = nodes.select(F.col("url").alias("k"))
    inside = edges.select("src", "dst").where("src <> dst").distinct()
    inside = stage(inside.join(known, F.col("src") == F.col("k"), "left_semi").join(known, F.col("dst") == F.col("k"), "left_semi"), "edges")
    out = stage(inside.groupBy("src").agg(F.count("*").alias("out_degree")), "out")
    into = inside.groupBy("dst").agg(F.count("*").alias("in_degree"))
    base = bucketed(nodes.join(out, F.col("url") == F.col("src"), "left").join(into, F.col("url") == F.col("dst"), "left").select("url", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree")), "url", "base")
    leads_on = out.select(F.col("src").alias("dst"), F.lit(False).alias("dead"))
    weighed = inside.join(out, "src").join(leads_on, "dst", "left").select("src", "dst", (damping / F.col("out_degree")).alias("w"), F.coalesce("dead", F.lit(True)).alias("dead"))
    hot = hot_keys(inside, ["src"]).select("src")
    hot = stage(hot, "hot") if not hot.isEmpty() else None
    own = bucketed(weighed.join(F.broadcast(hot), "src", "left_anti") if hot is not None else weighed, "src", "edges")
    apart = stage(weighed.join(F.broadcast(hot), "src", "left_semi"), "apart") if hot is not None else None
    now, walks, parts = base.select(F.col("url").alias("src"), F.lit(1.0).alias("v")), [], []
    for k in range(1, rounds + 1):
        sent = own.join(now, "src").select("dst", "dead", (F.col("w") * F.col("v")).alias("v"))
        if hot is not None:
            sent = sent.unionAll(apart.join(F.broadcast(now.join(F.broadcast(hot), "src", "left_semi")), "src").select("dst", "dead", (F.col("w") * F.col("v")).alias("v")))
        walk = sent.groupBy("dst").agg(F.sum("v").alias("v"), F.bool_or("dead").alias("dead"))
        parts.append(walk.select("dst", "v", "dead", F.lit(k).alias("k")))
        if len(parts) == AT_ONCE or k == rounds:
            walks.append(bucketed(reduce(DataFrame.unionAll, parts), "dst", "walks", placed=True))
            walk, parts = walks[-1].where(F.col("k") == k), []
        now = walk.select(F.col("dst").alias("src"), "v")
    every = reduce(DataFrame.unionAll, walks)
    ends = {r["k"]: r["d"] for r in every.where("dead").groupBy("k").agg(F.sum("v").alias("d")).collect()}  # a number a round
    ends[0] = base.where("out_degree = 0").count()
    share, lost = [0.0], [ends[0] / n]  # by round: what every node is given, and what nodes without out-links hold
    for t in range(1, rounds + 1):
        share.append((1 - damping) / n + damping * lost[t - 1] / n)
        lost.append(sum(share[t - k] * ends.get(k, 0.0) for k in range(t)) + ends.get(t, 0.0) / n)
    weight = F.array(*[F.lit(share[rounds - k]) for k in range(rounds)], F.lit(1.0 / n))
    got = every.groupBy("dst").agg(F.sum(F.col("v") * F.get(weight, F.col("k"))).alias("got"))
    first = share[rounds] if rounds else 1.0 / n
    rank = stage(base.join(got, F.col("url") == F.col("dst"), "left").select("url", "in_degree", "out_degree", (F.lit(first) + F.coalesce("got", F.lit(0.0))).alias("pr")), "rank")
    top = F.broadcast(rank.agg(F.max("pr").alias("top")))
    return rank.join(top, F.lit(True)).select("url", rounded(F.col("pr") / F.col("top") * 100, 2).alias("score"), rounded(F.col("pr"), 8).alias("raw"), "in_degree", "out_degree")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(url, depth): breadth-first distance from ``seeds`` (url) over ``edges`` (src, dst), until
    nothing new is found: each round joins the frontier only, and drops what is known by an anti
    join. What is known is staged anew every ``MERGED`` levels, so plans stay small."""
    edges = stage(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "edges")
    frontier = stage(seeds.select("url").distinct().select("url", F.lit(0).alias("depth")), "frontier")
    found = frontier
    for d in count(1):
        nxt = edges.join(frontier.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        frontier = stage(nxt.join(found.select("url"), "url", "left_anti").select("url", F.lit(d).alias("depth")), "frontier")
        if frontier.isEmpty():
            return found
        found = found.unionAll(frontier)
        if d % MERGED == 0:
            found = stage(found, "found")


def redirect_chains(hops: DataFrame) -> DataFrame:
    """(original_url, chain, final_url, n_hops, is_chain, is_loop, n_temporary) of redirect rows
    (original_url, from_url, to_url, status_code) in any order.

    Hops are put in order by following from -> to from the original; rows that don't connect
    come last. A chain has several rows. It loops if it ends where it began, at one of its own
    sources, or leaves one twice. Only 302 is temporary. Chains are a few hops (crawlers stop
    following), so each is folded in one row with higher-order functions.
    """
    g = hops.where("original_url is not null").groupBy("original_url").agg(F.array_sort(F.collect_list(F.struct("from_url", "to_url", "status_code"))).alias("h"))
    at = lambda acc: F.filter(F.col("h"), lambda x: (x["from_url"] == acc["at"]) & ~F.exists(acc["seen"], lambda s: s.eqNullSafe(x)))
    kind = "struct<at:string,seen:array<struct<from_url:string,to_url:string,status_code:int>>>"
    zero = F.struct(F.col("original_url").alias("at"), F.slice("h", 1, 0).alias("seen")).cast(kind)

    def step(acc: Column, _: Column) -> Column:
        nxt = at(acc)
        return F.when(F.size(nxt) > 0, F.struct(nxt[0]["to_url"].alias("at"), F.concat(acc["seen"], F.slice(nxt, 1, 1)).alias("seen"))).otherwise(acc).cast(kind)

    g = g.withColumn("h", F.transform("h", lambda x: F.struct(x["from_url"].alias("from_url"), x["to_url"].alias("to_url"), x["status_code"].cast("int").alias("status_code"))))
    g = g.withColumn("w", F.aggregate("h", zero, step))
    ordered = F.concat(F.col("w.seen"), F.filter("h", lambda x: ~F.array_contains(F.col("w.seen"), x)))
    g = g.withColumn("o", ordered).withColumn("final_url", F.element_at("o", -1)["to_url"])
    froms = F.transform("o", lambda x: x["from_url"])
    loop = (F.col("original_url") == F.col("final_url")) | F.array_contains(froms, F.col("final_url")) | (F.size(F.array_distinct(froms)) < F.size(froms))
    return g.select(
        "original_url",
        F.array_join(F.concat(F.array("original_url"), F.transform("o", lambda x: x["to_url"])), " > ").alias("chain"),
        "final_url",
        F.size("o").alias("n_hops"),
        (F.size("o") > 1).alias("is_chain"),
        loop.alias("is_loop"),
        F.size(F.filter("o", lambda x: x["status_code"] == 302)).alias("n_temporary"),
    )


def protocol_upgrades(hops: DataFrame) -> DataFrame:
    """Distinct hops that only change http to https."""
    return hops.where(F.col("from_url").startswith("http://") & (F.regexp_replace("from_url", "^http://", "https://") == F.col("to_url"))).select("from_url", "to_url").distinct()


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First rows under a total order (take-ordered: each task sends its own first n)."""
    return df.orderBy(*order).limit(n)


def first_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """At most n rows a group; the rank limit is applied before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")
