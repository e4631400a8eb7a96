"""Parent-child links to full hierarchies (p5).

Method: range-partition the nodes, contract the parent chains inside each partition to
(exit, steps), keep only the nodes that some chain exits to (the quotient forest), solve
that the same way with fewer partitions until it fits one, then expand outwards again.
Addresses of a site sort together, so most links are local, and a range partitioner cuts a
site that holds a large share into several partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlloom.session import parallelism, stage
from crawlloom.skew import hot_keys, salted

#: Nodes that one task may contract in memory (about 200 bytes each).
NODES_PER_TASK = 200_000
#: Ranges that the first level is cut into however few the nodes are, as far as there are cores.
MOST_LOCAL = 64
SOLVED = "node string, root string, depth long, path array<string>, looped boolean"


def _contract(with_path: bool):
    """mapInPandas body: parent chains of one partition to their exits.

    State of a node: (exit, steps, path, kind); kind 0 ends at a node outside the partition,
    1 ends at a root inside, 2 runs into a cycle inside. An edge may already stand for
    several steps (``steps``, ``path`` of the levels below)."""

    def body(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}
        for b in batches:
            paths = b["path"] if with_path else [None] * len(b)
            for node, up, steps, path in zip(b["node"], b["parent"], b["steps"], paths):
                parent[node] = (up, int(steps), list(path) if path is not None else [])
        done: dict = {}
        for start in parent:
            trail, x = [], start
            at: dict = {}
            while x in parent and x not in done and x not in at:
                at[x] = len(trail)
                trail.append(x)
                x = parent[x][0]
                if x is None:
                    break
            if x is None:
                done[trail[-1]] = (trail[-1], 0, [], 1)
                trail.pop()
            elif x in at:
                for y in trail:
                    done[y] = (None, -1, [], 2)
                trail = []
            for y in reversed(trail):
                up, steps, path = parent[y]
                if up in done:
                    end, more, rest, kind = done[up]
                    done[y] = (None, -1, [], 2) if kind == 2 else (end, steps + more, path + rest if with_path else [], kind)
                else:
                    done[y] = (up, steps, path, 0)
        size = 50_000
        items = list(done.items())
        for i in range(0, len(items), size):
            cut = items[i : i + size]
            yield pd.DataFrame(
                {
                    "node": [k for k, _ in cut],
                    "exit": [v[0] for _, v in cut],
                    "steps": [v[1] for _, v in cut],
                    "path": [v[2] for _, v in cut],
                    "kind": [v[3] for _, v in cut],
                }
            )

    return body


FRAGMENT = "node string, exit string, steps long, path array<string>, kind int"


def contract(edges: DataFrame, parts: int, with_path: bool) -> DataFrame:
    """One level: (node, exit, steps, path, kind) of chains inside ``parts`` ranges of nodes."""
    spread = edges.repartitionByRange(parts, "node") if parts > 1 else edges.repartition(1)
    return spread.mapInPandas(_contract(with_path), FRAGMENT)


def _doubled(edges: DataFrame, with_path: bool) -> DataFrame:
    """Pointer doubling, the way out where a level hardly shrinks: chains halve each round,
    and what is unfinished after log2(nodes) rounds lies on, or leads into, a cycle."""
    now = stage(edges.select("node", F.col("parent").alias("exit"), "steps", "path"), "doubling")
    for _ in range(max(1, now.count()).bit_length() + 1):
        a, b = now.alias("a"), now.alias("b")
        moved = F.col("b.exit").isNotNull()
        after = a.join(b, F.col("a.exit") == F.col("b.node"), "left").select(
            "a.node",
            F.when(moved, F.col("b.exit")).otherwise(F.col("a.exit")).alias("exit"),
            F.when(moved, F.col("a.steps") + F.col("b.steps")).otherwise(F.col("a.steps")).alias("steps"),
            (F.when(moved, F.concat("a.path", "b.path")).otherwise(F.col("a.path")) if with_path else F.col("a.path")).alias("path"),
            moved.alias("moved"),
        )
        now = stage(after, "doubling")
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    inner = now.select(F.col("node").alias("n"), F.col("exit").alias("up"))
    looped = now.join(inner.where("up is not null"), F.col("exit") == F.col("n"), "left")
    unfinished = F.col("n").isNotNull()
    return looped.select(
        "node",
        F.when(unfinished, F.lit(None)).otherwise(F.coalesce("exit", "node")).alias("root"),
        F.when(unfinished, F.lit(-1)).otherwise(F.when(F.col("exit").isNull(), F.lit(0)).otherwise(F.col("steps"))).cast("long").alias("depth"),
        F.when(unfinished, F.array().cast("array<string>")).otherwise(F.col("path")).alias("path"),
        unfinished.alias("looped"),
    )


def solve_forest(edges: DataFrame, with_path: bool = True, nodes_per_task: int = NODES_PER_TASK, level: int = 0, before: int | None = None) -> DataFrame:
    """(node, root, depth, path, looped) for edges (node, parent, steps, path).

    ``path`` has the nodes above, nearest first, up to the root. Each node occurs once; a
    parent that isn't a node is a root outside the table. Cycles, and what leads into them,
    have looped = true, no root, depth -1 and an empty path.
    """
    count = edges.count()
    if level and before and count > 0.75 * before and count > nodes_per_task:
        return _doubled(edges, with_path)
    parts = max(1, -(-count // nodes_per_task), 0 if level else min(parallelism(edges.sparkSession), MOST_LOCAL))
    fragments = stage(contract(edges, parts, with_path), f"fragments{level}")
    settled = fragments.select(
        "node",
        F.when(F.col("kind") == 2, F.lit(None)).otherwise(F.col("exit")).alias("root"),
        F.col("steps").alias("depth"),
        "path",
        (F.col("kind") == 2).alias("looped"),
        "kind",
    )
    if parts == 1:
        return settled.drop("kind")
    leaving = fragments.where("kind = 0")
    exits = leaving.select(F.col("exit").alias("node")).distinct()
    # What ends in a cycle inside its range stays one step above itself, so that chains from
    # other ranges that lead there are told as cycles; what ends at a root keeps that root.
    up = F.when(F.col("kind") == 2, F.col("node")).when((F.col("kind") == 0) | (F.col("steps") > 0), F.col("exit"))
    quotient = stage(exits.join(fragments, "node").select("node", up.alias("parent"), "steps", "path"), f"quotient{level}")
    known = stage(solve_forest(quotient, with_path, nodes_per_task, level + 1, count), f"upper{level}")
    above = known.select(F.col("node").alias("exit"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"), F.col("path").alias("up_path"), F.col("looped").alias("up_looped"))
    a, b = salted(leaving.drop("kind"), above, ["exit"], hot_keys(leaving, ["exit"]), "node")
    joined = a.join(b, ["exit", "_salt"], "left")
    looped = F.coalesce("up_looped", F.lit(False))
    outer = joined.select(
        "node",
        F.when(looped, F.lit(None)).otherwise(F.coalesce("up_root", "exit")).alias("root"),
        F.when(looped, F.lit(-1)).otherwise(F.col("steps") + F.coalesce("up_depth", F.lit(0))).cast("long").alias("depth"),
        F.when(looped, F.array().cast("array<string>")).otherwise(F.concat("path", F.coalesce("up_path", F.array().cast("array<string>")))).alias("path"),
        looped.alias("looped"),
    )
    return outer.unionByName(settled.where("kind > 0").drop("kind"))


def hierarchy(parents: DataFrame, with_path: bool = True, nodes_per_task: int = NODES_PER_TASK) -> DataFrame:
    """Hierarchy of (url, parent): one row per url with root, depth, path and looped.

    A null parent makes a root (depth 0, its own root). Only nodes with a parent take part
    in the contraction; a root is where their chains end.
    """
    inner = parents.where("parent is not null").select(
        F.col("url").alias("node"), "parent", F.lit(1).cast("long").alias("steps"), (F.array("parent") if with_path else F.array().cast("array<string>")).alias("path")
    )
    solved = solve_forest(stage(inner, "nodes"), with_path, nodes_per_task)
    roots = parents.where("parent is null").select(F.col("url").alias("node"), F.col("url").alias("root"), F.lit(0).cast("long").alias("depth"), F.array().cast("array<string>").alias("path"), F.lit(False).alias("looped"))
    return solved.unionByName(roots)


def descendants(solved: DataFrame) -> DataFrame:
    """(url, descendant, distance): every node below every other, one row each, so that a
    root above a third of all nodes isn't gathered into one row or task."""
    return solved.where("not looped").select(F.posexplode("path").alias("pos", "url"), F.col("node").alias("descendant")).select("url", "descendant", (F.col("pos") + 1).cast("long").alias("distance"))
