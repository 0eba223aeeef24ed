"""Breadth-first reachability over the edges, forward (dependencies) and reverse (impact).

A graph within storage.DRIVER_EDGES is walked on the driver. A larger one goes level by level: the frontier is joined
with the edges, made distinct, and what was visited before is removed by an anti-join; each level is written to the
shared folder, which ends its lineage, and costs one job for the level and one to see whether it is empty. Neither way
builds paths unless they are asked for. Several origins go through one loop, as a column.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..plans import storage
from ..plans.graph import CodeGraph

SCHEMA = "seed string, id string, distance int, path array<string>"


def _walk(links: pa.Table, seeds: list[str], max_depth: int | None, paths: bool, leaves: bool) -> list[tuple]:
    following = defaultdict(list)
    for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True):
        following[a].append(b)
    out = []
    for seed in seeds:
        parent, frontier, distance = {seed: None}, [seed], 0
        while frontier and (max_depth is None or distance < max_depth):
            distance += 1
            level: dict[str, str] = {}
            for a in sorted(frontier):  # the least predecessor becomes the parent
                if leaves and distance > 1 and not a.startswith((ids.FILE, ids.SYMBOL)):
                    continue
                for b in following[a]:
                    if b not in parent:
                        level.setdefault(b, a)
            parent |= level
            frontier = list(level)
            for b in frontier:
                path = None
                if paths:
                    path, at = [b], level[b]
                    while at is not None:
                        path.append(at)
                        at = parent[at]
                    path.reverse()
                out.append((seed, b, distance, path))
    return out


def reach(graph: CodeGraph, seeds: list[str], reverse: bool = False, max_depth: int | None = None, paths: bool = False) -> DataFrame:
    """(seed, id, distance, path): every node that can be reached from a seed, at its least number of hops.

    The seed itself is left out. Forward, an external node is reached but never left (but for a seed). A path goes from
    the seed to the node through the least predecessor at each hop; it is null unless asked for.
    """
    spark, (a, b) = graph.spark, ("dst", "src") if reverse else ("src", "dst")
    links = graph.edges.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    small = storage.if_small(links)
    if small is not None:
        return spark.createDataFrame(_walk(small, seeds, max_depth, paths, not reverse), SCHEMA)
    links = storage.written(links, "links")
    frontier = spark.createDataFrame([(s, s, 0, [s] if paths else None) for s in seeds], SCHEMA)
    levels = [storage.written(frontier, "level")]
    distance = 0
    while max_depth is None or distance < max_depth:
        distance += 1
        front = levels[-1] if reverse or distance == 1 else levels[-1].where(ids.node_kind(F.col("id")) != "external")
        step = front.select("seed", F.col("id").alias("a"), "path").join(links, "a")
        path = F.concat(F.min_by("path", "a"), F.array("b")) if paths else F.lit(None).cast("array<string>")
        found = step.groupBy("seed", "b").agg(path.alias("path")).select("seed", F.col("b").alias("id"), F.lit(distance).alias("distance"), "path")
        for level in levels:
            found = found.join(level.select("seed", "id"), ["seed", "id"], "left_anti")
        found = storage.written(found.select("seed", "id", "distance", "path"), "level")
        if found.isEmpty():
            break
        levels.append(found)
        if len(levels) % 8 == 0:
            # Few tables to be anti-joined, however deep the graph.
            merged = levels[1]
            for level in levels[2:-1]:
                merged = merged.unionByName(level)
            levels = [levels[0], storage.written(merged, "levels"), levels[-1]]
    out = levels[1] if len(levels) > 1 else levels[0].limit(0)
    for level in levels[2:]:
        out = out.unionByName(level)
    return out


def one_hop(graph: CodeGraph, nodes: DataFrame, reverse: bool = False) -> DataFrame:
    """(id, neighbour) for nodes (id): distinct next nodes."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return graph.edges.select(F.col(a).alias("id"), F.col(b).alias("neighbour")).join(nodes.select("id"), "id", "left_semi").distinct()


def roll_up(reached: DataFrame) -> DataFrame:
    """Reached symbols also as their files: (seed, id, distance, path, rolled_up) with a file at the least distance.

    A file is marked if it wasn't reached itself, or if one of its symbols was reached at a smaller distance; it then
    has no path. The seed's own file may turn up in this way.
    """
    direct = reached.select("seed", "id", "distance", "path")
    of = direct.select("seed", ids.containing_file(F.col("id")).alias("id"), "distance").where("id IS NOT NULL").groupBy("seed", "id").agg(F.min("distance").alias("near"))
    both = direct.join(of, ["seed", "id"], "full_outer")
    rolled = F.col("near").isNotNull() & (F.col("distance").isNull() | (F.col("near") < F.col("distance")))
    return both.select(
        "seed", "id", F.least("distance", "near").alias("distance"), F.when(~rolled | F.col("distance").isNotNull(), F.col("path")).alias("path"), rolled.alias("rolled_up")
    )
