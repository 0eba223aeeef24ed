"""k shortest simple paths between two nodes, in order of length and then of their ids.

Paths grow a hop per level; a level is finished before its hits are ranked, so the order is total. A budget bounds how
many paths are ever extended, and the result says if it ran out. Small graphs are searched on the driver, larger ones
by a join of the paths with the links at each level.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import storage
from ..plans.graph import CodeGraph

BUDGET, MOST = 50_000, 20


def directed(graph: CodeGraph, direction: str) -> DataFrame:
    """Distinct links (a, b) to follow: forward, reverse, or any."""
    forward = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    reverse = graph.edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"forward": forward, "reverse": reverse, "any": forward.unionByName(reverse)}[direction].distinct()


def _on_driver(links, start: str, goal: str, k: int, max_depth: int | None, budget: int) -> tuple[list[list[str]], bool]:
    following = defaultdict(list)
    for a, b in sorted(zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True)):
        following[a].append(b)
    hits, level, spent = [], [[start]], 0
    while level and len(hits) < k and (max_depth is None or len(level[0]) <= max_depth):
        more, room = [], budget - spent
        for path in level[:room]:
            for b in following[path[-1]]:
                if b not in path:
                    (hits if b == goal else more).append([*path, b])
        spent += min(len(level), room)
        if len(level) > room:
            return sorted(hits, key=lambda p: (len(p), p))[:k], len(hits) < k
        level = sorted(more)
    return sorted(hits, key=lambda p: (len(p), p))[:k], False


def shortest(graph: CodeGraph, start: str, goal: str, k: int = 1, direction: str = "forward", max_depth: int | None = None, budget: int = BUDGET) -> tuple[DataFrame, bool]:
    """(rank, path) of the k first paths, and whether the budget ended the search before there were k."""
    spark, links = graph.spark, directed(graph, direction)
    small = storage.if_small(links)
    schema = "rank int, path array<string>"
    if small is not None:
        found, truncated = _on_driver(small, start, goal, k, max_depth, budget)
        return spark.createDataFrame([(i + 1, p) for i, p in enumerate(found)], schema), truncated
    links = storage.written(links, "links")
    level = spark.createDataFrame([([start],)], "path array<string>")
    hits: list[list[str]] = []
    spent = depth = 0
    truncated = False
    while len(hits) < k and (max_depth is None or depth < max_depth) and not truncated:
        depth += 1
        width = level.count()
        if not width:
            break
        if spent + width > budget:
            level, truncated = level.orderBy("path").limit(budget - spent), True
        spent += width
        step = level.join(links, F.element_at("path", -1) == F.col("a")).where(~F.expr("array_contains(path, b)"))
        grown = storage.written(step.select(F.concat("path", F.array("b")).alias("path"), (F.col("b") == goal).alias("hit")), "paths")
        hits += [r.path for r in grown.where("hit").orderBy("path").limit(k - len(hits)).select("path").collect()]
        level = grown.where("NOT hit").select("path")
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(hits[:k])], schema), truncated and len(hits) < k


def path_edges(graph: CodeGraph, paths: DataFrame, direction: str = "forward") -> DataFrame:
    """(rank, step, src, dst, kind, target_type, loc): of each hop the edge of the least kind between its two nodes,
    in the direction that it has; an import between files if there is none."""
    hop = paths.select("rank", F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> named_struct('a', path[i - 1], 'b', path[i]))")).alias("step", "h")).select("rank", "step", "h.a", "h.b")
    edge = F.struct("kind", "target_type", "loc").alias("e")
    best = graph.edges.select("src", "dst", edge).groupBy("src", "dst").agg(F.min("e").alias("e"))
    ahead = best.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("e").alias("ahead"))
    behind = best.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("e").alias("behind"))
    own = hop.join(ahead, ["a", "b"], "left").join(behind, ["a", "b"], "left")
    flip = {"forward": F.lit(False), "reverse": F.lit(True), "any": F.col("ahead").isNull()}[direction]
    e = F.when(flip, F.col("behind")).otherwise(F.col("ahead"))
    return own.select(
        "rank", "step", F.when(flip, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(flip, F.col("a")).otherwise(F.col("b")).alias("dst"),
        F.coalesce(e["kind"], F.lit("import")).alias("kind"), F.coalesce(e["target_type"], F.lit("file")).alias("target_type"), e["loc"].alias("loc"),
    )
