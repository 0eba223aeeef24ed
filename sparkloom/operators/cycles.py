"""Cyclic groups: strongly connected components, their stable ids, and one example cycle each.

Components of a graph within storage.DRIVER_EDGES are found on the driver by an iterative depth-first search. In a
larger one, nodes without way in or out are trimmed again and again, then each node takes the greatest id that reaches
it (a colour), and what reaches the colour's own node within the colour is a component; components leave and the rest
goes on. Every step is a join and a partial aggregate on narrow rows, written to the shared folder.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans import storage
from ..plans.graph import CodeGraph
from . import traverse

GROUPS, GROUP_SIZE = 500, 50
#: Members up to which a group's links meet in one task for its example.
TOGETHER = 300_000
SCHEMA = "id string, root string"


def strong_components(following: dict[str, list[str]]) -> Iterator[list[str]]:
    """Components of a graph given by sorted successors; the stack is a list, so depth is no limit."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    waiting: list[str] = []
    inside: set[str] = set()
    for start in sorted(following):
        if start in number:
            continue
        work = [(start, iter(following[start]))]
        number[start] = low[start] = len(number)
        waiting.append(start)
        inside.add(start)
        while work:
            node, rest = work[-1]
            for after in rest:
                if after not in number:
                    number[after] = low[after] = len(number)
                    waiting.append(after)
                    inside.add(after)
                    work.append((after, iter(following.get(after, ()))))
                    break
                if after in inside:
                    low[node] = min(low[node], number[after])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    cut = waiting.index(node) if len(waiting) < 64 else _last(waiting, node)
                    found = waiting[cut:]
                    del waiting[cut:]
                    inside.difference_update(found)
                    yield found


def _last(items: list[str], item: str) -> int:
    at = len(items) - 1
    while items[at] != item:
        at -= 1
    return at


def example_cycle(members: list[str], following: dict[str, list[str]]) -> list[str]:
    """A cycle from the least member back to it, depth first over sorted successors; [a, a] for a self-loop."""
    start = min(members)
    if len(members) == 1:
        return [start, start]
    group, seen, path = set(members), {start}, [start]
    work = [iter(sorted(x for x in following.get(start, ()) if x in group))]
    while work:
        for after in work[-1]:
            if after == start and path[-1] != start:
                return [*path, start]
            if after not in seen:
                seen.add(after)
                path.append(after)
                work.append(iter(sorted(x for x in following.get(after, ()) if x in group)))
                break
        else:
            work.pop()
            path.pop()
    return []


def _fixpoint(label: DataFrame, links: DataFrame) -> DataFrame:
    """Propagates (id, colour) along links (a, b) until each node has the greatest colour that reaches it."""
    before = None
    while True:
        sent = links.join(label.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id"), "colour")
        label = storage.written(label.unionByName(sent).groupBy("id").agg(F.max("colour").alias("colour")), "colours")
        now = label.agg(F.sum(F.xxhash64("id", "colour").cast("decimal(20,0)"))).first()[0]
        if now == before:
            return label
        before = now


def _components_by_colour(links: DataFrame) -> DataFrame:
    """Components of more than one node, level by level in the cluster: (id, root), root the least member."""
    out, edges = None, storage.written(links.where("a <> b"), "scc")
    while True:
        size = None
        while True:  # trim
            ends = edges.select("a").intersect(edges.select(F.col("b").alias("a")))
            edges = edges.join(ends, "a", "left_semi").join(ends.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
            edges = storage.written(edges, "scc")
            n = edges.count()
            if n == size:
                break
            size = n
        if not n:
            break
        label = _fixpoint(edges.select(F.col("a").alias("id")).distinct().withColumn("colour", F.col("id")), edges)
        of_a, of_b = (label.select(F.col("id").alias(x), F.col("colour").alias(f"c{x}")) for x in "ab")
        same = storage.written(edges.join(of_a, "a").join(of_b, "b").where("ca = cb").select("a", "b", F.col("ca").alias("colour")), "scc")
        # Backwards from each colour's own node.
        found = storage.written(label.where("id = colour"), "scc")
        while True:
            back = same.join(found.select(F.col("id").alias("b"), "colour"), ["b", "colour"]).select(F.col("a").alias("id"), "colour")
            more = storage.written(back.distinct().join(found, ["id", "colour"], "left_anti"), "scc")
            if more.isEmpty():
                break
            found = storage.written(found.unionByName(more), "scc")
        least = found.groupBy("colour").agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("n"))
        part = found.join(least.where("n > 1"), "colour").select("id", "root")
        out = part if out is None else out.unionByName(part)
        gone = found.select("id")
        edges = edges.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        edges = storage.written(edges, "scc")
    return out if out is not None else links.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)


def candidates(graph: CodeGraph, granularity: str = "module", scope: str | None = None) -> DataFrame:
    """Distinct links (a, b) between nodes that cycles are looked for among: files, or files and symbols, in scope."""
    kinds = ("file",) if granularity == "module" else ("file", "symbol")
    own = graph.nodes.select("id").where(ids.node_kind(F.col("id")).isin(*kinds))
    if scope is not None:
        own = own.where(ids.file_path(F.col("id")).startswith(scope))
    links = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return links.join(own.withColumnRenamed("id", "a"), "a", "left_semi").join(own.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")


def members(links: DataFrame) -> DataFrame:
    """(id, root, self_loop) of the nodes of cyclic groups: more than one node, or one with a link to itself."""
    spark = links.sparkSession
    small = storage.if_small(links)
    if small is not None:
        following: dict[str, list[str]] = defaultdict(list)
        for a, b in sorted(zip(small["a"].to_pylist(), small["b"].to_pylist(), strict=True)):
            following[a].append(b)
        found = [sorted(c) for c in strong_components(following)]
        rows = [(x, c[0]) for c in found if len(c) > 1 or c[0] in following[c[0]] for x in c]
        return spark.createDataFrame(rows, SCHEMA)
    groups = _components_by_colour(links)
    alone = links.where("a = b").select(F.col("a").alias("id")).join(groups, "id", "left_anti")
    return groups.unionByName(alone.withColumn("root", F.col("id")))


def detect_cycles(graph: CodeGraph, granularity: str = "module", scope: str | None = None, group_size: int = GROUP_SIZE, groups: int = GROUPS, examples: bool = True) -> DataFrame:
    """(rank, id, size, nodes, example, truncated, total_groups): largest groups first, then by least node.

    nodes are cut to group_size, groups to `groups`; size and total_groups are whole counts. A component's ids meet in
    one row, for its hash and its list; its links meet in one task for the example, up to TOGETHER members.
    """
    links = candidates(graph, granularity, scope).persist()
    try:
        own = storage.written(members(links), "cycles")
        if examples:
            inside = links.join(own.select(F.col("id").alias("a"), F.col("root").alias("root")), "a").join(own.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b").where("root = rb")

            def example(rows: pd.DataFrame) -> pd.DataFrame:
                following = rows.groupby("a")["b"].apply(list).to_dict()
                return pd.DataFrame([{"root": rows["root"].iloc[0], "example": example_cycle(sorted(set(rows["a"])), following)}])

            inside = storage.written(inside.select("a", "b", "root"), "inside")
            # Few groups are this large; theirs is the shortest cycle through the least node, found level by level.
            large = [r.root for r in own.groupBy("root").count().where(F.col("count") > TOGETHER).select("root").collect()]
            rows = inside.where(~F.col("root").isin(large)) if large else inside
            shown = rows.groupBy("root").applyInPandas(example, "root string, example array<string>")
            for root in large:
                shown = shown.unionByName(_shortest_cycle(graph, inside.where(F.col("root") == root), root))
            shown = storage.written(shown, "examples")
    finally:
        links.unpersist()
    each = own.groupBy("root").agg(F.sort_array(F.collect_list("id")).alias("all"))
    each = each.select("root", ids.group_hash(F.col("all")).alias("id"), F.size("all").alias("size"), F.slice("all", 1, group_size).alias("nodes"))
    each = each.withColumn("truncated", F.col("size") > group_size)
    order = Window.orderBy(F.desc("size"), "root")  # one row per group
    each = each.withColumn("rank", F.row_number().over(order)).withColumn("total_groups", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).where(F.col("rank") <= groups)
    each = each.join(shown, "root") if examples else each.withColumn("example", F.lit(None).cast("array<string>"))
    return each.select("rank", "id", "size", "nodes", "example", "truncated", "total_groups")


def _shortest_cycle(graph: CodeGraph, links: DataFrame, root: str) -> DataFrame:
    edges = links.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    reached = traverse.reach(CodeGraph(graph.nodes, edges), [root], paths=True)
    back = edges.where(F.col("dst") == root).select(F.col("src").alias("id"))
    last = reached.join(back, "id").orderBy("distance", "id").limit(1)
    return last.select(F.lit(root).alias("root"), F.concat("path", F.array(F.lit(root))).alias("example"))


def cycle_count(graph: CodeGraph) -> int:
    """Groups of more than one file that import each other."""
    links = graph.edges.where("kind = 'import'").select(F.col("src").alias("a"), F.col("dst").alias("b")).where(F.col("a").startswith(ids.FILE) & F.col("b").startswith(ids.FILE)).distinct()
    return members(links.where("a <> b")).select("root").distinct().count()
