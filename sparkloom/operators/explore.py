"""Lookup, listing, neighbourhoods, degrees and statistics: declarative plans over nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.graph import CodeGraph


def by_locale(c: Column | str) -> Column:
    """Sort key in the order of a locale-aware comparison."""
    return F.collate(F.col(c) if isinstance(c, str) else c, "UNICODE")


def degrees(graph: CodeGraph) -> DataFrame:
    """(id, in_degree, out_degree) of all nodes that have edges. One shuffle: an edge counts once at either end."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def get_node(graph: CodeGraph, node: str, locations: bool = False) -> DataFrame:
    """The node with its degrees; one row, or none."""
    own = graph.nodes.where(F.col("id") == node)
    ends = graph.edges.where((F.col("src") == node) | (F.col("dst") == node)).agg(
        F.count(F.when(F.col("dst") == node, 1)).alias("in_degree"), F.count(F.when(F.col("src") == node, 1)).alias("out_degree")
    )
    out = own.crossJoin(F.broadcast(ends))  # one row each
    return out.drop("owner_file") if locations else out.drop("owner_file", "loc")


def list_nodes(graph: CodeGraph, prefix: str | None = None, language: str | None = None, kind: str | None = None) -> DataFrame:
    out = graph.nodes
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if language is not None:
        out = out.where(F.col("language") == language)
    if prefix is not None:
        out = out.where(ids.under_prefix(F.col("kind"), F.col("name"), F.col("file"), prefix))
    return out.drop("owner_file")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """`limit` rows from `offset` on: a top-k per partition and a merge, no full sort."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def neighbours(graph: CodeGraph, node: str, direction: str = "both") -> DataFrame:
    """(side, id, edges): next nodes with the edges that join them, in order of kind; a self-loop is on both sides."""
    sides = []
    for side, own, other in (("in", "dst", "src"), ("out", "src", "dst")):
        if direction in (side, "both"):
            sides.append(graph.edges.where(F.col(own) == node).select(F.lit(side).alias("side"), F.col(other).alias("id"), F.struct("kind", "src", "dst", "target_type", "resolution", "type_only", "wildcard", "loc").alias("edge")))
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    grouped = both.groupBy("side", "id").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    return grouped.join(graph.nodes.select("id", F.col("kind").alias("node_kind"), "language", "name", "symbol_kind", "file", "exported"), "id")


def split_limit(rows: DataFrame, limit: int, direction: str = "both") -> DataFrame:
    """rows (side, id, ...) cut to `limit`, with rank in the side and n_in, n_out (both sides' sizes before): for both
    sides half each (the odd one to `in`), and what a side leaves unused goes to the other."""
    order = Window.partitionBy("side").orderBy(by_locale("id"))
    whole = Window.partitionBy(F.lit(0))
    n = {s: F.count(F.when(F.col("side") == s, 1)).over(whole) for s in ("in", "out")}
    half = {"in": limit - limit // 2, "out": limit // 2} if direction == "both" else {s: limit if s == direction else 0 for s in ("in", "out")}
    quota = {s: F.least(n[s], F.lit(half[s]) + F.greatest(F.lit(0), F.lit(half[o]) - n[o])) if direction == "both" else F.lit(half[s]) for s, o in (("in", "out"), ("out", "in"))}
    ranked = rows.withColumn("rank", F.row_number().over(order)).withColumn("quota", F.when(F.col("side") == "in", quota["in"]).otherwise(quota["out"]))
    ranked = ranked.withColumn("n_in", n["in"]).withColumn("n_out", n["out"])
    return ranked.where("rank <= quota").drop("quota")


def kind_counts(graph: CodeGraph) -> DataFrame:
    """files, symbols, externals, nodes, edges: one row."""
    n = graph.nodes.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("file", "symbol", "external")], F.count(F.lit(1)).alias("nodes"))
    return n.crossJoin(F.broadcast(graph.edges.agg(F.count(F.lit(1)).alias("edges"))))


def language_histogram(graph: CodeGraph) -> DataFrame:
    return graph.nodes.where("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


def hotspots(graph: CodeGraph, top: int = 10) -> DataFrame:
    """(id, fan_in): the nodes with most incoming edges; ties by id. Partial counts, then a top-k."""
    counts = graph.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    return counts.orderBy(F.desc("fan_in"), by_locale("id")).limit(top)


def safe_to_change(graph: CodeGraph) -> DataFrame:
    """Ids of nodes that nothing but themselves depends on."""
    used = graph.edges.where("src <> dst").select(F.col("dst").alias("id"))
    return graph.nodes.select("id").join(used, "id", "left_anti")
