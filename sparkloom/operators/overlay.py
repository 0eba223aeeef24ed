"""A base graph with per-worktree overlays of whole files.

An overlay is an append-only log: rows (worktree_id, owner_file, seq, deleted), and nodes and edges with the same
worktree_id, owner_file and seq. The latest entry of a file wins (deleted null: the file is as in the base again); composing replaces the base slice of every file that
the log names by that entry's slice (nothing, if it is deleted). All of it is anti-joins, unions and one aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.graph import EDGE, NODE, CodeGraph, conform

KEY = ("worktree_id", "owner_file", "seq")


@dataclass(frozen=True)
class Overlay:
    files: DataFrame  # worktree_id, owner_file, seq, deleted
    nodes: DataFrame  # schema NODE, worktree_id, seq
    edges: DataFrame  # schema EDGE, worktree_id, seq

    def latest(self) -> DataFrame:
        """(worktree_id, owner_file, seq, deleted): the last entry of each file that the overlay covers."""
        last = self.files.groupBy("worktree_id", "owner_file").agg(F.max("seq").alias("seq"), F.max_by("deleted", "seq").alias("deleted"))
        return last.where("deleted IS NOT NULL")

    def of(self, worktree: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Latest entries, nodes and edges of one worktree."""
        last = self.latest().where(F.col("worktree_id") == worktree)
        live = last.where("NOT deleted").select(*KEY)
        own = [conform(x.join(live, list(KEY), "left_semi"), s) for x, s in ((self.nodes, NODE), (self.edges, EDGE))]
        return last, *own

    def append(self, files: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Overlay:
        add = lambda a, b: a if b is None else a.unionByName(b, allowMissingColumns=True)
        return Overlay(add(self.files, files), add(self.nodes, nodes), add(self.edges, edges))

    def without(self, worktree: str) -> Overlay:
        return Overlay(*(x.where(F.col("worktree_id") != worktree) for x in (self.files, self.nodes, self.edges)))


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest order."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def missing_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes for ends of edges that have none: external, labelled by their id."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return conform(ends.select("id", F.lit("external").alias("kind"), F.col("id").alias("name")), NODE)


def between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are nodes."""
    own = nodes.select("id")
    return edges.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def without_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose owner_file isn't among files (owner_file); rows that no file owns stay."""
    return rows.join(files.select("owner_file").distinct(), "owner_file", "left_anti").select(*rows.columns)


def last_of_each(edges: DataFrame) -> DataFrame:
    """One edge for each (src, kind, dst): the one whose other columns come last, whatever the rows' order."""
    key = ["src", "kind", "dst"]
    rest = [c for c in edges.columns if c not in key]
    return edges.groupBy(*key).agg(F.max(F.struct(*rest)).alias("rest")).select(*key, "rest.*").select(*edges.columns)


def compose(base: CodeGraph, overlay: Overlay, worktree: str, drop_inbound: bool = False, slices: bool = False) -> CodeGraph:
    """The worktree's graph. With `slices` it is just the union of the files' slices: every edge of a slice stays, also
    without its ends, and no node is made up. Else base edges stay if both ends exist afterwards, also into a replaced file (drop_inbound
    removes those, as if edges were tested before the overlay's nodes are there); ends that only overlay edges have
    become external nodes."""
    last, nodes, edges = overlay.of(worktree)
    kept = without_files(base.nodes, last)
    all_nodes = kept.join(nodes.select("id"), "id", "left_anti").select(*NODE.names).unionByName(nodes)
    if slices:
        return CodeGraph(all_nodes, last_of_each(without_files(base.edges, last).unionByName(edges)))
    all_nodes = all_nodes.unionByName(missing_ends(all_nodes, edges))
    old = between(without_files(base.edges, last), kept if drop_inbound else all_nodes)
    key = ["src", "kind", "dst"]
    both = old.join(edges.select(*key), key, "left_anti").select(*EDGE.names).unionByName(edges)
    return CodeGraph(all_nodes, last_of_each(both))


def apply_slice(base: CodeGraph, nodes: DataFrame, edges: DataFrame) -> CodeGraph:
    """The base with the files that own `nodes` replaced: old slices go, then nodes, missing ends and edges come."""
    files = nodes.select("owner_file").union(edges.select("owner_file")).distinct()
    nodes, edges = conform(nodes, NODE), conform(edges, EDGE)
    kept = without_files(base.nodes, files).join(nodes.select("id"), "id", "left_anti").select(*NODE.names).unionByName(nodes)
    kept = kept.unionByName(missing_ends(kept, edges))
    key = ["src", "kind", "dst"]
    old = between(without_files(base.edges, files), kept).join(edges.select(*key), key, "left_anti").select(*EDGE.names)
    return CodeGraph(kept, last_of_each(old.unionByName(edges)))


def remove_slice(base: CodeGraph, files: DataFrame) -> CodeGraph:
    """The base without the files (owner_file): their nodes, their edges, and others' edges into them."""
    nodes = without_files(base.nodes, files)
    return CodeGraph(nodes, between(without_files(base.edges, files), nodes))


def to_slice(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analyzer rows with the file that owns them; plural edge kinds become singular."""
    owner = F.coalesce("file", F.when(F.col("kind") == "file", ids.file_path(F.col("id"))))
    kind = F.when(F.col("kind").isin("imports", "references"), F.expr("left(kind, length(kind) - 1)")).otherwise(F.col("kind"))
    return nodes.withColumn("owner_file", owner), edges.withColumn("kind", kind).withColumn("owner_file", ids.file_path(F.col("src")))
