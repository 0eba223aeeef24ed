"""From what a user names to a node: by id, by path or path suffix, by path and symbol."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.graph import CodeGraph


@dataclass(frozen=True)
class Resolved:
    """One id; or several candidates, in order; or neither."""

    id: str | None = None
    candidates: list[str] = field(default_factory=list)

    @property
    def found(self) -> bool:
        return self.id is not None


def parse(target: str | dict) -> dict:
    """{node_id} or {path} or {path, symbol} of a target given as a string or in one of these forms."""
    if isinstance(target, dict):
        return {k: v for k, v in target.items() if v is not None}
    if target.startswith((ids.FILE, ids.SYMBOL, ids.EXTERNAL)):
        return {"node_id": target}
    path, mark, symbol = target.rpartition("#")
    return {"path": path, "symbol": symbol} if mark and path else {"path": target}


def _choice(rows: list) -> Resolved:
    found = sorted({r.id for r in rows})
    return Resolved(found[0]) if len(found) == 1 else Resolved(candidates=found)


def _path(graph: CodeGraph, path: str) -> Resolved:
    exact = f"{ids.FILE}{path}"
    want = path.replace("\\", "/")
    own = ids.slashes(F.substring("id", 6, 1 << 30))
    near = graph.nodes.where(F.col("id").startswith(ids.FILE) & ((F.col("id") == exact) | (own == want) | own.endswith(f"/{want}"))).select("id").collect()
    return Resolved(exact) if any(r.id == exact for r in near) else _choice(near)


def resolve(graph: CodeGraph, target: str | dict) -> Resolved:
    """One scan for each of file and symbol; equality and prefixes reach a Parquet scan as pushed filters."""
    t = parse(target)
    if "node_id" in t:
        rows = graph.nodes.where(F.col("id") == t["node_id"]).select("id").limit(1).collect()
        return Resolved(rows[0].id) if rows else Resolved()
    file = _path(graph, t["path"])
    if "symbol" not in t or not file.found:
        return file
    exact = f"{ids.SYMBOL}{file.id[len(ids.FILE) :]}#{t['symbol']}"
    rows = graph.nodes.where(F.col("id").startswith(exact)).select("id").collect()
    return Resolved(exact) if any(r.id == exact for r in rows) else _choice(rows)


def resolve_paths(graph: CodeGraph, targets: DataFrame) -> DataFrame:
    """Batch form for targets (path): path, id, candidates, as one join per suffix of the files' paths.

    A file of depth d is offered under d suffixes, so the join is on equality and takes any number of targets.
    """
    files = graph.nodes.where(F.col("id").startswith(ids.FILE)).select("id", ids.slashes(F.substring("id", 6, 1 << 30)).alias("own"))
    parts = F.split("own", "/")
    suffix = files.select("id", "own", F.posexplode(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts) - i), "/"))).alias("cut", "suffix"))
    want = targets.select("path", ids.slashes(F.col("path")).alias("suffix")).distinct()
    hits = want.join(suffix, "suffix", "left").groupBy("path").agg(
        F.max(F.when(F.col("cut") == 0, F.col("id"))).alias("exact"), F.count("id").alias("n"), F.min("id").alias("least"), F.sort_array(F.collect_set("id")).alias("all")
    )
    one = F.coalesce("exact", F.when(F.col("n") == 1, F.col("least")))
    return hits.select("path", one.alias("id"), F.when(one.isNull(), F.col("all")).otherwise(F.array().cast("array<string>")).alias("candidates"))
