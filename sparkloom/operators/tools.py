"""The query tools: validated arguments in, plain records out (dicts that serialise to JSON without null fields).

A tool resolves its targets with one small scan each and answers with a plan of the other modules; what it returns is
bounded by its own limits. Only get_blast_radius raises on a target that isn't found or isn't unique; the others answer
with found: false, and candidates if there are several.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass, fields
from typing import Any

from pyspark.sql import Row
from pyspark.sql import functions as F

from ..functions import ids
from ..plans.graph import CodeGraph
from . import cycles, explore, paths, traverse
from .resolve import Resolved, resolve

BLAST_LIMIT = 2_000


class TargetNotFound(LookupError):
    pass


class AmbiguousTarget(LookupError):
    pass


class InvalidInput(ValueError):
    pass


def plain(value: Any) -> Any:
    """Rows as dicts, without null fields."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items() if v is not None}
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


def to_json(result: Any) -> str:
    return json.dumps(plain(result), ensure_ascii=False, sort_keys=True)


def envelope(result: Any) -> dict:
    """The form that a result is sent in: one content item that holds its JSON text."""
    return {"content": [{"type": "text", "text": to_json(result)}]}


def no_worktree() -> dict:
    return {"error": "no_worktree", "message": "No worktree registered for this session."}


def not_found(r: Resolved) -> dict:
    return {"found": False, "candidates": r.candidates} if r.candidates else {"found": False}


def encode_cursor(offset: int) -> str:
    return base64.urlsafe_b64encode(str(offset).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> int:
    """The offset in a cursor, 0 if it holds none."""
    try:
        text = base64.urlsafe_b64decode((cursor or "") + "=" * (-len(cursor or "") % 4)).decode()
        return max(0, int(text))
    except ValueError:
        return 0


def paginate(items: list, offset: int, limit: int) -> tuple[list, str | None]:
    """A slice and, if more remain, the next offset as decimal text."""
    end = offset + limit
    return items[offset:end], str(end) if end < len(items) else None


def _bounded(name: str, value: int | None, low: int, high: int | None = None) -> None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < low or (high is not None and value > high)):
        raise InvalidInput(f"{name} must be an integer from {low}" + (f" to {high}" if high is not None else ""))


def _one_of(name: str, value: Any, allowed: tuple) -> None:
    if value not in allowed:
        raise InvalidInput(f"{name} must be one of {', '.join(map(str, allowed))}")


@dataclass(frozen=True)
class GetNode:
    target: str | dict
    include_locations: bool = False


@dataclass(frozen=True)
class GetNeighbors:
    target: str | dict
    direction: str = "both"
    include_locations: bool = False
    limit: int = 50

    def __post_init__(self):
        _one_of("direction", self.direction, ("in", "out", "both"))
        _bounded("limit", self.limit, 1, 200)


@dataclass(frozen=True)
class ListNodes:
    path_prefix: str | None = None
    language: str | None = None
    kind: str | None = None
    cursor: str | None = None
    limit: int = 100

    def __post_init__(self):
        _one_of("kind", self.kind, ("file", "symbol", "external", None))
        _bounded("limit", self.limit, 1, 500)


@dataclass(frozen=True)
class GetStats:
    top_n: int = 10

    def __post_init__(self):
        _bounded("top_n", self.top_n, 1, 100)


@dataclass(frozen=True)
class GetDependencies:
    target: str | dict
    depth: int = 1
    limit: int = 500
    include_paths: bool = False

    def __post_init__(self):
        _bounded("depth", self.depth, 1, 10)
        _bounded("limit", self.limit, 1, 5_000)


@dataclass(frozen=True)
class GetBlastRadius:
    target: str | dict
    max_depth: int | None = None
    roll_up: bool = False
    include_paths: bool = False

    def __post_init__(self):
        _bounded("max_depth", self.max_depth, 1)


@dataclass(frozen=True)
class TracePaths:
    from_: str | dict
    to: str | dict
    direction: str = "forward"
    k: int = 1
    max_depth: int | None = None
    include_locations: bool = False

    def __post_init__(self):
        _one_of("direction", self.direction, ("forward", "reverse", "any"))
        _bounded("k", self.k, 1, paths.MOST)
        _bounded("max_depth", self.max_depth, 1)


@dataclass(frozen=True)
class DetectCycles:
    granularity: str = "module"
    scope: str | None = None
    max_group_size: int = cycles.GROUP_SIZE

    def __post_init__(self):
        _one_of("granularity", self.granularity, ("module", "symbol"))
        _bounded("max_group_size", self.max_group_size, 1)


def get_node(graph: CodeGraph, q: GetNode) -> dict:
    r = resolve(graph, q.target)
    if not r.found:
        return not_found(r)
    row = plain(explore.get_node(graph, r.id, q.include_locations).first())
    degrees = {"in": row.pop("in_degree"), "out": row.pop("out_degree")}
    return {"found": True, "node": row, "degree": degrees}


def get_neighbors(graph: CodeGraph, q: GetNeighbors) -> dict:
    r = resolve(graph, q.target)
    if not r.found:
        return not_found(r)
    rows = explore.split_limit(explore.neighbours(graph, r.id, q.direction), q.limit, q.direction)
    sides: dict[str, list] = {"in": [], "out": []}
    whole = 0
    for row in rows.orderBy("rank").collect():  # at most `limit` nodes
        edges = [{k: v for k, v in plain(e).items() if q.include_locations or k != "loc"} for e in row.edges]
        node = {"id": row.id, "kind": row.node_kind, "language": row.language, "name": row.name, "symbol_kind": row.symbol_kind, "file": row.file, "exported": row.exported}
        sides[row.side].append({"node": plain(node), "edges": edges})
        whole = row.n_in + row.n_out
    out = {"found": True, "node_id": r.id, "in_neighbors": sides["in"], "out_neighbors": sides["out"]}
    return out | {"truncated": True} if len(sides["in"]) + len(sides["out"]) < whole else out


def list_nodes(graph: CodeGraph, q: ListNodes) -> dict:
    rows, offset = explore.list_nodes(graph, q.path_prefix, q.language, q.kind), decode_cursor(q.cursor)
    total = rows.count()
    page = explore.page(rows, [explore.by_locale("id"), F.col("id")], offset, q.limit).collect()
    out = {"nodes": [plain(r) for r in page], "total": total}
    return out | {"truncated": True, "cursor": encode_cursor(offset + q.limit)} if offset + q.limit < total else out


def get_stats(graph: CodeGraph, q: GetStats) -> dict:
    n = explore.kind_counts(graph).first()
    if not n.nodes:
        return {"indexed": False, "nodes": {"files": 0, "symbols": 0, "externals": 0}, "edges": 0, "languages": {}, "cycle_count": 0, "hotspots": []}
    return {
        "indexed": True, "nodes": {"files": n.files, "symbols": n.symbols, "externals": n.externals}, "edges": n.edges,
        "languages": {r.language: r.n for r in explore.language_histogram(graph).collect()}, "cycle_count": cycles.cycle_count(graph),
        "hotspots": [plain(r) for r in explore.hotspots(graph, q.top_n).collect()],
    }


def _entries(reached, limit: int, rolled: bool = False) -> list[dict]:
    rows = reached.withColumn("kind", ids.node_kind(F.col("id"))).withColumn("display_name", ids.display_name(F.col("id")))
    out = []
    for r in rows.orderBy("distance", "id").limit(limit).collect():
        e = {"id": r.id, "kind": r.kind, "display_name": r.display_name, "distance": r.distance, "example_path": r.path}
        out.append(plain(e | ({"rolled_up": True} if rolled and r.rolled_up else {})))
    return out


def get_dependencies(graph: CodeGraph, q: GetDependencies) -> dict:
    r = resolve(graph, q.target)
    if not r.found:
        return not_found(r)
    reached = traverse.reach(graph, [r.id], max_depth=q.depth, paths=q.include_paths)
    total = reached.count()
    return {"found": True, "origin": r.id, "dependencies": _entries(reached, q.limit), "truncated": total >= q.limit, "total": total}


def get_blast_radius(graph: CodeGraph, q: GetBlastRadius) -> dict:
    r = resolve(graph, q.target)
    if r.candidates:
        raise AmbiguousTarget(f"{q.target!r} has {len(r.candidates)} matches; give a full node id")
    if not r.found:
        raise TargetNotFound(str(q.target))
    reached = traverse.reach(graph, [r.id], reverse=True, max_depth=q.max_depth, paths=q.include_paths)
    total = reached.count()
    kept = reached.orderBy("distance", "id").limit(BLAST_LIMIT)
    # Rolling up adds files to at most BLAST_LIMIT entries.
    found = _entries(traverse.roll_up(kept), 2 * BLAST_LIMIT, True) if q.roll_up else _entries(kept, BLAST_LIMIT)
    return {"target_id": r.id, "dependents": found, "safe_to_change": not found, "truncated": total >= BLAST_LIMIT, "total": total}


def _node(graph: CodeGraph, node_ids: list[str]) -> dict[str, dict]:
    rows = graph.nodes.where(F.col("id").isin(node_ids)).select("id", "kind", "name").collect()
    return {r.id: {"id": r.id, "kind": r.kind, "name": r.name if r.name is not None else r.id} for r in rows}


def trace_paths(graph: CodeGraph, q: TracePaths) -> dict:
    ends = []
    for target in (q.from_, q.to):
        r = resolve(graph, target)
        if not r.found:
            return not_found(r)
        ends.append(r.id)
    if ends[0] == ends[1]:
        return {"self": True, "node": _node(graph, ends[:1])[ends[0]]}
    found, truncated = paths.shortest(graph, *ends, q.k, q.direction, q.max_depth)
    rows = {r["rank"]: r.path for r in found.collect()}  # at most k
    if not rows:
        return {"found": False}
    nodes = _node(graph, sorted({x for p in rows.values() for x in p}))
    edges: dict[int, list] = {k: [] for k in rows}
    for e in paths.path_edges(graph, found, q.direction).orderBy("rank", "step").collect():
        edge = {"from": e.src, "to": e.dst, "kind": e.kind, "target_type": e.target_type, "loc": e.loc if q.include_locations else None}
        edges[e["rank"]].append(plain(edge))
    out = {"paths": [{"nodes": [nodes[x] for x in rows[k]], "edges": edges[k]} for k in sorted(rows)]}
    return out | {"truncated": True} if truncated else out


def detect_cycles(graph: CodeGraph, q: DetectCycles) -> dict:
    rows = cycles.detect_cycles(graph, q.granularity, q.scope, q.max_group_size).orderBy("rank").collect()
    total = rows[0].total_groups if rows else 0
    groups = [{"id": r.id, "size": r.size, "nodes": r.nodes, "example_cycle_path": r.example, "truncated": r.truncated} for r in rows]
    return {"groups": groups, "truncated": total > cycles.GROUPS, "total_groups": total}


class Toolbox:
    """Tools by name. Registrations made before there is a sink wait for it; sessions choose the graph."""

    def __init__(self):
        self.tools: dict[str, tuple[type, Callable]] = {}
        self._sink: Callable[[str, type, Callable], None] | None = None
        self._waiting: list[str] = []

    def register(self, name: str, arguments: type, handler: Callable) -> None:
        self.tools[name] = (arguments, handler)
        if self._sink:
            self._sink(name, arguments, handler)
        else:
            self._waiting.append(name)

    def connect(self, sink: Callable[[str, type, Callable], None]) -> None:
        self._sink = sink
        for name in self._waiting:
            sink(name, *self.tools[name])
        self._waiting.clear()

    def call(self, name: str, graph: CodeGraph | None, arguments: dict | None = None) -> dict:
        """The tool's record; an error record for an unknown tool, no graph, bad arguments or a failed lookup."""
        if name not in self.tools:
            return {"error": "unknown_tool", "message": name}
        if graph is None:
            return no_worktree()
        kind, handler = self.tools[name]
        given = {("from_" if k == "from" else k): v for k, v in (arguments or {}).items()}
        try:
            if unknown := set(given) - {f.name for f in fields(kind)}:
                raise InvalidInput(f"unknown arguments: {', '.join(sorted(unknown))}")
            return handler(graph, kind(**given))
        except (InvalidInput, TypeError) as e:
            return {"error": "invalid_input", "message": str(e)}
        except LookupError as e:
            return {"error": type(e).__name__, "message": str(e)}


def standard() -> Toolbox:
    box = Toolbox()
    for name, kind, handler in (
        ("get_node", GetNode, get_node), ("get_neighbors", GetNeighbors, get_neighbors), ("list_nodes", ListNodes, list_nodes), ("get_stats", GetStats, get_stats),
        ("get_dependencies", GetDependencies, get_dependencies), ("get_blast_radius", GetBlastRadius, get_blast_radius), ("trace_paths", TracePaths, trace_paths),
        ("detect_cycles", DetectCycles, detect_cycles),
    ):
        box.register(name, kind, handler)
    return box


class StatsMemo:
    """get_stats results by a graph's version: a counter that every change raises, so no change goes unnoticed."""

    def __init__(self):
        self._kept: dict[tuple, dict] = {}

    def get(self, key: str, version: int, graph: CodeGraph, top_n: int = 10) -> dict:
        if (key, version) not in self._kept:
            self._kept = {k: v for k, v in self._kept.items() if k[0] != key}
            self._kept[key, version] = get_stats(graph, GetStats(100))
        out = self._kept[key, version]
        return out | {"hotspots": out["hotspots"][:top_n]}
