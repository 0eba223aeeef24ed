"""Small graphs and plain-Python models of what the operators compute."""

from __future__ import annotations

import random

from sparkloom.plans.graph import CodeGraph


def build(spark, edges, extra=(), languages=None) -> CodeGraph:
    """Edges (src, dst[, kind]); nodes are their ends and `extra`."""
    rows = [(e[0], e[1], e[2] if len(e) > 2 else "import") for e in edges]
    names = sorted({x for e in rows for x in e[:2]} | set(extra))

    def node(i):
        kind = "file" if i.startswith("file:") else "symbol" if i.startswith("sym:") else "external"
        path = i[5:] if kind == "file" else i[4:].split("#")[0] if kind == "symbol" else None
        name = path if kind == "file" else i.split("#", 1)[-1] if kind == "symbol" else i[4:]
        return (i, kind, (languages or {}).get(i, None if kind == "external" else "ts"), name, path if kind == "symbol" else None, path)

    nodes = spark.createDataFrame([node(i) for i in names], "id string, kind string, language string, name string, file string, owner_file string")
    owner = [(a, b, k, a[5:] if a.startswith("file:") else a[4:].split("#")[0]) for a, b, k in rows]
    return CodeGraph.of(nodes, spark.createDataFrame(owner, "src string, dst string, kind string, owner_file string"))


def files(pairs):
    return [(f"file:{a}", f"file:{b}") for a, b in pairs]


def random_edges(seed, nodes=30, edges=60):
    r = random.Random(seed)
    name = lambda: r.choice([f"file:n{r.randrange(nodes)}", f"file:n{r.randrange(nodes)}", f"sym:n{r.randrange(nodes)}#s", f"ext:p{r.randrange(4)}"])
    return sorted({(a, b) for a, b in ((name(), name()) for _ in range(edges)) if not a.startswith("ext:")})


def follow(edges):
    out = {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
    return out


def bfs(edges, seed, reverse=False, depth=None):
    nxt = follow([(b, a) for a, b in edges] if reverse else edges)
    seen, level, d = {seed: 0}, [seed], 0
    while level and (depth is None or d < depth):
        d += 1
        level = [b for a in level if reverse or d == 1 or not a.startswith("ext:") for b in nxt.get(a, ())]
        level = sorted({b for b in level if b not in seen})
        seen |= dict.fromkeys(level, d)
    return {k: v for k, v in seen.items() if k != seed}


def components(edges):
    """Sets of nodes that reach each other, with two members or a link to themselves."""
    nxt = follow(edges)
    reach = {}
    for a in nxt:
        seen, todo = set(), list(nxt[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += nxt.get(b, ())
        reach[a] = seen
    return {frozenset(b for b in reach[a] if a in reach.get(b, ())) for a in reach if a in reach[a]}


def simple_paths(edges, start, goal, hops):
    nxt, out = follow(edges), []

    def walk(path):
        if path[-1] == goal:
            out.append(path)
        elif len(path) <= hops:
            for b in nxt.get(path[-1], ()):
                if b not in path:
                    walk([*path, b])

    walk([start])
    return sorted(out, key=lambda p: (len(p), p))
