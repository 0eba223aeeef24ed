import json

import pytest
from sparkloom.operators import overlay, tools
from sparkloom.operators.resolve import parse, resolve
from sparkloom.plans.graph import EDGE, NODE, conform
from pyspark.sql import functions as F

from . import graphs as G

EDGES = [
    ("file:src/a.ts", "file:src/b.ts"), ("file:src/b.ts", "file:src/a.ts"), ("file:src/a.ts", "file:src/c.ts"), ("file:src/b.ts", "file:src/c.ts"),
    ("file:lib/a.ts", "ext:lodash"), ("sym:src/a.ts#foo", "sym:src/c.ts#bar", "reference"), ("file:src/a.ts", "sym:src/c.ts#bar", "reference"),
]
EXTRA = ["sym:src/a.ts#foo~1", "sym:src/a.ts#fooBar", "file:src/d_.ts", "file:src/D.ts"]


@pytest.fixture(scope="module")
def g(spark):
    return G.build(spark, EDGES, EXTRA, {"file:src/c.ts": "js"})


@pytest.fixture(scope="module")
def call(g):
    box = tools.standard()
    return lambda name, **a: box.call(name, g, a)


def test_parse():
    assert parse("file:x#y") == {"node_id": "file:x#y"} and parse("a#b#c") == {"path": "a#b", "symbol": "c"}
    assert parse("#x") == {"path": "#x"} and parse("a/b.ts") == {"path": "a/b.ts"}


def test_resolve(g):
    assert resolve(g, "src/a.ts").id == "file:src/a.ts" and resolve(g, "c.ts").id == "file:src/c.ts"
    assert resolve(g, "a.ts").candidates == ["file:lib/a.ts", "file:src/a.ts"]
    assert resolve(g, "src\\a.ts").id == "file:src/a.ts"
    assert not resolve(g, "zz.ts").found and not resolve(g, "sym:none#x").found
    assert resolve(g, "src/a.ts#foo").id == "sym:src/a.ts#foo"
    assert resolve(g, "src/c.ts#b").id == "sym:src/c.ts#bar"
    assert resolve(g, "src/a.ts#fo").candidates == ["sym:src/a.ts#foo", "sym:src/a.ts#fooBar", "sym:src/a.ts#foo~1"]
    assert resolve(g, {"path": "src/a.ts", "symbol": "foo"}).id == "sym:src/a.ts#foo"
    assert resolve(g, "a.ts#foo").candidates == ["file:lib/a.ts", "file:src/a.ts"]


def test_get_node(call):
    out = call("get_node", target="src/c.ts")
    assert out["node"]["id"] == "file:src/c.ts" and out["degree"] == {"in": 2, "out": 0} and "loc" not in out["node"]
    assert call("get_node", target="zz") == {"found": False}
    assert call("get_node", target="a.ts") == {"found": False, "candidates": ["file:lib/a.ts", "file:src/a.ts"]}


def test_get_neighbors(call, spark):
    out = call("get_neighbors", target="src/a.ts")
    assert [n["node"]["id"] for n in out["in_neighbors"]] == ["file:src/b.ts"]
    assert [n["node"]["id"] for n in out["out_neighbors"]] == ["file:src/b.ts", "file:src/c.ts", "sym:src/c.ts#bar"] and "truncated" not in out
    assert out["out_neighbors"][0]["edges"] == [{"kind": "import", "src": "file:src/a.ts", "dst": "file:src/b.ts"}]
    cut = call("get_neighbors", target="src/a.ts", limit=1)
    assert len(cut["in_neighbors"]) == 1 and not cut["out_neighbors"] and cut["truncated"]
    given = call("get_neighbors", target="src/a.ts", limit=4)
    assert len(given["out_neighbors"]) == 3 and "truncated" not in given
    assert call("get_neighbors", target="src/a.ts", direction="in")["out_neighbors"] == []
    assert call("get_neighbors", target="src/d_.ts")["in_neighbors"] == []
    loop = G.build(spark, [("file:x", "file:x", "import"), ("file:x", "file:x", "reference")])
    both = tools.standard().call("get_neighbors", loop, {"target": "file:x"})
    assert len(both["in_neighbors"]) == len(both["out_neighbors"]) == 1 and len(both["in_neighbors"][0]["edges"]) == 2


def test_list_nodes(call):
    first = call("list_nodes", kind="file", limit=2)
    assert [n["id"] for n in first["nodes"]] == ["file:lib/a.ts", "file:src/a.ts"] and first["total"] == 6 and first["truncated"]
    second = call("list_nodes", kind="file", limit=4, cursor=first["cursor"])
    assert [n["id"] for n in second["nodes"]] == ["file:src/b.ts", "file:src/c.ts", "file:src/d_.ts", "file:src/D.ts"] and "cursor" not in second
    assert call("list_nodes", kind="file", cursor="???")["nodes"] == call("list_nodes", kind="file")["nodes"]
    assert {n["id"] for n in call("list_nodes", path_prefix="lib/")["nodes"]} == {"file:lib/a.ts"}
    assert call("list_nodes", language="js")["total"] == 1


def test_get_stats(call, spark):
    out = call("get_stats", top_n=2)
    assert out["nodes"] == {"files": 6, "symbols": 4, "externals": 1} and out["edges"] == 7 and out["cycle_count"] == 1
    assert out["languages"] == {"ts": 9, "js": 1}
    assert [h["id"] for h in out["hotspots"]] == ["file:src/c.ts", "sym:src/c.ts#bar"]
    empty = G.build(spark, [("file:a", "file:b")])
    empty = type(empty)(empty.nodes.limit(0), empty.edges.limit(0))
    assert tools.get_stats(empty, tools.GetStats())["indexed"] is False


def test_dependencies_and_blast(call, g):
    out = call("get_dependencies", target="src/a.ts", include_paths=True)
    assert [d["id"] for d in out["dependencies"]] == ["file:src/b.ts", "file:src/c.ts", "sym:src/c.ts#bar"] and not out["truncated"]
    assert call("get_dependencies", target="src/a.ts", limit=3)["truncated"]  # as many as the limit
    blast = call("get_blast_radius", target="sym:src/c.ts#bar", roll_up=True)
    assert [(d["id"], d["distance"]) for d in blast["dependents"]] == [("file:src/a.ts", 1), ("sym:src/a.ts#foo", 1), ("file:src/b.ts", 2)]
    assert call("get_blast_radius", target="src/d_.ts")["safe_to_change"]
    assert call("get_blast_radius", target="zz")["error"] == "TargetNotFound" and call("get_blast_radius", target="a.ts")["error"] == "AmbiguousTarget"
    with pytest.raises(tools.TargetNotFound):
        tools.get_blast_radius(g, tools.GetBlastRadius("zz"))


def test_blast_radius_is_cut_at_its_limit(spark):
    g = G.build(spark, G.files((f"u{k:04}", "hub") for k in range(2100)))
    out = tools.get_blast_radius(g, tools.GetBlastRadius("hub"))
    assert len(out["dependents"]) == 2000 and out["truncated"] and out["total"] == 2100


def test_trace_paths(call):
    out = call("trace_paths", **{"from": "src/a.ts", "to": "src/c.ts", "k": 2})
    assert [[n["id"] for n in p["nodes"]] for p in out["paths"]] == [["file:src/a.ts", "file:src/c.ts"], ["file:src/a.ts", "file:src/b.ts", "file:src/c.ts"]]
    assert out["paths"][0]["edges"] == [{"from": "file:src/a.ts", "to": "file:src/c.ts", "kind": "import", "target_type": "file"}]
    assert call("trace_paths", from_="src/a.ts", to="src/a.ts")["self"] is True
    assert call("trace_paths", from_="src/c.ts", to="src/a.ts") == {"found": False}
    back = call("trace_paths", from_="src/c.ts", to="src/a.ts", direction="reverse")
    assert back["paths"][0]["edges"][0]["from"] == "file:src/a.ts"
    assert "candidates" in call("trace_paths", from_="a.ts", to="zz") and call("trace_paths", from_="zz", to="a.ts") == {"found": False}


def test_detect_cycles(call):
    out = call("detect_cycles")
    assert out["total_groups"] == 1 and out["groups"][0]["example_cycle_path"] == ["file:src/a.ts", "file:src/b.ts", "file:src/a.ts"]


def test_validation_and_errors(call, g):
    for name, a in (("get_neighbors", {"target": "x", "limit": 201}), ("get_stats", {"top_n": 0}), ("get_dependencies", {"target": "x", "depth": 11}), ("trace_paths", {"from": "a", "to": "b", "k": 21}), ("detect_cycles", {"granularity": "x"}), ("list_nodes", {"what": 1}), ("get_node", {})):
        assert call(name, **a)["error"] == "invalid_input"
    box = tools.standard()
    assert box.call("get_node", None, {"target": "x"})["error"] == "no_worktree" and box.call("nope", g)["error"] == "unknown_tool"


def test_toolbox_waits_for_its_sink():
    box, seen = tools.Toolbox(), []
    box.register("a", tools.GetStats, None)
    box.connect(lambda n, k, h: seen.append(n))
    box.register("b", tools.GetStats, None)
    assert seen == ["a", "b"]


def test_envelope_and_cursor():
    e = tools.envelope({"b": None, "a": [1, {"c": None}]})
    assert json.loads(e["content"][0]["text"]) == {"a": [1, {}]} and e["content"][0]["type"] == "text"
    assert tools.decode_cursor(tools.encode_cursor(120)) == 120 and tools.decode_cursor(tools.encode_cursor(-4)) == 0 and tools.decode_cursor(None) == 0
    assert tools.paginate([1, 2, 3], 0, 2) == ([1, 2], "2") and tools.paginate([1, 2, 3], 2, 2) == ([3], None)


def test_stats_memo(g):
    memo = tools.StatsMemo()
    a = memo.get("wt", 1, g)
    assert memo.get("wt", 1, None) == a  # kept
    with pytest.raises(AttributeError):
        memo.get("wt", 2, None)  # a new version is computed


# ---- overlays


def entries(spark, rows):
    return spark.createDataFrame(rows, "worktree_id string, owner_file string, seq long, deleted boolean")


def slices(spark, graph, worktree, seq):
    stamp = lambda df: df.withColumn("worktree_id", F.lit(worktree)).withColumn("seq", F.lit(seq).cast("long"))
    return stamp(conform(graph.nodes, NODE)), stamp(conform(graph.edges, EDGE))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def pairs(df):
    return sorted((r.src, r.dst) for r in df.collect())


def test_compose(spark):
    base = G.build(spark, G.files([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]) + [("file:d", "ext:x")])
    new = G.build(spark, [("file:b", "file:d"), ("file:b", "file:zz")])
    nodes, edges = slices(spark, new, "wt-1", 2)
    own = nodes.where("id = 'file:b'")
    log = entries(spark, [("wt-1", "b", 1, True), ("wt-1", "b", 2, False), ("wt-1", "c", 3, True), ("wt-2", "a", 1, True)])
    over = overlay.Overlay(log, own, edges)
    g = overlay.compose(base, over, "wt-1")
    assert ids(g.nodes) == ["ext:x", "file:a", "file:b", "file:d", "file:zz"]
    assert g.nodes.where("id = 'file:zz'").first().kind == "external"
    # The edge from an unchanged file into the replaced one stays.
    assert pairs(g.edges) == [("file:a", "file:b"), ("file:b", "file:d"), ("file:b", "file:zz"), ("file:d", "ext:x"), ("file:d", "file:a")]
    dropped = overlay.compose(base, over, "wt-1", drop_inbound=True)
    assert ("file:a", "file:b") not in pairs(dropped.edges)
    other = overlay.compose(base, over, "wt-2")
    assert ids(other.nodes) == ["ext:x", "file:b", "file:c", "file:d"] and pairs(other.edges) == [("file:b", "file:c"), ("file:c", "file:d"), ("file:d", "ext:x")]
    none = overlay.compose(base, over.without("wt-1"), "wt-1")
    assert ids(none.nodes) == ids(base.nodes) and pairs(none.edges) == pairs(base.edges)


def test_composed_equals_rebuilt(spark):
    """Replacing files one by one through the log gives the graph that is built from the final files."""
    import random

    r = random.Random(4)
    names = [f"f{k}" for k in range(8)]
    first = {n: r.sample(names, 2) for n in names}
    later = {n: r.sample(names, 2) for n in r.sample(names, 4)}
    gone = [n for n in names if n not in later][:1]
    base = G.build(spark, G.files((a, b) for a, t in first.items() for b in t), [f"file:{n}" for n in names])
    new = G.build(spark, G.files((a, b) for a, t in later.items() for b in t))
    nodes, edges = slices(spark, new, "w", 5)
    log = entries(spark, [("w", n, 5, False) for n in later] + [("w", n, 6, True) for n in gone])
    g = overlay.compose(base, overlay.Overlay(log, nodes.where(F.col("owner_file").isin(list(later))), edges), "w")
    final = {n: t for n, t in (first | later).items() if n not in gone}
    ends = {f"file:{n}" for n in final} | {f"file:{b}" for a in later for b in later[a]}
    assert ids(g.nodes) == sorted(ends)
    assert pairs(g.edges) == sorted({(f"file:{a}", f"file:{b}") for a, t in final.items() for b in t if f"file:{b}" in ends})


def test_base_slices(spark):
    base = G.build(spark, G.files([("a", "b"), ("b", "c")]))
    new = G.build(spark, G.files([("a", "c"), ("a", "new")]))
    g = overlay.apply_slice(base, new.nodes.where("id = 'file:a'"), new.edges)
    assert pairs(g.edges) == [("file:a", "file:c"), ("file:a", "file:new"), ("file:b", "file:c")]
    assert g.nodes.where("id = 'file:new'").first().kind == "external"
    cut = overlay.remove_slice(base, spark.createDataFrame([("b",)], "owner_file string"))
    assert ids(cut.nodes) == ["file:a", "file:c"] and cut.edges.count() == 0


def test_parallel_kinds_are_kept(spark):
    g = G.build(spark, [("file:a", "file:b", "import"), ("file:a", "file:b", "reference")])
    box = tools.standard()
    assert box.call("get_node", g, {"target": "file:b"})["degree"] == {"in": 2, "out": 0}
    assert len(box.call("get_dependencies", g, {"target": "file:a"})["dependencies"]) == 1


def test_to_slice(spark):
    nodes = spark.createDataFrame([("file:a", "file", None), ("sym:a#x", "symbol", "a")], "id string, kind string, file string")
    edges = spark.createDataFrame([("file:a", "file:b", "imports"), ("sym:a#x", "file:b", "references"), ("file:a", "file:c", "import")], "src string, dst string, kind string")
    n, e = overlay.to_slice(nodes, edges)
    assert [r.owner_file for r in n.collect()] == ["a", "a"] and sorted(r.kind for r in e.collect()) == ["import", "import", "reference"]
