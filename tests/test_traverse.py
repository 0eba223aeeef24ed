import pytest
from sparkloom.operators import cycles, paths, traverse
from sparkloom.plans import storage

from . import graphs as G


@pytest.fixture(params=["driver", "cluster"])
def way(request, monkeypatch):
    """Both ways of walking a graph."""
    monkeypatch.setattr(storage, "DRIVER_EDGES", 300_000 if request.param == "driver" else -1)
    monkeypatch.setattr(storage.if_small, "__defaults__", (storage.DRIVER_EDGES,))
    return request.param


def reached(df):
    return {r.id: r.distance for r in df.collect()}


@pytest.mark.parametrize("reverse", [False, True])
def test_reach_matches_model(spark, way, reverse):
    edges = G.random_edges(3)
    g = G.build(spark, edges)
    for seed, depth in (("file:n1", None), ("file:n2", 2), ("ext:p1", None)):
        assert reached(traverse.reach(g, [seed], reverse, depth)) == G.bfs(edges, seed, reverse, depth)


def test_deep_chain_many_levels(spark, way):
    n = 14
    g = G.build(spark, G.files((f"c{k:02}", f"c{k + 1:02}") for k in range(n)))
    assert reached(traverse.reach(g, ["file:c00"])) == {f"file:c{k:02}": k for k in range(1, n + 1)}


def test_blast_radius_is_whole_beyond_sixty_hops(spark, tmp_path):
    """The query's SQL follows walks of up to 60 hops, the query all there are: part k's file is 65 - k hops from the hub."""
    from sparkloom.plans.queries import QUERIES

    n = 65
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
    steps = [(k, k + 1) for k in range(n)] + [(n + 1, n)]  # two point to part n: the hub
    lines = [(o, p, 0, i, 45.0, 1.0, 0.0, 0.0, "N", None) for o, step in enumerate(steps) for i, p in enumerate(step)]
    tables = {
        "part": spark.createDataFrame([(k, "Brand#1", 1) for k in range(n + 2)], "p_partkey long, p_brand string, p_size int"),
        "lineitem": spark.createDataFrame(lines, columns),
        "supplier": spark.createDataFrame([(0, 0)], "s_suppkey long, s_nationkey int"),
        "nation": spark.createDataFrame([(0, "N")], "n_nationkey int, n_name string"),
    }
    for name, rows in tables.items():
        rows.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.id: r.distance for r in QUERIES["blast_radius"](spark, str(tmp_path)).collect()}
    assert got == {f"file:Brand-1/p{k}.src": n - k for k in range(n)} | {f"file:Brand-1/p{n + 1}.src": 1}
    cut = QUERIES["blast_radius_truncated"](spark, str(tmp_path)).collect()
    assert {(r.total, r.truncated) for r in cut} == {(n + 1, True)} and len(cut) == 10


def test_paths_go_through_the_least_parent(spark, way):
    g = G.build(spark, G.files([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a")]))
    got = {r.id: r.path for r in traverse.reach(g, ["file:a"], paths=True).collect()}
    assert got["file:d"] == ["file:a", "file:b", "file:d"] and "file:a" not in got
    back = {r.id: r.path for r in traverse.reach(g, ["file:d"], reverse=True, paths=True).collect()}
    assert back["file:a"] == ["file:d", "file:b", "file:a"]


def test_external_is_a_leaf_but_can_be_a_seed(spark, way):
    g = G.build(spark, [("file:a", "ext:x"), ("ext:x", "file:b"), ("file:a", "file:a")])
    assert reached(traverse.reach(g, ["file:a"])) == {"ext:x": 1}
    assert reached(traverse.reach(g, ["ext:x"])) == {"file:b": 1}
    assert reached(traverse.reach(g, ["file:b"], reverse=True)) == {"ext:x": 1, "file:a": 2}


def test_several_seeds_at_once(spark, way):
    edges = G.random_edges(5)
    got = {}
    for r in traverse.reach(G.build(spark, edges), ["file:n1", "file:n4"]).collect():
        got.setdefault(r.seed, {})[r.id] = r.distance
    assert all(got.get(s, {}) == G.bfs(edges, s) for s in ("file:n1", "file:n4"))


def test_unknown_seed_reaches_nothing(spark, way):
    assert reached(traverse.reach(G.build(spark, G.files([("a", "b")])), ["file:zz"])) == {}


def test_roll_up(spark):
    """Direct and through symbols: the nearer wins, at a tie the direct hit, unmarked."""
    rows = [("s", "sym:f1#a", 1, None), ("s", "file:f1", 2, ["x"]), ("s", "sym:f2#a", 2, None), ("s", "file:f2", 2, ["y"]), ("s", "sym:f3#b", 3, None), ("s", "file:f3", 1, ["z"]), ("s", "sym:f4#c", 2, None), ("s", "sym:f4#d", 1, None)]
    out = {r.id: (r.distance, r.rolled_up) for r in traverse.roll_up(spark.createDataFrame(rows, traverse.SCHEMA)).collect()}
    assert out["file:f1"] == (1, True) and out["file:f2"] == (2, False) and out["file:f3"] == (1, False) and out["file:f4"] == (1, True)
    assert out["sym:f4#c"] == (2, False) and len(out) == 9


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cycles_match_model(spark, way, seed):
    edges = [(a, b) for a, b in G.random_edges(seed, 25, 70)]
    g = G.build(spark, edges)
    rows = cycles.detect_cycles(g, "symbol").orderBy("rank").collect()
    inner = [(a, b) for a, b in edges if not b.startswith("ext:")]
    want = sorted((sorted(c) for c in G.components(inner)), key=lambda c: (-len(c), c[0]))
    assert [list(r.nodes) for r in rows] == [c[:50] for c in want]
    assert [r.size for r in rows] == [len(c) for c in want]
    links = set(inner)
    for r in rows:
        p = list(r.example)
        assert p[0] == p[-1] == r.nodes[0] and all(x in links for x in zip(p, p[1:], strict=False))
        assert len(set(p)) == len(p) - 1


def test_cycle_shapes(spark):
    g = G.build(spark, G.files([("a", "b"), ("b", "a"), ("c", "c"), ("d", "e"), ("x/a", "x/b"), ("x/b", "x/c"), ("x/c", "x/a"), ("x/c", "a")]) + [("sym:s#a", "sym:s#b"), ("sym:s#b", "sym:s#a")])
    rows = cycles.detect_cycles(g).orderBy("rank").collect()
    assert [list(r.nodes) for r in rows] == [["file:x/a", "file:x/b", "file:x/c"], ["file:a", "file:b"], ["file:c"]]
    assert list(rows[2].example) == ["file:c", "file:c"] and rows[0].total_groups == 3
    assert [list(r.nodes) for r in cycles.detect_cycles(g, scope="x/").collect()] == [["file:x/a", "file:x/b", "file:x/c"]]
    assert cycles.detect_cycles(g, "symbol").count() == 4
    cut = cycles.detect_cycles(g, group_size=2, groups=1).collect()
    assert len(cut) == 1 and cut[0].truncated and cut[0].size == 3 and len(cut[0].nodes) == 2 and cut[0].total_groups == 3
    assert cycles.cycle_count(g) == 2
    assert cycles.detect_cycles(G.build(spark, G.files([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]))).collect() == []


def test_example_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(cycles, "TOGETHER", 3)
    g = G.build(spark, G.files([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("c", "a"), ("x", "y"), ("y", "x"), ("a", "a")]))
    rows = cycles.detect_cycles(g).orderBy("rank").collect()
    assert [list(r.example) for r in rows] == [["file:a", "file:b", "file:c", "file:a"], ["file:x", "file:y", "file:x"]]


def test_group_hash_is_known(spark):
    g = G.build(spark, G.files([("src/a.ts", "src/b.ts"), ("src/b.ts", "src/a.ts")]))
    assert cycles.detect_cycles(g).first().id == "scc-83de25d0"


def test_long_cycle_needs_no_recursion():
    n = 5000
    nxt = {f"n{k:05}": [f"n{(k + 1) % n:05}"] for k in range(n)}
    assert [len(c) for c in cycles.strong_components(nxt)] == [n]
    assert len(cycles.example_cycle(sorted(nxt), nxt)) == n + 1


@pytest.mark.parametrize("direction", ["forward", "reverse", "any"])
def test_paths_match_model(spark, way, direction):
    edges = G.random_edges(9, 10, 34)
    both = {"forward": edges, "reverse": [(b, a) for a, b in edges], "any": edges + [(b, a) for a, b in edges]}[direction]
    g = G.build(spark, edges)
    for start, goal in (("file:n1", "file:n2"), ("file:n3", "file:n7")):
        found, truncated = paths.shortest(g, start, goal, 4, direction, 4)
        assert [list(r.path) for r in found.orderBy("rank").collect()] == G.simple_paths(both, start, goal, 4)[:4]
        assert not truncated


def test_path_budget(spark, way):
    g = G.build(spark, G.files([("a", f"m{k}") for k in range(6)] + [(f"m{k}", f"o{k}") for k in range(6)] + [("o5", "z")]))
    found, truncated = paths.shortest(g, "file:a", "file:z", 1, budget=5)
    assert truncated and found.collect() == []
    found, truncated = paths.shortest(g, "file:a", "file:z", 1)
    assert not truncated and len(found.first().path) == 4
    assert paths.shortest(g, "file:z", "file:a")[0].collect() == []


def test_path_edges(spark):
    g = G.build(spark, [("file:a", "file:b", "reference"), ("file:a", "file:b", "import"), ("file:c", "file:b", "reference")])
    p = spark.createDataFrame([(1, ["file:a", "file:b", "file:c"])], "rank int, path array<string>")
    rows = [(r.src, r.dst, r.kind) for r in paths.path_edges(g, p, "any").orderBy("step").collect()]
    assert rows == [("file:a", "file:b", "import"), ("file:c", "file:b", "reference")]
    q = spark.createDataFrame([(1, ["file:b", "file:a"])], "rank int, path array<string>")
    assert [(r.src, r.dst, r.kind) for r in paths.path_edges(g, q, "reverse").collect()] == [("file:a", "file:b", "import")]
