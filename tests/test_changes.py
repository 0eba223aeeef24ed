"""The change feed against a plain model of the pending map, in batch and as a stream."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F
from sparkloom.operators import overlay
from sparkloom.plans.graph import EDGE, NODE, conform
from sparkloom.streaming import changes as C
from sparkloom.streaming import live

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows):
    """rows (root, milliseconds, path, type)."""
    data = [(r, T0 + dt.timedelta(milliseconds=ms), i, p, t) for i, (r, ms, p, t) in enumerate(rows)]
    return spark.createDataFrame(data, live.EVENTS)


def model(rows, gap=200):
    """Per root the batches: lists of (type, path, old_path) in order."""
    out = {}
    for root in sorted({r[0] for r in rows}):
        batch, last = {}, None
        batches = []

        def flush(batch=None, batches=batches):
            adds = [p for p, t in batch.items() if t == "add"]
            moved, rest = [], []
            for p, t in batch.items():
                if t == "unlink":
                    mate = next((a for a in adds if a.rsplit("/", 1)[0] == p.rsplit("/", 1)[0] and a.rsplit(".", 1)[1] == p.rsplit(".", 1)[1]), None)
                    if mate:
                        adds.remove(mate)
                        moved.append(("move", mate, p))
                    else:
                        rest.append(("unlink", p, None))
            if batch:
                batches.append(moved + rest + [("add", a, None) for a in adds] + [("change", p, None) for p, t in batch.items() if t == "change"])

        for _, ms, path, kind in [r for r in rows if r[0] == root]:
            if last is not None and ms - last > gap:
                flush(batch)
                batch = {}
            last = ms
            before = batch.get(path)
            if before == "add" and kind == "unlink":
                del batch[path]
            elif not (before == "add" and kind == "change"):
                batch[path] = kind
        flush(batch)
        out[root] = batches
    return out


def got(changes):
    out = {}
    for r in changes.orderBy("root", "session", "place").collect():
        out.setdefault((r.root, r.session), []).append((r.type, r.path, r.old_path))
    by = {}
    for (root, _), batch in sorted(out.items()):
        by.setdefault(root, []).append(batch)
    return by


def test_batches_match_model(spark):
    r = random.Random(6)
    for seed in range(2):
        rows, ms = [], 0
        for _ in range(250):
            ms += r.choice([0, 1, 50, 199, 200, 201, 400])
            rows.append((f"w{r.randrange(2)}", ms, f"d{r.randrange(2)}/f{r.randrange(5)}.{r.choice(['ts', 'py'])}", r.choice(["add", "change", "unlink"])))
        want = {k: v for k, v in model(rows).items() if v}
        assert got(C.batches(events(spark, rows))) == want, seed


def test_gap_is_inclusive(spark):
    s = C.sessions(events(spark, [("w", 0, "a", "add"), ("w", 200, "b", "add"), ("w", 401, "c", "add")]))
    assert [r.session for r in s.orderBy("ts").collect()] == [1, 1, 2]


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.tar.gz",), ("x",), ("/x.ts",), ("a/.env",), ("a/b.",)], "p string")
    assert [tuple(r) for r in df.select(C.folder(F.col("p")), C.extension(F.col("p"))).collect()] == [("a/b", ".gz"), (".", ""), ("/", ".ts"), ("a", ""), ("a", ".")]


def test_bulk_and_effects(spark):
    rows = [("w", 0, f"f{k}.ts", "add") for k in range(50)] + [("w", 1000, "a/x.ts", "unlink"), ("w", 1001, "a/y.ts", "add")]
    b = C.batches(events(spark, rows)).persist()
    assert {(r.session, r.bulk) for r in b.collect()} == {(1, True), (2, False)}
    e = C.effects(b.where("session = 2")).collect()
    assert sorted((r.path, r.action) for r in e) == [("a/x.ts", "remove"), ("a/y.ts", "analyze")]


def test_dependents(spark):
    from . import graphs as G

    g = G.build(spark, G.files([("a", "b"), ("c", "b"), ("b", "a")]) + [("sym:d#x", "file:b"), ("file:e", "ext:q")])
    changed = spark.createDataFrame([("file:b",), ("file:gone",)], "id string")
    assert sorted(r.id for r in C.dependents(g.edges, g.nodes, changed).collect()) == ["file:a", "file:c"]


def test_stream_equals_batch(spark, tmp_path):
    """A feed of files through the stream gives the overlay that the batch functions give; listeners hear of it."""
    feed, log = tmp_path / "feed", str(tmp_path / "log")
    feed.mkdir()
    rows = [("wt-1", 0, "a.py", "add"), ("wt-1", 50, "b.py", "change"), ("wt-1", 100, "t.py", "add"), ("wt-1", 120, "t.py", "unlink"), ("wt-1", 5000, "b.py", "unlink"), ("wt-1", 5001, "gone.py", "change"), ("wt-2", 0, "c.py", "change")]

    def put(name, chosen):
        text = "".join(json.dumps({"root": r, "ts": (T0 + dt.timedelta(milliseconds=ms)).isoformat() + "Z", "seq": i, "path": p, "type": t}) + "\n" for i, (r, ms, p, t) in chosen)
        (feed / name).write_text(text)

    def read(worktree, paths):
        return paths.where("path <> 'gone.py'").select("path", F.lit("x").alias("text"))

    def analyze(files):
        nodes = files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("owner_file"))
        edges = files.select(F.concat(F.lit("file:"), "path").alias("src"), F.lit("ext:x").alias("dst"), F.lit("import").alias("kind"), F.col("path").alias("owner_file"))
        return conform(nodes, NODE), conform(edges, EDGE)

    over = live.LiveOverlay(spark, log, read, analyze)
    heard = []
    remove = over.listen(lambda w, changed: heard.append((w, changed)))
    put("1.json", list(enumerate(rows)))
    q = over.start(live.file_events(spark, str(feed)).coalesce(1), str(tmp_path / "ck"))
    q.processAllAvailable()
    put("2.json", [(90, ("wt-9", 60_000, "z.py", "add"))])  # moves the watermark past all sessions
    q.processAllAvailable()
    remove()
    put("3.json", [(91, ("wt-9", 120_000, "y.py", "add"))])
    live.stop(q)
    last = {(r.worktree_id, r.owner_file): r.deleted for r in over.overlay().latest().collect()}
    assert last == {("wt-1", "a.py"): False, ("wt-1", "b.py"): True, ("wt-1", "gone.py"): True, ("wt-2", "c.py"): False, ("wt-9", "z.py"): False}
    assert {w for w, _ in heard} == {"wt-1", "wt-2"} and over.version >= 2
    assert any("file:b.py" in changed for w, changed in heard if w == "wt-1")
    from . import graphs as G

    base = G.build(spark, G.files([("b.py", "a.py"), ("k.py", "a.py")]))
    g = overlay.compose(base, over.overlay(), "wt-1")
    assert sorted(r.id for r in g.nodes.collect()) == ["ext:x", "file:a.py", "file:k.py"]
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [("file:a.py", "ext:x"), ("file:k.py", "file:a.py")]


def test_refresh_starts_over(spark, tmp_path):
    def analyze(files):
        nodes = files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("owner_file"))
        return conform(nodes, NODE), conform(nodes.select(F.col("id").alias("src"), F.lit("ext:new").alias("dst"), F.lit("import").alias("kind"), "owner_file"), EDGE)

    read = lambda worktree, paths: paths.where("path <> 'lost'").select("path", F.lit("x").alias("text"))
    over = live.LiveOverlay(spark, str(tmp_path / "log"), read, analyze)
    changed = lambda rows: spark.createDataFrame(rows, "path string, status string")
    over.seed("w", changed([("a", "changed"), ("b", "deleted"), ("lost", "added")]), 1)
    state = lambda: {r.owner_file: r.deleted for r in over.overlay().latest().collect()}
    assert state() == {"a": False, "b": True, "lost": True}
    over.refresh("w", changed([("c", "added")]), 2)
    assert state() == {"c": False}
    from . import graphs as G

    base = G.build(spark, G.files([("a", "b"), ("b", "z")]))
    g = overlay.compose(base, over.overlay(), "w")
    assert sorted(r.id for r in g.nodes.collect()) == ["ext:new", "file:a", "file:b", "file:c", "file:z"] and g.edges.count() == 3


def test_tree_is_watched(spark, tmp_path):
    import os
    import time

    from sparkloom.sources.watch import TreeChanges, difference, snapshot

    root, state = tmp_path / "tree", tmp_path / "state"
    (root / "node_modules").mkdir(parents=True)

    def put(name, text):
        (root / name).write_text(text)
        old = time.time() - 5
        os.utime(root / name, (old, old))

    put("a.py", "1")
    put("b.py", "1")
    spark.dataSource.register(TreeChanges)
    seen = []
    stream = spark.readStream.format("tree_changes").option("root", str(root)).option("state", str(state)).load()
    q = stream.writeStream.foreachBatch(lambda df, i: seen.extend((r.path, r.type) for r in df.orderBy("seq").collect())).option("checkpointLocation", str(tmp_path / "ck")).start()

    def wait(n):
        end = time.time() + 60
        while len(seen) < n and time.time() < end:
            q.processAllAvailable()
            time.sleep(0.2)

    try:
        q.processAllAvailable()
        put("a.py", "two")
        put("c.py", "1")
        put("node_modules/x.js", "1")
        wait(2)
        os.remove(root / "b.py")
        wait(3)
    finally:
        q.stop()
    assert sorted(seen) == [("a.py", "change"), ("b.py", "unlink"), ("c.py", "add")]
    now = snapshot(str(root))
    assert set(now) == {"a.py", "c.py"}
    events, kept = difference({"c.py": [1, 1]}, {"a.py": [1, time.time_ns()], "c.py": [1, 1]}, time.time_ns())
    assert events == [] and kept == {"c.py": [1, 1]}  # written just now
