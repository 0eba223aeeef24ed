"""From raw file events to batches of changes: debouncing, coalescing per path, move detection, the bulk switch.

Events are rows (root, ts, seq, path, type), seq a tiebreak within a timestamp; types are add, change, unlink. All
steps are windows, aggregates and a join on equality, so the same functions serve a batch table and, in foreachBatch,
the sessions that a stream has closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEBOUNCE_MS, BULK = 200, 50


def sessions(events: DataFrame, gap_ms: int = DEBOUNCE_MS) -> DataFrame:
    """events with `session`: 1, 2, ... in each root. A session ends when nothing comes for longer than the gap; an
    event that comes exactly one gap later still belongs to it."""
    order = Window.partitionBy("root").orderBy("ts", "seq")
    until = F.lag("ts").over(order) + F.expr(f"INTERVAL '{gap_ms / 1000:.3f}' SECOND")
    return events.withColumn("session", 1 + F.count(F.when(F.col("ts") > until, 1)).over(order))


def coalesce(events: DataFrame) -> DataFrame:
    """(root, session, path, type, ts, seq): one change per path, or none, with the place where it began.

    An add that is unlinked leaves nothing; an add that changes stays an add; else the last event counts. A path that
    comes again after it left nothing begins anew.
    """
    own = events.groupBy("root", "session", "path").agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "type"))).alias("e"))
    none = F.struct(F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("type"))

    def step(state: Column, event: Column) -> Column:
        fresh = F.struct(event["ts"].alias("ts"), event["seq"].cast("long").alias("seq"), event["type"].alias("type"))
        later = F.struct(state["ts"].alias("ts"), state["seq"].alias("seq"), event["type"].alias("type"))
        added = state["type"] == "add"
        return F.when(state["type"].isNull(), fresh).when(added & (event["type"] == "unlink"), none).when(added & (event["type"] == "change"), state).otherwise(later)

    out = own.select("root", "session", "path", F.aggregate("e", none, step).alias("s"))
    return out.where("s.type IS NOT NULL").select("root", "session", "path", "s.type", "s.ts", "s.seq")


def folder(path: Column) -> Column:
    cut = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), F.lit(".")).when(path.startswith("/") & (cut == ""), F.lit("/")).otherwise(cut)


def extension(path: Column) -> Column:
    """From the last dot of the name on; a dot that the name begins with is none."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"^.+(\.[^.]*)$", 1)


def moves(changes: DataFrame) -> DataFrame:
    """(root, session, type, path, old_path, place): unlinks and adds of the same folder and extension become moves,
    first with first. place orders a session's changes: moves, unlinks, adds, changes, each by arrival."""
    key = ["root", "session", "dir", "ext"]
    c = changes.withColumn("dir", folder(F.col("path"))).withColumn("ext", extension(F.col("path")))
    nth = F.row_number().over(Window.partitionBy(*key, "type").orderBy("ts", "seq", "path"))
    c = c.withColumn("nth", nth)
    gone = c.where("type = 'unlink'").select(*key, "nth", F.col("path").alias("old_path"), F.col("ts").alias("old_ts"), F.col("seq").alias("old_seq"))
    come = c.where("type = 'add'").select(*key, "nth", "path", "ts", "seq")
    pairs = gone.join(come, [*key, "nth"], "full_outer")
    kind = F.when(F.col("path").isNull(), "unlink").when(F.col("old_path").isNull(), "add").otherwise("move")
    paired = pairs.select("root", "session", kind.alias("type"), F.coalesce("path", "old_path").alias("path"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("old_path"), F.coalesce("old_ts", "ts").alias("ts"), F.coalesce("old_seq", "seq").alias("seq"))
    rest = c.where("type = 'change'").select("root", "session", "type", "path", F.lit(None).cast("string").alias("old_path"), "ts", "seq")
    rank = F.array_position(F.array(*[F.lit(t) for t in ("move", "unlink", "add", "change")]), F.col("type"))
    both = paired.unionByName(rest)
    order = Window.partitionBy("root", "session").orderBy(rank, "ts", "seq", "path")
    return both.withColumn("place", F.row_number().over(order)).drop("ts", "seq")


def with_bulk(changes: DataFrame, threshold: int = BULK) -> DataFrame:
    """changes with `bulk`: the session has `threshold` changes or more, so that a full resync is cheaper."""
    n = changes.groupBy("root", "session").agg((F.count(F.lit(1)) >= threshold).alias("bulk"))
    return changes.join(n, ["root", "session"])


def batches(events: DataFrame, gap_ms: int = DEBOUNCE_MS, threshold: int = BULK) -> DataFrame:
    """All steps: (root, session, type, path, old_path, place, bulk)."""
    return with_bulk(moves(coalesce(sessions(events, gap_ms))), threshold)


def effects(changes: DataFrame) -> DataFrame:
    """What changes do to an overlay: (root, session, path, action), action remove or analyze. A move removes the old
    path and analyzes the new one."""
    does = F.expr(
        "CASE type WHEN 'unlink' THEN array(named_struct('path', path, 'action', 'remove'))"
        " WHEN 'move' THEN array(named_struct('path', old_path, 'action', 'remove'), named_struct('path', path, 'action', 'analyze'))"
        " ELSE array(named_struct('path', path, 'action', 'analyze')) END"
    )
    return changes.select("root", "session", F.explode(does).alias("e")).select("root", "session", "e.path", "e.action")


def dependents(edges: DataFrame, nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids of files with an edge to a changed node (id) that is in the graph, one hop: to be analyzed again."""
    there = changed.select("id").distinct().join(nodes.select("id"), "id", "left_semi")
    into = edges.select(F.col("dst").alias("id"), "src").join(there, "id", "left_semi")
    return into.where(F.col("src").startswith("file:")).select(F.col("src").alias("id")).distinct()
