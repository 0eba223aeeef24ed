"""Structured Streaming: a change feed keeps worktree overlays current.

A stream of events is debounced by event-time session windows per root; a closed session is emitted once, after the
watermark. foreachBatch turns its events into changes, analyzes the files that are left and appends to the overlay log,
a Parquet table in shared storage keyed by batch id, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import ids
from ..operators.overlay import Overlay
from ..plans.graph import EDGE, NODE, conform
from . import changes

EVENTS = "root string, ts timestamp, seq long, path string, type string"
FILES = T.StructType([T.StructField("worktree_id", T.StringType()), T.StructField("owner_file", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("deleted", T.BooleanType())])
_MORE = [T.StructField("worktree_id", T.StringType()), T.StructField("seq", T.LongType())]

#: (nodes, edges) of files (path, text) of one worktree.
Analyze = Callable[[DataFrame], tuple[DataFrame, DataFrame]]
#: (path, text) of those of the given paths (path) that can be read.
Read = Callable[[str, DataFrame], DataFrame]


def closed_sessions(events: DataFrame, gap_ms: int = changes.DEBOUNCE_MS, late: str = "1 second") -> DataFrame:
    """A streaming frame of (root, session, events): event-time sessions that no event can reach any more. Events later
    than the watermark are dropped."""
    marked = events.withWatermark("ts", late)
    own = marked.groupBy("root", F.session_window("ts", f"{gap_ms} milliseconds").alias("w"))
    return own.agg(F.collect_list(F.struct("ts", "seq", "path", "type")).alias("events")).select("root", F.col("w.start").alias("start"), "events")


class LiveOverlay:
    """The overlay log under a folder, and listeners that are told of the ids that a batch changed."""

    def __init__(self, spark: SparkSession, folder: str, read: Read, analyze: Analyze, resync: Callable[[str], DataFrame] | None = None, threshold: int = changes.BULK):
        self.spark, self.folder, self.read, self.analyze, self.resync, self.threshold = spark, folder.rstrip("/"), read, analyze, resync, threshold
        self.listeners: list[Callable[[str, list[str]], None]] = []
        self.version = 0

    def listen(self, on_change: Callable[[str, list[str]], None]) -> Callable[[], None]:
        """Calls on_change(worktree, ids) after each update that changed any; returns what removes it."""
        self.listeners.append(on_change)
        return lambda: self.listeners.remove(on_change) if on_change in self.listeners else None

    def _table(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.folder}/{name}")
        except Exception as e:  # the log's folder isn't there before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def overlay(self) -> Overlay:
        return Overlay(self._table("files", FILES), self._table("nodes", T.StructType([*NODE, *_MORE])), self._table("edges", T.StructType([*EDGE, *_MORE])))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of closed sessions (root, start, events)."""
        rows = batch.select("root", F.col("start").alias("session"), F.explode("events").alias("e")).select("root", "session", "e.*")
        made = changes.with_bulk(changes.moves(changes.coalesce(rows)), self.threshold).persist()
        try:
            for at, r in enumerate(made.groupBy("root").agg(F.max("bulk").alias("bulk")).orderBy("root").collect()):
                own = made.where(F.col("root") == r.root)
                todo = self.resync(r.root) if r.bulk and self.resync else changes.effects(own).groupBy("path").agg(F.max_by("action", "session").alias("action"))
                self._write(r.root, todo, batch_id, at)
        finally:
            made.unpersist()

    def _write(self, worktree: str, todo: DataFrame, batch_id: int, at: int) -> None:
        todo = todo.persist()
        wanted = todo.where("action = 'analyze'").select("path")
        texts = self.read(worktree, wanted).persist()
        try:
            # What can't be read counts as deleted.
            lost = wanted.join(texts.select("path"), "path", "left_anti").unionByName(todo.where("action = 'remove'").select("path"))
            nodes, edges = self.analyze(texts)
            stamp = lambda df: df.withColumn("worktree_id", F.lit(worktree)).withColumn("seq", F.lit(batch_id).cast("long"))
            files = texts.select(F.col("path").alias("owner_file"), F.lit(False).alias("deleted")).unionByName(lost.select(F.col("path").alias("owner_file"), F.lit(True).alias("deleted")))
            for name, df, schema in (("files", files, FILES), ("nodes", nodes, T.StructType([*NODE, *_MORE])), ("edges", edges, T.StructType([*EDGE, *_MORE]))):
                conform(stamp(df), schema).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch_id}-{at}")
            changed = [r.id for r in nodes.select("id").unionByName(lost.select(ids.file_id(F.col("path")).alias("id"))).distinct().orderBy("id").collect()] if self.listeners else []
        finally:
            texts.unpersist()
            todo.unpersist()
        self._tell(worktree, changed)

    def _tell(self, worktree: str, changed: list[str]) -> None:
        self.version += 1
        if changed:
            for on_change in list(self.listeners):
                on_change(worktree, changed)

    def seed(self, worktree: str, changed: DataFrame, batch_id: int) -> None:
        """Fills the overlay from changed files (path, status): deleted ones are marked, the others analyzed; one that
        can't be read counts as deleted."""
        action = F.when(F.col("status") == "deleted", "remove").otherwise("analyze")
        self._write(worktree, changed.select("path", action.alias("action")), batch_id, 0)

    def refresh(self, worktree: str, changed: DataFrame, batch_id: int) -> None:
        """Starts over: files that the overlay covers but that are no longer changed are as in the base again."""
        covered = self.overlay().latest().where(F.col("worktree_id") == worktree).select("owner_file")
        clear = covered.join(changed.select(F.col("path").alias("owner_file")), "owner_file", "left_anti")
        rows = clear.select(F.lit(worktree).alias("worktree_id"), "owner_file", F.lit(batch_id).cast("long").alias("seq"), F.lit(None).cast("boolean").alias("deleted"))
        conform(rows, FILES).write.mode("overwrite").parquet(f"{self.folder}/files/batch={batch_id}-clear")
        self.seed(worktree, changed, batch_id)

    def start(self, events: DataFrame, checkpoint: str, gap_ms: int = changes.DEBOUNCE_MS, late: str = "1 second") -> StreamingQuery:
        return closed_sessions(events, gap_ms, late).writeStream.outputMode("append").foreachBatch(self.apply).option("checkpointLocation", checkpoint).start()


def stop(query: StreamingQuery) -> None:
    """Takes in what has arrived, then stops."""
    query.processAllAvailable()
    query.stop()


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """A change feed of JSON lines that some watcher drops into a folder."""
    return spark.readStream.schema(EVENTS).json(folder)
