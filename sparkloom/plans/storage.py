"""Shared scratch tables that cut lineage in loops, and collecting what is known to be small."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Graphs up to this many edges are traversed on the driver (tens of MB); larger ones level by level in the cluster.
DRIVER_EDGES = 300_000

_bound: ContextVar[int | None] = ContextVar("bound", default=None)


@contextmanager
def driver_edges(bound: int) -> Iterator[None]:
    """Another bound for what is begun inside; 0 keeps all graphs in the cluster."""
    before = _bound.set(bound)
    try:
        yield
    finally:
        _bound.reset(before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or the context's checkpoint folder; a local one only where
    the master is local and names neither."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="sparkloom-graph-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, bound: int | None = None) -> pa.Table | None:
    """All rows of df if there are at most `bound` (else the one of driver_edges, else DRIVER_EDGES), else None. One row
    more than that is all that is ever read for it."""
    bound = next(b for b in (bound, _bound.get(), DRIVER_EDGES) if b is not None)
    if not bound:
        return None
    rows = df.limit(bound + 1).toArrow()
    return rows if rows.num_rows <= bound else None
