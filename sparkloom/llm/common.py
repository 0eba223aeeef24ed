"""What the operators of this subpackage share: tables, shared scratch space, words."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing as the contracts state it (ASCII only).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Maps a byte to its lower-case form, and every ASCII byte that is in no word to a space.
#: Bytes of non-ASCII characters stay: they always belong to a word.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (letters, digits, anything beyond ASCII) of a text, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) tokens between ASCII white space, as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir, or the context's checkpoint folder. Only a local master
    without either gets one of its own; on a cluster that raises, as executors would write to their own disks."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _on(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors. What
    nobody discards earlier is deleted when the application ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, files = _on(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once no later job reads it."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            at, files = _on(df.sparkSession, path)
            files.delete(at, True)


def grouped(df: DataFrame, rows: int, per_partition: int) -> int:
    """How many partitions hold `rows` rows at about `per_partition` each, at least the session's number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, for mapInArrow, that gives freed memory back to the system at the end of its task. Workers wait for a minute
    for more to do; what they hold on to counts beside the memory of the stages that follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return run


#: Bits of a table's trace (8 MB): a bound on what is broadcast to tell rows that can't have a partner.
TRACE_BITS = 26


def trace(keys: DataFrame, column: str) -> DataFrame:
    """Which low bits of a column of hashes (long) occur: (slot, bits), 2 ** TRACE_BITS bits at most for any table."""
    low = F.col(column).bitwiseAND((1 << TRACE_BITS) - 1)
    at = keys.select(F.shiftright(low, 15).alias("slot"), low.bitwiseAND(32767).alias("bit"))
    return at.groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))


def traced(rows: DataFrame, column: str, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those whose hash may be among the traced keys, and those whose hash is null or not among them.

    It spares rows without a partner an exchange; some others come along, nearly all where the keys are very many, so
    a join has to follow for the first part.
    """
    names = [f"`{c}`" for c in rows.columns]
    low = f"(`{column}` & {(1 << TRACE_BITS) - 1})"
    own = F.broadcast(seen.withColumnsRenamed({"slot": "__slot", "bits": "__bits"}))
    both = rows.join(own, F.expr(f"shiftright({low}, 15) = __slot"), "left")
    byte = f"cast(conv(hex(substring(__bits, cast(shiftright({low} & 32767, 3) AS int) + 1, 1)), 16, 10) AS int)"
    is_set = F.expr(f"coalesce(shiftright({byte}, cast({low} & 7 AS int)) & 1, 0) = 1")
    return both.where(is_set).select(*names), both.where(~is_set).select(*names)
