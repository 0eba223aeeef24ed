"""Token counts by a two-tier lookup on the map side: no pre-token is ever shuffled.

A text is normalised and cut into pre-tokens; its count is the sum of its pre-tokens' lengths in tokens. Lengths come
from a compact table of frequent pre-tokens that the driver broadcasts (first tier), else from a cache that each
Python worker keeps between batches (second tier). What neither knows is encoded by the library, each distinct
pre-token of a batch once. The table has at most ``table_size`` entries and the cache ``cache_size``, which bounds a
worker's memory; a full cache is emptied, not the table. Both only save time: the counts don't depend on them.

Pre-tokens are cut here for texts of a fixed set of characters on which the two regular-expression engines are known
to agree. A text with any other character, or with a special token's string, is encoded whole by the library.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, stored

#: Entries of the broadcast table, and the longest pre-token in it: together they bound what is broadcast.
TABLE_SIZE, TABLE_CHARS = 20_000, 64
#: The share of the table's rows, drawn by a seed, whose whole texts tell which pre-tokens are frequent.
DRAWN = 0.01
CACHE_SIZE = 300_000
SLICE_CHARS = 1_000_000

#: Fixed value: the tokenizer's own pattern, for the characters that pass _OTHER.
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_OTHER = re.compile("[^\t-\r -~¡-¬®-ɏ‐-‧€]|[²³¹¼-¾İ]|<\\|(?:start|end)oftext\\|>")

_workers: dict[str, tuple] = {}


def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _encoded(tok, texts: list[str]) -> list[int]:
    return [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def frequent(docs: DataFrame, text: str, path: str, table_size: int = TABLE_SIZE, drawn: float = DRAWN) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of the drawn rows, at most table_size of them.

    A task counts its rows' pre-tokens and sends each distinct one once. How many there are of each frequency (in steps
    of a sixteenth of a doubling) tells from which on all fit; these alone come to the driver.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0):
                if (t := t.as_py()) and not _OTHER.search(t):
                    seen.update(_PRE_TOKEN.findall(t.lower()))
            if len(seen) > CACHE_SIZE:
                yield _tally(seen)
                seen.clear()
        yield _tally(seen)

    sums = docs.select(docs[text]).sample(drawn, seed=1).mapInArrow(lean(counted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # A pre-token is a run of letters of any length; what is broadcast holds words, no longer ones.
    sums = stored(sums.where(f"length(word) <= {TABLE_CHARS}").withColumn("step", F.expr("cast(16 * log2(n) as int)")), "frequent")
    least, total = None, 0
    for step, k in sums.groupBy("step").count().orderBy(F.desc("step")).collect():
        total += k
        if total > table_size:
            break
        least = step
    words = [] if least is None else [w for w, in sums.where(F.col("step") >= least).select("word").collect()]
    discard(sums)
    return dict(zip(words, _encoded(tokenizer(path), words), strict=True)) if words else {}


def _tally(seen: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])


def _counter(path: str, table: dict[str, int], cache_size: int) -> Callable[[list[str | None]], list[int]]:
    """Counts for a slice of texts, with the lengths that this worker keeps."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _workers:
        _workers[path] = (tokenizer(path), {})
    tok, known = _workers[path]

    def count(texts: list[str | None]) -> list[int]:
        if len(known) > cache_size + len(table):
            known.clear()
        if not known:
            known.update(table)
        out, cut, whole = [0] * len(texts), [], []
        for i, t in enumerate(texts):
            if t:
                if _OTHER.search(t):
                    whole.append(i)
                else:
                    cut.append((i, _PRE_TOKEN.findall(t.lower())))
        new = set().union(*(w for _, w in cut)) - known.keys()
        if new:
            new = sorted(new)
            for k in range(0, len(new), 20_000):
                known.update(zip(new[k : k + 20_000], _encoded(tok, new[k : k + 20_000]), strict=True))
        for i, w in cut:
            out[i] = sum(map(known.__getitem__, w))
        for i in whole:
            out[i] = len(tok.encode(texts[i], add_special_tokens=False))
        return out

    return count


def sliced(texts: pa.Array, chars: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    """The texts of a batch in lists of about `chars` bytes, one text at least."""
    own, total = [], 0
    for t in texts:
        t = t.as_py()
        own.append(t)
        total += len(t) if t else 0
        if total >= chars:
            yield own
            own, total = [], 0
    if own:
        yield own


def count_tokens(docs: DataFrame, path: str, text: str = "text", into: str = "n_tokens", table_size: int = TABLE_SIZE, cache_size: int = CACHE_SIZE) -> DataFrame:
    """docs with a column `into` (long): tokens of the whole text as the library of the file at `path` counts them.

    A null or empty text has 0 tokens. Every row is kept, repeated rows and null ids too; a column of docs that is
    called `into` is replaced. An empty table gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent(docs, text, path, table_size))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns if c != into]).alias("row"), docs[text].alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _counter(path, table.value, cache_size)
        for b in batches:
            n = [k for part in sliced(b.column(1)) for k in counted(part)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["row", "n"])

    from pyspark.sql.types import LongType, StructField, StructType

    out = rows.mapInArrow(lean(count), StructType([rows.schema["row"], StructField("n", LongType())]))
    return out.select("row.*", F.col("n").alias(into))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document (contract of op2)."""
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    out = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
