"""Benchmark decontamination with suffix arrays over shards of the training documents.

A shard is some megabytes of documents, in the order in which Spark reads them; its words become integers and the
suffixes that can hold a benchmark window are sorted by prefix doubling (a sparse suffix array: a suffix whose run of
benchmark words is shorter than the shortest window can hold none). Every suffix of every benchmark item is
binary-searched in it, word by word, which gives its longest verbatim match with all places, and for the window that
starts there the range of suffixes that begin with it. Nothing is shuffled: a document's result depends on itself and
on the benchmark alone.

The benchmark is dealt into blocks of at most ``block_words`` words (an item beyond that is a block of its own), so
what is broadcast is bounded however many items there are; the documents pass each block in turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, words_of
from .token_counts import sliced

WINDOW = 13
BLOCK_WORDS = 400_000
SHARD_CHARS = 3_000_000


class Block:
    """Items of the benchmark as integers: ids from 1, 0 for any other word."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.longest = max(len(words) for _, words in items)
        self.shortest = min(min(window, len(words)) for _, words in items)
        flat, item, left = [], [], []
        for k, (_, words) in enumerate(items):
            flat += map(self.vocabulary.__getitem__, words)
            item += [k] * len(words)
            left += range(len(words), 0, -1)
        self.words = np.array([*flat, 0], np.int32)
        self.item = np.array(item, np.int64)
        self.left = np.array(left, np.int64)  # words from here to the item's end
        length = np.array([len(w) for _, w in items], np.int64)
        self.width = np.minimum(window, length)[self.item]  # of a window of this item
        self.starts = self.left >= self.width


def suffix_array(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """`at` in the order of the suffixes of words that start there, compared up to `depth` words or the first 0."""
    if not len(at):
        return at
    rank = np.zeros(len(words) + 1, np.int64)
    rank[:-1] = words  # order of the first word; h words are in order after each round
    order, h = at[np.argsort(words[at], kind="stable")], 1
    while h < depth:
        # A suffix that ends within h words has nothing after it; the rank of its end, a 0, is 0.
        key = rank[at] * (int(rank.max()) + 1) + _after(rank, words, at, h)
        by = np.argsort(key, kind="stable")
        order, sorted_key = at[by], key[by]
        new = np.empty(len(at), np.int64)
        new[0] = 1
        new[1:] = 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])
        rank = np.zeros(len(words) + 1, np.int64)
        rank[order] = new
        if new[-1] == len(at):
            break
        h *= 2
    return order


def _after(rank: np.ndarray, words: np.ndarray, at: np.ndarray, h: int) -> np.ndarray:
    return rank[np.minimum(at + h, len(rank) - 1)]


def search(block: Block, words: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Binary search of all suffixes of the block: length of the longest match and one place of it (-1: none), and
    the range of the array whose suffixes begin with the window that starts there (empty: none)."""
    n, m = len(block.item), len(array)
    lo, hi = np.zeros(n, np.int64), np.full(n, m, np.int64)
    length, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    padded = np.concatenate([words, np.zeros(block.longest + 1, words.dtype)])
    live = np.flatnonzero(hi > lo)
    k = 0
    while len(live):
        want = block.words[live + k]
        bounds = []
        for upper in (False, True):
            a, b = lo[live].copy(), hi[live].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                have = padded[array[np.minimum(mid, m - 1)] + k]
                right = open_ & ((have <= want) if upper else (have < want))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            bounds.append(a)
        found = bounds[0] < bounds[1]
        live, k = live[found], k + 1
        lo[live], hi[live] = bounds[0][found], bounds[1][found]
        length[live], place[live] = k, array[lo[live]]
        full = live[block.width[live] == k]
        first[full], last[full] = lo[full], hi[full]
        live = live[block.left[live] > k]
    return length, place, first, last


class Shard:
    """Some documents as integers, with the suffix array of the places that can hold a window of the block."""

    def __init__(self, block: Block, texts: list[str | None]):
        get, zero, parts, self.length, starts, total = block.vocabulary.get, repeat(0), [], [], [], 0
        for t in texts:
            w = words_of(t)
            self.length.append(len(w))
            starts.append(total)
            parts.append(np.fromiter(map(get, w, zero), np.int32, len(w)))
            parts.append(np.zeros(1, np.int32))
            total += len(w) + 1
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        self.start = np.array(starts, np.int64)
        ends = np.flatnonzero(self.words == 0)
        at = np.flatnonzero(self.words)
        after = np.searchsorted(ends, at)
        run = ends[after] - at if len(at) else at  # benchmark words from here on
        whole = run + at - np.where(after > 0, ends[after - 1] + 1, 0) if len(at) else at
        # All of a run takes part in sorting, as the order of its start depends on its end.
        keep = whole >= block.shortest
        order = suffix_array(self.words, at[keep], block.longest)
        self.array = order[np.isin(order, at[run < block.shortest], invert=True)]

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, places, "right") - 1


def hits(block: Block, texts: list[str | None]) -> list[tuple[int, np.ndarray, set[str]]]:
    """Per text: its number of words, the places of hit words, the items that have a window in it."""
    s = Shard(block, texts)
    n = len(texts)
    spans: list[np.ndarray] = [np.zeros(0, np.int64)] * n
    items: list[set[str]] = [set() for _ in range(n)]
    if len(s.array):
        _, _, first, last = search(block, s.words, s.array)
        of = np.flatnonzero(block.starts & (last > first))
        if len(of):
            delta = np.zeros(len(s.words) + 1, np.int64)
            ranges = np.unique(np.stack([first[of], last[of], block.width[of]], 1), axis=0)
            for a, b, width in ranges.tolist():
                at = s.array[a:b]
                np.add.at(delta, at, 1)
                np.add.at(delta, at + width, -1)
            hit = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
            cut = np.searchsorted(hit, s.start)
            for d, (a, b) in enumerate(zip(cut, [*cut[1:], len(hit)], strict=True)):
                if b > a:
                    spans[d] = hit[a:b] - s.start[d]
            pairs = {}
            for k in of.tolist():
                pairs.setdefault((first[k], last[k]), set()).add(int(block.item[k]))
            for (a, b), names in pairs.items():
                named = {block.names[i] for i in names}
                for d in np.unique(s.document(s.array[a:b])).tolist():
                    items[d] |= named
    return [(s.length[d], spans[d], items[d]) for d in range(n)]


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[Block]:
    """The benchmark in blocks, read a partition at a time; items without words are left out."""
    own, total = [], 0
    for name, t in benchmark.select(benchmark[item_id].cast("string"), benchmark[text]).toLocalIterator():
        words = words_of(t)
        if words:
            if own and total + len(words) > block_words:
                yield Block(own, window)
                own, total = [], 0
            own.append(("" if name is None else name, words))
            total += len(words)
    if own:
        yield Block(own, window)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: row (a struct of its columns, or of those to keep), n_words, hit (places of hit words), items (sorted ids).

    A null or empty text has no words and no hits; an empty benchmark hits nothing. Repeated rows each get their own
    result; items of one id count as one item, a null id as the empty string.
    """
    spark: SparkSession = docs.sparkSession
    columns = keep or docs.columns
    inside = text in columns  # the text travels once
    row = F.struct(*[docs[c] for c in columns]).alias("row")
    out = docs.select(row, (F.lit(None).cast("string") if inside else docs[text]).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<int>").alias("hit"), F.array().cast("array<string>").alias("items"))
    schema = T.StructType([f for f in out.schema])
    any_block = False
    for block in blocks(benchmark, item_id, item_text, window, block_words):
        any_block = True
        sent = spark.sparkContext.broadcast(block)

        def passed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                offset = 0
                for texts in sliced(b.column(0).field(text) if inside else b.column(1), SHARD_CHARS):
                    part = b.slice(offset, len(texts))
                    offset += len(texts)
                    n, hit, items = [], [], []
                    for (length, at, names), h0, i0 in zip(hits(sent.value, texts), part.column(3), part.column(4), strict=True):
                        n.append(length)
                        before, named = h0.as_py(), i0.as_py()
                        hit.append(np.union1d(at, before).astype(np.int32) if before else at.astype(np.int32))
                        items.append(sorted(names.union(named)))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(hit, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["row", "text", "n_words", "hit", "items"])

        out = out.mapInArrow(lean(passed), schema)
    if not any_block:
        out = out.withColumn("n_words", F.expr(rf"regexp_count(coalesce({f'row.`{text}`' if inside else 'text'}, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')").cast("long"))
    return out.drop("text")


CONTAMINATED = "size(hit) > 0 AND 20L * size(hit) >= n_words"


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs without the rows of which a twentieth of the words or more lie in benchmark windows."""
    return contamination(docs, benchmark, **parameters).where(f"NOT ({CONTAMINATED})").select("row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per benchmark item and start word: its longest verbatim match over all shards and one place of it.

    Columns item_id string, item_start, length, doc_id, doc_start. Matches shorter than the shortest window of the
    item's block are not reported. Shards' results meet in a partial aggregate, one row per suffix and shard.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    schema = "item_id string, item_start long, length long, doc_id long, doc_start long"
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, item_id, item_text, window, block_words):
        sent = spark.sparkContext.broadcast(block)

        def matched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b_ = sent.value
            base = np.concatenate([[0], np.cumsum(np.bincount(b_.item, minlength=len(b_.names)))])
            for b in batches:
                offset = 0
                for texts in sliced(b.column(1), SHARD_CHARS):
                    ids = b.column(0).slice(offset, len(texts)).to_pylist()
                    offset += len(texts)
                    s = Shard(b_, texts)
                    if len(s.array):
                        length, place, _, _ = search(b_, s.words, s.array)
                        of = np.flatnonzero(length >= b_.shortest)
                        d = s.document(place[of])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([b_.names[i] for i in b_.item[of]], pa.string()), pa.array(of - base[b_.item[of]]), pa.array(length[of]),
                                pa.array([ids[i] for i in d], pa.int64()), pa.array(place[of] - s.start[d]),
                            ],
                            names=["item_id", "item_start", "length", "doc_id", "doc_start"],
                        )

        out = out.unionByName(docs.mapInArrow(lean(matched), schema))
    best = F.max(F.struct("length", (-F.col("doc_id")).alias("d"), (-F.col("doc_start")).alias("s"))).alias("b")
    return out.groupBy("item_id", "item_start").agg(best).select("item_id", "item_start", "b.length", (-F.col("b.d")).alias("doc_id"), (-F.col("b.s")).alias("doc_start"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document (contract of op6)."""
    from .common import table

    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"),
    )
