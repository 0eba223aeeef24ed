"""Near-duplicate classes: DartMinHash signatures, banded joining, exact verification, connected components.

A link is a weighted (1 + ln count) or a plain Jaccard similarity of five-word shingles of at least 0.8.

1. A node is a distinct sequence of words, named by 64 bits of its hash (two of 10^9 distinct texts share a name with
   probability 0.03). Copies are one node from the start and never meet in pairs. A map over the documents gives each
   node the bands of its signature and a sketch (8 bits of each coordinate). A node with repeated shingles is signed
   twice, by the weights and by the plain set, which for all others is the same signature; so both kinds of links share
   buckets: with 32 bands of 4 coordinates a pair of similarity 0.8 of either kind shares none with probability 5e-8.
2. Nodes that share a band's bucket are candidates. A bucket's hub is its least node. Pairs of a node with its hubs are
   compared by sketch and, where that may reach the threshold, on their whole texts; links make connected components.
3. A bucket whose members are then still in several classes has all its members of different classes compared in
   blocks of bounded size, by sketch and, where that may reach the threshold, by their whole shingle sets, which travel
   with the members. A pair is compared in the first bucket that it shares. A block sends on only links, and none
   between members that its links join already, so a dense group of n members sends on at most n for each block, and
   a loose one nothing. So every pair that shares a bucket is linked, or in one class already, or known to be
   dissimilar (a link's sketches differ too much with probability 1e-10).

Texts move only where they have to: those of nodes that share a bucket, and rows that have a copy or a link. What can't
have a partner is told beforehand by a broadcast bitmap of fixed size (``common.trace``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dart_minhash as M
from .common import discard, grouped, lean, stored, table, trace, traced
from .token_counts import sliced

THRESHOLD = 0.8
#: Documents signed at once; members compared with a hub in one group; members, and bytes of their shingles, of a block.
SIGNED, GROUP, BLOCK, BLOCK_BYTES = 600, 64, 1024, 16_000_000
#: Sketches of a pair at the threshold agree in 102 of 128 coordinates on average, with a deviation of 4.5.
AGREE = 72
#: Half the width of the band around the threshold in which 32 bits of a shingle's hash don't decide.
DOUBT = 0.005
#: Pairs or members for each partition of a comparison.
PAIRS = 20_000


def _bands(signs: np.ndarray) -> np.ndarray:
    """Keys of the bands: hashes whose last five bits are the band's number."""
    return ((M.bands(signs) & ~np.uint64(31)) | np.arange(signs.shape[1] // (M.K // M.BANDS), dtype=np.uint64)).view(np.int64)


def _signed(rows: DataFrame) -> DataFrame:
    """(t, node, n, keys, sketch) of rows (t, text) with words, at least once for each t (a hash of the text): a hash of
    the words, how many distinct shingles, the bands, and the last 8 bits of the coordinates - of the weighted
    signature, then of the plain one if that differs."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, first = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)
            b = b.take(pa.array(np.sort(first)))
            for start in range(0, b.num_rows, SIGNED):
                part, at = b.slice(start, SIGNED), 0
                for texts in sliced(part.column(1)):
                    own = part.slice(at, len(texts))
                    at += len(texts)
                    sets = M.shingles(texts)
                    twice = [k for k, (_, c, _) in enumerate(sets) if (c > 1).any()]
                    signs = M.signatures([(s, M.weights(c)) for s, c, _ in sets])
                    plain = M.signatures([(sets[k][0], np.ones(len(sets[k][0]))) for k in twice])
                    some = pa.array([len(s) > 0 for s, _, _ in sets])
                    node = pa.array([int.from_bytes(x[:8], "little", signed=True) if x else None for _, _, x in sets], pa.int64())
                    keys, marks = list(_bands(signs)), [x.astype(np.uint8).tobytes() for x in signs]
                    for k, more, sign_ in zip(twice, _bands(plain), plain, strict=True):
                        keys[k], marks[k] = np.union1d(keys[k], more), marks[k] + sign_.astype(np.uint8).tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [own.column(0), node, pa.array([len(s) for s, _, _ in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                        names=["t", "node", "n", "keys", "sketch"],
                    ).filter(some)

    return rows.mapInArrow(lean(sign), "t long, node long, n int, keys array<long>, sketch binary")


def both_sketches(marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted and plain sketches, a row each."""
    return tuple(np.frombuffer(b"".join(x), np.uint8).reshape(-1, M.K) for x in ([m[: M.K] for m in marks], [m[-M.K :] for m in marks]))


def _grouped_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of consecutive rows with equal first `keys` columns, over batch borders; the rest of each row."""
    key, own = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != key:
                if own:
                    yield key, own
                key, own = row[:keys], []
            own.append(row[keys:])
    if own:
        yield key, own


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The links among pairs (a, b): those whose texts (node, text, sketch) are similar.

    A b that many pairs have is sent once for each GROUP of them, so no task gets an unbounded group."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    own = pairs.select("a", "b").join(sizes.hint("shuffle_hash"), "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    members = own.select("b", "part", F.lit(1).alias("role"), F.col("a").alias("node"))
    hubs = own.select("b", "part").distinct().select("b", "part", F.lit(0).alias("role"), F.col("b").alias("node"))
    rows = members.unionByName(hubs).join(texts, "node").select("b", "part", "role", "node", "text", "sketch")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_marks, hub_set = None, None, None
        for b in batches:
            found = []
            marks = list(zip(*both_sketches(b.column(5).to_pylist()), strict=True))
            heads, roles, nodes = (b.column(i).to_pylist() for i in (0, 2, 3))
            todo = []
            for k, role in enumerate(roles):
                if role == 0:
                    hub, hub_marks = k, marks[k]
                    todo.append(k)
                elif max(int((marks[k][0] == hub_marks[0]).sum()), int((marks[k][1] == hub_marks[1]).sum())) >= AGREE:
                    todo.append(k)
            for first in range(0, len(todo), SIGNED):
                at = todo[first : first + SIGNED]
                part = b.column(4).take(pa.array(at))
                for texts_ in sliced(part):
                    for k, (s, c, _) in zip(at, M.shingles(texts_), strict=False):
                        if roles[k] == 0:
                            hub_set = (s, c)
                        elif max(M.similarity((s, c), hub_set)) >= threshold - 1e-9:
                            found.append((nodes[k], heads[k]))
                    at = at[len(texts_) :]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    n = grouped(pairs, pairs.count(), PAIRS)
    return rows.repartition(n, "b", "part").sortWithinPartitions("b", "part", "role").mapInArrow(lean(compare), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b): the least node of each connected component.

    Alternates large and small stars until nothing changes, each round a few shuffles of narrow rows; a hub's edges are
    joined with its one least neighbour, never gathered. The joins build maps of one row for each node, dealt evenly, which
    takes less memory than sorting and keeps the driver out of it.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    open_ = True
    while open_:
        both = e.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least.hint("shuffle_hash"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.hint("shuffle_hash"), "a")
        to = F.explode(F.when(F.col("b") == F.col("m"), F.array(F.struct("a", "m"))).otherwise(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))))
        spent, e = e, stored(small.select(to.alias("x")).select(F.col("x.a").alias("a"), F.col("x.m").alias("b")).distinct(), "near-edges")
        discard(spent)
        # Stars are left when each a has one edge and is no other's b.
        ends = e.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("y"))
        open_ = not ends.select("y.*").groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1").isEmpty()
    out = stored(e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "near-found")
    discard(e)
    return out


def _with_roots(rows: DataFrame, column: str, roots: DataFrame, into: str) -> DataFrame:
    r = roots.select(F.col("node").alias(column), F.col("root").alias(into))
    return rows.join(r.hint("shuffle_hash"), column, "left").withColumn(into, F.coalesce(into, column))


def _sets(texts: DataFrame) -> DataFrame:
    """(node, sketch, shingles) of texts (node, text, sketch): 32 bits of each distinct shingle's hash, in order, and its count."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts_ in sliced(b.column(1)):
                own = []
                for s, c, _ in M.shingles(texts_):
                    high, first = np.unique((s >> np.uint64(32)).astype(np.uint32), return_index=True)
                    own.append(high.tobytes() + np.minimum(c[first], 65535).astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(at, len(texts_)) for i in (0, 2)), pa.array(own, pa.binary())], names=["node", "sketch", "shingles"])
                at += len(texts_)

    return texts.select("node", "text", "sketch").mapInArrow(lean(pack), "node long, sketch binary, shingles binary")


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 6
    return np.frombuffer(packed, np.uint32, n), np.frombuffer(packed, np.uint16, n, 4 * n)


def _links_in_block(band: int, part: tuple[int, int], rows: list[tuple], threshold: float) -> list[tuple[int, int]]:
    """Links between members (part, node, hub, root, sketch, shingles) of two parts (or of one) of a bucket of `band`."""
    parts, node, hub, root, sketch, shingles = zip(*rows, strict=True)
    parts, node = np.array(parts), np.array(node, np.int64)
    marks = both_sketches(sketch)
    words = [np.ascontiguousarray(m).view(np.uint32) for m in marks]  # a band's four coordinates
    sets = [_unpacked(s) for s in shingles]
    up = {r: r for r in root}

    def find(r: int) -> int:
        while up[r] != r:
            up[r] = up[up[r]]
            r = up[r]
        return r

    left, right = np.flatnonzero(parts == part[0]), np.flatnonzero(parts == part[1])
    out = []
    for x in left:
        # The hub has been compared with all members.
        if node[x] == hub[0]:
            continue
        near = right[((node[right] > node[x]) | (part[0] != part[1])) & (node[right] != hub[0])]
        near = near[np.maximum((marks[0][near] == marks[0][x]).sum(1), (marks[1][near] == marks[1][x]).sum(1)) >= AGREE]
        if not len(near):
            continue
        shared = np.zeros((len(near), M.BANDS), bool)
        for own in words:
            for other in words:
                shared |= own[near] == other[x]
        near = near[shared.argmax(1) == band]  # in their first bucket
        for y in near.tolist():
            a, b = find(root[x]), find(root[y])
            if a != b and (like := max(M.similarity(sets[x], sets[y]))) >= threshold - DOUBT:
                out.append((max(int(node[x]), int(node[y])), min(int(node[x]), int(node[y]))))
                if like >= threshold + DOUBT:
                    up[max(a, b)] = min(a, b)
    return out


def _blocks(members: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of members (key, node, n, hub) of a bucket in different classes that are, or may just be, links."""
    opened = stored(_with_roots(members, "node", roots, "root"), "near-open")
    mixed = opened.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(6 * F.col("n") + 3 * M.K).alias("bytes"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi AND size > 2")
    parts = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    m = opened.join(mixed.select("key", parts.alias("parts")), "key")
    m = mixed_members = stored(m.withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int")), "near-mixed")
    open_ = m.select("node").distinct()
    whole = sets = stored(_sets(texts.join(open_, "node", "left_semi")), "near-sets")
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    m = m.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "hub", "root").join(whole, "node")
    m = m.select("key", "i", "j", "part", "node", "hub", "root", "sketch", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), rows in _grouped_rows(batches, 3):
            found = _links_in_block(key & 31, (i, j), rows, threshold)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    n = grouped(m, mixed_members.count(), PAIRS)
    out = stored(m.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(compare), "a long, b long").distinct(), "near-rest")
    discard(opened, mixed_members, sets)
    return out


def link_roots(rows: DataFrame, signed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of those nodes of rows (t, text) that have links: the least node of each class. signed: _signed(rows)."""
    members = signed.select("node", "n", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub")
    # As a table, so that the join with it has an exchange on either side, whose hot keys can be split.
    buckets = stored(buckets, "near-buckets")
    members, _ = traced(members, "key", trace(buckets, "key"))
    members = stored(members.join(buckets.hint("shuffle_hash"), "key").distinct(), "near-members")
    nodes = members.select("node").distinct()
    own, _ = traced(signed.select("node", "t", "sketch"), "node", trace(nodes, "node"))
    sketches = stored(own.groupBy("node").agg(F.min(F.struct("t", "sketch")).alias("x")).join(nodes, "node", "left_semi").select("node", "x.*"), "near-sketches")
    texts, _ = traced(rows, "t", trace(sketches, "t"))
    # Copies meet before they move: one row of a text from each task.
    texts = texts.groupBy("t").agg(F.first("text").alias("text")).join(sketches, "t")
    texts = stored(texts.select("node", "text", "sketch"), "near-texts")
    discard(buckets)

    pairs = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = stored(pairs, "near-pairs")
    links = stored(verify(pairs, texts, threshold), "near-links")
    roots = components(links)
    rest = _blocks(members, roots, texts, threshold)
    more = stored(verify(rest, texts, threshold), "near-links")
    if not more.isEmpty():
        star = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b")
        spent, roots = roots, components(star.unionByName(more))
        discard(spent)
    discard(members, sketches, texts, pairs, links, rest, more)
    return roots


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: row (a struct of its columns, or of those to keep), class_id, class_size, kept.

    class_id is the least id in the class, null if all are; exactly one row of each class is kept, with that id. Words
    are lower-cased runs of letters, digits and characters beyond ASCII. Rows without words (null, empty) are classes
    of their own, repeated rows share one. An empty table gives an empty one.
    """
    last = F.lit((1 << 63) - 1)
    t = F.when(docs[text].isNotNull(), F.xxhash64(docs[text])).alias("t")
    texts = docs.select(t, docs[text].cast("string").alias("text")).where("t IS NOT NULL")
    signed = stored(_signed(texts), "near-signed")
    roots = link_roots(texts, signed, threshold)
    counts = texts.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    same = signed.select("t", "node").distinct().join(counts, "t")
    copies = same.groupBy("node").agg(F.sum("n").alias("all"))
    of = same.join(copies, "node").join(roots, "node", "left").where("all > 1 OR root IS NOT NULL")
    of = stored(of.select("t", F.coalesce("root", "node").alias("root")), "near-roots")
    discard(roots, signed)

    rows = docs.select(
        F.coalesce(docs[doc_id].cast("long"), last).alias("did"), F.struct(*[docs[c] for c in keep or docs.columns]).alias("row"), t,
    )
    seen = stored(trace(of, "t"), "near-trace")
    several, alone = traced(rows, "t", seen)
    several = stored(several.withColumn("uid", F.monotonically_increasing_id()), "near-rows")
    # A row that only came along is a class of its own.
    joined = several.select("uid", "did", "t").join(of, "t", "left")
    own = stored(joined.select("uid", "did", F.col("root").isNull().alias("single"), F.coalesce("root", "uid").alias("root")), "near-own")
    heads = own.groupBy("single", "root").agg(F.min(F.struct("did", "uid")).alias("head"), F.count(F.lit(1)).alias("class_size"))
    heads = stored(heads, "near-heads")
    told = stored(own.join(heads, ["single", "root"]).select("uid", F.when(F.col("head.did") < last, F.col("head.did")).alias("class_id"), "class_size", (F.col("uid") == F.col("head.uid")).alias("kept")), "near-told")
    discard(of, own, heads)
    single = alone.select("row", F.when(F.col("did") < last, F.col("did")).alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return several.select("uid", "row").join(told, "uid").select("row", "class_id", "class_size", "kept").unionByName(single)


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one row of each near-duplicate class."""
    return classes(docs, **parameters).where("kept").select("row.*")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, and whether it is the one that stays."""
    out = classes(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "class_id", "class_size", "kept")
