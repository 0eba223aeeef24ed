"""K-d tree sharding: documents are split at weighted medians of their metadata until each leaf is one shard.

Equal texts are one *unit* with the group's bytes; a group larger than nine tenths of a shard is cut into pieces by its
rows' ids, which are units of their own. A node of the tree is split across its widest dimension (of the scaled metadata:
bytes, source, language, id) at the weighted quantile that gives both sides the bytes of their leaves. A unit's coordinate
is followed by bits of its hash, so that ties of a dimension can be split anywhere. What lies before the cut goes left,
what lies behind it right; the few units at the cut itself (ZONE at most) are dealt, largest first, to the side that lacks
most, so both sides come out even. Units beyond a quarter of a shard, which no quantile could balance, are dealt like that
before the node's quantile is looked for.

Quantiles are found for all nodes of a level at once by radix histograms over the stored units: some bytes summed per
node and bin (2,048 bins at most), then again within the bin that holds the quantile. So what the driver reads is bounded
by the shards, not by the data. What differs between passes - each node's dimension, bin and split - is a small broadcast
table, so all passes share one compiled plan; units are written with their new node after each level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table

SHARDS = 24
#: Shares of a shard: groups that are cut, the pieces, units dealt before the quantile, groups joined by a broadcast.
WHOLE, PIECE, BIG, NOTED = 0.9, 0.01, 0.25, 0.01
DIM_BITS, HASH_BITS, STEP_BITS = 20, 42, 11
#: Units at a cut.
ZONE = 64

DIMENSIONS = ("d_bytes", "d_source", "d_lang", "d_id")
GROUP = ("h", "crc", "size")
UNIT = (*GROUP, "piece")


def _place(c: F.Column) -> F.Column:
    """Where a name stands in its dimension: a hash of the whole of it."""
    return F.pmod(F.xxhash64(c.cast("string"), c.isNull()), F.lit(1 << DIM_BITS)).cast("double")


def with_group(docs: DataFrame, doc_id: str, text: str, source: str, lang: str, keep: list[str]) -> DataFrame:
    """row (a struct of the columns to keep), id, h, crc, size and the dimensions; equal texts agree in h, crc, size."""
    t = docs[text].cast("string")
    size = (F.coalesce(F.octet_length(t), F.lit(0)) + 8).cast("long")
    return docs.select(
        F.struct(*[docs[c] for c in keep]).alias("row"), docs[doc_id].cast("string").alias("id"), F.xxhash64(t, t.isNull()).alias("h"),
        F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("crc"), size.alias("size"), F.log2(size.cast("double")).alias("d_bytes"),
        _place(docs[source]).alias("d_source"), _place(docs[lang]).alias("d_lang"), F.coalesce(docs[doc_id].cast("double"), F.lit(0.0)).alias("d_id"),
    )


def deal(units: list[tuple], room: list[float]) -> list[int]:
    """The side (0 or 1) of each unit (bytes, *key): largest first, to the side with more room left."""
    left, side = list(room), [0] * len(units)
    for i in sorted(range(len(units)), key=lambda i: (-units[i][0], units[i][1:])):
        side[i] = int(left[1] > left[0])
        left[side[i]] -= units[i][0]
    return side


def window(bins: list[tuple[int, int, int]], at: int, most: int) -> tuple[int, int]:
    """First and last place in bins (bin, bytes, units) of the run around `at` that has `most` units at most."""
    a, b, n = at, at, bins[at][2]
    while True:
        more = [(bins[i][2], i) for i in (a - 1, b + 1) if 0 <= i < len(bins) and n + bins[i][2] <= most]
        if not more:
            return a, b
        units, i = min(more)
        a, b, n = min(a, i), max(b, i), n + units


def _sums(units: DataFrame, open_: dict[int, dict], big: float) -> dict[int, list[tuple[int, int, int]]]:
    """(bin, bytes, units) in order, of the nodes that are being split; only units within a node's present bin count."""
    rows = [(a, x["dim"], x["shift"], max(0, x["shift"] - STEP_BITS), x["prefix"]) for a, x in open_.items()]
    state = units.sparkSession.createDataFrame(rows, "node int, dim int, shift int, next int, prefix long")
    at = units.where(F.col("bytes") <= big).join(F.broadcast(state), "node").withColumn("key", F.expr("element_at(keys, dim + 1)"))
    sums = at.where("shiftright(key, shift) = prefix").groupBy("node", F.expr("shiftright(key, next)").alias("bin"))
    out: dict[int, list] = {}
    for r in sums.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():  # at most 2^STEP_BITS for each node
        out.setdefault(r.node, []).append((r.bin, r.bytes, r.n))
    return {a: sorted(bins) for a, bins in out.items()}


def split(units: DataFrame, shards: int, target: float) -> DataFrame:
    """units (h, crc, size, piece, bytes, keys, node) with node the unit's leaf. A node is named by the first of its
    leaves, a to b - 1; it is split in the middle of them."""
    spark, big = units.sparkSession, max(1.0, BIG * target)
    nodes = [(0, shards)]
    while todo := [n for n in nodes if n[1] - n[0] > 1]:
        wide = [F.max(F.expr(f"shiftright(keys[{d}], {HASH_BITS})")) - F.min(F.expr(f"shiftright(keys[{d}], {HASH_BITS})")) for d in range(len(DIMENSIONS))]
        seen = {r.node: r for r in units.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[w.alias(f"w{d}") for d, w in enumerate(wide)]).collect()}
        large: dict[int, list] = {}
        for r in units.where(F.col("bytes") > big).select("node", "bytes", *UNIT).collect():  # at most 1 / BIG for each shard
            large.setdefault(r.node, []).append(tuple(r)[1:])
        open_, cuts, dealt = {}, [], []
        for a, b in todo:
            r, mid = seen.get(a), (a + b) // 2
            if r is None:
                continue
            share = (mid - a) / (b - a)
            room = [r.bytes * share, r.bytes * (1 - share)]
            own = large.get(a, [])
            for u, side in zip(own, deal(own, room), strict=True):
                room[side] -= u[0]
                dealt.append((a, *u[1:], mid if side else a))
            dim = max(range(len(DIMENSIONS)), key=lambda d: (r[f"w{d}"], -d))
            if sum(u[0] for u in own) < r.bytes:
                open_[a] = {"mid": mid, "dim": dim, "room": room, "prefix": 0, "shift": DIM_BITS + HASH_BITS}
        zones: list[tuple] = []
        while open_:
            sums = _sums(units, open_, big)
            for a in list(open_):
                x, bins = open_[a], sums[a]
                shift, below = max(0, x["shift"] - STEP_BITS), 0
                for i, (bin_, size, n) in enumerate(bins):
                    if below + size >= x["room"][0] or i == len(bins) - 1:
                        break
                    below += size
                if n <= ZONE or shift == 0:
                    lo, hi = window(bins, i, ZONE)
                    room = [x["room"][0] - sum(s for _, s, _ in bins[:lo]), x["room"][1] - sum(s for _, s, _ in bins[hi + 1 :])]
                    zones.append((a, x["dim"], bins[lo][0] << shift, ((bins[hi][0] + 1) << shift) - 1, x["mid"], room))
                    del open_[a]
                else:
                    room = [x["room"][0] - below, x["room"][1] - sum(s for _, s, _ in bins[i + 1 :])]
                    open_[a] = x | {"prefix": bin_, "shift": shift, "room": room}
        zone = spark.createDataFrame([z[:5] for z in zones], "node int, dim int, first long, last long, right int")
        at = units.where(F.col("bytes") <= big).join(F.broadcast(zone), "node").where("element_at(keys, dim + 1) BETWEEN first AND last")
        at_cut: dict[int, list] = {}
        for r in at.select("node", "bytes", *UNIT).collect():  # at most ZONE for each node
            at_cut.setdefault(r.node, []).append(tuple(r)[1:])
        for a, _, _, _, mid, room in zones:
            own = at_cut.get(a, [])
            dealt += [(a, *u[1:], mid if side else a) for u, side in zip(own, deal(own, room), strict=True)]
        nodes = [n for a, b in nodes for n in ([(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > 1 else [(a, b)])]
        to = spark.createDataFrame(dealt, "node int, h long, crc long, size long, piece int, side int")
        moved = units.join(F.broadcast(zone), "node", "left").join(F.broadcast(to), ["node", *UNIT], "left")
        moved = moved.select(*UNIT, "bytes", "keys", F.expr("coalesce(side, if(element_at(keys, dim + 1) > last, right, node))").alias("node"))
        before, units = units, stored(moved, "shard-level")
        discard(before)
    return units


def assign(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Per row of docs, also repeated ones: row (a struct of its columns, or of those to keep), id, size, crc, h, shard.

    A document weighs its UTF-8 bytes plus 8 (a null text has none); shards' bytes come out nearly equal. Rows with
    equal texts (null is a text of its own) share a shard unless their group exceeds nine tenths of one, when it is cut
    by a hash of the ids. A single long document is never cut; a shard may exceed the others by it. Null ids count as 0,
    null sources and languages as names of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    at = with_group(docs, doc_id, text, source, lang, keep or docs.columns)
    sums = (F.sum("size").alias("bytes"), *(F.min(d).alias(d) for d in DIMENSIONS))
    groups = stored(at.groupBy(*GROUP).agg(*sums), "shard-groups")
    ends = groups.agg(F.sum("bytes").alias("all"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    target = max(1.0, (ends["all"] or 0) / shards)
    # At most 1 / WHOLE for each shard.
    hot = [(*(r[c] for c in GROUP), -int(-r.bytes // (PIECE * target))) for r in groups.where(F.col("bytes") > WHOLE * target).collect()]
    cut = spark.createDataFrame(hot, "h long, crc long, size long, pieces int")
    piece = F.coalesce(F.pmod(F.xxhash64("id", "h"), F.col("pieces")), F.lit(0)).cast("int").alias("piece")
    rows = at.join(F.broadcast(cut), [*GROUP], "left").select("row", "id", *GROUP, *DIMENSIONS, piece)
    whole = groups.join(F.broadcast(cut), [*GROUP], "left_anti").withColumn("piece", F.lit(0))
    pieces = rows.join(F.broadcast(cut), [*GROUP], "left_semi").groupBy(*UNIT).agg(*sums)
    units = whole.unionByName(pieces) if hot else whole
    keys = []
    for i, d in enumerate(DIMENSIONS):
        lo, hi = ends[f"lo_{d}"], ends[f"hi_{d}"]
        scaled = (F.col(d) - F.lit(lo)) / F.lit(hi - lo) * F.lit(float((1 << DIM_BITS) - 1)) if lo is not None and hi > lo else F.lit(0)
        low = F.pmod(F.xxhash64(F.lit(i), "h", "crc", "piece"), F.lit(1 << HASH_BITS))
        keys.append(F.shiftleft(scaled.cast("long"), HASH_BITS) + low)
    units = stored(units.select(*UNIT, "bytes", F.array(*keys).alias("keys"), F.lit(0).alias("node")), "shard-level")
    discard(groups)
    placed = split(units, shards, target).select(*UNIT, "bytes", F.col("node").alias("shard"))
    rows = rows.drop(*DIMENSIONS)
    # Larger groups, at most 1 / NOTED for each shard, are known to the rows by a broadcast, so that no key of the
    # other join has over a hundredth of a shard.
    noted = placed.where(F.col("bytes") > NOTED * target).select(*UNIT, F.col("shard").alias("noted"))
    rows = rows.join(F.broadcast(noted), [*UNIT], "left")
    out = ["row", "id", "size", "crc", "h", "shard"]
    rest = rows.where("noted IS NULL").join(placed.drop("bytes"), [*UNIT]).select(*out)
    return rows.where("noted IS NOT NULL").withColumn("shard", F.col("noted")).select(*out).unionByName(rest)


def with_slots(rows: DataFrame, shards: int = SHARDS, per_bin: int = 20_000) -> DataFrame:
    """What assign() gives with `slot` (long): places 0, 1, ... within each shard, without gaps.

    A shard is numbered in bins of about per_bin rows; a bin begins where the bins before it end. Rows that are equal in
    id and text share a bin, in any order.
    """
    rows = stored(rows, "shard-rows")
    bins = max(1, -(-rows.count() // (shards * per_bin)))
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("id", "h"), F.lit(bins)))
    counts = rows.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "bin").orderBy("id", "h", "size")
    out = rows.withColumn("place", F.row_number().over(own) - 1).join(starts, ["shard", "bin"])
    return out.select("row", "id", "size", "crc", "h", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes (contract of op1)."""
    rows = assign(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return with_slots(rows).select(
        "row.doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
