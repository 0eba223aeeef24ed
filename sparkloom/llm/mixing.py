"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

A document of a source has the expected number of copies ``target / source_size`` (at most 3). Its whole part is
certain; its fraction is a probability. The pivotal method pairs two documents of a source and moves *words* (size
times probability) at random from one to the other until one probability is 0 or 1. Each move keeps the source's
words exactly and every document's expectation, so a source ends within one document of its target.

Pairs are made in a reduction tree. Documents are dealt by a hash into chunks of about ``fan_in``; a chunk is rounded
in order by a fold over its array and leaves one document undecided; ``fan_in`` chunks' residuals make a chunk of the
next level, until each source has one residual, which a last draw settles. A chunk is folded from its longest to its
shortest documents: the long ones are settled while there is mass to settle them, and a short one is left over. A level has ``1 / fan_in`` of the rows of
the one before, so the first exchange of narrow rows (no texts) is nearly all that moves. A hot source only has more
chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FAN_IN = 64
MOST_COPIES = 3.0

SIZE = r"regexp_count(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"

#: One pivotal step: s.cur is the undecided document, x the next one. One of them is decided, the other carried on.
_STEP = """
transform(array(named_struct('c', s.cur, 'x', x,
    'up', least(s.cur.w * (1 - s.cur.p), x.w * x.p),
    'dn', least(s.cur.w * s.cur.p, x.w * (1 - x.p)))), v ->
  transform(array(named_struct('gain', v.x.u * (v.up + v.dn) < v.dn,
      'cur_done', if(v.x.u * (v.up + v.dn) < v.dn, v.up >= v.c.w * (1 - v.c.p), v.dn >= v.c.w * v.c.p),
      'move', if(v.x.u * (v.up + v.dn) < v.dn, v.up, -v.dn))), d ->
    named_struct(
      'cur', if(d.cur_done, {carry_x}, {carry_c}),
      'outs', concat(s.outs, array(if(d.cur_done, {done_c}, {done_x}))))
  )[0])[0]
"""


def _element(of: str, p: str) -> str:
    return (
        f"named_struct('k', {of}.k, 'id', {of}.id, 'h', {of}.h, 'size', {of}.size, 'm', {of}.m, 'base', {of}.base, "
        f"'w', {of}.w, 'p', least(greatest({p}, 0D), 1D), 'u', {of}.u)"
    )


def _decided(of: str, extra: str) -> str:
    return f"named_struct('id', {of}.id, 'h', {of}.h, 'size', {of}.size, 'm', {of}.m, 'copies', {of}.base + {extra})"


_FOLD = (
    "aggregate(slice(a, 2, size(a)), named_struct('cur', a[0], 'outs', "
    "filter(array({none}), o -> false)), (s, x) -> {step})"
).format(
    none=_decided("a[0]", "0"),
    step=_STEP.format(
        carry_x=_element("v.x", "(v.x.w * v.x.p - d.move) / v.x.w"),
        carry_c=_element("v.c", "(v.c.w * v.c.p + d.move) / v.c.w"),
        done_c=_decided("v.c", "if(d.gain, 1, 0)"),
        done_x=_decided("v.x", "if(d.gain, 0, 1)"),
    ),
)


def _uniform(seed: int, *cols: str) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = MOST_COPIES) -> DataFrame:
    """Per source of (source, source_size): its weight and target.

    Sources in code-point order (null last) take the weights in turn and share the total by them. No target exceeds
    ``most`` times its source's size; the excess is shared again by weight among the others until none is above:
    the targets are ``min(most * size, level * weight)`` for the one level at which they add up to the total.
    One row per source passes through the two global windows here, never the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    s = sizes.withColumn("weight", weight)
    s = s.withColumn("bound", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    # The first source that its level does not fill up sets the level for all that follow.
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct(F.col("bound") / F.col("weight"), "level"))).over(whole)
    return s.select(
        "source", "source_size", "weight",
        F.least(F.col("bound"), F.coalesce(free["level"] * F.col("weight"), F.col("bound"))).alias("target"),
    )


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Narrow rows to decide on: one for each distinct (source, doc_id, text), `m` of which are in docs."""
    at = docs.select(
        docs[source].alias("source"), docs[doc_id].alias("id"), F.xxhash64(docs[text]).alias("h"),
        F.expr(SIZE.format(text=f"`{text}`")).cast("long").alias("size"),
    )
    return at.groupBy("source", "id", "h", "size").agg(F.count(F.lit(1)).alias("m"))


def decide(docs: DataFrame, seed: int = 20, fan_in: int = FAN_IN, **columns: str) -> DataFrame:
    """Copies of every document of the mix: source, id, h (hash of the text), size, m, source_size, target, copies.

    Rows that are equal in source, id and text are one unit: all of them get the same number of copies. Documents
    without words move no mass; they are drawn singly. A null text has no words, null ids and sources are values
    like any other. Empty input gives no rows. The same rows give the same result, however they are partitioned.
    """
    unit = stored(units(docs, **columns), "mix-units")
    stats = unit.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("n")
    )
    targets = source_targets(stats.select("source", "source_size"))
    per = stats.select("source", "n").join(
        targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))
    )
    per = stored(per.drop("s").coalesce(1), "mix-sources")  # a row for each source
    most = (per.agg(F.max("n")).first()[0] or 0)

    joined = unit.withColumnRenamed("source", "src").join(per, F.col("src").eqNullSafe(F.col("source"))).drop("src")
    pi = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    p = F.col("pi") - F.col("base")
    joined = (
        joined.withColumn("pi", F.when(F.abs(pi - F.round(pi)) < 1e-12, F.round(pi)).otherwise(pi))
        .withColumn("base", F.floor("pi").cast("int"))
        .withColumn("p", p)
        .withColumn("u", _uniform(seed, "id", "h"))
    )
    certain = (F.col("size") == 0) | (F.col("p") <= 0)
    found = [
        joined.where(certain).select(
            "source", "id", "h", "size", "m",
            (F.col("base") + F.when(F.col("u") < F.col("p"), 1).otherwise(0)).alias("copies"),
        )
    ]
    chunks = F.ceil(F.col("n") / fan_in)
    rows = joined.where(~certain).select(
        "source", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "h"), chunks).alias("chunk"),
        F.struct(
            (-F.col("size") * F.col("m")).alias("k"), "id", "h", "size", "m", "base",
            (F.col("size") * F.col("m")).cast("double").alias("w"), "p", "u",
        ).alias("e"),
    )
    left = -(-most // fan_in)
    level = 0
    while True:
        level += 1
        lists = rows.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("e")).alias("a"))
        done = stored(lists.select("source", "chunk", F.expr(_FOLD).alias("r")), f"mix-level{level}")
        found.append(done.select("source", F.explode("r.outs").alias("o")).select("source", "o.*"))
        cur = done.select("source", "chunk", "r.cur.*")
        if left <= 1:
            break
        left = -(-left // fan_in)
        fresh = cur.withColumn("u", _uniform(seed + 10 * level, "id", "h"))
        rows = fresh.select(
            "source", F.floor(F.col("chunk") / fan_in).alias("chunk"),
            F.struct("k", "id", "h", "size", "m", "base", "w", "p", "u").alias("e"),
        )
    last = F.when(_uniform(seed + 10 * level, "id", "h") < F.col("p"), 1).otherwise(0)
    found.append(cur.select("source", "id", "h", "size", "m", (F.col("base") + last).alias("copies")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    to = per.select(F.col("source").alias("s"), "source_size", "target")
    return out.join(to, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def mix(docs: DataFrame, **columns: str) -> DataFrame:
    """The mixed corpus: each row of docs as many times as it was decided, columns unchanged."""
    text, doc_id, source = columns.get("text", "text"), columns.get("doc_id", "doc_id"), columns.get("source", "source")
    chosen = decide(docs, **columns).where("copies > 0").select(
        F.col("source").alias("to_source"), F.col("id").alias("to_id"), F.col("h").alias("to_h"), "copies"
    )
    # A row travels as one struct, whatever its columns are called.
    at = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source].alias("source"), docs[doc_id].alias("id"), F.xxhash64(docs[text]).alias("h"))
    on = at["id"].eqNullSafe(chosen["to_id"]) & (at["h"] == chosen["to_h"]) & at["source"].eqNullSafe(chosen["to_source"])
    return at.join(chosen, on).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("row.*")


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each (contract of op4)."""
    from .common import table

    d = decide(table(spark, sf_dir, "documents"))
    d = d.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return d.select(
        F.col("id").alias("doc_id"), "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "source",
    )
