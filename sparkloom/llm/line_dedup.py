"""Line dedup by content-defined chunks of lines, in DataFrame and SQL functions only.

A rolling hash over the hashes of a line and the one before it decides where a chunk ends, so boundaries depend on
nearby lines alone and an inserted line shifts no later chunk. Chunks come in two sizes: between the lines that the hash
marks (one in DIVISOR), so that a long passage is a few chunks; and, as no marked line need lie in a short passage or
near its ends, every two lines in a row. A chunk of two lines or more with LEAST bytes in them that stands in several places is
kept where it stands first (least doc_id, then place); elsewhere its lines are removed. So all of a repeated passage of
two lines or more goes, whatever stands around it; single lines stay.

Places of each chunk hash are counted first, as narrow rows with partial aggregates; only chunks whose hash repeats carry
their text on (a broadcast bitmap of fixed size spares the others an exchange), and the final grouping is by the text
itself, that is, by comparing its bytes. A hot chunk is one row of the counts, and its places are matched against it by a
join that adaptive execution splits. A document's text moves only if something is removed from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table, trace, traced

#: One line in DIVISOR ends a chunk, by its rolling hash; chunks whose lines have fewer bytes than LEAST stay.
DIVISOR, LEAST = 4, 50

#: Lines of a text t, their hashes and bytes; lines that end a chunk; the chunks as first line, number of lines and a key
#: made of the lines' hashes. Each is bound to a name once, as a lambda evaluates its body per line.
_CHUNKS = r"""
transform(array(split(t, '\\n')), l ->
 transform(array(transform(l, x -> md5(x))), h ->
  transform(array(transform(l, x -> octet_length(x))), w ->
   transform(array(transform(sequence(0, size(l) - 1), i -> i > 0 AND pmod(cast(conv(right(md5(concat(get(h, i - 1), get(h, i))), 6), 16, 10) AS bigint), {divisor}) = 0)), f ->
    transform(array(filter(sequence(0, size(l) - 1), i -> i = size(l) - 1 OR (get(f, i) AND NOT get(f, i - 1)))), e ->
     concat(
      transform(filter(transform(e, (x, j) -> named_struct('i', if(j = 0, 0, get(e, j - 1) + 1), 'n', if(j = 0, x + 1, x - get(e, j - 1)))),
        c -> c.n > 2 AND aggregate(slice(w, c.i + 1, c.n), 0, (s, x) -> s + x) >= {least}), c -> {coarse}),
      if(size(l) < 2, array(), transform(filter(sequence(0, size(l) - 2), i -> get(w, i) + get(w, i + 1) >= {least}), i -> {fine})))
    )[0])[0])[0])[0])[0]
"""
_KEYS = {"coarse": "xxhash64(array_join(slice(h, c.i + 1, c.n), ''))", "fine": "xxhash64(get(h, i), get(h, i + 1))"}


def chunk_keys(text: str = "t", divisor: int = DIVISOR, least: int = LEAST) -> F.Column:
    """array<long>: hashes of the chunks of the column named by `text`."""
    return F.expr(_CHUNKS.format(divisor=divisor, least=least, **_KEYS).replace("split(t,", f"split({text},"))


def chunks(text: str = "t", divisor: int = DIVISOR, least: int = LEAST) -> F.Column:
    """array<struct<i, n, key, text>>: first line, number of lines, hash and text of the chunks."""
    own = {
        "coarse": f"named_struct('i', c.i, 'n', c.n, 'key', {_KEYS['coarse']}, 'text', array_join(slice(l, c.i + 1, c.n), '\n'))",
        "fine": f"named_struct('i', i, 'n', 2, 'key', {_KEYS['fine']}, 'text', concat(get(l, i), '\n', get(l, i + 1)))",
    }
    return F.expr(_CHUNKS.format(divisor=divisor, least=least, **own).replace("split(t,", f"split({text},"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", divisor: int = DIVISOR, least: int = LEAST) -> DataFrame:
    """Per row of docs: row (a struct of its columns), n_lines, removed (numbers of the removed lines, from 0, in order),
    kept (the text without them).

    A chunk inside a document that repeats an earlier one of the same document goes too. Rows that are equal in id and
    text count as one document and fare alike. Null ids come last, so that such rows keep a chunk only if no row with
    an id has it. A null text stays null, with no lines; an empty table gives an empty one.
    """
    last = F.lit((1 << 63) - 1)
    did = F.coalesce(docs[doc_id].cast("long"), last)
    at = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), did.alias("did"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("t"))
    at = at.withColumn("g", F.when(F.col("t").isNotNull(), F.xxhash64("did", "h")))
    texts = at.where("t IS NOT NULL")
    counts = texts.select(F.explode(chunk_keys(divisor=divisor, least=least)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # Tables, so that a join with them has an exchange on either side, whose hot keys can be split.
    keys = stored(counts.where("n > 1").select("key"), "line-keys")
    places = texts.select("did", "h", F.explode(chunks(divisor=divisor, least=least)).alias("x")).select("did", "h", "x.*")
    repeated, _ = traced(places, "key", trace(keys, "key"))
    repeated = stored(repeated.join(keys, "key"), "line-chunks")
    place = F.struct("did", "h", "i")
    first = repeated.groupBy("key", "text").agg(F.min(place).alias("first"), F.max(place).alias("end")).where("first <> end").drop("end")
    first = stored(first, "line-first")
    gone = repeated.join(first, ["key", "text"]).where(place != F.col("first")).select("did", "h", F.explode(F.expr("sequence(i, i + n - 1)")).alias("line"))
    gone = stored(gone.groupBy("did", "h").agg(F.sort_array(F.collect_set("line")).alias("removed")), "line-gone")
    discard(keys, repeated, first)

    some, whole = traced(at, "g", stored(trace(gone.select(F.xxhash64("did", "h").alias("g")), "g"), "line-trace"))
    none = F.array().cast("array<int>")
    some = some.join(gone, ["did", "h"], "left").select("row", F.coalesce("removed", none).alias("removed"), "t")
    out = some.unionByName(whole.select("row", none.alias("removed"), "t"))
    # Both array_except and the lookups take time in proportion to the lines.
    kept = F.expr("transform(array(split(t, '\\\\n')), l -> array_join(transform(array_except(sequence(0, size(l) - 1), removed), i -> get(l, i)), '\\n'))[0]")
    lines = F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.expr("regexp_count(t, '\\\\n') + 1"))
    return out.select("row", lines.alias("n_lines"), "removed", F.when(F.size("removed") == 0, F.col("t")).otherwise(kept).alias("kept"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup removes from every document, and the bytes and checksum of what is left."""
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("removed_lines"), F.coalesce(F.octet_length("kept"), F.lit(0)).cast("long").alias("kept_bytes"),
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
