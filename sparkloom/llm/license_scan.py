"""License scan by diagonal voting, as one Spark join.

Every document's rolling k-gram hashes are joined with the hashes at all template positions (about 1,500 fixed rows,
broadcast). A match at document word ``pos`` and template word ``t`` votes for the diagonal ``pos - t``: a verbatim copy
puts all votes of a template on one diagonal, an inserted or missing word moves the rest to a neighbouring one. Votes are
bit masks per (document, template, diagonal, 63 template words), so they pre-aggregate and a template may be of any
length; neighbouring diagonals are merged; a span is verified by the share of the template's k-grams that its diagonals
hold (all of them, on one diagonal, for the base phrases). A k-gram votes only if its words are the template's, so an
equal hash alone never counts. All of it is DataFrame code in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, words_of
from .license_texts import BASE, NOTICES

K = 2
#: Template words for each mask.
BITS = 63
#: Diagonals at most this far apart are one span; the share of k-grams that makes a span of a notice.
NEAR, SHARE = 3, 0.85

WORD = r"[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Stands for a document itself among its k-grams, so that each document survives the join; no word holds a space.
_SELF = "xxhash64('a document')"


def templates(spark: SparkSession, base: dict[str, str], notices: dict[str, str], k: int = K) -> DataFrame:
    """Rows (gram, words, tid, tpos, grams, label, exact), one for each template word that begins a k-gram."""
    rows = [(None, -1, 0, 0, None, True)]
    for tid, (phrase, label, exact) in enumerate([*((p, x, True) for p, x in base.items()), *((p, x, False) for p, x in notices.items())]):
        w = [x.decode() for x in words_of(phrase)]
        if len(w) < k:
            raise ValueError(f"a template needs {k} words: {phrase}")
        rows += [(w[i : i + k], tid, i, len(w) - k + 1, label, exact) for i in range(len(w) - k + 1)]
    t = spark.createDataFrame(rows, "words array<string>, tid int, tpos int, grams int, label string, exact boolean")
    gram = F.expr(f"if(tid < 0, {_SELF}, xxhash64({', '.join(f'get(words, {i})' for i in range(k))}))")
    return t.select(gram.alias("gram"), "words", "tid", "tpos", "grams", "label", "exact")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, k: int = K, near: int = NEAR, share: float = SHARE) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans lists the verified places: (label, first, last, share), words from 0. score is the greatest share of a
    template found in one span, 1 for a base phrase. A null or empty text has no words, no labels and score 0. Every
    row of docs has its row, repeated ones and null ids too; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    words = f"regexp_extract_all(translate(coalesce(t, ''), '{UPPER}', '{LOWER}'), '{WORD}', 0)"
    own_words = ", ".join(f"get(w, i + {j})" for j in range(k))
    gram = f"named_struct('gram', xxhash64({own_words}), 'words', array({own_words}))"
    itself = f"array(named_struct('gram', {_SELF}, 'words', cast(null as array<string>)))"
    grams = (
        f"transform(array({words}), w -> named_struct('n', size(w), 'g', concat({itself}, "
        f"if(size(w) < {k}, array(), transform(sequence(0, size(w) - {k}), i -> {gram})))))[0]"
    )
    at = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("t"))
    at = at.select("doc_id", F.xxhash64("t").alias("h"), F.expr(grams).alias("x"))
    at = at.select("doc_id", "h", F.col("x.n").alias("n_words"), F.posexplode("x.g").alias("pos", "g"))
    at = at.select("doc_id", "h", "n_words", "pos", "g.gram", "g.words")
    # By the hash, then word by word.
    same = F.broadcast(templates(spark, base, notices, k).withColumnRenamed("words", "twords"))
    found = at.join(same, "gram").where(F.col("words").eqNullSafe(F.col("twords")))
    own = ["doc_id", "h", "n_words"]
    diagonal = F.when(F.col("tid") < 0, F.lit(0)).otherwise(F.col("pos") - 1 - F.col("tpos"))
    template = ["tid", "grams", "label", "exact"]
    votes = found.groupBy(*own, *template, diagonal.alias("diagonal"), F.expr(f"tpos div {BITS}").alias("part")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, tpos % {BITS})")).alias("mask"), F.count(F.lit(1)).alias("n"),
        F.min(F.col("pos") - 1).alias("lo"), F.max(F.col("pos") - 1).alias("hi"),
    )
    by = Window.partitionBy(*own, "tid").orderBy("diagonal", "part")
    gap = F.col("diagonal") - F.lag("diagonal").over(by)
    fresh = F.when(gap.isNull() | (gap > near) | (F.col("exact") & (gap > 0)), 1).otherwise(0)
    votes = votes.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(by))
    masks = votes.groupBy(*own, "tid", "span", "part", *template[1:]).agg(F.bit_or("mask").alias("mask"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n"))
    spans = masks.groupBy(*own, "tid", "span", *template[1:]).agg(
        F.sum(F.bit_count("mask")).alias("held"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n")
    )
    spans = spans.withColumn("share", F.when(F.col("tid") >= 0, F.col("held") / F.col("grams"))).withColumn(
        "good", F.when(F.col("tid") >= 0, F.when(F.col("exact"), F.col("share") == 1).otherwise(F.col("share") >= share))
    )
    # From the first to the last word that voted.
    first, last = F.col("lo"), F.col("hi") + (k - 1)
    is_base = F.col("exact") & F.col("good")
    kept = F.when(F.col("good"), F.struct("label", first.cast("long").alias("first"), last.cast("long").alias("last"), "share"))
    out = spans.groupBy(*own).agg(
        F.max(F.when(F.col("tid") < 0, F.col("n"))).alias("rows"),
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("lo"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("good"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("exact"), F.when(F.col("good"), F.lit(1.0))).otherwise(F.col("share"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(kept)).alias("spans"),
    )
    # Repeated rows voted together; each of them gets its row back.
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document (contract of op9)."""
    from .common import table

    return scan(table(spark, sf_dir, "documents")).drop("spans")
