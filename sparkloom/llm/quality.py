"""Quality classifier by co-training a text view and a metadata view.

The text view sees how densely a document is set with some words and beginnings of words, and what its characters look
like; the metadata view sees language, source, length and layout. For each of the two flaws that labels tell of (low
quality, toxic) both views are fitted to labelled documents. Then, in rounds, each view labels all documents without a
label that it is sure of, and the other view takes a step towards fitting these too. At last each view's log-odds are
calibrated and combined by a logistic regression on labelled documents that neither view was fitted to. All documents
are scored with the combination.

The labelled sample is bounded: the ``labelled`` documents with labels that come first by a hash of their id; it also
gives the ``words`` words of each flaw's text view. Nothing else is: every distinct document without a label there has
its features in a table (some 200 bytes each), and a round is one pass over it that sums gradients, so its result is a
few thousand numbers whatever the size. A round's pseudo-labels of a class weigh together at most TRUST times what the
labelled documents of that class weigh, be they many or few. The fits to the labelled sample run in one task; the driver
sees coefficients. Scoring is a map over all documents with a broadcast model of bounded size.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, stored, table, words_of
from .token_counts import sliced

#: Bounds of the labelled sample, of the words that a flaw's text view knows, and documents a word stands in at least.
LABELLED, WORDS, LEAST = 8000, 250, 5
#: Rounds of the exchange; probability from which a view is sure; weight of all pseudo-labels against the labels.
ROUNDS, SURE, TRUST = 4, 0.99, 0.3
#: Beginnings of words that are features beside the words; words for which one occurrence counts half of the most.
PREFIXES, DENSE = range(4, 9), 150
#: Buckets of the metadata view's languages and sources.
NAMES = 64
FLAWS = ("junk", "toxic")

_SHAPES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"*", b"%", b"$", b"&", b"#", b"|", b".,;:", b"@<>=/{}[]()_\"'`^~+\\-"]


def looks(text: str | None, words: list[bytes], distinct: int) -> list[float]:
    """Numbers of the text view: shares of kinds of characters, of distinct words, of lines that repeat."""
    b = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(b))
    shares = [(len(b) - len(b.translate(None, s))) / n for s in _SHAPES]
    lines = b.split(b"\n")
    return [*(x**0.5 for x in shares), distinct / max(1, len(words)) ** 0.9, 1 - len(set(lines)) / len(lines), len(words) / n, float(not words)]


def features(word: str) -> list[str]:
    """A word and its beginnings, which a hyphen marks (no word has one)."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


def density(count, n_words):
    return count / (count + n_words / DENSE)


def layout(text: str | None) -> list[float]:
    """Numbers of the metadata view that are taken from the text's size."""
    n, lines = len(text or ""), (text or "").count("\n") + 1
    return [np.log1p(n) / 10, np.log(lines) / 5, np.log1p(n / lines) / 10, float(n < 100)]


def named(value, salt: str) -> int:
    return -1 if value is None else zlib.crc32(f"{salt}{value}".encode("utf-8", "surrogatepass")) % NAMES


def meta_row(lang, source, text) -> np.ndarray:
    out = np.zeros(2 * NAMES + 4, np.float32)
    for k, i in enumerate((named(lang, "l"), named(source, "s"))):
        if i >= 0:
            out[k * NAMES + i] = 1
    out[2 * NAMES :] = layout(text)
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 150) -> np.ndarray:
    """Logistic regression by Nesterov's gradient; the last coefficient is the constant."""
    n, d = x.shape
    w = np.zeros(d + 1)
    if not n:
        return w
    share = (y.sum() + 0.5) / (n + 1)
    w[-1] = np.log(share / (1 - share))
    if not 0 < y.sum() < n:
        return w
    s = np.ones(n, np.float32) if weight is None else weight.astype(np.float32)
    x = np.ascontiguousarray(x, np.float32)
    narrow = np.float32
    bound = 0.25 * float((s * (np.einsum("ij,ij->i", x, x) + 1)).sum()) + l2
    # The largest eigenvalue, by a few steps of the power method, instead of that trace.
    v = np.ones(d + 1)
    for _ in range(12):
        z = s * (x @ v[:-1].astype(narrow) + narrow(v[-1]))
        v = np.append(z @ x, z.sum())
        v /= max(np.linalg.norm(v), 1e-30)
    z = s * (x @ v[:-1].astype(narrow) + narrow(v[-1]))
    bound = min(bound, 0.25 * 1.2 * float(np.linalg.norm(np.append(z @ x, z.sum()))) + l2)
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead[:-1].astype(narrow) + narrow(ahead[-1]), -30, 30)))
        r = s * (p - y).astype(narrow)
        g = np.append(r @ x + l2 * ahead[:-1], r.sum())
        new, t1 = ahead - g / bound, (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, w, t = new + (t - 1) / t1 * (new - w), new, t1
    return w


def odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def probability_of(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return probability(odds(w, x))


def first_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients for labelled rows, and a bound of the Hessian anywhere (p (1 - p) is a quarter at most) with as much
    again as pseudo-labels may weigh: steps by it never overshoot."""
    one = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    return fit(x, y), (1 + TRUST) / 4 * one.T @ one + np.diag([1.0] * x.shape[1] + [1e-3])


def is_held(place: np.ndarray) -> np.ndarray:
    """Of labelled rows in order of their ids: every fourth is for the combination, not for the views."""
    return place % 4 == 3


def exchange(views: list[np.ndarray], y: np.ndarray, held: np.ndarray, w: list[np.ndarray], sure: float = SURE) -> dict[tuple[str, int], np.ndarray]:
    """What rows (y: 0, 1, -1 unknown) add to a round, by (what, learner): gradients of the learner for its labelled rows
    (g) and for those that the other view is sure are 0 or 1 (g0, g1) with their numbers (n0, n1), and how often the
    other view is sure of a class among held rows, and right (s0, r0, s1, r1); labelled rows by class (l0, l1)."""
    out: dict[tuple[str, int], np.ndarray] = {}
    p = [probability_of(c, x) for c, x in zip(w, views, strict=True)]
    own, pool = (y >= 0) & ~held, y < 0

    def gradient(learner: int, rows: np.ndarray, value: np.ndarray | int) -> np.ndarray:
        r = (p[learner][rows] - value).astype(np.float64)
        return np.append(r @ views[learner][rows], r.sum())

    for learner in (0, 1):
        teacher = 1 - learner
        out["g", learner] = gradient(learner, own, y[own])
        for value in (0, 1):
            said = p[teacher] if value else 1 - p[teacher]
            taught = pool & (said >= sure)
            check = held & (y >= 0) & (said >= sure)
            out[f"g{value}", learner] = gradient(learner, taught, value)
            out[f"n{value}", learner] = np.array([taught.sum()], np.float64)
            out[f"s{value}", learner] = np.array([check.sum()], np.float64)
            out[f"r{value}", learner] = np.array([(check & (y == value)).sum()], np.float64)
            out[f"l{value}", learner] = np.array([(own & (y == value)).sum()], np.float64)
    return out


def step(w: list[np.ndarray], hessian: list[np.ndarray], sums: dict[tuple[str, int], np.ndarray], sure: float = SURE) -> tuple[list[np.ndarray], float]:
    """The views after a round, and how many pseudo-labels it used. A view teaches a class only where its sure answers are
    right on held labelled rows."""
    out, used = [], 0.0
    for learner in (0, 1):
        g = sums["g", learner] + np.append(w[learner][:-1], 0)
        for value in (0, 1):
            n, asked, right, labelled = (float(sums[f"{k}{value}", learner][0]) for k in "nsrl")
            if n and asked and right / asked >= sure - 0.01:
                g = g + sums[f"g{value}", learner] * TRUST * min(1.0, labelled / n)
                used += n
        out.append(w[learner] - np.linalg.solve(hessian[learner], g))
    return out, used


class Model:
    """What a scorer needs: the words' places, and for each flaw both views and their combination."""

    def __init__(self, words: list[str], center: np.ndarray, scale: np.ndarray):
        self.place = {w: i for i, w in enumerate(words)}
        self.center, self.scale = center, scale
        self.flaws: dict[str, tuple] = {}

    def text_rows(self, texts: list[str | None]) -> np.ndarray:
        """The text view of a slice of documents. Each distinct word of the slice is looked up once."""
        wide = len(self.place)
        rows = np.zeros((len(texts), wide + len(self.center)), np.float32)
        ids: dict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        parts = []
        for i, t in enumerate(texts):
            words = words_of(t)
            own = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
            parts.append(own)
            rows[i, wide:] = (np.array(looks(t, words, len(np.unique(own)))) - self.center) / self.scale
        get, word, place = self.place.get, [], []
        for i, w in enumerate(ids):
            for f in features(w.decode("utf-8", "replace")):
                if (k := get(f)) is not None:
                    word.append(i)
                    place.append(k)
        if word:
            # For each word the range of its features in `place`.
            starts = np.searchsorted(word, np.arange(len(ids) + 1))
            place = np.array(place)
            for i, own in enumerate(parts):
                own = own[starts[own + 1] > starts[own]]
                if len(own):
                    at = np.concatenate([place[starts[w] : starts[w + 1]] for w in own])
                    count = np.bincount(at, minlength=wide)
                    rows[i, :wide] = density(count, len(parts[i]))
        return rows

    def probabilities(self, flaw: str, views: list[np.ndarray]) -> np.ndarray:
        if flaw not in self.flaws:
            return np.zeros(len(views[0]))
        coefficients, combined = self.flaws[flaw]
        return probability(odds(combined, np.stack([odds(c, x) for c, x in zip(coefficients, views, strict=True)], 1)))


def _labelled(docs: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """(doc_id, text, lang, source, junk, toxic, place): the labelled sample; -1 where no label is. Of rows that share an
    id one stands for all, the least by its text's hash."""
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)").groupBy("doc_id").agg(
        F.coalesce(1 - F.min("quality"), F.lit(-1)).alias("junk"), F.coalesce(F.max("toxic"), F.lit(-1)).alias("toxic")
    )
    chosen = known.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(labelled)
    rows = docs.join(F.broadcast(chosen), "doc_id")  # at most `labelled` narrow rows
    one = F.min(F.struct(F.xxhash64("text", "lang", "source").alias("h"), "text", "lang", "source", "junk", "toxic")).alias("x")
    return rows.groupBy("doc_id").agg(one).select("doc_id", "x.*")


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features (text) of labelled documents, with their density."""
    for b in batches:
        at = 0
        for texts in sliced(b.column(0)):
            own = b.slice(at, len(texts))
            at += len(texts)
            found = []
            for t in texts:
                w = words_of(t)
                dense: Counter[str] = Counter()
                for x, n in Counter(w).items():
                    for f in features(x.decode("utf-8", "replace")):
                        dense[f] += n
                found.append([f for f, n in dense.items() if density(n, len(w)) >= 0.1])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), own.column(1), own.column(2)], names=["words", *FLAWS])


def _vocabulary(sample: DataFrame, words: int) -> list[str]:
    """Features that flawed documents have more often, by the likelihood ratio in nats times documents."""
    s = stored(sample.select("text", *FLAWS).mapInArrow(lean(_seen), "words array<string>, junk int, toxic int"), "quality-words")
    chosen: set[str] = set()
    by_word = s.select(F.explode("words").alias("word"), *FLAWS)
    for flaw in FLAWS:
        n = {r[0]: r[1] for r in s.groupBy(flaw).count().collect()}
        bad, good = n.get(1, 0), n.get(0, 0)
        if bad and good:
            counts = by_word.where(F.col(flaw) >= 0).groupBy("word").agg(F.sum(flaw).alias("b"), F.sum(1 - F.col(flaw)).alias("g")).where(f"b + g >= {LEAST}")
            rate_b, rate_g = (F.col("b") + 0.5) / F.lit(bad + 1.0), (F.col("g") + 0.5) / F.lit(good + 1.0)
            gain = F.col("b") * F.log(rate_b / rate_g) + F.col("g") * F.log(rate_g / rate_b)
            chosen.update(r.word for r in counts.where(rate_b > rate_g).orderBy(F.desc(gain), "word").limit(words).collect())
    discard(s)
    return sorted(chosen)


VIEWS = "at array<int>, dense array<float>, looks array<float>, meta array<float>"


def _viewed(rows: DataFrame, vocabulary: list[str], names: list[str]) -> DataFrame:
    """names (columns of rows), and both views of rows (text, lang, source): the text view's words where they are not 0."""
    none = np.zeros(len(looks("", [], 0)))
    sent = rows.sparkSession.sparkContext.broadcast(Model(vocabulary, none, none + 1))
    kinds = ", ".join(f"{n} {dict(rows.dtypes)[n]}" for n in names)

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, wide = sent.value, len(vocabulary)
        for b in batches:
            at = 0
            for texts in sliced(b.column(0)):
                own = b.slice(at, len(texts))
                at += len(texts)
                x = model.text_rows(texts)
                i, j = np.nonzero(x[:, :wide])
                cuts = pa.array(np.searchsorted(i, np.arange(len(texts) + 1)), pa.int32())
                meta = np.stack([meta_row(lang, source, t) for t, lang, source in zip(texts, own.column(1).to_pylist(), own.column(2).to_pylist(), strict=True)])
                yield pa.RecordBatch.from_arrays([
                    *own.columns[3:], pa.ListArray.from_arrays(cuts, pa.array(j, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(x[i, j], pa.float32())),
                    pa.array(list(x[:, wide:]), pa.list_(pa.float32())), pa.array(list(meta), pa.list_(pa.float32())),
                ], names=[*names, "at", "dense", "looks", "meta"])

    own = rows.select("text", F.col("lang").cast("string"), F.col("source").cast("string"), *names)
    return own.mapInArrow(lean(view), f"{kinds}, {VIEWS}")


def _views_of(b: pa.RecordBatch, wide: int, center: np.ndarray, scale: np.ndarray) -> list[np.ndarray]:
    """The text and the metadata view of a batch of the features' table."""
    n, column = b.num_rows, lambda c: b.column(b.schema.get_field_index(c))
    meta = column("meta").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float32)
    numbers = column("looks").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    text = np.zeros((n, wide + numbers.shape[1]), np.float32)
    row = np.repeat(np.arange(n), np.diff(column("at").offsets.to_numpy()))
    text[row, column("at").flatten().to_numpy(zero_copy_only=False)] = column("dense").flatten().to_numpy(zero_copy_only=False)
    text[:, wide:] = (numbers - center) / scale
    return [text, meta]


def _in_one_task(rows: DataFrame, work) -> object:
    """work(rows as one Arrow table) in a single task; its (small) result."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(batches)
        if own:
            whole = pa.Table.from_batches(own).combine_chunks().to_batches(max_chunksize=1 << 30)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(whole[0]))])], names=["out"])

    # Sorted, as a sum's last bits depend on the order.
    got = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(lean(run), "out binary").collect()
    return pickle.loads(got[0].out) if got else None


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, words: int = WORDS, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """Co-trains on docs (doc_id, text, lang, source) and labels (doc_id, quality, toxic)."""
    sample = stored(_labelled(docs, labels, labelled), "quality-sample")
    vocabulary = _vocabulary(sample, words)
    wide = len(vocabulary)
    known = stored(_viewed(sample, vocabulary, ["doc_id", *FLAWS]), "quality-labelled")

    def begin(b: pa.RecordBatch) -> dict:
        """Center and scale of the text's numbers; by flaw both views' coefficients and Hessians."""
        numbers = b.column(b.schema.get_field_index("looks")).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
        out = {"center": numbers.mean(0), "scale": np.maximum(numbers.std(0), 1e-3)}
        views = _views_of(b, wide, out["center"], out["scale"])
        for flaw in FLAWS:
            y = b.column(b.schema.get_field_index(flaw)).to_numpy()
            if (y == 1).any() and (y == 0).any():
                own = (y >= 0) & ~is_held(np.cumsum(y >= 0) - 1)
                out[flaw] = [first_fit(x[own], y[own]) for x in views]
        return out

    fitted = _in_one_task(known, begin)
    if fitted is None:
        discard(sample, known)
        return Model([], np.zeros(len(looks("", [], 0))), np.ones(len(looks("", [], 0))))
    center, scale = fitted["center"], fitted["scale"]
    model = Model(vocabulary, center, scale)
    flaws = [f for f in FLAWS if f in fitted]
    w = {f: [c for c, _ in fitted[f]] for f in flaws}
    hessian = {f: [h for _, h in fitted[f]] for f in flaws}

    # Distinct documents without a label; equal ones say the same.
    rest = docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_anti") if flaws else docs.limit(0)
    rest = _viewed(rest.withColumn("h", F.xxhash64("text", "lang", "source")), vocabulary, ["h"])
    pool = stored(rest.groupBy("h").agg(F.first(F.struct("at", "dense", "looks", "meta")).alias("x")).select("x.*"), "quality-pool")
    model.exchanged = {f: [] for f in flaws}
    for _ in range(rounds if flaws else 0):

        def add(batches: Iterator[pa.RecordBatch], w=w) -> Iterator[pa.RecordBatch]:
            total: dict[tuple, np.ndarray] = {}
            for b in batches:
                for start in range(0, b.num_rows, 4096):
                    part = b.slice(start, 4096)
                    views = _views_of(part, wide, center, scale)
                    for flaw in flaws:
                        none = np.full(part.num_rows, -1)
                        for k, x in exchange(views, none, none == 0, w[flaw], sure).items():
                            total[flaw, *k] = total.get((flaw, *k), 0) + x
            rows = [(f, what, learner, i, float(v)) for (f, what, learner), x in total.items() for i, v in enumerate(x) if v]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["flaw", "what", "learner", "i", "v"])

        def held_part(b: pa.RecordBatch, w=w) -> dict:
            views = _views_of(b, wide, center, scale)
            out = {}
            for flaw in flaws:
                y = b.column(b.schema.get_field_index(flaw)).to_numpy()
                held = (y >= 0) & is_held(np.cumsum(y >= 0) - 1)
                # Rows of the sample that have the other flaw's label only are left out.
                some = y >= 0
                out[flaw] = exchange([x[some] for x in views], y[some], held[some], w[flaw], sure)
            return out

        sums = _in_one_task(known, held_part)
        added = pool.mapInArrow(lean(add), "flaw string, what string, learner long, i long, v double").groupBy("flaw", "what", "learner", "i").agg(F.sum("v").alias("v"))
        for r in added.collect():  # a few thousand numbers
            sums[r.flaw][r.what, r.learner][r.i] += r.v
        new = {f: step(w[f], hessian[f], sums[f], sure) for f in flaws}
        w = {f: x for f, (x, _) in new.items()}
        for f, (_, used) in new.items():
            model.exchanged[f].append(int(used))

    def combine(b: pa.RecordBatch) -> dict:
        views = _views_of(b, wide, center, scale)
        out = {}
        for flaw in flaws:
            y = b.column(b.schema.get_field_index(flaw)).to_numpy()
            held = (y >= 0) & is_held(np.cumsum(y >= 0) - 1)
            out[flaw] = fit(np.stack([odds(c, x[held]) for c, x in zip(w[flaw], views, strict=True)], 1), y[held], l2=0.1)
        return out

    combined = _in_one_task(known, combine)
    model.flaws = {f: (w[f], combined[f]) for f in flaws}
    discard(sample, known, pool)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **sizes: int) -> DataFrame:
    """docs' columns in a struct `row`, with p_junk, p_toxic, and keep (both under the threshold).

    A document without text is scored like any other (it has no words); null languages and sources are no language
    and no source; repeated rows get equal scores. Without labels of both kinds a flaw's probability is 0 and nothing
    is rejected for it. Labels of one id are joined: the worst counts. An empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    view = docs.select(*[docs[c] for c in ("doc_id", "text", "lang", "source")])
    sent = spark.sparkContext.broadcast(train(view, labels.select("doc_id", "quality", "toxic"), **sizes))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["lang"].cast("string").alias("lang"), docs["source"].cast("string").alias("source"))
    from pyspark.sql.types import DoubleType, StructField, StructType

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            at = 0
            for texts in sliced(b.column(0).field("text")):
                own = b.slice(at, len(texts))
                at += len(texts)
                views = [model.text_rows(texts), np.stack([meta_row(x, s, t) for x, s, t in zip(own.column(1).to_pylist(), own.column(2).to_pylist(), texts, strict=True)])]
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(model.probabilities(f, views)) for f in FLAWS)], names=["row", "p_junk", "p_toxic"])

    out = rows.mapInArrow(lean(scored), StructType([rows.schema["row"], StructField("p_junk", DoubleType()), StructField("p_toxic", DoubleType())]))
    return out.withColumn("keep", F.greatest("p_junk", "p_toxic") < threshold)


def keep_good(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    return score(docs, labels, **parameters).where("keep").select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of both flaws for every document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = score(docs, table(spark, sf_dir, "labels"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "p_junk", "p_toxic", (1 - F.greatest("p_junk", "p_toxic")).alias("quality"), "keep")
