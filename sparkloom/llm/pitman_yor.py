"""Language-model scores from a hierarchical Pitman-Yor model, trained on the corpus by Gibbs sampling.

Each word (the end too) is a context with a restaurant of its own: the words that follow it are its customers. All
context restaurants share one parent, the root restaurant, whose customers are their tables. A context without a
follower in training gives the root's probabilities. The root's base measure is uniform over the vocabulary and one
unknown word.

Everything about a word - its counts after each context, its tables there and in the root - lives in the bucket of its
hash. Between buckets only the restaurants' totals are shared. A restaurant's total lives in the shard of its context's
hash: after each sweep a bucket sends each shard its tables in the contexts it has, and the shard answers with the sums,
in the same order; so no process holds all contexts. A sweep reseats, bucket by bucket, all customers of a dish in turn,
each at a new table with the Chinese restaurant's probability given the totals of the sweep before; a chain can be run
again from its recorded totals, so no seating is stored, and a lost task repeats it. From the sixteenth customer on, up to
an eighth of those seated come in at once and draw their new tables by one binomial. After each sweep the strengths of
the contexts and of the root are drawn from their conditional given expected auxiliary variables, which the shards sum.
Predictive probabilities are averaged over the sweeps after ``burn``.

All draws of a dish come from hashes of word, context, sweep and customer, so the result doesn't depend on how the rows
or the words are dealt out.

Words never move as text. A batch of documents is written once as integers, with a request for each bucket: hashes of
the batch's distinct words, of the contexts they follow, how often in training documents. A bucket answers each request
with probabilities and counts in the same order, and a batch's answers meet its documents again. So the exchanges carry
each distinct pair of a batch once, and a word as frequent as may be is one entry.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _on, discard, scratch_dir, stored, table, tokens_of
from .token_counts import sliced

BATCH_CHARS, BUCKET_BYTES = 8_000_000, 24_000_000
SWEEPS, BURN, THETA, SEED = 4, 1, 1.0, 11
END = b"\n"  # stands in no token

CORPUS = "batch long, ids array<long>, held array<boolean>, lengths binary, words binary, hashes binary"
REQUESTS = "batch long, bucket int, hashes binary, runs binary, context_hashes binary, contexts binary, counts binary"
MODEL = "bucket int, word_hashes binary, pair_word binary, pair_context binary, pair_count binary, context_hashes binary, batches array<long>, sizes array<long>, asked binary"
SENT = "shard int, bucket int, hashes binary, customers binary, tables binary, sums array<long>"
TOTALS = "bucket int, shard int, number int, customers binary, tables binary, places binary, sums array<double>"
ANSWER = "batch long, bucket int, logs binary, counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def index_type(n: int) -> type:
    """The narrower of two types that hold numbers below n."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    start = np.flatnonzero(np.diff(x, prepend=-1))
    return start, np.diff(start, append=len(x)).astype(np.uint32)


def packed(x: np.ndarray) -> bytes:
    """An array as its size in bytes and its compressed bytes."""
    return x.nbytes.to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def unpacked(x: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True), dtype)


def packed_hashes(x: np.ndarray) -> bytes:
    """Hashes in order, as the bytes of their differences, the first bytes first: the last ones are mostly 0."""
    return packed(np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, 8).T.copy())


def unpacked_hashes(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked(x, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def encode(ids: list, held: list[bool], texts: list[str | None]) -> dict:
    """A batch's corpus row: the words of its documents one after the other, numbered as they come, and their hashes."""
    from xxhash import xxh3_64_intdigest

    vocabulary: dict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    vocabulary[END]
    parts = [np.fromiter(map(vocabulary.__getitem__, chain(tokens_of(t), (END,))), np.uint32) for t in texts]
    hashes = np.fromiter(map(xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
    lengths = np.array([len(p) for p in parts], np.int64)
    return {"ids": ids, "held": held, "lengths": lengths.tobytes(), "words": packed(np.concatenate(parts)), "hashes": hashes.tobytes()}


def pairs_of(row: dict, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a corpus row: its words' hashes in order; the word and the context of its distinct pairs, as places there, in
    order of (word's bucket, word, context); which pair each token is; lengths of the documents."""
    hashes, lengths = np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["lengths"], np.int64)
    n, order = len(hashes), np.argsort(hashes)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    by = np.argsort(hashes[order] % np.uint64(buckets), kind="stable")
    rank = np.empty(n, np.int64)
    rank[by] = np.arange(n)
    word = place[unpacked(row["words"], np.uint32)]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[np.cumsum(lengths) - lengths] = place[0]  # the end
    pair, inverse = np.unique(rank[word] * n + before, return_inverse=True)
    return hashes[order], by[pair // n], pair % n, inverse, lengths


def requests(row: dict, buckets: int) -> list[dict]:
    """What a batch asks of each bucket."""
    hashes, word, context, inverse, lengths = pairs_of(row, buckets)
    trained = np.repeat(~np.array(row["held"], bool), lengths)
    count = np.bincount(inverse, weights=trained, minlength=len(word)).astype(np.uint32)
    where = (hashes % np.uint64(buckets)).astype(np.int64)[word]
    out = []
    cuts = np.flatnonzero(np.diff(where, prepend=-1, append=buckets))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first, runs = runs_of(word[a:b])
        own, at = np.unique(context[a:b], return_inverse=True)
        out.append({
            "batch": row["batch"], "bucket": int(where[a]), "hashes": packed_hashes(hashes[word[a:b][first]]), "runs": packed(runs),
            "context_hashes": packed_hashes(hashes[own]), "contexts": packed(at.astype(index_type(len(own)))), "counts": packed(count[a:b]),
        })
    return out


def numbered(lists: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct hashes of all lists, in order, and the places of each list's in them."""
    hashes = [unpacked_hashes(x) for x in lists]
    unique, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    return unique, np.split(inverse.astype(np.int32), np.cumsum([len(x) for x in hashes])[:-1])


def model_bucket(bucket: int, rows: pd.DataFrame) -> dict:
    """Sums the requests of all batches: the bucket's pairs with their counts, and which pairs each request asks
    for, as steps from one to the next: both are in order of (word hash, context hash). Context k, from 1, is the k-th of context_hashes."""
    rows = rows.sort_values("batch")
    word_hashes, words = numbered(rows["hashes"])
    words = [np.repeat(w, unpacked(x, np.uint32)) for w, x in zip(words, rows["runs"], strict=True)]
    contexts, places = numbered(rows["context_hashes"])
    wide = len(contexts) + 1
    context = np.concatenate([p[unpacked(x, index_type(len(p)))] for p, x in zip(places, rows["contexts"], strict=True)]) + 1
    pair, asked = np.unique(np.concatenate(words).astype(np.int64) * wide + context, return_inverse=True)
    count = np.bincount(asked, weights=np.concatenate([unpacked(x, np.uint32) for x in rows["counts"]]), minlength=len(pair))
    steps = [np.diff(x, prepend=0) for x in np.split(asked, np.cumsum([len(w) for w in words])[:-1])]
    return {
        "bucket": bucket, "word_hashes": packed_hashes(word_hashes), "pair_word": packed((pair // wide).astype(np.int32)), "pair_context": packed((pair % wide).astype(index_type(wide))),
        "pair_count": packed(count.astype(np.int64)), "context_hashes": packed_hashes(contexts), "batches": rows["batch"].tolist(),
        "sizes": [len(w) for w in words], "asked": packed(np.concatenate(steps).astype(np.uint32)),
    }


def opened(rows: pd.DataFrame) -> dict:
    """The one row of a bucket, its pairs unpacked."""
    pa.default_memory_pool().release_unused()
    row = rows.to_dict("records")[0]
    return row | {k: unpacked(row[k], np.uint8) for k in ("pair_word", "pair_context", "pair_count")} | {k: unpacked_hashes(row[k]).tobytes() for k in ("word_hashes", "context_hashes")}


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's output function."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw(keys: np.ndarray, turn: int) -> np.ndarray:
    """A number between 0 and 1 for each key and turn."""
    return ((mixed(keys + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def binomial(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The u-quantiles of binomials, of the normal distribution where both outcomes are frequent."""
    out, mean = np.zeros(len(u), np.int64), n * p
    wide = (mean > 30) & (n - mean > 30)
    if wide.any():
        normal = NormalDist().inv_cdf
        z = np.array([normal(x) for x in u[wide]])
        out[wide] = np.clip(np.rint(mean[wide] + z * np.sqrt(mean[wide] * (1 - p[wide]))), 0, n[wide]).astype(np.int64)
    # By the rarer outcome; of the other one there is the rest.
    at = np.flatnonzero(~wide)
    turned = p[at] > 0.5
    q = np.clip(np.where(turned, 1 - p[at], p[at]), 0, 0.5)
    number, left, size = np.zeros(len(at), np.int64), u[at].copy(), n[at]
    mass, live, k = np.exp(size * np.log1p(-q)), np.arange(len(at)), 0
    while len(live):
        left[live] -= mass[live]
        live = live[(left[live] > 0) & (k < size[live])]
        mass[live] *= (size[live] - k) / (k + 1) * q[live] / (1 - q[live])
        k += 1
        number[live] = k
    out[at] = np.where(turned, size - number, number)
    return out


def seat(keys: np.ndarray, customers: np.ndarray, strength: np.ndarray, discount: float) -> np.ndarray:
    """Tables of a dish after all its customers sat down in turn; keys are what its draws come from. strength: (theta +
    discount * tables of the restaurant) times the parent's probability of the dish."""
    tables = np.minimum(customers, 1).astype(np.int64)
    at, seated = np.flatnonzero(customers > 1), 1
    while len(at):
        block = np.minimum(max(1, seated // 8), customers[at] - seated)
        a = strength[at]
        p = np.clip(a / (a + seated + (block - 1) / 2 - discount * tables[at]), 0, 1)
        u = draw(keys[at], seated)
        tables[at] += binomial(u, block, p) if seated >= 16 else u < p
        seated += max(1, seated // 8)
        at = at[customers[at] > seated]
    return tables


def digamma(x: np.ndarray) -> np.ndarray:
    """The logarithmic derivative of the gamma function, from its series for large numbers."""
    x = np.asarray(x, np.float64)
    out = np.zeros_like(x)
    for k in range(6):
        out -= 1 / (x + k)
    x = x + 6
    return out + np.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def auxiliary(customers: np.ndarray, tables: np.ndarray, theta: float, discount: float) -> tuple[float, float]:
    """Shape and rate that restaurants add to the gamma distribution of their strength: how many of their tables after the
    first the strength is expected to have opened, and minus the expected logarithm of their beta variables."""
    many = customers > 1
    c, t = customers[many].astype(np.float64), tables[many].astype(np.float64)
    x = theta / discount
    return float((x * (digamma(x + t) - digamma(x + 1))).sum()), float((digamma(theta + c) - digamma(np.full(len(c), theta + 1.0))).sum())


def strength(seed: int, sweep: int, level: int, shape: float, rate: float) -> float:
    """Drawn with a gamma(1, 1) prior."""
    return max(1e-3, float(np.random.default_rng((seed, sweep, level)).gamma(1 + shape, 1 / (1 + rate))))


#: Sums over all buckets: training tokens and types, dishes served once and twice in contexts and in the root, root customers.
FIRST = ("tokens", "types", "ones", "twos", "root_ones", "root_twos", "root_customers")


class Totals:
    """What buckets share: fixed sizes and discounts, and tables after each sweep; of contexts, those a bucket has."""

    def __init__(self, wide: int, seen: dict):
        self.wide = wide
        self.tokens, self.types = seen["tokens"], seen["types"]
        self.d1 = min(0.95, max(0.05, seen["ones"] / max(1, seen["ones"] + 2 * seen["twos"])))
        self.d0 = min(0.95, max(0.05, seen["root_ones"] / max(1, seen["root_ones"] + 2 * seen["root_twos"])))
        self.customers = np.asarray(seen["customers"], np.float64)
        # Before the first sweep each dish has one table wherever it is served.
        self.sweeps = [self.vector(seen["tables"], wide, self.types, seen["root_customers"])]

    @staticmethod
    def vector(tables: np.ndarray, wide: int, root_tables: int, root_customers: int) -> tuple[np.ndarray, float, float]:
        return np.asarray(tables[:wide], np.float64), float(root_tables), float(root_customers)


class Chain:
    """The Gibbs chain of one bucket. thetas: strengths of contexts and root, for each sweep and after it."""

    def __init__(self, row: dict, totals: Totals, thetas: list[tuple[float, float]] | None = None, seed: int = SEED):
        self.t, self.thetas = totals, thetas or [(THETA, THETA)]
        self.word = np.frombuffer(row["pair_word"], np.int32)
        self.context = np.frombuffer(row["pair_context"], index_type(self.t_wide)).astype(np.int64)
        self.count = np.frombuffer(row["pair_count"], np.int64)
        self.n_words = int(self.word.max(initial=-1)) + 1
        self.of_word = np.bincount(self.word, weights=self.count, minlength=self.n_words).astype(np.int64)
        self.served = (self.context > 0) & (self.count > 0)
        self.direct = np.bincount(self.word, weights=np.where(self.context == 0, self.count, 0), minlength=self.n_words).astype(np.int64)
        self.tables = self.served.astype(np.int64)
        self.root = self.direct + self._up()
        self.root_tables = np.minimum(self.root, 1)
        self.keys = mixed(np.frombuffer(row["word_hashes"], np.uint64) + np.uint64(seed))
        # Dishes of one customer have one table in every sweep.
        self.several = np.flatnonzero(self.served & (self.count > 1))
        contexts = np.frombuffer(row["context_hashes"], np.uint64)
        self.pair_keys = mixed(self.keys[self.word[self.several]] ^ contexts[self.context[self.several] - 1])

    def _up(self) -> np.ndarray:
        return np.bincount(self.word, weights=self.tables, minlength=self.n_words).astype(np.int64)

    def start(self) -> dict:
        """What totals begin with: the sums of FIRST, customers and tables of each context."""
        n = self.count[self.served]
        sums = (self.of_word.sum(), (self.of_word > 0).sum(), (n == 1).sum(), (n == 2).sum(), (self.root == 1).sum(), (self.root == 2).sum(), self.root.sum())
        customers = np.bincount(self.context, weights=self.count, minlength=self.t_wide).astype(np.int64)
        return dict(zip(FIRST, map(int, sums), strict=True)) | {"customers": customers, "tables": self.sums(self.t_wide)}

    @property
    def t_wide(self) -> int:
        return self.t if isinstance(self.t, int) else self.t.wide

    def sums(self, wide: int) -> np.ndarray:
        """Tables in each context."""
        return np.bincount(self.context, weights=self.tables, minlength=wide).astype(np.int64)

    def theta(self, number: int) -> tuple[float, float]:
        return self.thetas[min(number, len(self.thetas) - 1)]

    def parent(self, shared: tuple[np.ndarray, float, float], theta: float) -> np.ndarray:
        """The root's probability of each word."""
        _, tables, customers = shared
        base = (theta + self.t.d0 * tables) / (self.t.types + 1)
        return (np.maximum(self.root - self.t.d0 * self.root_tables, 0) + base) / (theta + customers)

    def sweep(self, number: int) -> None:
        """Reseats everyone, given the totals and strengths after sweep number - 1."""
        shared, (theta, root_theta) = self.t.sweeps[number - 1], self.theta(number - 1)
        turn = np.uint64(number * 0xD1342543DE82EF95 & (1 << 64) - 1)
        at = self.several
        strong = (theta + self.t.d1 * shared[0][self.context[at]]) * self.parent(shared, root_theta)[self.word[at]]
        self.tables[at] = seat(self.pair_keys + turn, self.count[at], strong, self.t.d1)
        self.root = self.direct + self._up()
        base = (root_theta + self.t.d0 * shared[1]) / (self.t.types + 1)
        self.root_tables = seat(self.keys + turn, self.root, np.full(len(self.root), base), self.t.d0)

    def predict(self, number: int) -> np.ndarray:
        """Probability of each pair's word after its context, given the totals and strengths after sweep `number`."""
        shared, (theta, root_theta) = self.t.sweeps[number], self.theta(number)
        p = self.parent(shared, root_theta)[self.word]
        u = self.context
        own = np.maximum(self.count - self.t.d1 * self.tables, 0) + (theta + self.t.d1 * shared[0][u]) * p
        return np.where(u == 0, p, own / (theta + self.t.customers[u]))


def by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the hashes by shard, and each shard's part of it."""
    shard = (hashes % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=shards))
    return order, [(int(shard[order[a]]), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def sent(row: dict, shards: int, tables: np.ndarray, sums: list[int], customers: np.ndarray | None = None) -> pd.DataFrame:
    """What a bucket sends: to each shard the totals of its own contexts there, and sums over all words as shard -1.
    The contexts' hashes go along with the customers, before the first sweep."""
    hashes = np.frombuffer(row["context_hashes"], np.uint64)
    order, parts = by_shard(hashes, shards)
    out = [{"shard": -1, "bucket": row["bucket"], "hashes": None, "customers": None, "tables": None, "sums": sums}]
    for shard, a, b in parts:
        at = order[a:b]
        new = {"hashes": None, "customers": None} if customers is None else {"hashes": packed_hashes(hashes[at]), "customers": packed(customers[1:][at])}
        out.append({"shard": shard, "bucket": row["bucket"], **new, "tables": packed(tables[1:][at]), "sums": None})
    return pd.DataFrame(out)


def first_totals(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's totals over all buckets, for each bucket in the order it sent, with the places of its contexts in the
    shard's list; and, as bucket -1, the customers of all of these."""
    rows = rows.sort_values("bucket")
    _, places = numbered(rows["hashes"])
    at = np.concatenate(places)
    customers, tables = (np.bincount(at, weights=np.concatenate([unpacked(x, np.int64) for x in rows[name]])).astype(np.int64) for name in ("customers", "tables"))
    own = [(b, packed(customers[p]), packed(tables[p]), packed(np.diff(p, prepend=0).astype(np.uint32))) for b, p in zip(rows["bucket"], places, strict=True)]
    out = pd.DataFrame([*own, (-1, packed(customers), None, None)], columns=["bucket", "customers", "tables", "places"])
    return out.assign(shard=int(rows["shard"].iloc[0]), number=0, sums=None)[_columns(TOTALS)]


def shard_totals(first: pd.DataFrame, rows: pd.DataFrame, number: int, theta: float, discount: float) -> pd.DataFrame:
    """The same after a sweep; and, as bucket -1, what the shard's restaurants tell of their strength."""
    first, rows = first.sort_values("bucket"), rows.sort_values("bucket")
    customers = unpacked(first["customers"].iloc[0], np.int64)
    places = [np.cumsum(unpacked(x, np.uint32), dtype=np.int64) for x in first["places"].iloc[1:]]
    total = np.bincount(np.concatenate(places), weights=np.concatenate([unpacked(x, np.int64) for x in rows["tables"]])).astype(np.int64)
    own = [(b, packed(total[p]), None) for b, p in zip(rows["bucket"], places, strict=True)]
    out = pd.DataFrame([*own, (-1, None, list(auxiliary(customers, total, theta, discount)))], columns=["bucket", "tables", "sums"])
    return out.assign(shard=int(rows["shard"].iloc[0]), number=number, customers=None, places=None)[_columns(TOTALS)]


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def bucket_totals(row: dict, rows: pd.DataFrame, sums: list[list[int]], shards: int) -> Totals:
    """The totals of a bucket's contexts after each sweep so far, put together from the shards' answers."""
    hashes = np.frombuffer(row["context_hashes"], np.uint64)
    order, _ = by_shard(hashes, shards)

    def vector(number: int, name: str) -> np.ndarray:
        own = rows[rows["number"] == number].sort_values("shard")
        out = np.zeros(len(hashes) + 1, np.int64)
        out[1 + order] = np.concatenate([unpacked(x, np.int64) for x in own[name]])
        return out

    totals = Totals(len(hashes) + 1, dict(zip(FIRST, sums[0], strict=True)) | {"customers": vector(0, "customers"), "tables": vector(0, "tables")})
    for number, (root_tables, root_customers) in enumerate(sums[1:], 1):
        totals.sweeps.append(Totals.vector(vector(number, "tables"), totals.wide, root_tables, root_customers))
    return totals


def in_buckets(df: DataFrame, buckets: int, by: str, label: str) -> DataFrame:
    """df in the shared folder as a table of buckets by a column, so that grouping by it later needs no exchange."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, by).saveAsTable(name)
    at, files = _on(spark, path)
    files.deleteOnExit(at)
    out = spark.table(name)
    out._stored_at = path
    return out


def score(docs: DataFrame, held: F.Column, doc_id: str = "doc_id", text: str = "text", sweeps: int = SWEEPS, burn: int = BURN, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, base_score, score, train_tokens, perplexity.

    held tells which rows are left out of training (null: trained on). A null or empty text is one token, its end.
    Null ids and repeated rows are rows like any other; an empty table gives an empty one. A word that no training
    document has gets the unknown word's probability.
    """
    if not 0 <= burn < sweeps:
        raise ValueError("burn must be less than sweeps")
    docs = docs.select(docs[text].alias("text"), F.coalesce(held, F.lit(False)).alias("held"), docs[doc_id].cast("long").alias("doc_id"))
    spark: SparkSession = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        schema = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((n, pa.binary()) for n in ("lengths", "words", "hashes"))])
        for b in batches:
            at = 0
            for texts in sliced(b.column(0), BATCH_CHARS):
                own = b.slice(at, len(texts))
                at += len(texts)
                row = encode(own.column(2).to_pylist(), own.column(1).to_pylist(), texts)
                yield pa.RecordBatch.from_pylist([{"batch": number, **row}], schema=schema)
                number += 1

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), *((n, pa.binary()) for n in ("hashes", "runs", "context_hashes", "contexts", "counts"))])
        for b in batches:
            for k in range(len(b)):
                yield pa.RecordBatch.from_pylist(requests(b.slice(k, 1).to_pylist()[0], buckets), schema=schema)

    # Dealt by batch now, while little else is stored, so that only the answers move later.
    corpus = in_buckets(docs.mapInArrow(encoded, CORPUS).repartition(buckets, "batch"), buckets, "batch", "lm_corpus")
    spark.sparkContext._jvm.System.gc()
    asked = corpus.select("batch", "held", "lengths", "words", "hashes").mapInArrow(asking, REQUESTS)

    def summed(key, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([model_bucket(key[0], rows)])

    model = in_buckets(asked.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(summed, MODEL), buckets, "bucket", "lm_model")
    spark.sparkContext._jvm.System.gc()  # lets Spark delete the exchanged requests
    def started(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for k in range(len(rows)):
                row = opened(rows[k : k + 1])
                first = Chain(row, len(row["context_hashes"]) // 8 + 1).start()
                yield sent(row, buckets, first["tables"], [first[k] for k in FIRST], first["customers"])

    narrow = model.select("bucket", "word_hashes", "pair_word", "pair_context", "pair_count", "context_hashes")

    def summed_up(said: DataFrame, width: int) -> list[float]:
        one = said.agg(*(F.sum(F.col("sums")[k]) for k in range(width))).first()
        return [x or 0 for x in one]

    said = stored(narrow.mapInPandas(started, SENT), "lm-sent")
    sums = [[int(x) for x in summed_up(said.where("shard < 0"), len(FIRST))]]
    dealt = said.where("shard >= 0").repartition(buckets, "shard").groupBy("shard").applyInPandas(first_totals, TOTALS)
    first = in_buckets(dealt, buckets, "shard", "lm_first")
    discard(said)
    spark.sparkContext._jvm.System.gc()
    totals = first.where("bucket >= 0").drop("places")
    # Discounts as Totals has them; strengths begin with THETA.
    thetas, fixed = [(THETA, THETA)], Totals(0, dict(zip(FIRST, sums[0], strict=True)) | {"customers": [], "tables": []})

    # Functions of their own, as Spark tells what a function is given from how many parameters it has.
    def sweeper(number: int, sums: list[list[int]], thetas: list[tuple[float, float]]):
        def swept(rows: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
            row = opened(rows)
            c = Chain(row, bucket_totals(row, shared, sums, buckets), thetas, seed)
            for k in range(1, number + 1):
                c.sweep(k)
            return sent(row, buckets, c.sums(c.t_wide), [int(c.root_tables.sum()), int(c.root.sum())])

        return swept

    def adder(number: int, theta: float, discount: float):
        def added(first: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            return shard_totals(first, rows, number, theta, discount)

        return added

    links = first.select("shard", "bucket", "customers", "places").withColumn("customers", F.when(F.col("bucket") < 0, F.col("customers")))
    for number in range(1, sweeps + 1):
        said = stored(narrow.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInPandas(sweeper(number, sums, thetas), SENT), "lm-sent")
        sums = [*sums, [int(x) for x in summed_up(said.where("shard < 0"), 2)]]
        tables = said.where("shard >= 0").select("shard", "bucket", "tables")
        new = stored(links.groupBy("shard").cogroup(tables.groupBy("shard")).applyInPandas(adder(number, thetas[-1][0], fixed.d1), TOTALS), "lm-totals")
        root = auxiliary(np.array([sums[-1][1]]), np.array([sums[-1][0]]), thetas[-1][1], fixed.d0) if sums[-1][1] else (0.0, 0.0)
        theirs = summed_up(new.where("bucket < 0"), 2)
        thetas = [*thetas, (strength(seed, number, 1, *theirs), strength(seed, number, 0, *root))]
        totals = totals.unionByName(new.where("bucket >= 0").drop("places"))
        discard(said)
        spark.sparkContext._jvm.System.gc()

    def answered(rows: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        row = opened(rows)
        c = Chain(row, bucket_totals(row, shared, sums, buckets), thetas, seed)
        p = np.zeros(len(c.count))
        for k in range(1, sweeps + 1):
            c.sweep(k)
            if k > burn:
                p += c.predict(k)
        logs = np.log10(p / (sweeps - burn)).astype(np.float32)
        ends = np.cumsum(row["sizes"])
        steps = unpacked(row["asked"], np.uint32)
        out = []
        for batch, end, size in zip(row["batches"], ends, row["sizes"], strict=True):
            at = np.cumsum(steps[end - size : end], dtype=np.int64)
            word = c.word[at]
            out.append({"batch": batch, "bucket": row["bucket"], "logs": logs[at].tobytes(), "counts": packed(c.of_word[word[runs_of(word)[0]]])})
        return pd.DataFrame(out)

    answers = model.groupBy("bucket").cogroup(totals.groupBy("bucket")).applyInPandas(answered, ANSWER)
    tokens, types = sums[0][:2]

    def scored(corpus: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
        pa.default_memory_pool().release_unused()
        own, rest = corpus.iloc[0], rest.sort_values("bucket")
        _, word, _, pairs, lengths = pairs_of(own, buckets)
        logs = np.concatenate([np.frombuffer(x, np.float32) for x in rest["logs"]]).astype(np.float64)
        counts = np.repeat(np.concatenate([unpacked(x, np.int64) for x in rest["counts"]]), runs_of(word)[1])
        base = np.log10((counts + 0.5) / (tokens + 0.5 * (types + 1)))
        starts = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(x[pairs], starts) for x in (base, logs, (counts > 0).astype(np.int64))]
        return pd.DataFrame({"doc_id": pd.array(list(own["ids"]), dtype="Int64"), "held_out": own["held"], "n_tokens": lengths, "n_known": sums[2], "base_score": sums[0], "score": sums[1]})

    out = corpus.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(scored, SCORES)
    return out.select("*", F.lit(tokens).cast("long").alias("train_tokens"), F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, a fifth of them held out (contract of op8)."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    out = score(table(spark, sf_dir, "documents"), held)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
