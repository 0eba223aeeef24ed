"""Nearest neighbours, the language model and the quality classifier: brute force, exact parts, held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkloom.llm import hnsw as H
from sparkloom.llm import pitman_yor as P
from sparkloom.llm import quality as Q
from sparkloom.llm.common import tokens_of


def exact(rows, k=20, every=20):
    out = {}
    for q, v in rows.items():
        if q % every == 0:
            s = sorted((-float(np.dot(v, w)), i) for i, w in rows.items() if i != q)
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for q, near in want.items():
        own = sorted(found.get(q, []))
        assert [r for r, _, _ in own] == list(range(1, len(own) + 1)) and len(own) == len(near)
        worst = near[-1][1] if near else 0
        hit += sum(s >= worst - 1e-12 for _, _, s in own)
        total += len(near)
    assert set(found) <= set(want)
    return hit / max(1, total)


def test_hnsw(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(1500, 12)) * r.uniform(0.3, 2, size=(1500, 1))
    v[700:1200] = v[3]  # a hot vector
    rows = {i: x.astype(np.float32).astype(float) for i, x in enumerate(v)}
    data = [(i, x.tolist(), 0) for i, x in rows.items()]
    odd = [(2000, None, 0), (2020, [0.0] * 12, 0), (2040, [float("nan")] * 12, 0), (2060, [None] + [1.0] * 11, 0), (2080, [float("inf")] * 12, 0), (None, [1.0] * 12, 0)]
    short = [(2100, [1.0], 0), (2101, [3.0], 0), (2102, [-1.0], 0)]  # neighbours have the same length
    df = spark.createDataFrame(data + odd + short + data[:3], "vec_id long, embedding array<float>, shard int").repartition(3)
    other = [x for x in H.nearest(df, shard_rows=400).collect() if x.query_id == 2100]
    assert [(x["rank"], x.vec_id, x.score) for x in sorted(other, key=lambda x: x["rank"])] == [(1, 2101, 3.0), (2, 2102, -1.0)]
    df = df.where("vec_id < 2100 OR vec_id IS NULL")
    out = H.nearest(df, shard_rows=400).collect()
    want = exact(rows)
    assert recall(out, want) >= 0.95
    score = {(q, i): s for q, near in exact(rows, 1500).items() for i, s in near}
    assert all(abs(score[r.query_id, r.vec_id] - r.score) < 1e-9 for r in out)
    hot = [x for x in out if x.query_id == 700]
    assert [x.vec_id for x in sorted(hot, key=lambda x: x["rank"])][:5] == [i for i, _ in want[700][:5]]
    few = H.nearest(df.where("vec_id < 5")).collect()
    assert sorted((r.query_id, r["rank"]) for r in few) == [(0, k) for k in range(1, 5)]
    assert H.nearest(df.limit(0)).collect() == []


def test_hnsw_rows_that_share_an_id(spark):
    """Each is a query of its own, and a candidate of the other."""
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0]), (0, [0.0, 2.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = {}
    for x in H.nearest(df).collect():
        got.setdefault(x.query_row, []).append((x["rank"], x.vec_id, x.score))
    assert sorted(map(sorted, got.values())) == [[(1, 7, 1.0), (2, 0, 0.0)], [(1, 7, 2.0), (2, 0, 0.0)]]


def test_hnsw_ties_and_several_shards(spark):
    """Vectors of few values have many equal scores: the smaller id wins, whatever shard it is in. Recall over shards."""
    r = np.random.default_rng(8)
    tied = {i: r.integers(1, 3, 6).astype(float) for i in range(900)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in tied.items()], "vec_id long, embedding array<double>")
    want = exact(tied)
    for x in H.nearest(df, shard_rows=128).collect():
        assert (x.vec_id, x.score) == want[x.query_id][x["rank"] - 1]
    rows = {i: v for i, v in enumerate(r.normal(size=(9000, 24)))}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>").repartition(4)
    assert H.build_index(df, shard_rows=2500).count() == 4
    assert recall(H.nearest(df, shard_rows=2500).collect(), exact(rows)) >= 0.95


def test_hnsw_query(spark, sf_small):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()}
    assert recall(H.op7_hnsw(spark, sf_small).collect(), exact(rows)) >= 0.9


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def check_scores(rows, data):
    known = Counter(w for i, t in data if not held(i) for w in [*tokens_of(t), b"\n"])
    n, v = sum(known.values()), len(known)
    text = dict(data)
    assert len(rows) == len(data)
    for r in rows:
        w = [*tokens_of(text[r.doc_id]), b"\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(known[x] > 0 for x in w), n)
        base = sum(math.log10((known[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert abs(base - r.base_score) < 1e-6 * max(1, abs(base)) and r.score <= 0


HELD = "pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), 5) = 1"


def chain_corpus(n=400, seed=2):
    """Texts of a Markov chain: contexts tell much about the next word."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    follow = {w: [r.choice(words) for _ in range(3)] for w in words}
    data = []
    for k in range(n):
        w = r.choice(words)
        out = [w]
        for _ in range(r.randrange(5, 60)):
            w = r.choice(follow[w]) if r.random() < 0.9 else r.choice(words)
            out.append(w)
        data.append((k, " ".join(out)))
    return data


def test_language_model(spark):
    data = chain_corpus() + [(1000, None), (1001, ""), (1002, "UNSEEN words Only"), (None, "w1 w2"), (1004, "a " * 4000)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in data], "doc_id long, text string, score double").repartition(3)
    out = P.score(df, F.expr(HELD)).collect()
    check_scores(out, data)
    new = [r for r in out if r.held_out and r.doc_id < 1000]
    base, score = (sum(r[c] for r in new) / sum(r.n_tokens for r in new) for c in ("base_score", "score"))
    assert score > base + 0.25  # log10 a token: the contexts were learnt
    again = {r.doc_id: r.score for r in P.score(df.coalesce(3), F.expr(HELD)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, rel=1e-6) for r in out)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        other = {r.doc_id: r.score for r in P.score(df.repartition(9), F.expr(HELD)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert all(other[r.doc_id] == pytest.approx(r.score, rel=1e-6) for r in out)


def test_language_model_learns_rare_contexts(spark):
    """Each of 2,000 cues, a hundredth of a percent of the tokens each, has one follower; a unigram can't tell it."""
    r = random.Random(4)
    pairs = [(f"cue{k}", f"then{r.randrange(2000)}") for k in range(2000)]
    data = [(k, " ".join(w for _ in range(20) for w in r.choice(pairs))) for k in range(1200)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    out = P.score(df, F.expr(HELD)).collect()
    check_scores(out, data)
    new = [x for x in out if x.held_out]
    n = sum(x.n_tokens for x in new)
    assert sum(x.score for x in new) / n > sum(x.base_score for x in new) / n + 0.8


def test_language_model_whatever_the_layout(spark):
    """A word of 0.115 % of the tokens that lies mostly in one part is the same context as in any other layout."""
    r = random.Random(6)
    data = []
    for k in range(400):
        w = [f"w{r.randrange(3000)}" for _ in range(499)]
        for _ in range(1 if k % 200 < (45 if k < 200 else 185) else 0):
            w[10:12] = ["uneven", "follower"]
        data.append((k, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    two = {x.doc_id: x.score for x in P.score(df.coalesce(1).repartitionByRange(2, "doc_id"), F.lit(False)).collect()}
    one = {x.doc_id: x.score for x in P.score(df.coalesce(1), F.lit(False)).collect()}
    assert all(two[k] == pytest.approx(v, rel=1e-6) for k, v in one.items())


def test_language_model_is_a_distribution():
    """Over the vocabulary and one unknown word the root's and each context's probabilities add up to 1."""
    r = np.random.default_rng(5)
    word, context = np.divmod(np.arange(40 * 4), 4)
    count = r.integers(0, 9, 160) * r.integers(0, 2, 160)
    row = {"bucket": 0, "pair_word": word.astype(np.int32).tobytes(), "pair_context": context.astype(np.uint16).tobytes(), "pair_count": count.astype(np.int64).tobytes(), "word_hashes": np.arange(40, dtype=np.uint64).tobytes(), "context_hashes": np.arange(90, 93, dtype=np.uint64).tobytes()}
    t = P.Totals(4, P.Chain(row, 4).start())
    c, theta = P.Chain(row, t), P.THETA
    for number in range(1, 5):
        c.sweep(number)
        seen = c.sums(4)
        t.sweeps.append(P.Totals.vector(seen, 4, int(c.root_tables.sum()), int(c.root.sum())))
        parent, unknown = c.parent(t.sweeps[number], theta), (theta + t.d0 * t.sweeps[number][1]) / (t.types + 1) / (theta + t.sweeps[number][2])
        assert (c.of_word[parent <= unknown * 1.0000001] == 0).all()
        left = t.types - (c.of_word > 0).sum()
        assert left == 0
        known = parent[c.of_word > 0].sum() + unknown
        assert known == pytest.approx(1)
        p = c.predict(number).reshape(40, 4)
        for u in range(1, 4):
            miss = (theta + t.d1 * t.sweeps[number][0][u]) * unknown / (theta + t.customers[u])
            assert p[c.of_word > 0, u].sum() + miss == pytest.approx(1)


def test_seat_follows_the_restaurant():
    """Expected tables of one dish with a strong parent, against the exact recursion."""
    keys = np.random.default_rng(3).integers(0, 1 << 63, 20_000).astype(np.uint64)
    for customers, strength, discount in ((2, 0.7, 0.5), (12, 2.0, 0.3), (300, 5.0, 0.6)):
        exact = {1: 1.0}
        for seated in range(1, customers):
            step = {}
            for t, p in exact.items():
                new = strength / (strength + seated - discount * t)
                step[t + 1] = step.get(t + 1, 0) + p * new
                step[t] = step.get(t, 0) + p * (1 - new)
            exact = step
        want = sum(t * p for t, p in exact.items())
        got = P.seat(keys, np.full(20_000, customers), np.full(20_000, strength), discount)
        assert got.min() >= 1 and got.max() <= customers
        assert abs(got.mean() - want) < 0.03 * want
    assert P.seat(keys[:2], np.array([0, 1]), np.ones(2), 0.5).tolist() == [0, 1]


def test_binomial_quantiles():
    r = np.random.default_rng(4)
    for n, p in ((7, 0.3), (500, 0.01), (500, 0.99), (4000, 0.4), (1, 0.5), (60, 0.0), (60, 1.0)):
        got = P.binomial(r.random(20_000), np.full(20_000, n), np.full(20_000, p))
        assert got.min() >= 0 and got.max() <= n
        assert abs(got.mean() - n * p) < 6 * (n * p * (1 - p) / 20_000) ** 0.5 + 1e-9 and abs(got.var() - n * p * (1 - p)) < 0.06 * n * p * (1 - p) + 1e-9


def test_strength_follows_its_conditional():
    """Expected auxiliaries against sums and simulated beta variables."""
    r = np.random.default_rng(6)
    customers, tables = np.array([1, 2, 9, 400]), np.array([1, 1, 4, 37])
    shape, rate = P.auxiliary(customers, tables, 1.7, 0.6)
    assert shape == pytest.approx(sum(1.7 / (1.7 + 0.6 * i) for t in (1, 4, 37) for i in range(1, t)), rel=1e-6)
    want = -sum(np.log(r.beta(2.7, c - 1, 200_000)).mean() for c in (2, 9, 400))
    assert rate == pytest.approx(want, rel=0.01)
    draws = [P.strength(1, k, 0, shape, rate) for k in range(4000)]
    assert np.mean(draws) == pytest.approx((1 + shape) / (1 + rate), rel=0.05)
    x = np.array([0.3, 1.0, 7.5, 1e6])
    assert np.allclose(P.digamma(x), [-3.5025242, -0.5772157, 1.9468, 13.81551], atol=1e-3)


def test_language_model_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.score(df, F.expr(HELD)).collect() == []
    one = P.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).collect()[0]
    assert one.train_tokens == 0 and one.n_known == 0 and one.base_score == 0


def test_quality(spark):
    r = random.Random(7)
    words = [f"word{k}" for k in range(400)]
    bad = ["nastyone", "nastytwo", "vile", "vilest"]
    data, labels = [], []
    for k in range(1200):
        t = [r.choice(words) for _ in range(r.randrange(20, 200))]
        junk, toxic = r.random() < 0.15, r.random() < 0.15
        if toxic:
            t = [r.choice(bad) if r.random() < 0.05 else w for w in t] + [r.choice(bad)]
        text = " ".join(f"{w.upper()}!!" if junk else w for w in t)
        data.append((k, text, r.choice(["en", "de", None]), "low" if junk and r.random() < 0.7 else f"s{k % 4}", 3, "x"))
        if k < 700:
            labels.append((k, int(not junk), int(toxic)))
        data[-1] += (junk, toxic)
    truth = {d[0]: d[6:] for d in data}
    rows = [d[:6] for d in data] + [(5000, None, "en", None, 0, "x"), (5001, "", None, "s1", 0, "x"), (None, "word1 word2", "en", "s1", 0, "x"), data[0][:6]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, p_junk string").repartition(3)
    lab = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (700, None, None)], "doc_id long, quality int, toxic int")
    model = Q.train(df, lab)
    assert any(sum(x) for x in model.exchanged.values())
    out = [x for x in Q.score(df, lab).collect()]
    assert len(out) == len(rows)
    new = [x for x in out if x.row.doc_id is not None and 700 <= x.row.doc_id < 1200]
    right = [x.keep != any(truth[x.row.doc_id]) for x in new]
    assert sum(right) / len(right) > 0.97
    kept = Q.keep_good(df, lab)
    assert kept.columns == df.columns


def test_co_training_against_plain(spark):
    """Fits, rounds and combination once more, over all rows at once, a row at a time."""
    r = random.Random(9)
    words = [f"word{k}" for k in range(60)]
    data, labels = [], []
    for k in range(500):
        junk = r.random() < 0.3
        t = " ".join(r.choice(words).upper() if junk and r.random() < 0.6 else r.choice(words) for _ in range(r.randrange(5, 60)))
        data.append((k, t, "en", "low" if junk and r.random() < 0.8 else "high"))
        if k < 240:
            labels.append((k, int(not junk), 0))
    data += data[300:310]  # repeated rows say the same
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").repartition(3)
    got = Q.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), words=10, rounds=3, sure=0.9)
    y = {i: 1 - q for i, q, _ in labels}
    own = [d for d in data if d[0] in y]
    pool = list({d[1:]: d for d in data if d[0] not in y}.values())
    raw = Q.Model(sorted(got.place), 0 * got.center, 0 * got.scale + 1)

    def views(docs):
        text = raw.text_rows([d[1] for d in docs])
        wide = len(got.place)
        text[:, wide:] = (text[:, wide:] - got.center) / got.scale
        return [text.astype(float), np.array([Q.meta_row(d[2], d[3], d[1]) for d in docs], float)]

    lab, rest = views(own), views(pool)
    numbers = raw.text_rows([d[1] for d in own])[:, len(got.place) :]
    assert np.allclose(got.center, numbers.mean(0), atol=1e-5)
    truth = np.array([y[d[0]] for d in own])
    held = [k for k in range(len(own)) if k % 4 == 3]
    train = [k for k in range(len(own)) if k % 4 != 3]
    w = [Q.fit(x[train].astype(np.float32), truth[train]) for x in lab]
    sure, moved = 0.9, []
    prob = lambda c, x: 1 / (1 + math.exp(-max(-30, min(30, float(x @ c[:-1] + c[-1])))))
    for _ in range(3):
        new, used = [], 0
        for me, other in ((0, 1), (1, 0)):
            x = np.hstack([lab[me][train], np.ones((len(train), 1))])
            bound = 1.3 / 4 * x.T @ x + np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
            g = np.append(w[me][:-1], 0)
            for k in train:
                g = g + (prob(w[me], lab[me][k]) - truth[k]) * np.append(lab[me][k], 1)
            for value in (0, 1):
                says = lambda c, x, v=value: prob(c, x) if v else 1 - prob(c, x)
                asked = [k for k in held if says(w[other], lab[other][k]) >= sure]
                taught = [k for k in range(len(pool)) if says(w[other], rest[other][k]) >= sure]
                if taught and asked and sum(truth[k] == value for k in asked) / len(asked) >= sure - 0.01:
                    weight = 0.3 * min(1, sum(truth[k] == value for k in train) / len(taught))
                    used += len(taught)
                    for k in taught:
                        g = g + weight * (prob(w[me], rest[me][k]) - value) * np.append(rest[me][k], 1)
            new.append(w[me] - np.linalg.solve(bound, g))
        w = new
        moved.append(used)
    assert sum(moved) > 0 and got.exchanged["junk"] == moved
    for a, b in zip(got.flaws["junk"][0], w, strict=True):
        assert np.allclose(a, b, atol=5e-3)
    z = np.array([[x[k] @ c[:-1] + c[-1] for c, x in zip(w, lab, strict=True)] for k in held])
    assert np.allclose(got.flaws["junk"][1], Q.fit(z, truth[held], l2=0.1), atol=5e-2)
    assert "toxic" not in got.flaws


def test_quality_without_labels(spark):
    df = spark.createDataFrame([(1, "a", "en", "s")], "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.keep for x in Q.score(df, none).collect()] == [True]
    same = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [x.keep for x in Q.score(df, same).collect()] == [True]
    assert Q.score(df.limit(0), none).collect() == []
