"""Near-duplicate classes against brute force over all pairs, and the signatures against exact similarities."""

import random
from itertools import combinations

import numpy as np
import pytest
from sparkloom.llm import dart_minhash as M
from sparkloom.llm import near_dedup as N

SCHEMA = "doc_id long, text string, class_id string, uid int"


def corpus(seed=1):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    texts = [[word() for _ in range(r.choice([1, 3, 5, 8, 40, 120, 300]))] for _ in range(50)]
    for base in texts[:25]:
        for _ in range(r.randrange(0, 5)):
            t = list(base)
            for _ in range(r.randrange(0, 1 + len(t) // 25)):
                t[r.randrange(len(t))] = word()
            texts.append(t)
    hub = [word() for _ in range(150)]
    for _ in range(70):  # a group whose members are about as far apart as the threshold
        t = list(hub)
        for _ in range(3):
            t[r.randrange(len(t))] = word()
        texts.append(t)
    line = ["all", "the", "same", "words", "on", "one", "line"]
    texts += [line * k + [word() for _ in range(3)] for k in (2, 3, 20, 40)]
    return [" ".join(t) for t in texts]


def brute(texts, threshold=0.8):
    s = M.shingles(texts)
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if len(s[i][0]) and len(s[j][0]) and max(M.similarity(s[i][:2], s[j][:2])) >= threshold:
            up[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_shingles_and_similarity():
    a, b, short, none, other = M.shingles(["A b c d e f g, a b c d e!", "a b c d e f g x", "one Two", None, "two one"])
    assert sorted(a[1].tolist()) == [1] * 6 + [2] and len(b[0]) == 4
    w, plain = M.similarity(a[:2], b[:2])
    assert plain == pytest.approx(3 / 8) and w == pytest.approx(3 / (8 + np.log(2)))
    assert len(short[0]) == 1 and short[0][0] != other[0][0] and len(none[0]) == 0 and none[2] == b""


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(2)
    for share, n in ((0.3, 40), (0.8, 300), (0.6, 5)):
        elements = r.integers(1, 1 << 62, 2 * n).astype(np.uint64)
        w = 1 + np.log(r.integers(1, 30, 2 * n))
        cut = int(n * share)
        a, b = np.arange(n), np.arange(n - cut, 2 * n - cut)
        wb = w * np.where(r.random(2 * n) < 0.3, 1.5, 1)
        both = np.intersect1d(a, b)
        common = np.minimum(w[both], wb[both]).sum()
        exact = common / (w[a].sum() + wb[b].sum() - common)
        s = M.signatures([(elements[a], w[a]), (elements[b], wb[b]), (elements[:0], w[:0])], 4096)
        assert abs((s[0] == s[1]).mean() - exact) < 5 * (exact * (1 - exact) / 4096) ** 0.5 + 1e-9
        assert (s[:2] != 0).all() and (s[2] == 0).all()


def test_signature_of_a_document_does_not_depend_on_its_batch():
    texts = corpus()
    whole = M.signatures([(s, M.weights(c)) for s, c, _ in M.shingles(texts)])
    for k in (0, 7, 60):
        s, c, _ = M.shingles([texts[k]])[0]
        assert (M.signatures([(s, M.weights(c))])[0] == whole[k]).all()


def test_classes_match_brute_force(spark):
    texts = corpus()
    order = random.Random(3).sample(range(len(texts)), len(texts))
    rows = [(k, texts[k], "x", 1) for k in order]
    odd = [(1000, None), (1001, ""), (1002, " !"), (1003, None), (None, texts[3]), (None, "only without an id"), (None, "only without an id"), (3, texts[3])]
    df = spark.createDataFrame(rows + [(i, t, "y", 2) for i, t in odd], SCHEMA).repartition(3)
    every = [t for _, t, _, _ in rows] + [t for _, t in odd]
    ids = [i for i, _, _, _ in rows] + [i for i, _ in odd]
    root = brute(every)
    copies = {}
    for k, t in enumerate(every):
        if M.words_of(t):
            copies.setdefault(root[k], []).append(k)
    want = sorted((min((ids[k] for k in own if ids[k] is not None), default=-1), sorted(ids[k] if ids[k] is not None else -1 for k in own)) for own in copies.values())
    want = sorted(want + [(i, [i]) for i in (1000, 1001, 1002, 1003)])
    out = N.classes(df).collect()
    assert len(out) == len(every)
    got = {}
    for r in out:
        got.setdefault((r.class_id if r.class_id is not None else -1), []).append(r)
    assert sorted((c, sorted(r.row.doc_id if r.row.doc_id is not None else -1 for r in own)) for c, own in got.items()) == want
    for c, own in got.items():
        assert [r.row.doc_id if r.row.doc_id is not None else -1 for r in own if r.kept] == [c]
        assert all(r.class_size == len(own) for r in own)
    kept = N.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(want)
    assert N.classes(df.limit(0)).collect() == []


def test_blocks_reach_pairs_that_share_no_hub(spark, monkeypatch):
    """Two groups whose members are near each other, not the hub; small blocks must find all of their links."""
    monkeypatch.setattr(N, "BLOCK", 5)
    texts = corpus(9)
    base = texts[0:1]
    r = random.Random(4)
    words = [f"v{k}" for k in range(200)]
    group = []
    for side in range(2):
        other = [f"{w}{side}" if k > 110 else w for k, w in enumerate(words)]
        for _ in range(12):
            t = list(other)
            t[r.randrange(len(t))] = "zz"
            group.append(" ".join(t))
    every = base + group
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(every)], SCHEMA)
    root = brute(every)
    want = {}
    for k, c in enumerate(root):
        want.setdefault(c, []).append(k)
    out = N.classes(df).collect()
    got = {}
    for x in out:
        got.setdefault(x.class_id, []).append(x.row.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(want.values())


def test_plain_links_between_texts_with_repeats(spark):
    """Texts that share most shingles, of which some repeat a line very often: plainly similar, by weight they aren't."""
    r = random.Random(12)
    texts = []
    for g in range(12):
        base = [f"b{g}x{r.randrange(10_000)}" for _ in range(130)]
        for k in range(4):
            line = [f"l{g}x{k}x{j}" for j in range(8)]
            t = base[: 130 - k] + line * (1 if k == 0 else 150)
            texts.append(" ".join(t))
    sets = [s[:2] for s in M.shingles(texts)]
    weak = [x for g in range(12) for i, j in combinations(range(4 * g, 4 * g + 4), 2) for x in [M.similarity(sets[i], sets[j])] if x[1] >= 0.8 > 0.7 > x[0]]
    assert len(weak) > 20
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], SCHEMA)
    want, got = {}, {}
    for k, c in enumerate(brute(texts)):
        want.setdefault(c, []).append(k)
    for x in N.classes(df).collect():
        got.setdefault(x.class_id, []).append(x.row.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(want.values())


def test_rows_without_words_stay(spark):
    """Whatever their number, and whatever bits of the trace are set."""
    from sparkloom.llm import common

    df = spark.createDataFrame([(k, ["", " .", None, "one two", "one two"][k % 5], "x", 1) for k in range(50)], SCHEMA)
    bits, common.TRACE_BITS = common.TRACE_BITS, 1
    try:
        out = N.classes(df).collect()
    finally:
        common.TRACE_BITS = bits
    assert sorted(x.row.doc_id for x in out if x.kept) == sorted({k for k in range(50) if k % 5 < 3} | {3})
    assert len(out) == 50 and sum(x.class_size == 20 for x in out) == 20


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(2000, 2001 + k) for k in range(60)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {x.node: x.root for x in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert N.components(spark.createDataFrame([], "a long, b long")).collect() == []
