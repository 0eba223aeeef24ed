"""Suffix-array decontamination against a scan that compares every window at every place."""

import hashlib
import random

import numpy as np
from sparkloom.llm import decontamination as D
from sparkloom.llm.common import words_of

DOCS = "doc_id long, text string, item_id int, row string"


def brute(text, items, window=13):
    w = words_of(text)
    hit, named = set(), set()
    for name, t in items:
        v = words_of(t)
        n = min(window, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    hit |= set(range(p, p + n))
                    named.add("" if name is None else str(name))
    return len(w), len(hit), sorted(named)


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: r.choice(["a", "b", "cé", "d4", "E"])
    items = [(k, " ".join(word() for _ in range(r.choice([0, 1, 3, 12, 13, 14, 20, 40])))) for k in range(12)]
    items += [(3, items[5][1]), (None, "x y z"), (99, None), (100, "")]
    docs = []
    for k in range(n):
        parts = [" ".join(word() for _ in range(r.randrange(0, 30)))]
        for _ in range(r.randrange(0, 3)):
            v = words_of(r.choice(items)[1])
            a = r.randrange(0, len(v) + 1)
            parts += [b" ".join(v[a : a + 25]).decode().upper(), "q " * r.randrange(0, 3)]
        docs.append((k if k % 9 else None, ", ".join(parts), 1, "r"))
    return docs + [(500, None, 2, None), (501, "", 2, None), (502, "--- !!", 2, None), docs[1], docs[1]], items


def test_matches_brute_force(spark):
    for seed, window, block_words in ((1, 13, 10**6), (2, 4, 10**6), (3, 13, 30)):
        docs, items = corpus(seed)
        d = spark.createDataFrame(docs, DOCS).repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        out = D.contamination(d, b, window=window, block_words=block_words).collect()
        got = sorted((str(r.row.text), r.n_words, len(r.hit), list(r["items"])) for r in out)
        assert got == sorted((str(t), *brute(t, items, window)) for _, t, _, _ in docs)


def test_longest_matches(spark):
    docs, items = corpus(5)
    items = [x for x in items if x[1] and len(words_of(x[1])) >= 12]
    docs = [(k, t, 1, "r") for k, (_, t, _, _) in enumerate(docs)]
    out = D.longest_matches(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items[:1], "item_id long, text string"), window=5).collect()
    v = words_of(items[0][1])
    best = {}
    for _, t, _, _ in docs:
        w = words_of(t)
        for s in range(len(v)):
            for p in range(len(w)):
                n = 0
                while s + n < len(v) and p + n < len(w) and v[s + n] == w[p + n]:
                    n += 1
                best[s] = max(best.get(s, 0), n)
    assert {r.item_start: r.length for r in out} == {s: n for s, n in best.items() if n >= 5}
    for r in out:
        w = words_of(docs[r.doc_id][1])
        assert w[r.doc_start : r.doc_start + r.length] == v[r.item_start : r.item_start + r.length]


def test_suffix_array_is_sorted():
    r = np.random.default_rng(4)
    words = np.append(r.integers(0, 3, 400), 0).astype(np.int32)
    at = np.flatnonzero(words)
    order = D.suffix_array(words, at, 500)

    def suffix(p):
        return words[p : p + list(words[p:]).index(0) + 1].tolist()

    assert [suffix(p) for p in order] == sorted(suffix(p) for p in at)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two", 1, "r"), (2, None, 1, "r")], DOCS)
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.n_words, r.hit) for r in D.contamination(docs, none).collect()) == [(0, []), (2, [])]
    assert D.contamination(docs.limit(0), none).collect() == []
    assert D.remove_contaminated(docs, docs.select("doc_id", "text").withColumnRenamed("doc_id", "item_id")).collect()[0].doc_id == 2


def test_query(spark, sf_small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    windows = {}
    for name, t in items:
        v = words_of(t)
        n = min(13, len(v))
        for k in range(len(v) - n + 1):
            windows.setdefault(tuple(v[k : k + n]), set()).add(str(name))
    widths = {len(w) for w in windows}
    for r in D.op6_decontamination(spark, sf_small).collect():
        t = spark_text(spark, sf_small)[r.doc_id]
        w, hit, named = words_of(t), set(), set()
        for n in widths:
            for p in range(len(w) - n + 1):
                if names := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    named |= names
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(named))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def spark_text(spark, sf, kept={}):  # noqa: B006
    if sf not in kept:
        kept[sf] = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    return kept[sf]
