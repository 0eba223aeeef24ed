"""Mixing, line dedup, license scan and sharding against plain-Python models and their laws."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from sparkloom.llm import license_scan as L
from sparkloom.llm import line_dedup as D
from sparkloom.llm import mixing as M
from sparkloom.llm import sharding as S
from sparkloom.llm.common import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, shard string"


def rows(spark, data, parts=3):
    return spark.createDataFrame([(i, t, lang, src, len(t or ""), 1, "x") for i, t, lang, src in data], SCHEMA).repartition(parts)


def texts(n, seed=3):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(99)}" for _ in range(r.choice([0, 1, 5, 40, 200]))) for _ in range(n)]


def targets(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left, base = total - sum(capped.values()), sum(w[s] for s in free)
        above = [s for s in free if left * w[s] / base > most * sizes[s] * (1 + 1e-12)]
        if not above:
            return capped | {s: left * w[s] / base for s in free}
        capped |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("parts", [1, 5])
def test_mixing(spark, parts):
    data = [(k if k % 50 else None, t, "en", None if k % 7 == 0 else f"s{min(k % 9, 4)}") for k, t in enumerate(texts(900))]
    data += [(1000, None, "en", "s1"), (1001, "", "en", "tiny"), (1002, "one", "en", "tiny"), data[5], data[5], (1003, "", "en", "void")]
    out = M.decide(rows(spark, data, parts)).collect()
    assert sum(r.m for r in out) == len(data)
    size, taken, far = Counter(), Counter(), {}
    for _, t, _, src in data:
        size[src] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in out:
        taken[r.source] += r.copies * r["size"] * r.m
        far[r.source] = r.target
        assert 0 <= r.copies <= 3
    want = targets({s: n for s, n in size.items()})
    for s, n in want.items():
        assert abs(far[s] - n) < 1e-6 * max(1, n)
        assert abs(taken[s] - n) <= 600, (s, taken[s], n)
    again = M.decide(rows(spark, data[::-1], 7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    mixed = M.mix(rows(spark, data, parts))
    assert mixed.columns == SCHEMA.replace(",", "").split()[::2]
    got = Counter((r.doc_id, r.text, r.source) for r in mixed.collect())
    for r in out:
        if r["size"] > 200:
            assert sum(n for (i, t, s), n in got.items() if i == r.id and s == r.source and len((t or "").split()) == r["size"]) >= r.copies


def test_mixing_keeps_expectation(spark):
    data = [(k, " ".join(["w"] * (1 + k % 30)), "en", "a" if k < 60 else "b") for k in range(300)]
    total = Counter()
    for seed in range(12):
        for r in M.decide(rows(spark, data, 1).coalesce(1), seed=seed * 1000, fan_in=8).collect():
            total[r.source] += r.copies
            p = r.target / r.source_size
    for s, n in (("a", 60), ("b", 240)):
        size = sum(1 + k % 30 for k in range(300) if (k < 60) == (s == "a"))
        whole = sum(1 + k % 30 for k in range(300))
        t = targets({"a": whole - size if s == "b" else size, "b": size if s == "b" else whole - size})[s]
        assert abs(total[s] / 12 / n - t / size) < 0.12
    assert p > 0


def test_mixing_empty(spark):
    assert M.decide(rows(spark, [(1, "a", "en", "s")]).limit(0)).collect() == []


def chunk(text, marks):
    lines, out, own = text.split("\n"), [], []
    for i, x in enumerate(lines):
        own.append(x)
        if i == len(lines) - 1 or (marks[i] and not marks[i - 1]):
            out.append(own)
            own = []
    return out


def marks(t):
    x = [hashlib.md5(y.encode()).hexdigest() for y in t.split("\n")]
    return [False] + [int(hashlib.md5((a + b).encode()).hexdigest()[-6:], 16) % 4 == 0 for a, b in zip(x, x[1:], strict=False)]


def chunks_of(t):
    """(first line, lines) of the chunks of both sizes that have enough bytes."""
    lines, out, at = t.split("\n"), [], 0
    for own in chunk(t, marks(t)):
        if len(own) > 2:
            out.append((at, own))
        at += len(own)
    out += [(i, lines[i : i + 2]) for i in range(len(lines) - 1)]
    return [(i, x) for i, x in out if sum(len(y.encode()) for y in x) >= D.LEAST]


def test_line_dedup(spark):
    r = random.Random(5)
    line = [f"line {k} " + " x" * (k % 30) for k in range(400)]
    blocks = [[r.choice(line) for _ in range(r.randrange(2, 14))] for _ in range(12)]
    data = []
    for k in range(120):
        parts = [[r.choice(line) for _ in range(r.randrange(0, 6))] for _ in range(3)]
        parts.insert(r.randrange(4), r.choice(blocks))
        data.append((k if k % 40 else None, "\n".join(x for p in parts for x in p), "en", "s"))
    data += [(200, None, "en", "s"), (201, "", "en", "s"), (202, "\n\n\n", "en", "s"), (203, "\n\n\n", "en", "s"), data[3], data[3], (300, data[3][1], "en", "s")]
    df = rows(spark, data)
    own = spark.createDataFrame([(t[1],) for t in data], "t string").selectExpr("t", "xxhash64(t) h").distinct().collect()
    text_hash = {x.t: x.h for x in own}
    key_of = lambda i, t: ((1 << 63) - 1 if i is None else i, text_hash[t])
    places = defaultdict(list)
    for i, t, _, _ in data:
        for at, x in chunks_of(t) if t is not None else []:
            places["\n".join(x)].append((*key_of(i, t), at))
    want = []
    for i, t, _, _ in data:
        gone = set()
        for at, x in chunks_of(t) if t is not None else []:
            if (*key_of(i, t), at) != min(places["\n".join(x)]):
                gone.update(range(at, at + len(x)))
        want.append((i, t if not gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), sorted(gone), 0 if t is None else t.count("\n") + 1))
    got = [(x.row.doc_id, x.kept, list(x.removed), x.n_lines) for x in D.dedup(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(len(x[2]) for x in want) > 100
    assert D.dedup(df.limit(0)).collect() == []


def test_repeated_passages_go_whole(spark):
    """Passages of 2 to 10 lines and over 50 words, each in three documents with other neighbours."""
    r = random.Random(6)
    fresh = iter(range(10**9))
    new_line = lambda: " ".join(f"w{next(fresh)}" for _ in range(30))
    data, planted = [], {}
    for n in range(2, 11):
        for _ in range(6):
            passage = [new_line() for _ in range(n)]
            for copy in range(3):
                before = [new_line() for _ in range(r.randrange(0, 5))]
                planted[len(data)] = (len(before), n, copy)
                data.append((len(data), "\n".join([*before, *passage, *(new_line() for _ in range(r.randrange(0, 5)))]), "en", "s"))
    for x in D.dedup(rows(spark, data)).collect():
        at, n, copy = planted[x.row.doc_id]
        assert list(x.removed) == ([] if copy == 0 else list(range(at, at + n)))


def test_line_dedup_of_a_very_long_text(spark):
    """Time grows with the lines, not with their square."""
    import time

    took = {}
    for n in (2000, 100_000, 200_000):
        text = "\n".join(f"one two three four five six seven {k % (n // 2)}" for k in range(n))
        began = time.time()
        out = D.dedup(spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")).collect()
        took[n] = time.time() - began
        assert sum(len(x.removed) for x in out) == n // 2
    assert took[200_000] < 4 * took[100_000] + 5


def test_line_dedup_query(spark, sf_small):
    out = D.op5_line_dedup(spark, sf_small).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    assert len(out) == len(text) and any(r.removed_lines for r in out)
    for r in out:
        if not r.removed_lines:
            assert r.kept_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def places(words, phrase):
    p = words_of(phrase)
    return [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]


def test_license_scan(spark, sf_small):
    odd = [
        None, "", "CC-BY and cc by cc by", "All rights reserved. ALL RIGHTS RESERVED", "general public licenses", "cc", "by cc",
        "é cc by é general public license" * 4, "Released under the MIT License.", "released under MIT License", "Licensed under CC BY-NC 4.0.",
        "Licensed under the fine Apache License, Version 2.0", "Licensed under\nthe Apache License, Version 2.0. " * 2, "cc by " * 3000,
    ]
    data = [(k if k != 3 else None, t, "en", "s") for k, t in enumerate(odd)] + [(2, odd[2], "en", "s")]
    data += [(r.doc_id + 100, r.text, "en", "s") for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    out = L.scan(rows(spark, data)).collect()
    got = sorted((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.doc_id) for r in out if r.doc_id is not None)
    want = []
    for i, t, _, _ in data:
        w = words_of(t)
        at = {x: places(w, p) for p, x in L.BASE.items()}
        every = [x for v in at.values() for x in v]
        if i is not None:
            want.append((len(w), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(x for x in at if at[x])), i))
    key = lambda x: (x[-1], str(x))
    assert sorted(got, key=key) == sorted(want, key=key)
    by = {r.doc_id: r for r in out}
    assert by[8].labels == "mit" and by[8].score == 1 and (by[8].spans[0].first, by[8].spans[0]["last"]) == (0, 4)
    assert by[11].labels == "apache-2.0" and 0.8 < by[11].score < 1
    assert by[10].labels == "cc-by,cc-by-nc-4.0" and by[4].labels == "" and by[0].score == 0
    assert sum(r.doc_id == 2 for r in out) == 2
    assert L.scan(rows(spark, data).limit(0)).collect() == []


def test_license_texts_of_any_length(spark):
    """Whole licences, verbatim, with changed names and with a word put in; a template of 300 words; half a licence."""
    mit = next(t for t, x in L.NOTICES.items() if x == "mit-text")
    bsd = next(t for t, x in L.NOTICES.items() if x == "bsd-3-clause-text").split()
    long_ = " ".join(f"t{k}" for k in range(300))
    data = [
        (0, f"Some words first. {mit.upper()} and more"), (1, " ".join([*bsd[:90], "really", *bsd[90:]])), (2, f"x {long_} y"),
        (3, " ".join(bsd[: len(bsd) // 2])), (4, " ".join(w for k, w in enumerate(long_.split()) if k % 40)), (5, mit + " " + mit),
    ]
    out = {r.doc_id: r for r in L.scan(rows(spark, [(i, t, "en", "s") for i, t in data]), notices=L.NOTICES | {long_: "long"}).collect()}
    assert "mit-text" in out[0].labels.split(",") and out[0].score == 1
    at = [(s.first, s["last"]) for s in out[0].spans if s.label == "mit-text"]
    assert at == [(3, 2 + len(mit.split()))]
    assert "bsd-3-clause-text" in out[1].labels.split(",") and len([s for s in out[5].spans if s.label == "mit-text"]) == 2
    assert out[2].labels == "long" and [(s.first, s["last"]) for s in out[2].spans] == [(1, 300)]
    assert "bsd-3-clause-text" not in out[3].labels.split(",") and out[4].labels == "long"


def test_license_scan_compares_words(spark, monkeypatch):
    """Templates whose hashes are those of other words get no votes."""
    own = L.templates
    data = rows(spark, [(0, "all rights reserved", "en", "s")])
    assert L.scan(data).first().n_base == 1
    monkeypatch.setattr(L, "templates", lambda *a: own(*a).withColumn("words", F.when(F.col("tid") >= 0, F.expr("transform(words, w -> concat(w, 'x'))"))))
    out = L.scan(data).first()
    assert (out.n_words, out.n_base, out.labels, out.score) == (3, 0, "", 0)


def sharding_rows():
    data = [(k, t, ["en", "de", None][k % 3], f"src{k % 20 if k % 3 else 0}") for k, t in enumerate(texts(3000, 8))]
    return data + [(5000 + k, "a large group " * 20, "en", "src1") for k in range(1200)] + [(9000, None, None, None), (None, "x", "en", "s"), (9001, "twice", "en", "s"), (9001, "twice", "en", "s"), (9002, "w " * 9000, "en", "s")]


def test_sharding(spark):
    data = sharding_rows()
    out = S.with_slots(S.assign(rows(spark, data))).collect()
    assert len(out) == len(data) and out[0].row.asDict().keys() == set(SCHEMA.replace(",", "").split()[::2])
    load, slots, group = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        assert r["size"] == len((r.row.text or "").encode()) + 8 and r.crc == zlib.crc32((r.row.text or "").encode())
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        group[r.row.text].add(r.shard)
    assert set(load) == set(range(24)) and max(load.values()) < 1.05 * min(load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for t, s in group.items() if not (t or "").startswith("a large group"))
    assert S.assign(rows(spark, data).limit(0)).collect() == []


@pytest.mark.parametrize("shards", [24, 5])
def test_shards_are_leaves(spark, monkeypatch, shards):
    """Every split is found again from its node's units: what lies before the zone went left, what lies behind it right,
    and both sides have the bytes of their leaves."""
    seen = []

    def noted(df, label, real=S.stored):
        out = real(df, label)
        if label == "shard-level":
            seen.append({tuple(r[:4]): (r.bytes, r["keys"], r.node) for r in out.collect()})
        return out

    monkeypatch.setattr(S, "stored", noted)
    assert S.assign(rows(spark, sharding_rows()), shards=shards).count() == len(sharding_rows())
    nodes = [(0, shards)]
    whole = sum(b for b, _, _ in seen[0].values())
    for before, after in zip(seen, seen[1:], strict=False):
        for a, b in [n for n in nodes if n[1] - n[0] > 1]:
            mid = (a + b) // 2
            units = {u: x for u, x in before.items() if x[2] == a}
            right = {u for u in units if after[u][2] == mid}
            assert all(after[u][2] in (a, mid) for u in units)
            total = sum(x[0] for x in units.values())
            got = total - sum(units[u][0] for u in right)
            assert abs(got - total * (mid - a) / (b - a)) < 0.02 * whole / shards, (a, b)
            wide = [max(x[1][d] >> S.HASH_BITS for x in units.values()) - min(x[1][d] >> S.HASH_BITS for x in units.values()) for d in range(4)]
            d = wide.index(max(wide))
            # Only units of the zone, or large ones, may stand out of order.
            small = sorted((x[1][d], u in right) for u, x in units.items() if x[0] <= S.BIG * whole / shards)
            first = next((i for i, (_, r) in enumerate(small) if r), len(small))
            last = max((i for i, (_, r) in enumerate(small) if not r), default=-1)
            assert last - first < S.ZONE
        nodes = [n for a, b in nodes for n in ([(a, (a + b) // 2), ((a + b) // 2, b)] if b - a > 1 else [(a, b)])]
    assert nodes == [(k, k + 1) for k in range(shards)]


def test_sharding_few_rows(spark):
    out = S.assign(rows(spark, [(k, "same" if k < 3 else f"t{k}", "en", "s") for k in range(5)])).collect()
    assert len(out) == 5 and all(0 <= r.shard < 24 for r in out)


def test_sharding_clashing_columns(spark):
    df = spark.createDataFrame([(k, f"text {k}", "en", "s", k, k, 2) for k in range(60)], "doc_id long, text string, lang string, source string, h long, node long, shard int")
    out = S.assign(df.drop("shard")).select("row.*", "shard").collect()
    assert {(r.doc_id, r.h, r.node) for r in out} == {(k, k, k) for k in range(60)} and len(out) == 60
