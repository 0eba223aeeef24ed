"""The pipeline's stages, each against a brute-force version on its own input."""

from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sparkloom.llm.common import words_of  # noqa: E402

from .test_decontamination import brute as windows  # noqa: E402
from .test_near_dedup import brute as similar  # noqa: E402


def test_every_stage(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns = docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_small}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_small).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        seen[name] = (before, after)
        assert docs.columns == (columns if k < 4 else [*columns, "shard"])
        rows = {r.doc_id: tuple(r) for r in before}
        assert all(rows[r.doc_id] == tuple(r)[: len(columns)] for r in after)
    before, after = seen["quality classifier"]
    kept = {r.doc_id for r in after}
    good = [i for i, r in labels.items() if r.quality == 1 and r.toxic == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    before, after = seen["MinHash near-dedup"]
    root = similar([r.text for r in before])
    least = {}
    for r, c in zip(before, root, strict=True):
        key = c if words_of(r.text) else ("none", r.doc_id)
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert {r.doc_id for r in after} == set(least.values()) and len(after) == len(least)
    before, after = seen["benchmark decontamination"]
    want = set()
    for r in before:
        n, hit, _ = windows(r.text, items)
        if not (hit and 20 * hit >= n):
            want.add(r.doc_id)
    assert {r.doc_id for r in after} == want
    before, after = seen["mixing sources to target weights"]
    copies = Counter(r.doc_id for r in after)
    assert max(copies.values()) <= 3
    size = Counter()
    taken = Counter()
    for r in before:
        size[r.source] += len(r.text.split())
        taken[r.source] += len(r.text.split()) * copies[r.doc_id]
    assert all(taken[s] <= 3 * size[s] for s in size)
    before, after = seen["sharding"]
    assert len(before) == len(after)
    at = {}
    for r in after:
        at.setdefault(r.text, set()).add(r.shard)
    assert all(0 <= r.shard < 24 for r in after) and sum(len(s) == 1 for s in at.values()) >= 0.9 * len(at)


def test_run(spark, sf_small):
    out = corpus_pipeline.run(spark, sf_small)
    assert out.columns[-1] == "shard" and out.count() > 50


def test_run_on_odd_rows(spark, sf_small, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and clashing extra columns, and empty tables."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    odd = [(None, None, None, None, None), (900_001, "", "en", "s", 0), (900_002, "word " * 60_000, None, "src1", 5), (900_003, "one two three", "en", None, 3)]
    more = docs.unionByName(spark.createDataFrame([*odd, *odd], docs.schema))
    clash = {"row": 1, "node": 2, "h": 3, "t": "x", "size": 4, "keep": True, "shard": 7, "copies": 8, "items": "y", "uid": 9, "class_id": 1, "text_": None}
    from pyspark.sql import functions as F

    more = more.withColumns({c: F.lit(v).cast("string") if v is None else F.lit(v) for c, v in clash.items()})
    columns = more.columns
    seen = more
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen, sf_small)
        assert out.columns == (columns if k < 4 else [c for c in columns if c != "shard"] + ["shard"])
        out.write.parquet(f"{tmp_path}/{k}")
        seen = spark.read.parquet(f"{tmp_path}/{k}")
    last = seen.collect()
    assert len(last) > 50 and all(r.h == 3 and r.t == "x" and r.copies == 8 and 0 <= r.shard < 24 for r in last)
    empty = more.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_small).collect() == []
