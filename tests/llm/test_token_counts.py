"""Token counts against the library's own encoding of every whole text."""

import public_tokenizers as P
from sparkloom.llm import token_counts as C

ODD = [
    None, "", " ", "Hello, it's 2024!  We'LL_see…", "tab\tnew\nline\r\n", "日本語 mixed ÉCOLE naïve", "ΣΑΣ ς", "İstanbul ı ǅ ŉ",
    "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "½ ² ٣ x²", "é combining", "'s'S''t !!'s _a_ 1a2", "\x00\x1c a b​c", "퟿😀 ok" * 50,
    "x" * 5000, "don't stop " * 3000, "ªº µ ß ĳ ſ",
]


def check(spark, texts, **parameters):
    t = C.tokenizer(P.path("word_bpe_49k.json"))
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    rows = [(k, x, 7) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    out = C.count_tokens(df, P.path("word_bpe_49k.json"), **parameters)
    assert out.columns == ["doc_id", "text", "n_tokens"]
    assert [r.n_tokens for r in out.orderBy("doc_id").collect()] == want


def test_odd_texts(spark):
    check(spark, ODD)


def test_every_character_of_the_fast_path(spark):
    chars = [chr(c) for c in [*range(32, 0x250), 9, 10, 11, 12, 13, *range(0x2010, 0x2028), 0x20AC]]
    check(spark, [f"{c}a {c} 1{c}b {c}{c}" for c in chars if not 0xD800 <= ord(c) < 0xE000])


def test_small_cache_and_no_table(spark):
    texts = [f"word{k} other{k * 7} {'z' * k}" for k in range(300)]
    check(spark, texts, table_size=0, cache_size=20)
    assert C.count_tokens(spark.createDataFrame([], "text string"), P.path("word_bpe_49k.json")).collect() == []


def test_frequent_words_of_all_sources(spark):
    rows = [("alpha beta" if k < 1000 else "gamma delta",) for k in range(2000)]
    df = spark.createDataFrame(rows, "text string").coalesce(1)
    assert {"alpha", "beta", "gamma", "delta"} <= set(C.frequent(df, "text", P.path("word_bpe_49k.json")))


def test_what_the_table_holds(spark):
    """The most frequent ones by counts over all partitions, none of any length."""
    rows = [(f"{'z' * 70} common common often w{k} {'often' if k % 2 else 'seldom'}",) for k in range(400)]
    df = spark.createDataFrame(rows, "text string").repartition(5)
    path = P.path("word_bpe_49k.json")
    assert set(C.frequent(df, "text", path, table_size=3, drawn=1.0)) == {"common", "often", "w"}
    assert set(C.frequent(df, "text", path, table_size=1, drawn=1.0)) == {"common"}
    assert "z" * 70 not in C.frequent(df, "text", path, drawn=1.0)


def test_query(spark, sf_small):
    t = C.tokenizer(P.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}
    out = C.op2_token_counts(spark, sf_small).collect()
    assert len(out) == len(text)
    for r in out:
        n = len(t.encode(text[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text[r.doc_id] or "").encode()), n, n > 2048)
