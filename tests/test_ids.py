import base64

import pytest
from pyspark.sql import functions as F
from sparkloom.functions import ids


def value(spark, make, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_kinds_and_parts(spark):
    names = ["file:a/b.ts", "sym:a#b#c", "ext:js:x", "unresolved:q", "sym:nohash", "sym:#x"]
    assert value(spark, ids.node_kind, *names) == ["file", "symbol", "external", "external", "symbol", "symbol"]
    assert value(spark, ids.file_path, *names)[:4] == ["a/b.ts", "a", None, None]
    assert value(spark, ids.symbol_name, *names) == [None, "b#c", None, None, None, "x"]
    assert value(spark, ids.containing_file, *names)[:3] == [None, "file:a", None] and value(spark, ids.containing_file, "sym:#x") == [None]
    assert value(spark, ids.display_name, *names) == ["b.ts", "b#c", "js:x", "solved:q", "sym:nohash", "x"]


def test_parse(spark):
    got = value(spark, ids.parse_node_id, "file:p", "sym:p#n#m", "sym:p", "ext:x", "ext:js:a:b", "other")
    assert got[0].path == "p" and (got[1].path, got[1].name) == ("p", "n#m") and got[2] is None and got[3] is None
    assert (got[4].language, got[4].specifier) == ("js", "a:b") and got[5] is None
    t = value(spark, ids.parse_target, "file:a#b", "a#b#c", "#a", "x\ny#z")
    assert t[0].node_id == "file:a#b" and (t[1].path, t[1].symbol) == ("a#b", "c") and t[2].path == "#a" and (t[3].path, t[3].symbol) == ("x\ny", "z")


def test_cursor(spark):
    for n in (0, 7, 100, 123456789):
        text = base64.urlsafe_b64encode(str(n).encode()).decode().rstrip("=")
        df = spark.range(1).select(ids.encode_cursor(F.lit(n)).alias("c"), ids.decode_cursor(F.lit(text)).alias("n"))
        assert tuple(df.first()) == (text, n)
    assert value(spark, ids.decode_cursor, "", "!!", "LTQ", "YWJj", "A") == [0] * 5  # none, none, -4, abc, a broken one


@pytest.mark.parametrize(
    ("path", "out"), [("a/node_modules/x", True), ("a/node_modules", False), ("mydist/x", True), ("x.pyc", True), ("src/pyc", False), ("a\\.git\\b", True), ("distance/x", False)]
)
def test_ignored(spark, path, out):
    assert value(spark, ids.ignored, path) == [out]


def test_globs():
    import re

    for glob, yes, no in (("**/*.ts", "a/b.ts", "a/b.js"), ("src/?.c", "src/a.c", "src/ab.c"), ("a+(b)", "a+(b)", "ab")):
        assert re.search(ids.glob_regex(glob), yes) and not re.search(ids.glob_regex(glob), no)


def test_packages(spark):
    assert value(spark, ids.package_name, "lodash/fp", "@a/b/c", "@a", "x") == ["lodash", "@a/b", "@a", "x"]
    assert value(spark, ids.package_of_path, "r/node_modules/a/node_modules/@s/p/i.js", "r/x") == ["@s/p", "r/x"]
    assert value(spark, ids.framework_name, "UIKit/UIKit.h", "a.h", "/a/b.h") == ["UIKit", "a", "/a/b"]


def test_within(spark):
    df = spark.createDataFrame([("/a/b", "/a"), ("/ab", "/a"), ("/a/", "/a"), ("\\a\\b", "/a/")], "p string, r string")
    assert [r[0] for r in df.select(ids.is_within(F.col("p"), F.col("r"))).collect()] == [True, False, True, True]


def test_cpp_signs(spark):
    texts = ["class A", "namespace {", "template<int>", "operator+", "#include <vector>", "#include <sys/types.h>", "int classy;", "x = std::y;", "#include <map> // c"]
    assert value(spark, ids.looks_cpp, *texts) == [True, True, True, True, True, False, False, True, False]
