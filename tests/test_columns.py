import base64
import hashlib

from pyspark.sql import functions as F

from tracemill import kernels as K
from tracemill.functions import columns as X


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["_"])
    return df.select(c.alias("r")).first()[0]


def test_paths(spark):
    rows = spark.createDataFrame([("src/a.ts",), ("a/b.test.js",), ("dist/x.mjs",), ("README",), ("x/.git/y.py",)], "path string")
    got = rows.select(X.language("path"), X.auxiliary("path"), X.derived("path")).collect()
    assert [tuple(r) for r in got] == [("typescript", False, False), ("javascript", True, False), ("javascript", False, True), ("unknown", False, False), ("python", False, False)]


def test_exclusions_cover_whole_segments(spark):
    rows = spark.createDataFrame([("src/a",), ("src/a/b.py",), ("src/ab",)], "path string")
    assert [r[0] for r in rows.select(X.excluded_by("path", ["src/a"])).collect()] == [True, True, False]


def test_unsafe_paths(spark):
    bad = ["", "/a", "a/../b", "a//b", "./a", "c:\\x", "a%2fb", "a\\b", "x\x01", "a" * 513]
    rows = spark.createDataFrame([(p,) for p in bad + ["a/b.py"]] + [(None,)], "path string")
    assert [r[0] for r in rows.select(X.safe_path("path")).collect()] == [False] * len(bad) + [True, False]


def test_selection_takes_the_first_reason(spark):
    rows = [("vendor/a.js", "x"), ("a.txt", "x"), ("a.js", "x" * 100_001), ("a.js", "a\0b"), ("a.js", "// @generated\n"), ("a.js", "y" * 1001), ("a.js", "let a = 1;\n"), ("a.js", None)]
    df = spark.createDataFrame(rows, "path string, source string")
    got = [r[0] for r in df.select(X.selection_reason("path", "source")).collect()]
    assert got == ["excluded_path", "unsupported_type", "too_large", "binary", "generated", "minified", None, None]


def test_hash_columns_equal_the_kernels(spark):
    assert one(spark, X.fnv1a32("t"), t="hello") == K.fnv1a("hello")
    assert one(spark, X.fnv1a32("t"), t="") == K.fnv1a("")
    text = "a  \r\nb\t\n"
    assert one(spark, X.exact_hash("t"), t=text) == hashlib.sha256(b"a\nb\n").hexdigest()
    got = one(spark, X.winnow("h", 3), h=[9, 2, 7, 1, 8, 3, 6])
    assert [tuple(r) for r in got] == [(2, 1), (1, 3), (3, 5)]
    empty = spark.sql("select cast(array() as array<bigint>) h").select(X.winnow("h", 3)).first()[0]
    assert empty == []


def test_ranges_and_excerpts(spark):
    df = spark.sql("select array(named_struct('start', 8, 'end', 9), named_struct('start', 1, 'end', 3), named_struct('start', 3, 'end', 5), named_struct('start', 6, 'end', 6)) r, array(named_struct('start', 1, 'end', 2), named_struct('start', 10, 'end', 12)) s, cast(array() as array<struct<start:int,end:int>>) e")
    row = df.select(X.merge_ranges("r"), X.merge_ranges("s"), X.merge_ranges("e"), X.format_ranges("s")).first()
    assert [[tuple(x) for x in r] for r in row[:3]] == [[(1, 9)], [(1, 2), (10, 12)], []]
    assert row[3] == "1–2, 10–12"
    source = "\n".join(str(i) for i in range(1, 101))
    assert one(spark, X.excerpt("s", F.lit(10), F.lit(12), 2), s=source) == "8\n9\n10\n11\n12\n13\n14"
    assert one(spark, X.excerpt("s", F.lit(10), F.lit(12), 2, 5), s=source).count("\n") == 4


def test_repository_addresses(spark):
    rows = ["https://github.com/a-b/c.d.git", "a/b", "https://github.com/a", "https://u:p@github.com/a/b", "http://github.com/a/b", "", None]
    name, error = X.repository_of("u")
    got = [tuple(r) for r in spark.createDataFrame([(r,) for r in rows], "u string").select(name, error).collect()]
    assert got == [("a-b/c.d", None), ("a/b", None), (None, "UNSUPPORTED"), (None, "CREDENTIALS"), (None, "UNSUPPORTED"), (None, "EMPTY"), (None, "EMPTY")]


def test_integrity(spark):
    data = b"content"
    b64 = "sha512-" + base64.b64encode(hashlib.sha512(data).digest()).decode()
    rows = [(data, b64, True), (data, "sha256-" + hashlib.sha256(data).hexdigest(), True), (data, "sha256-00", False), (data, None, True), (data, "what", False)]
    df = spark.createDataFrame(rows, "c binary, i string, ok boolean")
    assert all(r[0] == r[1] for r in df.select(X.integrity_matches("c", "i"), "ok").collect())


def test_small_texts(spark):
    assert one(spark, X.escape_html("t"), t="<a href='x'>&\"") == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    assert one(spark, X.percent("t"), t=0.925) == "93%"
    assert one(spark, X.clean_text("t", 5), t=" a\x00 b  cdefg ") == "a b c"
    assert one(spark, X.purl("e", "n", "v"), e="go", n="@a/b", v="1") == "pkg:golang/%40a/b@1"
    assert one(spark, X.name_tokens("n"), n="@s/Left-Pad_x") == ["left", "pad"]
