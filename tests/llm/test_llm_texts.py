import ast
import random
import re
import warnings
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracemill.llm import grammars, handwritten, licenses, queries
from tracemill.llm.derivatives import Grammar
from tracemill.llm.license_texts import BODIES
from tracemill.llm.leakage import leaks, tiles, words
from tracemill.llm.packing import best_fit, pack, token_counts
from tracemill.llm.survivorship import Attribute, instant, shape_origins, survivors
from tracemill.llm.syntax import rates, verdicts, with_language
from tracemill.llm.truncation import ending, limits, source_rates, truncated

# --- survivorship


def test_survivors_choose_field_by_field(spark):
    df = spark.createDataFrame([("k", 1, None, 5), ("k", 2, "b", 3), ("k", 3, "c", 3), (None, 4, None, 1)], "g string, id bigint, name string, at int").withColumn("top", F.lit("clash"))
    a = Attribute("best", F.col("name"), F.col("name").isNotNull(), (F.col("at"),), F.col("id"))
    r = {x.g: x for x in survivors(df, ["g"], [a], F.count("*").alias("n")).collect()}
    assert r["k"].best == "b" and r["k"].n == 3 and r[None].best is None
    assert survivors(df.where("false"), ["g"], [a]).count() == 0


def test_a_trusted_source_ranks_before_a_later_one(spark):
    rows = [("k", 1, "old", 2, 1), ("k", 2, "new", 1, 9), ("k", 3, None, 5, 10), ("k", 4, "unknown source", None, 20), ("m", 5, "b", 1, 1), ("m", 6, "a", 1, 1)]
    df = spark.createDataFrame(rows, "g string, id bigint, name string, trust int, at int")
    a = Attribute("best", F.col("name"), F.col("name").isNotNull(), (F.col("at"),), F.col("id"), priority=F.col("trust"))
    assert {r.g: r.best for r in survivors(df, ["g"], [a]).collect()} == {"k": "old", "m": "b"}


def test_instants(spark):
    cases = [("2020-01-02", 1577923200), ("2020-01-02T03:04:05.5Z", 1577934245), ("2020-01-02 03:04:05", 1577934245), ("2020-01-02T03:04:05+02:00", 1577927045), ("1577934245000", 1577934245), ("0000-00-00", None), ("unknown", None), ("", None), (None, None), ("2020-13-01", None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    assert [r[0] for r in df.select(F.unix_seconds(instant(F.col("t")))).collect()] == [c[1] for c in cases]


def test_shape_origins(spark):
    blobs = spark.createDataFrame([(1, "s", "python"), (2, "s", None), (3, None, "js"), (4, "t", "text")], "id bigint, shape_hash string, language string").withColumn("projects", F.lit(0))
    files = spark.createDataFrame([(10, 1), (11, 2), (12, 1), (10, 3), (11, 4), (99, 1), (None, 1)], "release_id bigint, blob_id bigint")
    releases = spark.createDataFrame([(10, 5, "2019-01-01"), (11, 6, "2018-01-01"), (12, 7, "1999-01-01"), (13, 8, None)], "id bigint, project_id bigint, first_published string").withColumn("indexed_at", F.lit("2025-01-01").cast("timestamp_ntz"))
    projects = spark.createDataFrame([(5, 0), (6, None), (7, -5)], "id bigint, downloads bigint")
    r = shape_origins(blobs, files, releases, projects).collect()
    assert [(x.shape_hash, x.projects, x.origin_project_id, x.top_project_id) for x in r] == [("s", 3, 6, 5)]
    assert shape_origins(blobs.where("false"), files, releases, projects).count() == 0


# --- syntax


def test_derivatives_of_a_small_grammar():
    g = Grammar("start = 'a' {'b' inner} ['c'] ; inner = '(' [start] ')' ;", "start")
    read = lambda s: g.parse((c, False) for c in s)
    assert read("ab()b(a)c") == ("valid", 9) and read("ab(") == ("truncated", 3) and read("acc") == ("failed", 3) and read("") == ("truncated", 0)


GOOD = [
    "", "# only\n", "x = 1\nif x:\n    pass\nelse:\n  y = [i for i in x if i]\n", "def f(a, *, b=1, **k) -> int:\n\treturn {**a, 'b': b}\n",
    "async def f():\n    async with a as b, c:\n        await d\n", "@d.e(1)\nclass A(B, metaclass=C):\n    x: int = 3\n", "a, *b = c = yield_ = 1\nx[1:2, ::3] += 4\n",
    "match x:\n    case [1, *_] if y:\n        pass\n    case {'a': b, **c}: pass\n", "print(f'{x!r:>{w}}' \"{{\" f'{{}}')\n", "lambda *a, k=1, **b: (yield)\n", "try:\n  pass\nexcept* (A, B) as e:\n  raise X from e\nfinally: pass\n",
    "with (a as b, c as d,):\n  del a[0], b.c\n", "x = (1 if a else 2) if not b is not c else -~d ** 2\n", "from . import (a as b, c,)\nfrom ..x import *\n", "type X[T: int] = list[T]\ndef f[T](x: T): ...\n", "if (y := f(x)) > 1: pass\n", "\"\"\"doc\"\"\"\nx = r'\\'\n" if False else "x = r'\\d'\n",
]
BAD = ["x = (1\n", "def f(:\n  pass\n", "if x\n  pass\n", "  x = 1\n", "if x:\npass\n", "x = 'abc\n", "<<<<<<< a\n", "f(a=1, b)\n", "1 = x\n", "a + b = c\n", "x = 012\n", "x = 1a\n", "def f(a=1, b): pass\n", "for x in y:\n", "class A:\n  def f(self):\n", "if x:\n    a\n  b\n", "print 'a'\n", "else:\n  pass\n", "x = [1, 2\ny = 3\n", "import\n", "try:\n  pass\nx = 1\n"]


@pytest.mark.parametrize("source", GOOD + BAD)
def test_python_agrees_with_the_standard_parser(source):
    try:
        ast.parse(source)
        want = True
    except SyntaxError:
        want = False
    assert (grammars.check(source, "python")[0] == "valid") == want


SCRIPTS = [
    ("import a, { b as c, default as d } from './x';\nexport * as y from 'z'\nexport default function () { return }\n", True),
    ("const f = async (a, { b = 1, ...c }, [d, , e]) => { await g(a) }\nfor await (const x of y) z(x)", True),
    ("class A extends B { static #p = 1; get x() { return this.#p } static { f() } async *g() { yield* h } }", True),
    ("let a = b\n/re[/]x/g.test(c)\nlet t = `a${`n${1}`}b`", False),
    ("let r = /re[/]x/g.test(c); let t = `a${`n${1}`}b`; x ??= y?.z?.[1] ?? 2 ** 3", True),
    ("if (a) b; else { c } do d++; while (e) switch (f) { case 1: g; break; default: }", True),
    ("a = b\n++c", True), ("return 1", False), ("function f() { return\n1 }", True), ("const a;", False), ("f() = ;", False), ("1 + 2 = a", False), ("let x = {a: 1, b, [c]: d, e() {}, ...f}", True),
    ("function f() { if (a) {", False), ("<<<<<<< HEAD\na\n", False), ("export function f( {}", False), ("await x", True), ("function f() { await x }", False), ("var a = 08;", False), ("label: for (;;) { continue label }", True), ("new A.B(1).c; import('x'); import.meta.url", True),
    ("x = 'a\nb'", False), ("({ a: 1 }) => b", False), ("(a, b) => ({})", True), ("interface A { b: string }", False), ("a ? b : c ? d : e", True),
]


@pytest.mark.parametrize("source,valid", SCRIPTS)
def test_scripts(source, valid):
    assert (grammars.check(source, "javascript")[0] == "valid") == valid


TYPED = [
    ("export interface A<T extends B = C> extends D<T> { readonly a?: string[]; [k: string]: number | null; f(x: T): void; new (y): A }", True),
    ("type X = { [K in keyof T]?: T[K] } & (() => void) | 'a' | readonly string[] | [a: number, ...b: C[]]", True),
    ("function f<T>(this: A, a: ReadonlyArray<Map<string, T>>, b?: number): asserts a is B { return g<T>(a!)! as unknown as C }", True),
    ("abstract class A<T> implements B, C { private readonly x: number = 1; constructor(public y?: string) { super() } abstract f(): void; declare z; }", True),
    ("enum E { A = 1, B }\ndeclare module 'x' { export const y: number }\nnamespace N.M { const a = 1 }\nimport type { T } from 'x'; export type { T };", True),
    ("const a = b >> 2 >= c, d = e satisfies F; let g: (x: number) => string; const h = <T,>(x: T): x is T => true", True),
    ("const a: = 1", False), ("interface A { b: string", False), ("class A { f(): { }", False), ("let x: Map<string, number = 1", False), ("function f(a: number b: string) {}", False),
]


@pytest.mark.parametrize("source,valid", TYPED)
def test_typed_scripts(source, valid):
    assert (grammars.check(source, "typescript")[0] == "valid") == valid


def library(step):
    """Sources of the standard library, every step-th; texts that begin with a byte order mark are decoded before they are parsed."""
    root = Path(ast.__file__).parent
    for path in sorted(p for p in root.rglob("*.py") if "site-packages" not in p.parts)[::step]:
        try:
            text = path.read_text(encoding="utf-8")
        except UnicodeDecodeError:
            continue
        if len(text) < 200_000 and not text.startswith("\ufeff"):
            yield path, text


def parses(text):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError):
            return False


def test_the_standard_library_agrees():
    apart = [str(path) for path, text in library(1) if (grammars.check(text, "python")[0] == "valid") != parses(text)]
    assert not apart


def test_damaged_files_of_the_standard_library_agree():
    rng = random.Random(11)
    for path, text in library(9):
        tokens = list(re.finditer(r"\w+|[^\w\s]|\n *", text))
        if len(tokens) < 10:
            continue
        a, b, c, d = (rng.choice(tokens) for _ in range(4))
        cut = text[: rng.randrange(len(text))]
        for damaged in (cut, text[: a.start()] + text[a.end() :], text[: b.start()] + c.group() + text[b.end() :], text[: d.end()] + d.group() + text[d.end() :]):
            assert (grammars.check(damaged, "python")[0] == "valid") == parses(damaged), path


def test_lines_broken_inside_brackets():
    for text in ("x = [1,\n  2] + y\n", "raise X('a'\n  'b') from None\n", "class A:\n    def f(self,\n          a):\n        pass\n", "f'{x['a']}'\n", "f'''{\nx!r:>{w}\n}'''\n"):
        assert grammars.check(text, "python")[0] == "valid" and parses(text)


def test_every_cut_of_a_python_file_agrees():
    source = "import a\n\nclass A(B):\n    def f(self, x=1):\n        if x in (1, 2):\n            return {'a': [x, *y]}\n        try:\n            pass\n        except E as e:\n            raise\n"
    for n in range(len(source)):
        try:
            ast.parse(source[:n])
            want = True
        except SyntaxError:
            want = False
        assert (grammars.check(source[:n], "python")[0] == "valid") == want, n


def test_verdicts_and_rates(spark):
    blobs = spark.createDataFrame([(1, "py", "x = (\n"), (2, None, "x = 1;"), (3, "TypeScript", "let a: = 1"), (4, "text", "("), (5, None, None), (6, None, "??"), (7, "python", "")], "id bigint, language string, source string").withColumn("verdict", F.lit(1))
    files = spark.createDataFrame([(1, "a.py", "r"), (1, "b.py", "r"), (2, "c.js", "r"), (3, "d.ts", None), (6, "e.zig", "r"), (2, None, "r")], "blob_id bigint, path string, repository string")
    found = verdicts(with_language(blobs, files))
    got = {r.id: (r.language, r.verdict) for r in found.collect()}
    assert got == {1: ("python", "truncated"), 2: ("javascript", "valid"), 3: ("typescript", "failed"), 6: (None, "undecided"), 7: ("python", "valid")}
    assert {(r.repository, r.language): (r.files, r.failed + r.truncated) for r in rates(found, files).collect()}[("r", "python")] == (2, 2)
    assert verdicts(with_language(blobs.where("false"), files)).count() == 0


def test_deep_nesting_does_not_crash(spark):
    deep = "x = " + "(" * 5000 + ")" * 5000 + "\n"
    df = spark.createDataFrame([(1, "python", deep), (2, "javascript", "[" * 3000)], "id bigint, language string, source string")
    assert {r.verdict for r in verdicts(df).collect()} <= {"valid", "failed", "truncated", "undecided"}


# --- licences


@pytest.mark.parametrize(
    "text,want",
    [
        ("GPLv3+", {"GPL-3.0-or-later"}), ("GNU General Public License v2 (GPLv2)", {"GPL-2.0-only"}), ("UNLICENSED", set()), ("(MIT OR Apache-2.0)", {"MIT", "Apache-2.0"}), ("Expat", {"MIT"}), ("SEE LICENSE IN LICENSE.md", set()),
        ("License :: OSI Approved :: ISC License (ISCL)", {"ISC"}), ("New BSD License", {"BSD-3-Clause"}), ("2-clause BSD", {"BSD-2-Clause"}), ("AGPLv3", {"AGPL-3.0-only"}), ("LGPL-2.1", {"LGPL-2.1-only"}), ("ASL 2.0", {"Apache-2.0"}), (None, set()), ("", set()), ("NOASSERTION", set()),
        ("The Unlicense (Unlicense)", {"Unlicense"}), ("Mozilla Public License 2.0 (MPL 2.0)", {"MPL-2.0"}),
    ],
)
def test_metadata_names(text, want):
    assert {x[0] for x in licenses.stated(text, True)} == want


def test_statements_of_sources():
    of = lambda s: {x[0] for x in licenses.statement_of_source(s)}
    assert of("#!/usr/bin/env python\n# Use of this source is governed by the\n# GNU Lesser General Public License, version 2.1 only.\nx = 1") == {"LGPL-2.1-only"}
    assert of('import a\n__license__ = "ISC"\n') == {"ISC"}
    assert of("x = 1\n# MIT License\n") == set() and of("// mit dem Rest\nlet a") == set() and of("") == set()
    assert of("/*\n * Licensed under the Apache License, Version 2.0 or the MIT licence\n */\nlet a") == {"Apache-2.0", "MIT"}


def test_alignment_reports_what_was_altered():
    body = "Permission is hereby granted, free of charge, to any person obtaining a copy of this program and associated documentation files"
    ((name, coverage, altered),) = licenses.stated(body)
    assert name == "MIT" and 0.85 <= coverage < 1 and altered == ["software>program"]


def test_findings(spark):
    blobs = spark.createDataFrame([(1, "text", "SPDX-License-Identifier: MIT"), (2, "python", "# @license ISC\n"), (3, "js", None), (4, "python", "# MIT license\n"), (5, "text", None)], "id bigint, language string, source string").withColumn("own", F.lit(1))
    files = spark.createDataFrame([(1, 10, 1), (2, 10, 2), (3, 11, 3), (4, 10, 4), (5, 12, 5), (6, 99, 4), (7, None, 3)], "id bigint, release_id bigint, blob_id bigint").withColumn("found", F.lit(1))
    releases = spark.createDataFrame([(10, "GPL-3.0-only", "MIT"), (11, None, ""), (12, "NOASSERTION", "Expat")], "id bigint, license_spdx string, license_raw string")
    got = {tuple(r) for r in licenses.findings(*licenses.licenses(blobs, files, releases)).collect()}
    assert got == {("release", 10, "conflict"), ("release", 11, "unknown"), ("file", 2, "conflict"), ("file", 3, "unknown"), ("file", 7, "unknown")}
    assert licenses.findings(*licenses.licenses(blobs.where("false"), files, releases.where("false"))).count() == 0


# --- generated, minified, data, third-party


def test_compositions():
    data = "module.exports = [\n" + ",\n".join(f"  [{i}, {i * 7}]" for i in range(60)) + "\n];\n"
    hand = "\n".join(f"function f{i}(alpha, beta) {{\n  if (alpha > {i}) return beta.call{i}(alpha);\n  return {i} + alpha;\n}}" for i in range(4))
    tiny = "".join(f"function _{c}(a,b){{var c=a.x[{i}];return c?b(c,{i}):!1}}" for i, c in enumerate("abcdefghij"))
    assert handwritten.composition(data)[1] and not any(handwritten.composition(hand)[:2]) and handwritten.composition(tiny)[0] and handwritten.composition("") == (False,) * 3
    blob = 'X = "' + "AbC1+/" * 300 + '"\n'
    assert handwritten.composition(blob)[1]


def test_markers_stand_in_comments_only():
    marked = lambda s: any(handwritten.MARKED.search(x) for x in handwritten.heading(s))
    assert marked("// Code generated by x. DO NOT EDIT.\n") and marked('"""Autogenerated: tool 1.2 --in a.proto\n"""\n') and marked("/*\n * @generated\n */")
    assert not marked('BANNER = "DO NOT EDIT"\n') and not marked("# ids are generated once per run; we don't minify them\n")


def test_third_party_by_place_heading_and_lines(spark):
    own = "\n".join(f"const value{i} = compute{i}(source, {i});" for i in range(12))
    other = "\n".join(f"let part{i} = derive{i}(target, {i});" for i in range(12))
    named = "/* Part of left-pad 1.2.3, released under MIT */\n" + own
    blobs = spark.createDataFrame([(1, "js", own), (2, "js", other), (3, "js", named), (4, "text", "x"), (5, "js", None)], "id bigint, language string, source string").withColumn("path", F.lit("clash"))
    projects = spark.createDataFrame([(1, "@me/mine"), (2, "left-pad")], "id bigint, name string")
    releases = spark.createDataFrame([(10, 1), (20, 2)], "id bigint, project_id bigint")
    rows = [(1, 10, 1, "src/a.js"), (2, 10, 1, "vendor/left_pad-1.0.0/a.js"), (3, 10, 1, "vendor/mine/a.js"), (4, 10, 2, "lib/left-pad/b.js"), (5, 20, 2, "lib/b.js"), (6, 10, 3, "src/c.js"), (7, 20, 3, "src/c.js"), (8, 10, 2, "src/vendor_portal/b.js"), (9, 10, 4, "vendor/x/LICENSE"), (10, 10, 5, "gen/d.js"), (11, 10, 1, None), (12, 99, 1, "./node_modules/q/a.js")]
    files = spark.createDataFrame(rows, "id bigint, release_id bigint, blob_id bigint, path string")
    got = {r.file_id: r.reasons for r in handwritten.not_handwritten(blobs, files, releases, projects).collect()}
    assert got == {1: [], 2: ["third-party"], 3: [], 4: ["third-party"], 5: [], 6: ["third-party"], 7: [], 8: [], 10: ["generated"], 11: [], 12: ["third-party"]}
    assert handwritten.not_handwritten(blobs.where("false"), files, releases, projects).count() == 0


# --- packing


def test_best_fit_fills_without_overflow():
    rng = random.Random(4)
    sizes = [rng.randrange(0, 100) for _ in range(500)]
    bins = best_fit(sizes, 100)
    fill = Counter()
    for s, b in zip(sizes, bins):
        fill[b] += s
    assert max(fill.values()) <= 100 and len(fill) <= -(-sum(sizes) // 100) * 1.1 + 1


def containers(spark, *rows):
    return spark.createDataFrame(list(rows), "container string, capacity int")


def test_packing_keeps_every_item_whole(spark):
    rng = random.Random(6)
    items = [(i, rng.randrange(0, 90)) for i in range(700)] + [(1000, 250), (1001, 100), (1002, 300)]
    df = spark.createDataFrame(items, "id bigint, tokens bigint").withColumn("bin", F.lit(1))
    out = pack(df, containers(spark, ("a", 100), ("b", 64), ("none", 0), ("null", None)), group=50).collect()
    for name, capacity in (("a", 100), ("b", 64)):
        mine = [r for r in out if r.container == name]
        total, fill = Counter(), Counter()
        for r in mine:
            total[r.id] += r.tokens
            fill[r.bin] += r.tokens
        assert dict(total) | {i: 0 for i, n in items if n == 0} == dict(items) and max(fill.values()) <= capacity
        assert len({(r.id, r.piece) for r in mine}) == len(mine)
        assert all(len([r for r in mine if r.id == i]) == 1 for i, n in items if n <= capacity)
        whole = best_fit([n % capacity if n > capacity else n for _, n in items if n % capacity or n <= capacity], capacity)
        split = sum(n // capacity for _, n in items if n > capacity)
        # groups of 50 items cost up to 6 % over one best-fit of everything
        assert len(fill) <= (len(set(whole)) + split) * 1.06 + 1
    assert pack(df.where("false"), containers(spark, ("a", 100))).count() == 0


def test_items_that_never_share_a_container_stay_in_bounded_groups(spark):
    df = spark.range(600).select("id", (F.lit(60) + F.col("id") % 5).alias("tokens"))
    out = pack(df, containers(spark, ("a", 100)), group=50)
    assert out.count() == 600 and out.select("bin").distinct().count() == 600


def test_tokens_are_counted(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (None, "x")], "id bigint, text string")
    assert {r.id: r.tokens for r in token_counts(df, "id", "text", queries.VOCABULARY).collect()} == {1: 2, 2: 0, 3: 0}


# --- leakage


def test_words():
    assert words("A-b, (c)  ... Straße é_1") == ["ab", "c", "strasse", "é1"]


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"t{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 60)))) for i in range(12)] + [(12, None), (13, ""), (14, "t0 " * 40)]
    docs = []
    for i in range(80):
        w = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))).split()
        if i % 2:
            source = (rng.choice(items)[1] or "").split()
            a = rng.randrange(0, len(source) + 1)
            w[len(w) // 2 : len(w) // 2] = [x.upper() + rng.choice(["", ",", "!"]) for x in source[a : a + rng.randrange(5, 30)]]
        docs.append((i, " ".join(w)))
    docs += [(90, None), (91, ""), (92, "T0, " * 13), (93, items[0][1])]
    runs = defaultdict(set)
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - 12):
            runs[tuple(w[k : k + 13])].add(i)
    want = {(d, i) for d, t in docs for w in [words(t or "")] for k in range(len(w) - 12) for i in runs.get(tuple(w[k : k + 13]), ())}
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(1))
    q = spark.createDataFrame(items, "item_id bigint, text string").withColumn("answer", F.lit("x"))
    found = leaks(d, "doc_id", "text", q, "item_id", "text").collect()
    assert {(r.id, r.item_id) for r in found} == want and all(r.words <= r.item_words and r.longest >= 13 for r in found)
    assert leaks(d, "doc_id", "text", q.where("false"), "item_id", "text").count() == 0


def test_reordered_passages_are_covered():
    first, second = [f"a{i}" for i in range(15)], [f"b{i}" for i in range(20)]
    found = tiles(second + ["x"] + first, first + second, 13)
    assert sorted(t[2] for t in found) == [15, 20]
    assert tiles(first[:12], first, 13) == [] and tiles([], first, 13) == [] and len(tiles(["a"] * 60, ["a"] * 40, 13)) == 1


def test_coverage_tells_reordered_passages(spark):
    first, second, other = [f"a{i}" for i in range(15)], [f"b{i}" for i in range(20)], [f"c{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(first + second)), (2, " ".join(first + other))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(second + ["x"] + first)), (2, " ".join(first + second)), (3, "no words of it")], "doc_id bigint, text string")
    for bits in (1 << 8, 1 << 20):
        got = {(r.id, r.item_id): (r.tiles, r.words, r.covered, r.reordered) for r in leaks(docs, "doc_id", "text", items, "item_id", "text", bits=bits).collect()}
        assert got == {(1, 1): (2, 35, True, True), (1, 2): (1, 15, False, False), (2, 1): (1, 35, True, False), (2, 2): (1, 15, False, False)}


def test_more_containers_than_before(spark):
    many = containers(spark, *((f"c{i}", 10 + i) for i in range(1200)))
    out = pack(spark.createDataFrame([(1, 7), (2, 4)], "id bigint, tokens bigint"), many)
    assert out.select("container").distinct().count() == 1200
    assert pack(spark.createDataFrame([(1, 7)], "id bigint, tokens bigint"), containers(spark)).count() == 0


# --- truncation


def test_endings(spark):
    cases = [
        ("All done.", "complete"), ("", "complete"), (None, "complete"), ("It ends with a wor", "open"), ("He said \"yes.\"", "complete"), ("Text.\n\n- an item", "complete"), ("Text.\n```\ncode\n```", "complete"), ("See https://x.example/a", "complete"), ("Done.\n\nStatus: open", "complete"), ("Bye.\n\n-- the team", "complete"),
        ("was cut…", "open"), ("was cut [more]", "open"), ("and so on...", "doubtful"), ("> a quote that sto", "doubtful"), ("> a whole quote.", "complete"), ("counted (3 of 3 files)", "doubtful"), ("Since version 8.", "doubtful"), ("For version 8.1.2.", "complete"), ("as told [1]", "complete"), ("fine :)", "complete"), ("Text.\n```\ncode", "doubtful"), ("trailing blank and \n", "open"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    assert [r[0] for r in df.select(ending(F.col("t"))).collect()] == [c[1] for c in cases]


def test_markers_and_claims_beyond_the_first_lines(spark):
    licence = "".join(f"// clause {i} of the licence\n" for i in range(30))
    code = "let a = 1;\nlet b = 2;\n"
    cases = {
        licence + "// Code generated by protoc. DO NOT EDIT.\n" + code: (True, []),
        licence + "// left-pad 1.2.3\n" + code: (False, ["left-pad"]),
        code + "\n// @generated\n\n": (True, []),
        code + "/*\n * Code generated by protoc.\n */\n": (True, []),
        "/* @generated */\n".join(["", code]): (True, []),
        "// do not edit the order below\n".join([code, code]): (False, []),
        code + "let c = 3; /* @generated */": (False, []),
        'x = """\n# @generated\n"""\n': (False, []),
        "": (False, []),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id bigint, source string")
    got = {r.blob_id: (r.marked, r.claims) for r in handwritten.features(df).collect()}
    assert got == dict(enumerate(cases.values()))


def test_a_source_may_have_limits_in_two_measures(spark):
    rng = random.Random(8)
    rows = []
    for i in range(4000):
        w = ["".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 12))) for _ in range(rng.randrange(10, 220))]
        text = " ".join(w) + "."
        if i % 2 and len(text) > 255:
            text = text[:254] + "x"
        elif i % 4 == 0 and len(w) > 120:
            text = " ".join(w[:120]) + ")"
        rows.append((i, "a", text))
    df = spark.createDataFrame(rows, "id bigint, source string, text string")
    cause = {r.id: r.cause for r in truncated(df, "id", "text", "source").collect()}
    assert cause == {i: "limit" if t[-1] != "." else None for i, _, t in rows}


def test_all_of_many_containers_are_packed(spark, tmp_path):
    spark.createDataFrame([(1, "a text")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(1001).selectExpr("cast(id as string) as container", "cast(id + 10 as int) as capacity_tokens").write.parquet(str(tmp_path / "containers.parquet"))
    assert queries.p8_packed(spark, str(tmp_path)).count() == 1001


def test_limits_stand_out_and_cuts_are_flagged(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        n = rng.randrange(40, 500)
        # every text is another one: equal texts count once
        words_ = f"n{i:05} " + "word " * 120
        text = words_[: n - 1] + "."
        if i % 2 and n > 200:
            text = words_[:199] + "w"
        rows.append((i, "a" if i % 3 else "b", text if i % 3 else words_[: n - 1] + "."))
    rows += [(5000, "b", "cut in the midd"), (5001, None, None), (5002, "b", "")]
    df = spark.createDataFrame(rows, "id bigint, source string, text string").withColumn("cause", F.lit(1))
    lengths = df.where("text is not null").select("source", F.lit("chars").alias("measure"), F.length("text").alias("length"))
    assert {(r.source, r.length) for r in limits(lengths).collect()} == {("a", 200)}
    got = {r.id: r.cause for r in truncated(df, "id", "text", "source").collect()}
    assert got[5000] == "transfer" and got[5001] is None and got[5002] is None
    assert {i for i, c in got.items() if c == "limit"} == {i for i, s, t in rows if s == "a" and t.endswith("w")}
    assert truncated(df.where("false"), "id", "text", "source").count() == 0


def _holders(spark):
    rng = random.Random(6)
    line = lambda: " ".join(rng.choice("alpha beta gamma delta rho tau".split()) for _ in range(6))
    common = ["}", "return x", "x = 1"]
    texts = {}
    for i in range(40):
        body = [line() for _ in range(rng.randrange(1, 30))] + rng.sample(common, 2)
        if i >= 20:
            source = texts[rng.randrange(20)].split("\n")
            body = [x if rng.random() > 0.15 else line() for x in source] + [line() for _ in range(rng.randrange(3))]
        texts[i] = "\n".join(body)
    texts[40], texts[41], texts[42] = "}", "", "}\r\n  }\t\r\n"
    held = {(i, rng.randrange(7)) for i in texts} | {(i, rng.randrange(7)) for i in texts}
    return texts, held


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_containment_equals_brute_force(spark, least):
    texts, held = _holders(spark)
    lines = {i: {x.replace("\t", " ").strip(" ") for x in re.split("\r\n|\r|\n", t)} - {""} for i, t in texts.items()}
    of = defaultdict(set)
    for i, p in held:
        of[p] |= lines[i]
    want = {(i, p) for i in texts for p in of if lines[i] and len(lines[i] & of[p]) >= least * len(lines[i]) - 1e-9} | held
    df = spark.createDataFrame([*texts.items(), (None, "x"), (99, "unheld")], "id bigint, source string")
    got = handwritten.contained(handwritten.line_sets(df), spark.createDataFrame(list(held), "blob_id bigint, project bigint"), least).collect()
    assert {(r.blob_id, r.project) for r in got} == want and len(got) == len(want)
    assert handwritten.contained(handwritten.line_sets(df.where("false")), spark.createDataFrame(list(held)[:0], "blob_id bigint, project bigint"), least).count() == 0


def _shuffled_records(spark, run):
    """Records that the stages of run write for shuffles."""
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(found.apply, range(found.size()))}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_lines_of_one_blob_are_moved_once(spark):
    texts = [(i, "\n".join(f"value_{i}_{k} = {k}" for k in range(200))) for i in range(60)]
    sets = handwritten.line_sets(spark.createDataFrame(texts, "id bigint, source string"))
    held = spark.createDataFrame([(i, i % 7) for i, _ in texts], "blob_id bigint, project bigint")
    got = []
    moved = _shuffled_records(spark, lambda: got.extend(handwritten.contained(sets, held).collect()))
    assert {(r.blob_id, r.project, r.share) for r in got} == {(i, i % 7, 1.0) for i, _ in texts} and moved < 1.5 * 60 * 200


def test_blobs_of_no_project_are_found_in_the_only_one_that_holds_their_lines(spark):
    body = [f"value_{i} = compute_{i}(argument)" for i in range(10)]
    texts = [(1, body), (2, [*body[:8], "x", "y"]), (3, [*body[:7], "x", "y", "w"]), (4, [*body, "z"])]
    sets = handwritten.line_sets(spark.createDataFrame([(i, "\n".join(t)) for i, t in texts], "id bigint, source string"))
    held = spark.createDataFrame([(1, 5), (1, 6), (4, 6)], "blob_id bigint, project bigint")
    for only in (held, held.where("project = 5")):
        got = {(r.blob_id, r.project): r.share for r in handwritten.contained(sets, only).collect()}
        want = {(2, 5): 0.8, (1, 5): 1.0, (4, 5): 10 / 11} | ({(2, 6): 0.8, (1, 6): 1.0, (4, 6): 1.0} if only is held else {})
        assert got == want


def test_the_index_finds_vendored_copies_without_markers(spark, monkeypatch):
    monkeypatch.setattr(handwritten, "VENDOR_DIRECTORIES", "no-such-directory")
    monkeypatch.setattr(handwritten, "GENERATED_PATH", "^$")
    body = "\n".join(f"value_{i} = compute_{i}(argument)" for i in range(30))
    blobs = spark.createDataFrame([(1, "python", body), (2, "python", body.replace("compute_3(", "changed(")), (3, "python", "other = 1\nmore = f(2)")], "id bigint, language string, source string")
    files = spark.createDataFrame([(10, 1, 1, "src/a.py"), (11, 2, 2, "third_party/left-pad/a.py"), (12, 2, 2, "lib/plain/a.py"), (13, 2, 3, "third_party/left-pad/b.py"), (14, 2, 1, "src/a.py"), (15, None, 2, "x/left-pad/y.py")], "id bigint, release_id bigint, blob_id bigint, path string")
    releases = spark.createDataFrame([(1, 100), (2, 200)], "id bigint, project_id bigint")
    projects = spark.createDataFrame([(100, "@scope/left_pad"), (200, "own"), (None, "nothing"), (300, None)], "id bigint, name string")
    got = {r.file_id: r.reasons for r in handwritten.not_handwritten(blobs, files, releases, projects).collect()}
    assert got == {10: [], 11: ["third-party"], 12: [], 13: [], 14: [], 15: ["third-party"]}


def test_markers_far_down_and_small_data():
    license_block = "/*\n" + "\n".join(f" * line {i} of a licence" for i in range(40)) + "\n * @generated by somegen 1.2\n */\ncode()\n"
    assert any(handwritten.MARKED.search(x) for x in handwritten.heading(license_block))
    assert handwritten.composition("id;name;weight\n1;a b;3\n2;c;4\n")[1] and not handwritten.composition("f(a);\ng(b);\nh(c);\n")[1]
    assert not handwritten.composition('"""Only a docstring."""\n')[1] and not handwritten.composition("a = b\nc = d\n")[1]
    assert handwritten.composition("X = [" + ", ".join(hex(i * 7919) for i in range(12)) + "]\n")[1]


GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    "text,want",
    [
        (GNU_NOTICE.format(3), "GPL-3.0-or-later"),
        (GNU_NOTICE.format(2), "GPL-2.0-or-later"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation.", "LGPL-2.1-only"),
        *[(body, spdx) for spdx, body in BODIES.items()],
        *[("Copyright (c) 2020 A. Body\n\n" + body.upper() + "\n\nmore words of another kind", spdx) for spdx, body in BODIES.items()],
        ("This file is not licensed under the MIT license", None),
        ("compatible with the GPL, version 2", None),
        ("It was never released under the terms of the Apache License 2.0.", None),
        ("No longer released under the Apache License 2.0 but under the MIT license.", "MIT"),
        ("Licensed under the GPL version 2 (and no later version); see LICENSE.", "GPL-2.0-only"),
    ],
)
def test_labelled_statements(text, want):
    assert [(x[0], x[1]) for x in licenses.stated(text)] == ([(want, 1.0)] if want else [])


def test_altered_clauses_are_reported():
    changed = BODIES["MIT"].replace("without restriction, including without limitation the rights to use", "for private study only, excluding the rights to use")
    (spdx, coverage, altered), = licenses.stated(changed)
    assert spdx == "MIT" and 0.9 < coverage < 1 and {"-restriction", "+private", "+study"} <= set(altered)
    opening = BODIES["MIT"].split("(the")[0] + "to look at it on sundays. " + "the keeper of the well decides all that concerns the garden. " * 12
    (spdx, coverage, altered), = licenses.stated(opening)
    assert spdx == "MIT" and coverage < 0.4 and "-warranties" in altered


def test_coverage_and_alterations_of_files(spark):
    blobs = spark.createDataFrame([(1, "python", "# MIT License\nx = 1\n"), (2, "python", "x = 1\n"), (3, "text", BODIES["ISC"])], "id bigint, language string, source string")
    files = spark.createDataFrame([(10, 1, 1), (11, 1, 2), (12, 1, 3)], "id bigint, release_id bigint, blob_id bigint")
    releases = spark.createDataFrame([(1, "MIT", None)], "id bigint, license_spdx string, license_raw string")
    found, per_file = licenses.licenses(blobs, files, releases)
    assert [(r.metadata, r.documents, r.finding) for r in found.collect()] == [(["MIT"], ["ISC"], "conflict")]
    assert {(r.id, tuple(r.own), r.coverage, tuple(r.release), r.finding) for r in per_file.collect()} == {(10, ("MIT",), 1.0, ("MIT", "ISC"), None), (11, (), None, ("MIT", "ISC"), None)}


def test_limits_are_hazards_not_counts(spark):
    rng = random.Random(4)
    # falling counts: few texts reach 900, and most of those that do end there
    rows = [(int(rng.expovariate(1 / 150)) + 1,) for _ in range(6000)]
    rows = [(n,) for (n,) in rows if n != 900] + [(900,)] * 8
    df = spark.createDataFrame(rows, "length int").select(F.lit("s").alias("source"), F.lit("chars").alias("measure"), "length")
    got = {r.length: r for r in limits(df).collect()}
    assert set(got) == {900} and got[900].n == 8 and got[900].expected < 0.2


def test_a_limit_before_the_mark_of_the_cut(spark):
    rng = random.Random(5)
    words_ = "alpha beta gamma delta éta".split()
    text = lambda n: (" ".join(rng.choice(words_) for _ in range(n)))[:n]
    rows = [(i, text(rng.randrange(50, 900)) + ".") for i in range(600)]
    marks = ["...", "…", " [more]"]
    rows += [(1000 + i, text(500) + marks[i % 3]) for i in range(30)]
    rows += [(2000 + i, text(rng.randrange(50, 400)) + ", and so on...") for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("source", F.lit("s"))
    got = truncated(df, "id", "text", "source")
    assert {r.id for r in got.where("cause is not null").collect()} == {1000 + i for i in range(30)}
    rates_ = source_rates(got).collect()
    assert [(r.documents, r.at_limit, r.in_transfer) for r in rates_] == [(650, 30, 0)] and rates_[0].open_rate == 0
    assert source_rates(got.where("false")).count() == 0


def test_repeated_texts_make_no_limit(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcde fgh ") for _ in range(n))
    rows = [(i, text(40 + i % 300) + "x.") for i in range(600)] + [(1000 + i, "yes " * 83 + "z") for i in range(50)]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("source", F.lit("s"))
    assert {r.cause for r in truncated(df, "id", "text", "source").where("id >= 1000").collect()} == {"transfer"}
