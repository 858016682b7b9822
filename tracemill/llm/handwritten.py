"""Generated, minified, data and third-party files among the code files of releases.

Copies are found through an inverted index of line hashes over all files: a file whose lines stand to a share of `least`
in the files of another project shares with it one of its rarest lines, so only these are looked up, and the exact share
is counted for what they meet. Such a file is third-party where its place or its heading names that project; a
directory for foreign packages or a heading with another package and version also tell. What a file is made of is
judged on its content: markers that tools leave in the heading or behind the code, and the composition of its tokens
(names, literals, white space, repeated line shapes, rows of equal fields).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, release
from .corpus import is_code

LEAST_SHARE = 0.8
# fixed values: wording of tool headings, directories and names by convention
MARKED = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated\b\s*(:|by|from|file|code|with|using)|\bdo not (edit|modify|change)\b|"
    r"\b(code|file|source|module|output)\s+(was\s+|is\s+)?(auto-?)?(produced|generated|emitted|created|written)\s+(automatically\s+)?(by|from|with)\s+\S|"
    r"\bmachine[- ](written|generated)\b|\bedit \S+ instead\b|"
    r"^\W*(this\s+(file|module|code)\s+)?(is\s+|was\s+)?(automatically\s+)?(generated|produced)\s+(by|from)\b|\bmanual (changes|edits) will be (lost|overwritten)\b",
    re.I,
)
NAMED = re.compile(r"^\W*(?:part of|copied from|vendored from|taken from|bundled from|from)?\s*((?:@[\w.-]+/)?[A-Za-z][\w.-]*?)(?:@|,?\s+(?:-\s+)?(?:v(?:ersion)?\.?\s*)?)(\d+\.\d+[\w.+-]*)\b", re.I)
NOT_PACKAGES = frozenset("apache gpl lgpl agpl mpl bsd mit isc asl epl cc cddl license licence licenses version v mozilla gnu python node nodejs typescript javascript ecmascript es since copyright revision release".split())
VENDOR_DIRECTORIES = "node_modules|bower_components|jspm_packages|third_party|third-party|thirdparty|3rdparty|vendor|vendors|vendored|_vendor|_vendored|extern|external|externals|deps"
GENERATED_PATH = r"(^|/)(gen|generated|__generated__|_generated|autogen|codegen_out)/|(\.generated|\.gen|\.g|\.pb|_pb2|_pb2_grpc|_pb)\.[A-Za-z]+$"
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_NUMBER = re.compile(r"\b(?:0[xX][0-9a-fA-F]+|\d[\d_.]*(?:[eE][+-]?\d+)?)")
_NAME = re.compile(r"\b[^\W\d]\w*")
_MARK = re.compile(r"[^\w\s\[\]{}(),:;=\-\"'`]")
_CONSTANTS = ("true", "false", "null", "None", "True", "False")
_DOCSTRING = re.compile(r"\A\s*(?:[rRuU]?\"\"\"[\s\S]*?\"\"\"|[rRuU]?\'\'\'[\s\S]*?\'\'\')")
_FIELDS = re.compile(r"[;,|\t]")
_COMMENT = re.compile(r"^\s*(//|#|/?\*|<!--|\"\"\"|''')")
_ACCESSOR = re.compile(r"\b(get|set|has|clear)_?[A-Za-z]\w*\s*\(|\b(this|self)\._\w+\s*(=|$)|\breturn (this|self)(\._\w+)?\b|\bprivate _\w+", re.M)
_LONG_COMMENTS = re.compile(r"/\*[\s\S]*?\*/|(?m:^\s*(?://|#)[^\n]*$)")


def heading(source: str) -> list[str]:
    """The comment lines at the head of a source, docstrings and shebang included, blank lines skipped."""
    out, block = [], ""
    for line in source.split("\n"):
        s = line.strip()
        if not s:
            continue
        if block:
            out.append(line)
            if block in s:
                block = ""
        elif s[:2] == "/*":
            out.append(line)
            block = "" if "*/" in s[2:] else "*/"
        elif s[:3] in ('"""', "'''"):
            out.append(line)
            block = "" if s[:3] in s[3:] else s[:3]
        elif _COMMENT.match(line):
            out.append(line)
        else:
            break
    return out


def closing(source: str) -> list[str]:
    """The comment lines behind the last code line of a source, from the last one upwards, blank lines skipped."""
    out, lines = [], source.split("\n")
    while lines:
        line = lines.pop()
        s = line.strip()
        if not s:
            continue
        if s[-2:] == "*/":
            block = [line]
            while "/*" not in block[-1] and lines:
                block.append(lines.pop())
            if block[-1].strip()[:2] != "/*" or "*/" in s[:-2]:
                break
            out += block
        elif s[:2] == "//" or s[0] == "#" or s[:4] == "<!--" or (len(s) > 6 and s[:3] in ('"""', "'''") and s[-3:] == s[:3]):
            out.append(line)
        else:
            break
    return out


def rows_of_fields(lines: list[str]) -> bool:
    """Whether all lines are rows of one table: as many fields in each, split by one separator, and nothing that makes code."""
    if len(lines) < 3:
        return False
    found = _FIELDS.search(lines[0])
    if not found or any(c in x for x in lines for c in "(){}[]=<>"):
        return False
    by = found.group()
    fields = lines[0].count(by)
    return all(x.count(by) == fields and x.rstrip()[-1:] != by for x in lines)


def composition(source: str) -> tuple[bool, bool, bool]:
    """(minified, data, repetitive) by the tokens of a source without its comments and opening docstring.

    minified: lines that are long throughout, hardly any white space and short names. data: nothing but literals,
    separators and a name to hold them, or one literal that is nearly all of the text, or rows of equally many fields.
    repetitive: accessors of fields make up most of the lines and repeat a few shapes, as a tool writes them.
    """
    body = _DOCSTRING.sub("", _LONG_COMMENTS.sub("", source)).strip()
    if not body:
        return False, False, False
    lines = [x for x in body.split("\n") if x.strip()]
    strings = _STRING.findall(body)
    plain = _STRING.sub(" ", body)
    names = _NAME.findall(plain)
    numbers = _NUMBER.findall(plain)
    constants = sum(map(names.count, _CONSTANTS))
    literal, literal_chars = len(strings) + len(numbers) + constants, sum(map(len, strings)) + sum(map(len, numbers))
    words, marks = len(names) - constants, len(_MARK.findall(plain))
    minified = False
    if len(body) > 120 * len(lines):
        space = len(plain) - len("".join(plain.split())) - len(strings)
        minified = space < 0.09 * len(body) and sum(len(x) <= 2 for x in names) > 0.2 * max(1, words)
    data = literal >= 8 and words + marks <= 0.06 * (words + marks + literal) + 3 or literal_chars > 0.85 * len(body) or rows_of_fields(lines)
    repetitive = False
    if len(_ACCESSOR.findall(body)) >= 0.5 * len(lines):
        accessors = sum(1 for x in lines if _ACCESSOR.search(x))
        repetitive = accessors >= 0.5 * len(lines) and len({re.sub(r"\w+", "w", x) for x in lines}) <= 0.4 * len(lines)
    return minified, data, repetitive


def line_hashes(source: str) -> np.ndarray:
    """The hashes of the different lines of a source, without the blanks around them; empty lines do not count."""
    lines = {x.strip(" ") for x in source.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ").split("\n")}
    lines.discard("")
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x.encode("utf-8", "surrogatepass")) for x in lines), dtype=np.uint64, count=len(lines)).view(np.int64)


def line_sets(blobs: DataFrame) -> DataFrame:
    """(blob_id, lines): the line hashes of blobs (id, source)."""

    def run(batches):
        for batch in batches:
            lines = [line_hashes(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.int64()))], names=["blob_id", "lines"])

    return blobs.where("id is not null and source is not null").select("id", "source").mapInArrow(run, "blob_id bigint, lines array<bigint>")


def features(blobs: DataFrame) -> DataFrame:
    """(blob_id, marked, minified, data, repetitive, claims, lines): what the contents of code blobs say, in one reading.

    claims are the packages named in the heading, lines the hashes of the lines.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for i, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = source.as_py()
                head = heading(text)
                claims = [m.group(1) for m in map(NAMED.match, head) if m and m.group(1).lower() not in NOT_PACKAGES]
                rows.append((i, any(MARKED.search(x) for x in head + closing(text)), *composition(text), claims, line_hashes(text)))
            columns = list(zip(*rows)) if rows else [[]] * 7
            types = (pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["blob_id", "marked", "minified", "data", "repetitive", "claims", "lines"])

    return blobs.select("id", "source").mapInArrow(run, "blob_id bigint, marked boolean, minified boolean, data boolean, repetitive boolean, claims array<string>, lines array<bigint>")


def package_name(c: Column) -> Column:
    """A package name without scope, version and spelling differences."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(c, "^@[^/]*/", "")), r"[-@_]v?\d+\.\d.*$", ""), "[_.]", "-")


def contained(sets: DataFrame, held: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """(blob_id, project, share): the projects whose files hold a share of at least `least` of the lines of a blob (blob_id, lines).

    held has (blob_id, project), which project's releases hold which blob. Blobs that a project holds itself have a share of
    1 and are not looked up. A line of one blob only is therefore never looked up and is dropped first; the index lists for
    each other line the projects that hold it. A blob that lacks more lines in projects that do not hold the blob than the
    share allows is dropped; for the others, as many of the rarest lines are looked up as there must be one among them that
    the project holds. Shares are exact.
    """
    spark = sets.sparkSession
    held = held.select("blob_id", "project").distinct()
    sets = sets.select("blob_id", "lines").where("size(lines) > 0")
    of = Window.partitionBy("line")
    each = sets.select("blob_id", F.explode("lines").alias("line"))
    met_twice = materialise(each.select("blob_id", "line", F.min("blob_id").over(of).alias("least"), F.max("blob_id").over(of).alias("most")).where("least < most").select("blob_id", "line"))
    release(spark)
    index = materialise(met_twice.join(held, "blob_id").select("line", "project").distinct())
    release(spark)
    spread = index.groupBy("line").agg(F.count("*").alias("projects"))
    sizes = sets.select("blob_id", F.size("lines").alias("n")).join(held.groupBy("blob_id").agg(F.count("*").alias("holders")), "blob_id", "left")
    # all holders of a blob hold its lines, so any further project of a line is another one
    elsewhere = met_twice.join(spread, "line").join(sizes, "blob_id").where(F.col("projects") > F.coalesce("holders", F.lit(0)))
    shared = elsewhere.groupBy("blob_id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("projects", "line"))).alias("shared"))
    # of the n - ceil(least n) + 1 rarest lines those that no other project holds come first
    look = F.size("shared") - F.ceil(F.col("n") * least - 1e-9) + 1
    able = materialise(shared.where(look > 0).select("blob_id", "n", F.col("shared.line").alias("lines"), F.slice("shared.line", F.lit(1), look.cast("int")).alias("rare")))
    release(spark)
    met = able.select("blob_id", F.explode("rare").alias("line")).join(index, "line").select("blob_id", "project").distinct()
    new = met.join(held, ["blob_id", "project"], "left_anti")
    counted = new.join(able.select("blob_id", "n", F.explode("lines").alias("line")), "blob_id").join(index, ["line", "project"]).groupBy("blob_id", "project").agg((F.count("*") / F.first("n")).alias("share"))
    return held.select("blob_id", "project", F.lit(1.0).alias("share")).union(counted.where(F.col("share") >= least - 1e-9))


def code_files(blobs: DataFrame, files: DataFrame, releases: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Code files as (file_id, blob_id, path, own, project), the known code as (id, source), and projects as (project, name).

    A project is named by the least id among those of one package name; own and project are null where the release is unknown.
    """
    code = blobs.where(is_code(F.col("language")) & F.col("id").isNotNull())
    named = projects.where("id is not null and name is not null").select(F.col("id").alias("project_id"), package_name(F.col("name")).alias("own"))
    keys = named.groupBy("own").agg(F.min("project_id").alias("project"))
    of = releases.select(F.col("id").alias("release_id"), "project_id").join(named.join(keys, "own"), "project_id").select("release_id", "own", "project")
    path = F.regexp_replace(F.col("path"), r"^(\./)+", "")
    rows = files.select(F.col("id").alias("file_id"), "release_id", "blob_id", path.alias("path")).join(of, "release_id", "left").join(code.select(F.col("id").alias("blob_id")), "blob_id", "left_semi")
    return rows.select("file_id", "blob_id", "path", "own", "project"), code.where("source is not null").select("id", "source"), keys.select("project", F.col("own").alias("name"))


def copies(rows: DataFrame, sets: DataFrame, names: DataFrame, claims: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """(file_id) of the code files that another project holds, where a directory of the path or a heading (blob_id, claim) names it.

    Files that lie at the same path there do not count: they tell of a fork of the whole project.
    """
    held = rows.where("project is not null").select("blob_id", "project", "path")
    directories = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    placed = rows.select("file_id", "blob_id", "path", "own", F.explode(directories).alias("sign"))
    headed = rows.select("file_id", "blob_id", "path", "own").join(claims.withColumnRenamed("claim", "sign"), "blob_id").select("file_id", "blob_id", "path", "own", "sign")
    signs = placed.union(headed).withColumn("name", package_name(F.col("sign"))).where(F.col("name") != F.coalesce("own", F.lit("")))
    told = signs.join(names, "name").select("file_id", "blob_id", "path", "project").distinct()
    forked = held.select("path", "project").distinct()
    return told.join(contained(sets, held, least), ["blob_id", "project"]).join(forked, ["path", "project"], "left_anti").select("file_id").distinct()


def not_handwritten(blobs: DataFrame, files: DataFrame, releases: DataFrame, projects: DataFrame) -> DataFrame:
    """(file_id, path, blob_id, reasons) of every code file; reasons is empty for files written by hand.

    Files of null or unknown releases have no package of their own, so any named package is foreign to them. Null
    paths give no sign by place, null sources none by content. Repeated ingestions count each.
    """
    rows, known, names = code_files(blobs, files, releases, projects)
    place = F.regexp_extract("path", rf"(?i)(?:^|/)(?:{VENDOR_DIRECTORIES})/((?:@[^/]+/)?[^/]+)(?:/|$)", 1)
    direct = F.col("path").rlike(rf"(?i)(?:^|/)(?:{VENDOR_DIRECTORIES})/[^/]+$")
    own = F.coalesce("own", F.lit(""))
    placed = F.coalesce((place != "") & (direct | (package_name(place) != own)), F.lit(False))
    told = materialise(features(known))
    copied = copies(rows, told, names, told.select("blob_id", F.explode("claims").alias("claim"))).withColumn("copied", F.lit(True))

    joined = rows.withColumn("placed", placed).join(told.drop("lines"), "blob_id", "left").join(copied, "file_id", "left")
    claimed = F.coalesce(F.exists("claims", lambda c: package_name(c) != own), F.lit(False))
    # a heading of the own package says that the tool-free file is its own; other packages' headings show a copy
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(yes("marked") | F.coalesce(F.col("path").rlike(GENERATED_PATH), F.lit(False)) | (yes("repetitive") & ~yes("data")), F.lit("generated")),
            F.when(yes("minified"), F.lit("minified")),
            F.when(yes("data"), F.lit("data")),
            F.when(F.col("placed") | claimed | yes("copied"), F.lit("third-party")),
        )
    )
    return joined.select("file_id", "path", "blob_id", reasons.alias("reasons"))
