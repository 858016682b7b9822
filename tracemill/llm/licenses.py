"""Licence of each code file and release.

Statements are matched against templates: names of licences, whole permission texts and notices. An inverted index of the
templates' rare token shingles finds the candidates; each is confirmed by aligning its tokens with the text around, which
gives its coverage and the tokens that were altered. Where templates overlap, the one that explains most counts.
A statement that is denied ("not licensed under", "compatible with") is none.
"""

from __future__ import annotations

import difflib
import functools
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .corpus import is_code
from .handwritten import heading
from .license_texts import BODIES, GNU_LATER, GNU_ONLY

LEAST_COVERAGE = 0.85
# a text that begins like a licence and goes on for at least half of its length is that licence down to this coverage
LEAST_ALTERED = 0.6
SHINGLE = 5
LONG = 20

# fixed values: names of licences by SPDX identifier; numbers are written without trailing zeros
NAMES = {
    "MIT": ["mit", "expat", "expat mit", "mit expat", "mit license", "expat license", "expat mit license", "permission is hereby granted free of charge to any person obtaining copy of this software and associated documentation files"],
    "Apache-2.0": ["apache 2", "apache license 2", "apache software license 2", "apache software license", "asl 2", "apache license", "licensed under apache license 2 you may not use this file except in compliance with license"],
    "Apache-1.1": ["apache 1.1", "apache license 1.1", "apache software license 1.1"],
    "ISC": ["isc", "isc license", "iscl", "isc license iscl", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "three clause bsd", "new bsd", "modified bsd", "revised bsd", "bsd 3", "bsd license", "bsd"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "two clause bsd", "simplified bsd", "freebsd", "bsd 2"],
    "0BSD": ["0bsd", "zero clause bsd", "bsd zero clause", "0 bsd"],
    "MPL-2.0": ["mpl 2", "mozilla public license 2", "mozilla public license 2 mpl 2", "subject to terms of mozilla public license 2"],
    "MPL-1.1": ["mpl 1.1", "mozilla public license 1.1"],
    "EPL-2.0": ["epl 2", "eclipse public license 2"],
    "EPL-1.0": ["epl 1", "eclipse public license 1"],
    "CDDL-1.0": ["cddl 1", "common development and distribution license 1"],
    "Unlicense": ["unlicense", "this is free and unencumbered software released into public domain"],
    "CC0-1.0": ["cc0", "cc0 1", "creative commons zero 1", "cc0 1 universal"],
    "BSL-1.0": ["bsl 1", "boost software license 1", "boost software license"],
    "Zlib": ["zlib", "zlib license", "zlib libpng"],
    "WTFPL": ["wtfpl"],
    "Artistic-2.0": ["artistic 2", "artistic license 2"],
    "PSF-2.0": ["psf 2", "psf", "python software foundation license"],
    "EUPL-1.2": ["eupl 1.2", "european union public license 1.2"],
}
GNU = {
    "GPL": (["gpl", "gnu gpl", "gnu general public license", "general public license"], ["1", "2", "3"]),
    "LGPL": (["lgpl", "gnu lgpl", "gnu lesser general public license", "lesser general public license", "gnu library general public license"], ["2", "2.1", "3"]),
    "AGPL": (["agpl", "gnu agpl", "gnu affero general public license", "affero general public license"], ["3"]),
}
LATER = ["or later", "plus", "or any later", "or at your option any later", "or newer"]
DROPPED = frozenset("the a an version v".split())
BEFORE_NAME = frozenset("license licenses licensed identifier under or and by approved spdx".split())
UNMISTAKABLE = frozenset("unlicense wtfpl cc0 0bsd iscl".split())
_WORD = re.compile(r"[a-z]+|\d+(?:\.\d+)*|\+")


def tokens(text: str) -> list[str]:
    """Words and numbers of a licence statement in one spelling: licence and license, v3, version 3 and 3.0 alike."""
    low = text.lower().replace("licence", "license").replace("cc0", "cczero").replace("0bsd", "zerobsd")
    low = re.sub(r"\b(a?gpl|lgpl|mpl|epl|asl|bsl)[\s-]*v?\.?\s*(?=\d)", r"\1 ", low)
    low = re.sub(r"\bv\.?\s*(?=\d)", " ", low)
    out = []
    for w in _WORD.findall(low):
        if w == "+":
            w = "plus" if out and out[-1][0].isdigit() else ""
        elif w[0].isdigit():
            w = re.sub(r"(\.0)+$", "", w)
        if w and w not in DROPPED:
            out.append({"cczero": "cc0", "zerobsd": "0bsd"}.get(w, w))
    return out


# fixed values: words that deny the statement behind them, and those that may stand in between
DENYING = frozenset("not never no neither nor without unlike formerly previously instead rather compatible incompatible similar from except".split())
CARRYING = frozenset("license licensed licensing distributed released covered governed available offered published provided made used is are be been longer under by of with to than terms subject conditions any either".split())


@functools.lru_cache(maxsize=1)
def templates() -> tuple[list[tuple[str, tuple[str, ...]]], dict[tuple[str, ...], list[tuple[int, int]]]]:
    """All templates, and the inverted index of their shingles: (template, place) for each.

    Of a short template the rarest shingle of one or two tokens is indexed, which must stand as it is; of one of LONG
    tokens or more every shingle of SHINGLE tokens that is rare among the templates, and as each altered token spoils five
    shingles, one is left intact wherever the coverage is high enough.
    """
    rows = [(spdx, tuple(name.split())) for spdx, names in NAMES.items() for name in names]
    for family, (names, versions) in GNU.items():
        for name in names:
            for v in versions:
                spdx = f"{family}-{v if '.' in v else v + '.0'}"
                base = (*name.split(), v)
                rows.append((f"{spdx}-only", base))
                rows += [(f"{spdx}-or-later", (*base, *more.split())) for more in LATER]
                if name.startswith("gnu ") and name.endswith("license"):
                    rows.append((f"{spdx}-or-later", tuple(tokens(GNU_LATER.format(name=name, number=v)))))
                    rows += [(f"{spdx}-only", tuple(tokens(t.format(name=name, number=v)))) for t in GNU_ONLY]
    rows += [(spdx, tuple(tokens(body))) for spdx, body in BODIES.items()]
    df: Counter = Counter()
    for _, t in rows:
        df.update({t[i : i + k] for k in (1, 2) for i in range(len(t) - k + 1)})
    index = defaultdict(list)
    for n, (_, t) in enumerate(rows):
        if len(t) >= LONG:
            for at in range(len(t) - SHINGLE + 1):
                index[t[at : at + SHINGLE]].append((n, at))
        else:
            k = min(2, len(t))
            at = min(range(len(t) - k + 1), key=lambda i: (df[t[i : i + k]], i))
            index[t[at : at + k]].append((n, at))
    return rows, dict(index)


@functools.lru_cache(maxsize=1)
def openings() -> dict[int, int]:
    """For each template that begins a longer one of the same licence, the longer one."""
    rows, _ = templates()
    whole = {spdx: n for n, (spdx, t) in enumerate(rows) if len(t) >= LONG}
    return {n: whole[spdx] for n, (spdx, t) in enumerate(rows) if spdx in whole and 8 <= len(t) < len(rows[whole[spdx]][1]) and rows[whole[spdx]][1][: len(t)] == t}


def align_long(template: tuple[str, ...], text: list[str], start: int) -> tuple[float, int, int, list[str]]:
    """As align(), for whole texts: the longest common runs are matched first, then those on either side of them."""
    m = len(template)
    slack = max(8, m // 4)
    low, high = max(0, start - slack), min(len(text), start + m + slack)
    window = tuple(text[low:high])
    codes = difflib.SequenceMatcher(None, template, window, autojunk=False).get_opcodes()
    while codes and codes[0][0] == "insert":
        codes.pop(0)
    while codes and codes[-1][0] == "insert":
        codes.pop()
    same, added, altered, begin, end = 0, 0, [], None, 0
    for kind, a, b, c, d in codes:
        if kind == "equal":
            same += b - a
            begin = c if begin is None else begin
            end = d
            continue
        # what is left out or replaced at the very ends is not part of the text, so only the template's side counts there
        inner = begin is not None and (b, d) != (codes[-1][2], codes[-1][4])
        altered += [f"-{x}" for x in template[a:b]]
        if inner:
            altered += [f"+{x}" for x in window[c:d]]
            added += max(0, (d - c) - (b - a))
    kept = not any(re.match(r"-\d", x) for x in altered)
    return (same / (m + added) if kept else 0.0), low + (begin or 0), low + end, altered


def align(template: tuple[str, ...], text: list[str], start: int) -> tuple[float, int, int, list[str]]:
    """Coverage, begin, end and altered tokens of a template in a stretch of text that its first token should begin.

    Numbers and one-word templates must agree exactly; otherwise tokens may be put in between, left out or replaced
    as long as the coverage stays high.
    """
    m = len(template)
    slack = 0 if m < 4 else max(1, m // 6)
    low, high = max(0, start - slack), min(len(text), start + m + slack)
    window = text[low:high]
    n = len(window)
    # cost[i][j]: fewest edits of template[:i] against a stretch of the window that ends at j
    cost = [[0] * (n + 1)] + [[i] + [0] * n for i in range(1, m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (template[i - 1] != window[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    j = min(range(n + 1), key=lambda x: (cost[m][x], -x))
    end, i, altered, same = j, m, [], 0
    while i:
        if j and cost[i][j] == cost[i - 1][j - 1] + (template[i - 1] != window[j - 1]):
            if template[i - 1] == window[j - 1]:
                same += 1
            else:
                altered.append(f"{template[i - 1]}>{window[j - 1]}")
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + 1:
            altered.append(f"-{template[i - 1]}")
            i -= 1
        else:
            altered.append(f"+{window[j - 1]}")
            j -= 1
    digits_kept = not any(a[0] != "+" and re.match(r"-?\d", a) for a in altered)
    coverage = same / (m + sum(a[0] == "+" for a in altered)) if digits_kept else 0.0
    return coverage, low + j, low + end, altered[::-1]


def denied(words: list[str], begin: int) -> bool:
    """Whether the words before a statement deny it."""
    i = begin - 1
    while i >= 0 and words[i] in CARRYING and begin - i < 8:
        i -= 1
    return i >= 0 and words[i] in DENYING


def stated(text: str | None, field: bool = False) -> list[tuple[str, float, list[str]]]:
    """(licence, coverage, altered tokens) of the licences a text states, each once.

    field: the text is a metadata value; a name may then stand alone. In prose a name of one word counts only next
    to words that make it a statement, and none counts that is denied. A text that begins like a licence and then goes
    on in its own way is that licence only as far as it is covered.
    """
    if not text:
        return []
    words = tokens(text)
    rows, index = templates()
    places: dict[tuple[int, int], int] = {}
    for i in range(len(words)):
        for k in (1, 2, SHINGLE):
            for n, at in index.get(tuple(words[i : i + k]), ()) if i + k <= len(words) else ():
                # shingles of one copy of a template point at about the same start
                step = 1 if k < SHINGLE else max(8, len(rows[n][1]) // 4)
                places.setdefault((n, (i - at) // step), i - at)
    hits = []
    for (n, _), start in places.items():
        spdx, t = rows[n]
        coverage, begin, end, altered = (align_long if len(t) >= LONG else align)(t, words, start)
        whole = len(t) >= LONG and end - begin >= 0.5 * len(t)
        if coverage < (LEAST_ALTERED if whole else LEAST_COVERAGE):
            if whole:
                hits.append((len(t) * coverage - len(altered), coverage, begin, end, None, altered))
            continue
        if not field:
            before, after = words[begin - 1] if begin else "", words[end] if end < len(words) else ""
            if end - begin <= 1 and before not in BEFORE_NAME and after != "license" and t[0] not in UNMISTAKABLE and words[max(0, begin - 2) : begin] != ["terms", "of"]:
                continue
            if denied(words, begin):
                hits.append((len(t) * coverage - len(altered), coverage, begin, end, None, altered))
                continue
        score = len(t) * coverage - len(altered)
        body = openings().get(n)
        if body is not None and len(words) - begin >= 0.5 * len(rows[body][1]):
            # more follows than the opening: how much of the whole licence that is
            coverage, _, _, altered = align_long(rows[body][1], words, begin)
        hits.append((score, coverage, begin, end, spdx, altered))
    hits.sort(key=lambda h: (-h[0], h[2], h[4] or ""))
    taken = [False] * len(words)
    out: dict[str, tuple[str, float, list[str]]] = {}
    for _, coverage, begin, end, spdx, altered in hits:
        if not any(taken[begin:end]):
            taken[begin:end] = [True] * (end - begin)
            if spdx:
                out.setdefault(spdx, (spdx, coverage, altered))
    return list(out.values())


_ASSIGNED = re.compile(r"^__licen[sc]e__\s*=\s*[\"']+([^\"'\n]*)", re.M)


def statement_of_source(source: str) -> list[tuple[str, float, list[str]]]:
    """The licences given at the head of a source: in its first comments or docstring, or as __license__."""
    found = stated("\n".join(heading(source)))
    seen = {f[0] for f in found}
    for m in _ASSIGNED.finditer(source):
        found += [f for f in stated(m.group(1), field=True) if f[0] not in seen]
    return found


_RESULT = "array<struct<license:string,coverage:double,altered:array<string>>>"
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("altered", pa.list_(pa.string()))]))


def blob_licenses(blobs: DataFrame) -> DataFrame:
    """(blob_id, text, found): the licences that each blob states; text tells licence files from code."""

    def run(batches):
        for batch in batches:
            found = []
            for text, source in zip(batch.column(1).to_pylist(), batch.column(2)):
                value = source.as_py() or ""
                rows = stated(value) if text else statement_of_source(value)
                found.append([{"license": s, "coverage": c, "altered": a} for s, c, a in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _ARROW)], names=["blob_id", "text", "found"])

    rows = blobs.where("id is not null").select("id", (~is_code(F.col("language"))).alias("text"), "source")
    return rows.mapInArrow(run, f"blob_id bigint, text boolean, found {_RESULT}")


def named_licenses(spdx: str, raw: str) -> Column:
    """Licences named by the SPDX column, or by the raw one where that names none."""

    @F.pandas_udf("array<string>")
    def named(a, b):
        import pandas as pd

        return pd.Series([sorted(x[0] for x in stated(s, True) or stated(r, True)) for s, r in zip(a, b)])

    return named(F.col(spdx).cast("string"), F.col(raw).cast("string"))


def licenses(blobs: DataFrame, files: DataFrame, releases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Releases as (id, metadata, documents, finding) and code files as (id, own, coverage, release, alterations, finding).

    coverage is the least among a file's own statements, alterations are the tokens they leave out or add.


    All sets are sorted arrays of SPDX identifiers, empty where nothing is named. finding is conflict, unknown or
    null. A file of an unknown release has what it states itself only; a null source states nothing.
    """
    none = F.array().cast("array<string>")
    found = blob_licenses(blobs)
    names = F.array_sort(F.transform("found", lambda x: x.license))
    held = files.select(F.col("id").alias("file_id"), "release_id", "blob_id").join(found.select("blob_id", "text", names.alias("own"), F.array_min(F.transform("found", lambda x: x.coverage)).alias("coverage"), F.flatten(F.transform("found", lambda x: x.altered)).alias("alterations")), "blob_id")
    documents = held.where("text").select("release_id", F.explode("own").alias("l")).distinct().groupBy("release_id").agg(F.array_sort(F.collect_set("l")).alias("documents"))
    metadata = releases.where("id is not null").select("id", named_licenses("license_spdx", "license_raw").alias("metadata"))
    per_release = metadata.join(documents.withColumnRenamed("release_id", "id"), "id", "left").select("id", F.coalesce("metadata", none).alias("metadata"), F.coalesce("documents", none).alias("documents"))
    m, d = F.col("metadata"), F.col("documents")
    clash = (F.size(m) > 0) & (F.size(d) > 0) & ~F.arrays_overlap(m, d)
    out = per_release.select("id", "metadata", "documents", F.when(clash, "conflict").when((F.size(m) == 0) & (F.size(d) == 0), "unknown").alias("finding"))

    terms = per_release.select(F.col("id").alias("release_id"), F.array_union(m, d).alias("release"))
    code = held.where("not text").join(terms, "release_id", "left").withColumn("release", F.coalesce("release", none))
    o, r = F.col("own"), F.col("release")
    clash = (F.size(o) > 0) & (F.size(r) > 0) & ~F.arrays_overlap(o, r)
    per_file = code.select(F.col("file_id").alias("id"), "own", "coverage", "release", "alterations", F.when(clash, "conflict").when((F.size(o) == 0) & (F.size(r) == 0), "unknown").alias("finding"))
    return out, per_file


def findings(releases: DataFrame, files: DataFrame) -> DataFrame:
    """(scope, id, finding) of releases and files that have one."""
    one = lambda df, scope: df.where("finding is not null").select(F.lit(scope).alias("scope"), "id", "finding")
    return one(releases, "release").union(one(files, "file"))
