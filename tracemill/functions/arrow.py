"""Arrow functions over the kernels: tokens, fingerprints and sequence comparison."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import kernels as K
from ..constants import Profile

PRINTS = "array<struct<hash:bigint,position:int>>"


def tokens(source, language, engine: str = "search", normalised: bool = False) -> Column:
    """array<struct<kind, line>> of a source; null for null."""

    @F.pandas_udf("array<struct<kind:string,line:int>>")
    def run(s: pd.Series, lang: pd.Series) -> pd.Series:
        out = []
        for text, name in zip(s, lang):
            if text is None:
                out.append(None)
                continue
            kinds, lines = K.lex(text, name, engine, normalised, lines=True)
            out.append([{"kind": k, "line": n} for k, n in zip(kinds, lines)])
        return pd.Series(out)

    return run(source, language)


def kinds(source, language, engine: str = "search", normalised: bool = False) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else K.lex(t, n, engine, normalised)[0] for t, n in zip(s, lang)])

    return run(source, language)


def fingerprints(token_kinds, profile: Profile) -> Column:
    """Winnowed shingle hashes of an array of kinds."""

    @F.pandas_udf(PRINTS)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [{"hash": h, "position": p} for h, p in K.fingerprints(list(x), profile)] for x in s])

    return run(token_kinds)


def hash_sets(source, language, profile: Profile) -> Column:
    """Sorted distinct winnowed hashes of a source by the one-lexer engine; null for null."""

    @F.pandas_udf("array<bigint>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        sets = K.HashSets(profile)
        for s, lang in batches:
            out = []
            for at in range(0, len(s), 256):
                texts = s.iloc[at : at + 256].tolist()
                out += [None if t is None else x for t, x in zip(texts, sets(texts, lang.iloc[at : at + 256].tolist()))]
            yield pd.Series(out, dtype=object)

    return run(source, language)


def text_fingerprints(words, k: int, window: int) -> Column:
    """array<struct<hash, position>>: the MD5 of runs of k words, of every window the least, the rightmost on ties."""
    import hashlib

    @F.pandas_udf("array<struct<hash:string,position:int>>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for listed in s:
            if listed is None:
                out.append(None)
                continue
            grams = [hashlib.md5(" ".join(listed[i : i + k]).encode()).hexdigest() for i in range(len(listed) - k + 1)]
            rank = {g: n for n, g in enumerate(sorted(set(grams)))}
            out.append([{"hash": grams[p], "position": p} for _, p in K.winnow([rank[g] for g in grams], window)])
        return pd.Series(out)

    return run(words)


def lcs_length(a, b) -> Column:
    @F.pandas_udf("bigint")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([K.lcs_length(list(p), list(q)) for p, q in zip(x, y)])

    return run(a, b)


def longest_run(a, b) -> Column:
    @F.pandas_udf("struct<length:int,start_a:int,start_b:int>")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([K.longest_run(list(p), list(q)) for p, q in zip(x, y)], columns=["length", "start_a", "start_b"])

    return run(a, b)


def normal_form(c) -> Column:
    """Unicode NFC, which Catalyst has no expression for."""
    import unicodedata

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return run(c)
