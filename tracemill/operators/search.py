"""Source search: regions, postings, candidate retrieval, verification, folding and report order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import kernels as K
from ..constants import SOURCE_SEARCH, Profile, SearchSettings
from ..functions.columns import language_family
from ..session import materialise, release

_CHUNK = 128


def _chunks(frames):
    """Frames of few files each, so that what is kept of a frame stays small."""
    for frame in frames:
        for at in range(0, len(frame), _CHUNK):
            yield frame.iloc[at : at + _CHUNK]


def regions(files: DataFrame, profile: Profile = SOURCE_SEARCH, s: SearchSettings = SearchSettings()) -> DataFrame:
    """Token regions of files (file_id, language, source): each region is lexed and fingerprinted for itself.

    One Arrow pass lexes a file and cuts it; a file without tokens has no region.
    """
    schema = "file_id bigint, language string, region int, token_start int, token_end int, line_start int, line_end int, preserving array<string>, normalized array<string>, hashes_preserving array<struct<hash:bigint,position:int>>, hashes_normalized array<struct<hash:bigint,position:int>>, lines array<int>"

    def run(frames):
        for frame in _chunks(frames):
            out = []
            for i, language, source in zip(frame["file_id"], frame["language"], frame["source"]):
                if source is None:
                    continue
                kept, lines = K.lex(source, language, lines=True)
                plain = K.normal_kinds(kept)
                if not kept:
                    continue
                for n, a in enumerate(K.region_starts(len(kept), s.region, s.stride)):
                    b = min(len(kept), a + s.region)
                    prints = [[{"hash": h, "position": p} for h, p in K.fingerprints(k[a:b], profile)] for k in (kept, plain)]
                    out.append((i, language, n, a, b, lines[a], lines[b - 1], kept[a:b], plain[a:b], *prints, lines[a:b]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ("file_id language region token_start token_end line_start line_end preserving normalized hashes_preserving hashes_normalized lines").split()])

    return files.select("file_id", "language", "source").mapInPandas(run, schema)


def documents(files: DataFrame, profile: Profile = SOURCE_SEARCH) -> DataFrame:
    """(doc_id, language, preserving, normalized, lines, hashes_*): reference files (file_id, language, source), lexed once."""
    schema = "doc_id bigint, language string, preserving array<string>, normalized array<string>, lines array<int>, hashes_preserving array<struct<hash:bigint,position:int>>, hashes_normalized array<struct<hash:bigint,position:int>>"

    def run(frames):
        for frame in _chunks(frames):
            out = []
            for i, language, source in zip(frame["file_id"], frame["language"], frame["source"]):
                if source is None:
                    continue
                kept, lines = K.lex(source, language, lines=True)
                plain = K.normal_kinds(kept)
                prints = [[{"hash": h, "position": p} for h, p in K.fingerprints(k, profile)] for k in (kept, plain)]
                out.append((i, language, kept, plain, lines, *prints))
            yield pd.DataFrame(out, columns="doc_id language preserving normalized lines hashes_preserving hashes_normalized".split())

    return files.select("file_id", "language", "source").mapInPandas(run, schema)


_REPRESENTATIONS = ("preserving", "normalized")
_SEEN_BITS = 1 << 27


def seen(prints: DataFrame):
    """A table of bits of a fixed size, 16 MB, in which each hash of (representation, hash) has one, as a broadcast.

    Only its words reach the driver, 2 million at most. It lets through all hashes that are in it and few others.
    """
    at = F.shiftright("hash", 6) + F.when(F.col("representation") == "normalized", _SEEN_BITS >> 1).otherwise(0)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
    words = prints.select(F.shiftright(at, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(_SEEN_BITS >> 6, dtype=np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return prints.sparkSession.sparkContext.broadcast(table)


def _among(table: np.ndarray, representation: int, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> 6) + representation * (_SEEN_BITS >> 1)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def prints(files: DataFrame, regional: bool = False, only=None, plain: bool = False, profile: Profile = SOURCE_SEARCH, s: SearchSettings = SearchSettings()) -> DataFrame:
    """(file_id, language, shape, region, representation, hashes, first, last): the distinct hashes of files or of their regions with their places.

    Hashes are 32 bits with the sign of an int. Those that a table of seen() surely lacks are left out. With `plain`, the
    rows of spelled tokens also have the normalised tokens, a byte each.
    """
    schema = "file_id bigint, language string, shape string, region int, representation string, hashes array<int>, first array<int>, last array<int>" + ", plain binary" * plain
    names = [c.split()[0] for c in schema.split(", ")]

    def cuts(n: int) -> list[tuple[int, int]]:
        return [(a, min(n, a + s.region)) for a in K.region_starts(n, s.region, s.stride)] if regional else [(0, n)]

    def run(frames):
        kernel = K.SearchPrints(profile)
        for frame in frames:
            for at in range(0, len(frame), 2 * _CHUNK):
                part = frame.iloc[at : at + 2 * _CHUNK]
                part = part[part["source"].notna()]
                if not len(part):
                    continue
                out, told = [], kernel(part["source"].tolist(), part["language"].tolist(), cuts)
                for i, language, (shape, pieces, found), tokens in zip(part["file_id"], part["language"], told, kernel.plain):
                    for n in range(len(pieces)):
                        for r, (hashes, first, last) in enumerate(found[n]):
                            if only is not None:
                                kept = _among(only.value, r, hashes)
                                hashes, first, last = hashes[kept], first[kept], last[kept]
                            out.append((i, language, shape, n, _REPRESENTATIONS[r], hashes.astype(np.uint32).view(np.int32), first.astype(np.int32), last.astype(np.int32), *[None if r else tokens[slice(*pieces[n])]] * plain))
                    if not pieces and not regional:
                        none = np.zeros(0, dtype=np.int32)
                        out += [(i, language, shape, 0, r, none, none, none, *[b""] * plain) for r in _REPRESENTATIONS]
                yield pd.DataFrame(out, columns=names)

    return files.select("file_id", "language", "source").mapInPandas(run, schema)


def unsigned(hash) -> Column:
    return F.col(hash).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))


def flat(found: DataFrame, only) -> DataFrame:
    """(file_id, region, family, representation, hash, first, last) of prints() whose hash may be in a table of seen()."""
    schema = "file_id bigint, region int, language string, representation string, hash bigint, first int, last int"

    def run(frames):
        for frame in frames:
            for r, name in enumerate(_REPRESENTATIONS):
                part = frame[frame["representation"] == name]
                if not len(part):
                    continue
                row = np.repeat(np.arange(len(part)), [len(x) for x in part["hashes"]])
                columns = [np.concatenate([np.asarray(x) for x in part[c]]) for c in ("hashes", "first", "last")]
                columns[0] = columns[0].astype(np.int64) & 0xFFFFFFFF
                kept = _among(only.value, r, columns[0])
                of = part[["file_id", "region", "language", "representation"]].iloc[row[kept]].reset_index(drop=True)
                yield of.assign(hash=columns[0][kept], first=columns[1][kept], last=columns[2][kept])

    rows = found.select("file_id", "region", "language", "representation", "hashes", "first", "last").mapInPandas(run, schema)
    return rows.select("file_id", "region", language_family("language").alias("family"), "representation", "hash", "first", "last")


def shape_frequency(found: DataFrame) -> DataFrame:
    """(representation, hash, clusters): copies of one shape have equal hashes and count once."""
    one = found.groupBy("shape", "representation").agg(F.first("hashes").alias("hashes")).select("representation", F.explode("hashes").alias("h"))
    return one.groupBy("representation", "h").agg(F.count("*").alias("clusters")).select("representation", unsigned("h").alias("hash"), "clusters")


def _exploded(df: DataFrame, *keys: str) -> DataFrame:

    def named(r: str):
        return F.transform(f"hashes_{r}", lambda x: F.struct(F.lit(r).alias("representation"), x["hash"].alias("hash"), x["position"].alias("position")))

    both = F.concat(named("preserving"), named("normalized"))
    return df.select(*keys, language_family("language").alias("family"), F.explode(both).alias("p")).select(*keys, "family", "p.*")


def postings(docs: DataFrame, stop: DataFrame | None = None) -> DataFrame:
    """(representation, hash, family, doc_id, position), without the hashes of the stoplist (representation, hash)."""
    rows = _exploded(docs, "doc_id")
    return rows.join(stop, ["representation", "hash"], "left_anti") if stop is not None else rows


def retrieve(query: DataFrame, index: DataFrame, docs: DataFrame, s: SearchSettings = SearchSettings()) -> DataFrame:
    """The shortlist of each region: (file_id, region, doc_id, score, matched, common, rare, first, last, nth).

    Each distinct hash of a region counts once per document, weighted by its rarity among the documents of the
    language family; hashes that most documents hold keep a fifth of their weight. Postings meet regions in one
    join on (representation, hash, family).
    """
    once = _exploded(query, "file_id", "region").groupBy("file_id", "region", "family", "representation", "hash").agg(F.min("position").alias("query_position"))
    sizes = docs.groupBy(language_family("language").alias("family")).agg(F.count("*").alias("total"))
    held = index.groupBy("representation", "hash", "family", "doc_id").agg(F.min("position").alias("first"), F.max("position").alias("last"))
    return ranked(once, held, sizes, s)


def ranked(once: DataFrame, held: DataFrame, sizes: DataFrame, s: SearchSettings = SearchSettings()) -> DataFrame:
    """The shortlist of each region from its hashes (file_id, region, family, representation, hash), those of the
    documents (representation, hash, family, doc_id, first, last) and the documents of each family (family, total)."""
    keys = ["representation", "hash", "family"]
    total = F.greatest("total", F.lit(1))
    common = F.col("df") / total >= s.common_df
    idf = F.log((total + 1.0) / (F.col("df") + 1.0)) + 1.0
    known = held.withColumn("df", F.count("*").over(Window.partitionBy(*keys))).join(F.broadcast(sizes), "family")
    known = known.select(*keys, "doc_id", "first", "last", (F.when(common, s.common_weight).otherwise(1.0) * idf).alias("weight"), common.alias("common"))
    met = once.join(known, keys)
    scored = met.groupBy("file_id", "region", "doc_id").agg(
        F.round(F.sum("weight"), 9).alias("score"),
        F.count("*").alias("matched"),
        F.count_if("common").alias("common"),
        F.count_if((F.col("representation") == "preserving") & ~F.col("common")).alias("rare"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
    )
    order = Window.partitionBy("file_id", "region").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= s.shortlist)


def judge(q_kept: list, q_plain: list, d_kept: list, d_plain: list, rare: int, common_ratio: float, q_lines: list, d_lines: list, s: SearchSettings) -> tuple:
    """Evidence and class of one region against one stretch of a document.

    What is too weak for the lesser class is told so as soon as that is known; the strong one asks for more of the same.
    """
    nothing = ("insufficient_evidence", 0, 0, 0, 0, 0.0, None, None, None, None)
    run, a, b = K.longest_run(q_plain, d_plain)
    if run < s.possible_run:
        return nothing
    matched = K.lcs_length(q_plain, d_plain)
    coverage = matched / max(1, min(len(q_plain), len(d_plain)))
    if matched < s.possible_matched or coverage < s.possible_coverage:
        return nothing
    specific = lambda kinds: [x for x in kinds if x[:3] == "id:" or x[:4] == "lit:"]
    sq, sd = specific(q_kept), specific(d_kept)
    kept = K.lcs_length(sq, sd)
    names = lambda kinds: [x for x in kinds if x[:3] == "id:"]
    kept_run = max(K.longest_run(sq, sd)[0], K.longest_run(names(sq), names(sd))[0])
    structural = matched >= s.strong_matched and run >= s.strong_run and coverage >= s.strong_coverage
    spelled = run >= s.contiguous_run and kept_run >= s.specific_run and (kept >= s.specific_matched or rare >= s.rare_hashes)
    renamed = run >= s.renamed_run and len(set(q_plain[a : a + run])) >= s.renamed_kinds
    lines = (q_lines[a], q_lines[a + run - 1], d_lines[b], d_lines[b + run - 1]) if run else (None,) * 4
    distinct = True
    if run and lines[0] == lines[1] and lines[2] == lines[3]:
        chosen = lambda kinds, at, line: {k for k, n in zip(kinds, at) if n == line and ((k[:3] == "id:" and len(k[3:].lstrip("#")) >= 3) or (k[:4] == "lit:" and k[4:5] in "\"'`" and len(k) >= 10))}
        distinct = len(chosen(q_kept, q_lines, lines[0]) & chosen(d_kept, d_lines, lines[2])) >= 2
    strong = structural and (spelled or renamed) and common_ratio < s.strong_common_ratio and distinct
    label = "strong_match" if strong else "possible_common_pattern"
    return label, matched, run, kept, kept_run, coverage, *lines


def verify(shortlist: DataFrame, query: DataFrame, docs: DataFrame, s: SearchSettings = SearchSettings()) -> DataFrame:
    """Evidence of every shortlisted candidate; the document is cut to the matched span with padding first."""
    cut = lambda c: F.slice(c, F.col("low") + 1, F.col("high") - F.col("low"))
    spans = shortlist.join(docs.select("doc_id", F.col("preserving").alias("dp"), F.col("normalized").alias("dn"), F.col("lines").alias("dl")), "doc_id")
    spans = spans.withColumn("low", F.greatest(F.col("first") - s.padding, F.lit(0))).withColumn("high", F.least(F.col("last") + SOURCE_SEARCH.k + s.padding, F.size("dn")))
    rows = spans.select("file_id", "region", "doc_id", "score", "nth", "rare", (F.col("common") / F.col("matched")).alias("ratio"), cut(F.col("dp")).alias("dp"), cut(F.col("dn")).alias("dn"), cut(F.col("dl")).alias("dl"))
    rows = rows.join(query.select("file_id", "region", "preserving", "normalized", "lines", "line_start", "line_end"), ["file_id", "region"])
    schema = "file_id bigint, region int, doc_id bigint, score double, nth int, classification string, matched_tokens int, contiguous_tokens int, preserving_matched int, preserving_run int, smaller_coverage double, line_start int, line_end int, source_line_start int, source_line_end int"

    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                e = judge(list(r.preserving), list(r.normalized), list(r.dp), list(r.dn), r.rare, r.ratio, list(r.lines), list(r.dl), s)
                first, last = (e[6], e[7]) if e[6] is not None else (r.line_start, r.line_end)
                out.append((r.file_id, r.region, r.doc_id, r.score, r.nth, *e[:6], first, last, e[8], e[9]))
            yield pd.DataFrame(out, columns=[c.strip().split()[0] for c in schema.split(",")])

    # comparing is work for the cores and not for the network: small partitions, never coalesced
    parts = max(rows.sparkSession.sparkContext.defaultParallelism * 4, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, "file_id", "region", "doc_id").mapInPandas(run, schema)


def outline(shortlist: DataFrame, regions: DataFrame, docs: DataFrame, s: SearchSettings = SearchSettings()) -> DataFrame:
    """Of every place of a shortlist that reaches the lesser class: (file_id, region, doc_id, nth, score, rare, common, matched, first, last, run, tokens, coverage).

    regions and docs are prints() with `plain`: the three last hang on normalised tokens only, so a place moves a byte for a token. Which places are strong, verify_few() tells.
    """
    told = lambda df, *columns: df.where("representation = 'preserving'").select(*columns)
    asked = shortlist.join(told(regions, "file_id", "region", F.col("plain").alias("q")), ["file_id", "region"])
    both = asked.join(told(docs, F.col("file_id").alias("doc_id"), F.col("plain").alias("d")), "doc_id")
    low, high = F.greatest(F.col("first") - s.padding, F.lit(0)), F.least(F.col("last") + SOURCE_SEARCH.k + s.padding, F.octet_length("d"))
    keys = ["file_id", "region", "doc_id", "nth", "score", "rare", "common", "matched", "first", "last"]
    schema = "file_id bigint, region int, doc_id bigint, nth int, score double, rare bigint, common bigint, matched bigint, first int, last int, run int, tokens int, coverage double"

    def run(frames):
        for frame in frames:
            q, d = frame["q"].tolist(), frame["d"].tolist()
            longest, tokens = K.common_many(q, d)
            coverage = tokens / np.maximum(1, np.minimum([len(x) for x in q], [len(x) for x in d]))
            kept = (longest >= s.possible_run) & (tokens >= s.possible_matched) & (coverage >= s.possible_coverage)
            yield frame[keys].assign(run=longest, tokens=tokens, coverage=coverage)[kept]

    return both.select(*keys, "q", F.substring("d", low + 1, high - low).alias("d")).mapInPandas(run, schema)


_EVIDENCE = "file_id bigint, region int, doc_id bigint, score double, nth int, classification string, matched_tokens int, contiguous_tokens int, preserving_matched int, preserving_run int, smaller_coverage double, line_start int, line_end int, source_line_start int, source_line_end int"


def folded(places: DataFrame, files: DataFrame, documents: DataFrame, s: SearchSettings = SearchSettings()) -> DataFrame:
    """best_per_source() of verify() for pairs with few places (file_id, doc_id, places) of outline(), those with `strong` told apart.

    The sources of a pair meet once and are lexed there, so no tokens are moved. A place is compared as spelled only when the fold asks for its class.
    """
    pairs = places.join(files.select("file_id", F.col("language").alias("q_language"), F.col("source").alias("q")), "file_id")
    pairs = pairs.join(documents.select(F.col("file_id").alias("doc_id"), F.col("language").alias("d_language"), F.col("source").alias("d")), "doc_id")
    names = [c.split()[0] for c in _EVIDENCE.split(", ")]

    def run(frames):
        lexed: dict[tuple[str, int], tuple] = {}

        def tokens(side: str, i: int, source: str, language: str | None) -> tuple:
            if (side, i) not in lexed:
                if len(lexed) >= 64:
                    lexed.pop(next(iter(lexed)))
                kept, lines = K.lex(source, language, lines=True)
                lexed[side, i] = kept, K.normal_kinds(kept), lines
            return lexed[side, i]

        for frame in frames:
            out = []
            for f in frame.itertuples(index=False):
                kept, plain, lines = tokens("q", f.file_id, f.q, f.q_language)
                d_kept, d_plain, d_lines = tokens("d", f.doc_id, f.d, f.d_language)
                starts, known = K.region_starts(len(kept), s.region, s.stride), {}

                def evidence(r) -> tuple:
                    if r["region"] not in known:
                        a = starts[r["region"]]
                        b, low, high = a + s.region, max(r["first"] - s.padding, 0), r["last"] + SOURCE_SEARCH.k + s.padding
                        known[r["region"]] = judge(kept[a:b], plain[a:b], d_kept[low:high], d_plain[low:high], r["rare"], r["common"] / r["matched"], lines[a:b], d_lines[low:high], s)
                    return known[r["region"]]

                strong = lambda r: r["strong"] and evidence(r)[0] == "strong_match"
                best = None
                for r in sorted(f.places, key=lambda r: (r["region"], r["nth"])):
                    if best is None or r["tokens"] > best["tokens"] or r["strong"] and not strong(best) and strong(r):
                        best = r
                e = evidence(best)
                out.append((f.file_id, best["region"], f.doc_id, best["score"], best["nth"], *e))
            yield pd.DataFrame(out, columns=names)

    return pairs.mapInPandas(run, _EVIDENCE)


def reported(shortlist: DataFrame, regions: DataFrame, docs: DataFrame, files: DataFrame, documents: DataFrame, possible: int = 25, s: SearchSettings = SearchSettings()) -> DataFrame:
    """report() of best_per_source() of verify() of a whole shortlist; files are (file_id, path, language, source), documents (file_id, language, source), regions and docs their prints().

    All places are compared by normalised tokens. Only pairs with a place that may be strong, and the few others that are reported, are compared as spelled.
    """
    strong = (F.col("tokens") >= s.strong_matched) & (F.col("run") >= max(s.strong_run, min(s.contiguous_run, s.renamed_run))) & (F.col("coverage") >= s.strong_coverage) & (F.col("common") / F.col("matched") < s.strong_common_ratio)
    place = F.struct("region", "nth", "score", "rare", "common", "matched", "first", "last", "run", "tokens", strong.alias("strong"))
    pairs = materialise(outline(shortlist, regions, docs, s).groupBy("file_id", "doc_id").agg(F.array_sort(F.collect_list(place)).alias("places")))
    release(pairs.sparkSession)
    may = F.exists("places", lambda p: p["strong"])
    told = materialise(folded(pairs.where(may), files, documents, s))
    # all of one class: the first place with the most tokens is the best
    best = F.aggregate(F.slice("places", 2, F.size("places")), F.element_at("places", 1), lambda kept, p: F.when(p["tokens"] > kept["tokens"], p).otherwise(kept))
    weak = pairs.where(~may).select("file_id", "doc_id", best.alias("p")).select("file_id", "doc_id", F.lit("possible_common_pattern").alias("classification"), F.lit(1).alias("rank"), F.col("p.tokens").alias("matched_tokens"), F.col("p.run").alias("contiguous_tokens"), F.array("p").alias("places"))
    # of these no more than are reported at all
    shown = materialise(report(weak, files, possible).select("file_id", "doc_id", "places"))
    return report(best_per_source(told.unionByName(folded(shown, files, documents, s))), files, possible)


_CLASSES = {"insufficient_evidence": 0, "possible_common_pattern": 1, "strong_match": 2}


def best_per_source(evidence: DataFrame) -> DataFrame:
    """One finding per (file, document), by the ordered fold over regions and shortlist places.

    A later record replaces the kept one if its class is higher or it matched more tokens; the second test ignores
    the class, so the order matters and a plain maximum would differ.
    """
    rank = F.create_map(*[F.lit(x) for kv in _CLASSES.items() for x in kv])[F.col("classification")]
    fields = [c for c in evidence.columns if c not in ("file_id", "doc_id")]
    record = F.struct("region", "nth", rank.alias("rank"), *[c for c in fields if c not in ("region", "nth")])
    rows = evidence.where("classification <> 'insufficient_evidence'").groupBy("file_id", "doc_id").agg(F.array_sort(F.collect_list(record)).alias("all"))
    better = lambda kept, r: (r["rank"] > kept["rank"]) | (r["matched_tokens"] > kept["matched_tokens"])
    folded = F.aggregate(F.slice("all", 2, F.size("all")), F.element_at("all", 1), lambda kept, r: F.when(better(kept, r), r).otherwise(kept))
    return rows.select("file_id", "doc_id", folded.alias("f")).select("file_id", "doc_id", "f.*")


def report(findings: DataFrame, paths: DataFrame, possible: int = 25) -> DataFrame:
    """Findings in report order: weak ones in auxiliary files dropped, all strong ones, the best `possible` weak ones."""
    from ..functions.columns import auxiliary

    rows = findings.join(paths.select("file_id", "path"), "file_id").where(~((F.col("classification") == "possible_common_pattern") & auxiliary("path", scan=True)))
    weak = Window.partitionBy("classification").orderBy(F.desc("contiguous_tokens"), F.desc("matched_tokens"), "file_id", "doc_id")
    kept = rows.withColumn("place", F.row_number().over(weak)).where((F.col("classification") != "possible_common_pattern") | (F.col("place") <= possible))
    return kept.drop("place").orderBy(F.desc("rank"), F.desc("matched_tokens"), "file_id", "doc_id")
