"""Portable similarity: containment of fingerprint sets, bands, shared lines and provider union."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import kernels as K
from ..constants import PIPELINE
from ..functions.columns import merge_ranges
from ..session import materialise

#: classes of probes whose postings a task holds at once, and of documents that meet them in a task
_PROBES, _DOCS = 32_768, 4_096
#: containment from which a match shows, and from which it is strong
LEAST, STRONG = 0.55, 0.85


def containment(probe: DataFrame, corpus: DataFrame, least_hits: int = 1) -> DataFrame:
    """(probe_id, doc_id, shared, probe_size, doc_size, containment): distinct hashes in common over those of the document.

    probe is (probe_id, hash), corpus (doc_id, hash). Both sides are made distinct first; the join moves each hash once.
    """
    p, d = probe.select("probe_id", "hash").distinct(), corpus.select("doc_id", "hash").distinct()
    shared = p.join(d, "hash").groupBy("probe_id", "doc_id").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_hits)
    sizes = shared.join(d.groupBy("doc_id").agg(F.count("*").alias("doc_size")), "doc_id").join(p.groupBy("probe_id").agg(F.count("*").alias("probe_size")), "probe_id")
    return sizes.select("probe_id", "doc_id", "shared", "probe_size", "doc_size", (F.col("shared") / F.col("doc_size")).alias("containment"))


def classes(sets: DataFrame, key: str, *more: str) -> DataFrame:
    """(hashes, ids, ...): one row for each distinct set of sets (key, hashes, ...), with the ids that have it."""
    name = F.sha2(F.array_join(F.col("hashes").cast("array<string>"), ","), 256).alias("key")
    return materialise(sets.where(F.size("hashes") > 0).groupBy(name, *more).agg(F.first("hashes").alias("hashes"), F.collect_list(key).alias("ids")))


def containing(probes: DataFrame, docs: DataFrame, threshold: float, best: bool = False, top: int = 0, rank: Callable | None = None) -> DataFrame:
    """(probe_id, doc_id, mark, shared, probe_size, doc_size, containment) of all pairs from the threshold up.

    probes and docs are classes of sorted sets, those of documents by mark. Blocks of documents meet blocks of probes, where
    all intersections of a document are counted at once; no row per common hash is made. With `best`, a pair is left out
    if its probe meets another class of documents of that mark with no less containment; with `top`, if it neither belongs
    to the first `top` by rank(mark, containment) nor comes within 0.001 of them.
    """
    cores = probes.sparkSession.sparkContext.defaultParallelism
    across, along = max(1, -(-probes.count() // _PROBES)), max(2 * cores, -(-docs.count() // _DOCS))
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts = max(2 * cores, min(across * along, 4096))
    ps = probes.select(block(across).alias("a"), "hashes", "ids").withColumn("b", every(along)).repartition(parts, "a", "b")
    ds = docs.select(block(along).alias("b"), "hashes", "ids", "mark").withColumn("a", every(across)).repartition(parts, "a", "b")

    def pruned(rows: list) -> list:
        score = [rank(mark, n / size) for _, mark, size, _, n in rows]
        if sum(map(len, score)) <= top:
            return rows
        least = np.partition(np.concatenate(score), -top)[-top] - 0.001
        kept = ((ids, mark, size, at[s >= least], n[s >= least]) for (ids, mark, size, at, n), s in zip(rows, score))
        return [r for r in kept if len(r[3])]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["ids", "mark", "doc_size", "probes", "shared", "sizes"]
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=names)
        overlaps = K.Overlaps([np.asarray(x) for x in left["hashes"]])
        copies = np.array([len(x) for x in left["ids"]])
        begins, members = np.cumsum(copies) - copies, np.concatenate([np.asarray(x) for x in left["ids"]])
        alone, rows, held, most = int(copies.max()) == 1, [], 0, {}
        for i, (hashes, ids, mark) in enumerate(zip(right["hashes"], right["ids"], right["mark"])):
            n = overlaps(np.asarray(hashes))
            share = n / len(hashes)
            if best:
                share[share < threshold] = 0
                highest, which, shared = most.setdefault(mark, (np.zeros(len(n)), np.full(len(n), -1), np.zeros(len(n), dtype=np.int64)))
                at = np.flatnonzero(share > highest)
                highest[at], which[at], shared[at] = share[at], i, n[at]
                continue
            at = np.flatnonzero(share >= threshold)
            if len(at):
                rows.append((ids, mark, len(hashes), at, n[at]))
                held += len(at)
            if top and held > 1 << 20:
                rows = pruned(rows)
                held = sum(len(r[3]) for r in rows) // 2
        for mark, (_, which, shared) in most.items():
            for i in np.unique(which[which >= 0]).tolist():
                at = np.flatnonzero(which == i)
                rows.append((right["ids"].iloc[i][:1], mark, len(right["hashes"].iloc[i]), at, shared[at]))
        out = []
        for ids, mark, size, at, n in pruned(rows) if top and rows else rows:
            if alone:
                who = members[begins[at]]
            else:
                c = copies[at]
                who = members[np.repeat(begins[at] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
                at, n = np.repeat(at, c), np.repeat(n, c)
            out.append((ids, mark, size, who, n.astype(np.int32), overlaps.sizes[at].astype(np.int32)))
        return pd.DataFrame(out, columns=names)

    schema = "ids array<bigint>, mark int, doc_size bigint, probes array<bigint>, shared array<int>, sizes array<int>"
    rows = ps.groupBy("a", "b").cogroup(ds.groupBy("a", "b")).applyInPandas(run, schema)
    hits = rows.select("mark", "doc_size", "ids", F.posexplode("probes").alias("i", "probe_id"), "shared", "sizes")
    hits = hits.select("mark", "doc_size", "ids", "probe_id", F.get("shared", "i").cast("bigint").alias("shared"), F.get("sizes", "i").cast("bigint").alias("probe_size"))
    return hits.select("probe_id", F.explode("ids").alias("doc_id"), "mark", "shared", "probe_size", "doc_size", (F.col("shared") / F.col("doc_size")).alias("containment"))


def contained(sets: DataFrame, threshold: float) -> DataFrame:
    """(probe_id, doc_id, shared, containment) of all pairs from the threshold up; sets is (id, hashes), one row per id.

    Equal sets are one class and are compared once. A probe that holds enough of a document holds one of its rarest
    hashes, as many as may be missing and one more, so only those meet the probes; the sets are then intersected.
    """
    keyed = sets.select("id", F.sort_array(F.array_distinct("hashes")).alias("hashes")).where(F.size("hashes") > 0)
    keyed = keyed.withColumn("key", F.sha2(F.array_join(F.col("hashes").cast("array<string>"), ","), 256))
    classes = materialise(keyed.groupBy("key").agg(F.min("id").alias("rep"), F.first("hashes").alias("hashes"), F.count("*").alias("copies")))
    members = keyed.select("key", "id").join(classes.select("key", "rep"), "key").select("rep", "id")

    n = F.size("hashes")
    held = classes.select("rep", n.alias("n"), F.explode("hashes").alias("hash")).withColumn("df", F.count("*").over(Window.partitionBy("hash"))).where("df > 1")
    # hashes that no other class holds come first in the order and meet nothing
    least = F.ceil(F.col("n") * threshold - 1e-6).cast("int").alias("least")
    rarest = held.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("o")).select("rep", least, "o").where("size(o) >= least")
    asked = rarest.select(F.col("rep").alias("doc"), "least", F.explode(F.slice("o", 1, F.size("o") - F.col("least") + 1)["hash"]).alias("hash"))
    met = asked.join(held.select(F.col("rep").alias("probe"), "n", "hash"), "hash").where("probe <> doc and n >= least").select("probe", "doc").distinct()
    side = lambda i: classes.select(F.col("rep").alias(i), F.col("hashes").alias(f"{i}_hashes"))
    both = met.join(side("probe"), "probe").join(side("doc"), "doc").select("probe", "doc", F.size(F.array_intersect("probe_hashes", "doc_hashes")).cast("bigint").alias("shared"), F.size("doc_hashes").alias("n"))
    links = both.union(classes.where("copies > 1").select("rep", "rep", n.cast("bigint"), n)).withColumn("containment", F.col("shared") / F.col("n")).where(F.col("containment") >= threshold)
    probes, docs = members.select(F.col("rep").alias("probe"), F.col("id").alias("probe_id")), members.select(F.col("rep").alias("doc"), F.col("id").alias("doc_id"))
    return links.join(probes, "probe").join(docs, "doc").where("probe_id <> doc_id").select("probe_id", "doc_id", "shared", "containment")


def band(score, idiom, policy) -> Column:
    """clear, common_pattern, strong_match or review_suggested."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s < LEAST, "clear").when(idiom & (policy == "CLEAR"), "common_pattern").when(s >= STRONG, "strong_match").otherwise("review_suggested")


def severity(label, policy) -> Column:
    return F.when(label.isin("common_pattern", "clear"), "info").when((label == "strong_match") & (policy == "BLOCKING"), "blocking").otherwise("review")


def matches(probe: DataFrame, providers: dict[str, DataFrame], threshold: float = 0.55) -> tuple[DataFrame | None, list[str]]:
    """Matches of all providers from the threshold up, and the providers whose plans could not be analysed."""
    found, failed = None, []
    for name, corpus in providers.items():
        try:
            one = containment(probe, corpus).where(F.col("containment") >= threshold).withColumn("provider", F.lit(name))
            one.schema  # noqa: B018 - analysis errors show here
        except Exception:
            failed.append(name)
            continue
        found = one if found is None else found.unionByName(one)
    return found, failed


def shared_lines(prints: DataFrame, token_lines: DataFrame, shared: DataFrame, k: int = PIPELINE.k, gap: int = 1) -> DataFrame:
    """(file_id, ranges): merged line ranges that the shared hashes cover.

    prints is (file_id, hash, position), token_lines (file_id, lines array<int>), shared (file_id, hash).
    """
    hit = prints.join(shared.select("file_id", "hash").distinct(), ["file_id", "hash"], "left_semi")
    at = hit.join(token_lines, "file_id")
    last = F.least(F.col("position") + k, F.size("lines"))
    spans = at.select("file_id", F.struct(F.element_at("lines", F.col("position") + 1).alias("start"), F.element_at("lines", last).alias("end")).alias("r"))
    return spans.groupBy("file_id").agg(merge_ranges(F.collect_set("r"), gap).alias("ranges"))


def strongest_counts(found: DataFrame) -> DataFrame:
    """(band, files): each file once, by its strongest band."""
    order = F.create_map(*[F.lit(x) for kv in {"clear": 0, "common_pattern": 1, "review_suggested": 2, "strong_match": 3}.items() for x in kv])
    top = found.groupBy("probe_id").agg(F.max_by("band", order[F.col("band")]).alias("band"))
    return top.groupBy("band").agg(F.count("*").alias("files"))
