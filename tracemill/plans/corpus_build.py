"""The offline corpus build: select, deduplicate, count, rank and export, each stage a table of its own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SOURCE_SEARCH, Profile
from ..functions import arrow as A
from ..functions import columns as X
from ..operators import corpus
from ..session import materialise


@dataclass(frozen=True)
class Corpus:
    """blobs, one per exact hash; files; frequencies; ranked occurrences; the stoplist."""

    blobs: DataFrame
    files: DataFrame
    frequencies: DataFrame
    ranked: DataFrame
    stoplist: DataFrame
    reasons: DataFrame


def build(files: DataFrame, releases: DataFrame, projects: DataFrame, profile: Profile = SOURCE_SEARCH, least_tokens: int = 40) -> Corpus:
    """Build a corpus from raw files (file_id, release_id, path, source), releases and projects.

    Sources are lexed once per distinct source; fingerprints are counted per shape, so vendored copies do not
    inflate them. Only the hashes and identities of files meet releases and projects, never the sources.
    """
    chosen = corpus.selected(files)
    kept = chosen.where("reason is null").withColumn("exact_hash", X.exact_hash("source"))
    one = kept.groupBy("exact_hash").agg(F.min_by(F.struct("source", "language"), "file_id").alias("b")).select("exact_hash", "b.source", "b.language")
    lexed = one.select("exact_hash", "language", "source", A.kinds(F.col("source"), F.col("language")).alias("preserving"), A.kinds(F.col("source"), F.col("language"), normalised=True).alias("normalized"))
    prints = lambda c: F.array_distinct(F.transform(A.fingerprints(F.col(c), profile), lambda x: x["hash"])).alias(f"hashes_{c}")
    enough = lexed.where(F.size("preserving") >= least_tokens)
    blobs = materialise(enough.select("exact_hash", X.shape_hash("preserving").alias("shape_hash"), "language", F.size("preserving").alias("token_count"), "source", prints("preserving"), prints("normalized")))

    named = kept.select("file_id", "release_id", "path", "exact_hash").join(blobs.select("exact_hash", "shape_hash", "language"), "exact_hash")
    r = releases.select(F.col("id").alias("release_id"), "project_id", "version", "license_spdx", "license_family", "first_published")
    p = projects.select(F.col("id").alias("project_id"), "ecosystem", "name", "rank", "downloads")
    rows = materialise(named.join(r, "release_id").join(p, "project_id").withColumn("blob_id", F.col("exact_hash")))

    held = rows.select(F.col("shape_hash").alias("cluster"), "project_id")
    counts = None
    for representation in ("preserving", "normalized"):
        pairs = blobs.select(F.col("shape_hash").alias("cluster"), F.explode(f"hashes_{representation}").alias("hash"))
        one = corpus.document_frequency(pairs, held).withColumn("representation", F.lit(representation))
        counts = one if counts is None else counts.unionByName(one)
    counts = materialise(counts)
    return Corpus(blobs, rows, counts, corpus.upstream_rank(rows), corpus.stoplist(counts), chosen.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("files")))
