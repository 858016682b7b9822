"""Corpus building: selection, duplicate clusters, fingerprint frequencies, upstream ranking and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RANK_WEIGHTS
from ..functions import columns as X


def selected(files: DataFrame) -> DataFrame:
    """Files (path, source, ...) with their language and the reason for which they stay out, null for those kept."""
    return files.withColumn("language", X.language("path")).withColumn("reason", X.selection_reason("path", "source"))


def reason_counts(files: DataFrame) -> DataFrame:
    return selected(files).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("files"))


def occurrences(blobs: DataFrame, files: DataFrame, releases: DataFrame, projects: DataFrame) -> DataFrame:
    """Every ingested file with its shape, release and project; one row per file."""
    b = blobs.select(F.col("id").alias("blob_id"), "exact_hash", "shape_hash", "language")
    r = releases.select(F.col("id").alias("release_id"), "project_id", "version", "license_spdx", "license_family", "first_published")
    p = projects.select(F.col("id").alias("project_id"), "ecosystem", "name", "rank", "downloads")
    f = files.select(F.col("id").alias("file_id"), "release_id", "blob_id", "path")
    return f.join(b, "blob_id").join(r, "release_id").join(p, "project_id")


def clusters(rows: DataFrame, key: str) -> DataFrame:
    """(key, occurrences, project_count): counted per project first, so a hot cluster combines on the map side."""
    per = rows.where(F.col(key).isNotNull()).groupBy(key, "project_id").agg(F.count("*").alias("n"))
    return per.groupBy(key).agg(F.sum("n").alias("occurrences"), F.count("*").alias("project_count"))


def document_frequency(prints: DataFrame, held: DataFrame, least: int = 2) -> DataFrame:
    """(hash, clusters, projects) of hashes in at least `least` clusters.

    prints is (cluster, hash), held (cluster, project_id). Both distinct counts are exact: pairs are made distinct
    before they are counted, and the hash is shuffled once for each count.
    """
    pairs = prints.distinct()
    per_cluster = pairs.groupBy("hash").agg(F.count("*").alias("clusters")).where(F.col("clusters") >= least)
    per_project = pairs.join(per_cluster.select("hash"), "hash", "left_semi").join(held.distinct(), "cluster").select("hash", "project_id").distinct().groupBy("hash").agg(F.count("*").alias("projects"))
    return per_cluster.join(per_project, "hash", "left").select("hash", "clusters", F.coalesce("projects", F.lit(0)).alias("projects"))


def stoplist(df: DataFrame, preserving: int = 30, normalised: int = 8) -> DataFrame:
    """Hashes (representation, hash, clusters) that are too common to tell anything."""
    limit = F.when(F.col("representation") == "normalized", normalised).otherwise(preserving)
    return df.where(F.col("clusters") >= limit).select("representation", "hash")


def _features(at: Column) -> dict[str, Column]:
    path = F.lower("path")
    segments = F.split(path, "/")
    base = F.regexp_replace(F.element_at(segments, -1), r"\.[a-z]+$", "")
    package = F.regexp_replace(F.lower("name"), "^@[^/]+/", "")
    flat = F.replace(package, F.lit("-"), F.lit("_"))
    parts = X.name_tokens("name")
    cluster = Window.partitionBy("shape_hash")
    first = F.min(at).over(cluster)
    days = F.when(at.isNotNull() & first.isNotNull(), (F.unix_millis(at) - F.unix_millis(first)) / 86_400_000.0).otherwise(3650.0)
    downloads = F.coalesce(F.col("downloads"), F.lit(0)).cast("double")
    named = (base == package) | (base == flat) | F.array_contains(segments, package) | F.array_contains(segments, flat) | ((F.size(parts) > 0) & F.forall(parts, lambda t: F.contains(path, t)))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("double")
    return {
        "origin": 1.0 / (1.0 + F.greatest(days, F.lit(0.0)) / 180.0),
        "authority": F.log10(1.0 + F.greatest(downloads, F.lit(0.0))) / F.log10(1.0 + F.greatest(F.max(downloads).over(cluster), F.lit(1.0))),
        "name_match": flag(named),
        "primary_source": flag(path.rlike("^(src|lib)/") | (F.size(segments) == 1) | (segments[0] == flat)),
        "derived": flag(X.derived(path)),
        "auxiliary": flag(X.auxiliary(path)),
        "license_known": flag(F.length("license_spdx") > 0),
    }


def upstream_rank(rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Occurrences with features, score, probability and rank inside their shape; rank 1 is the likely upstream.

    A negative download count counts as none. Whether a directory names another package of the cluster is found by
    an equi-join of directories with the names in the cluster, not by comparing all pairs of occurrences.
    """
    at = at if at is not None else F.try_to_timestamp("first_published")
    rows = rows.where(F.col("shape_hash").isNotNull()).withColumn("published", at)
    package = F.regexp_replace(F.lower("name"), "^@[^/]+/", "")
    directories = F.slice(F.split(F.lower("path"), "/"), 1, F.size(F.split("path", "/")) - 1)
    inside = rows.select("file_id", "shape_hash", F.col("name").alias("own"), F.explode(F.array_distinct(directories)).alias("directory"))
    names = rows.select("shape_hash", package.alias("directory"), "name").distinct()
    vendored = inside.join(names, ["shape_hash", "directory"]).where("name <> own").select("file_id").distinct().withColumn("vendored", F.lit(1.0))
    features = rows.select("*", *[c.alias(n) for n, c in _features(F.col("published")).items()]).join(vendored, "file_id", "left").fillna(0.0, ["vendored"])
    score = sum((F.col(n) * w for n, w in RANK_WEIGHTS.items()), F.lit(0.0))
    cluster = Window.partitionBy("shape_hash")
    scored = features.withColumn("score", score).withColumn("best", F.max("score").over(cluster))
    weight = F.exp(F.col("score") - F.col("best"))
    order = cluster.orderBy(F.desc("score"), F.coalesce("first_published", F.lit("")), "path", "file_id")
    return scored.withColumn("probability", weight / F.sum(weight).over(cluster)).withColumn("rank_in_cluster", F.row_number().over(order)).drop("best")


def export_pack(ranked: DataFrame, documents: int = 1000, per_project: int = 8) -> DataFrame:
    """Canonical occurrences in export order: neither auxiliary nor derived, at most per_project of a project, the first `documents`."""
    canonical = ranked.where("rank_in_cluster = 1").where(~X.auxiliary("path") & ~X.derived("path"))
    nth = F.row_number().over(Window.partitionBy("ecosystem", "name").orderBy("path", "file_id"))
    order = [F.col("rank").asc_nulls_last(), "ecosystem", "path", "file_id"]
    kept = canonical.withColumn("nth", nth).where(F.col("nth") <= per_project).orderBy(*order).limit(documents)
    return kept.select(F.concat(F.concat_ws(":", "ecosystem", "name"), F.lit("@"), "version", F.lit(":"), "path").alias("document_id"), "file_id", "blob_id", "path", "version", "license_spdx", "probability")


def latest_versions(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, by one aggregation over a composite instead of a sort of every group."""
    rest = [c for c in df.columns if c not in key]
    top = df.groupBy(*key).agg(F.max(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *rest)).alias("top"))
    return top.select(*key, *[F.col(f"top.{c}").alias(c) for c in rest])
