"""Findings across scans: reconciliation with proof, and what a rescan shows to be gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = ["open", "in_review"]
# fixed values: bands that a finding may carry
BANDS = ["common_pattern", "review_suggested", "strong_match"]


def _in(paths: str, value: Column) -> Column:
    return F.coalesce(F.array_contains(F.col(paths), value), F.lit(False))


def reconcile_scans(tracked: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """(repository_id, finding_key, action, from_status, to_status, band, severity, title, file_path, last_seen_scan_id) after a scan of each repository.

    tracked: repository_id, finding_key, type, provider_id, title, file_path, severity, band, status, remediation_pending,
    last_seen_scan_id. scans, one complete scan for each repository: repository_id, scan_id, evaluated_types,
    providers_run, checked_paths, ingested_paths, missing_paths (arrays), manifests_checked, truncated. findings: scan_id,
    finding_key, type, provider_id, title, file_path, severity, band, created_at.

    action is detected, reopened, still_detected, seen (again, nothing to tell), resolved or kept. Only findings for review or
    blocking count, of equal keys the earliest. A finding that is not seen is resolved only if the scan was not cut off,
    evaluated its type and proves it: its path is gone, or was checked by its provider, or its manifests or file were
    read. Decisions of users are kept. The same scan again changes nothing.
    """
    proofs = scans.select("repository_id", "scan_id", "evaluated_types", "providers_run", "checked_paths", "ingested_paths", "missing_paths", F.coalesce("manifests_checked", F.lit(False)).alias("manifests_checked"), F.coalesce("truncated", F.lit(False)).alias("truncated"))
    mine = findings.where("finding_key is not null and severity in ('review', 'blocking')").join(proofs.select("scan_id", "repository_id"), "scan_id")
    first = mine.groupBy("repository_id", "finding_key").agg(F.min_by(F.struct("type", "provider_id", "title", "file_path", "severity", "band"), F.struct(F.col("created_at").isNotNull(), "created_at")).alias("new"))
    known = tracked.select("repository_id", "finding_key", F.struct("type", "provider_id", "title", "file_path", "severity", "band", "status", "remediation_pending", "last_seen_scan_id").alias("old"))
    both = known.join(first, ["repository_id", "finding_key"], "full_outer").join(proofs, "repository_id", "left")

    old, new = F.col("old"), F.col("new")
    seen, held = new.isNotNull(), old.isNotNull()
    is_open = F.coalesce(old["status"].isin(OPEN), F.lit(False))
    path, kind, key = old["file_path"], old["type"], F.col("finding_key")
    looked = _in("checked_paths", path) & (old["provider_id"].isNull() | _in("providers_run", old["provider_id"]))
    proven = (
        F.when(_in("missing_paths", path), True)
        .when(kind == "structural_similarity", looked)
        .when((kind == "license") & key.startswith("license:dependency:"), F.col("manifests_checked"))
        .when((kind == "license") & key.startswith("license:file:"), _in("ingested_paths", path))
        .otherwise(False)
    )
    gone = is_open & F.coalesce(~F.col("truncated"), F.lit(False)) & _in("evaluated_types", kind) & F.coalesce(proven, F.lit(False))
    action = (
        F.when(seen & ~held, "detected")
        .when(seen & (old["status"] == "resolved"), "reopened")
        .when(seen & is_open & F.coalesce(old["remediation_pending"], F.lit(False)), "still_detected")
        .when(seen, "seen")
        .when(gone, "resolved")
        .otherwise("kept")
    )
    status = F.when(F.col("action").isin("detected", "reopened"), "open").when(F.col("action") == "resolved", "resolved").otherwise(old["status"])
    banded = F.coalesce(F.when(new["band"].isin(BANDS), new["band"]), old["band"])
    return both.withColumn("action", action).select(
        "repository_id", "finding_key", "action", old["status"].alias("from_status"), status.alias("to_status"), banded.alias("band"),
        F.when(seen, new["severity"]).otherwise(old["severity"]).alias("severity"), F.when(seen, new["title"]).otherwise(old["title"]).alias("title"),
        F.when(held, path).otherwise(new["file_path"]).alias("file_path"), F.when(seen, F.col("scan_id")).otherwise(old["last_seen_scan_id"]).alias("last_seen_scan_id"),
    )


def reconcile_counts(actions: DataFrame) -> DataFrame:
    """(repository_id, detected, reopened, still_detected, resolved)."""
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return actions.groupBy("repository_id").agg(*[count(a) for a in ("detected", "reopened", "still_detected", "resolved")])


def missing_paths(tracked: DataFrame, tree: DataFrame, complete: DataFrame) -> DataFrame:
    """(repository_id, file_path) of open findings whose path is in no complete tree (repository_id, path); complete lists the repositories of complete trees."""
    held = tracked.where(F.col("status").isin(OPEN) & F.col("file_path").isNotNull()).select("repository_id", "file_path").distinct().join(complete.select("repository_id").distinct(), "repository_id", "left_semi")
    return held.join(tree.select("repository_id", F.col("path").alias("file_path")), ["repository_id", "file_path"], "left_anti")


def rescan_resolution(previous: DataFrame, following: DataFrame, checked: DataFrame, tree: DataFrame, complete: DataFrame, keys: list[str], id_col: str = "finding_id", path_col: str = "path") -> DataFrame:
    """(keys, finding_id, path, state) of the active findings of a scan that the next one lacks: resolved or unverified.

    A finding is resolved if its path was checked again, or if it is not in the tree of a scan whose tree is complete.
    checked and tree are (keys, path), complete lists the keys of complete trees.
    """
    lost = previous.select(*keys, id_col, path_col).distinct().join(following.select(*keys, id_col).distinct(), [*keys, id_col], "left_anti")
    mark = lambda df, name: df.select(*keys, path_col).distinct().withColumn(name, F.lit(True))
    told = lost.join(mark(checked, "_checked"), [*keys, path_col], "left").join(mark(tree, "_there"), [*keys, path_col], "left").join(complete.select(*keys).distinct().withColumn("_complete", F.lit(True)), keys, "left")
    deleted = F.col("_complete").isNotNull() & F.col("_there").isNull()
    return told.select(*keys, id_col, path_col, F.when(F.col("_checked").isNotNull() | deleted, "resolved").otherwise("unverified").alias("state"))


def by_basename(files: DataFrame, keys: list[str], order: list[Column], path_col: str = "path") -> DataFrame:
    """Files with a column looked_up_as: their full path, and the base name too where no full path is spelled so and no earlier file has it."""
    base = F.substring_index(path_col, "/", -1)
    full = files.withColumn("looked_up_as", F.col(path_col))
    taken = files.select(*keys, F.col(path_col).alias("looked_up_as")).distinct()
    nth = F.row_number().over(Window.partitionBy(*keys, "looked_up_as").orderBy(*order))
    first = files.withColumn("looked_up_as", base).join(taken, [*keys, "looked_up_as"], "left_anti").withColumn("_n", nth).where("_n = 1").drop("_n")
    return full.unionByName(first)
