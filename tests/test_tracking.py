import json

import pytest
from pyspark.sql import functions as F

from tracemill.functions import columns as X
from tracemill.operators import provenance, tracking

TRACKED = "repository_id bigint, finding_key string, type string, provider_id string, title string, file_path string, severity string, band string, status string, remediation_pending boolean, last_seen_scan_id bigint"
SCANS = "repository_id bigint, scan_id bigint, evaluated_types array<string>, providers_run array<string>, checked_paths array<string>, ingested_paths array<string>, missing_paths array<string>, manifests_checked boolean, truncated boolean"
FOUND = "scan_id bigint, finding_key string, type string, provider_id string, title string, file_path string, severity string, band string, created_at timestamp"
SIMILAR = "structural_similarity"


def tracked(key, status, path="a.js", kind=SIMILAR, provider="p", pending=False):
    return (1, key, kind, provider, "t", path, "review", "review_suggested", status, pending, 5)


def found(key, severity="review", path="a.js", band="strong_match"):
    return (9, key, SIMILAR, "p", "new", path, severity, band, None)


def after(spark, old, new, **scan):
    row = {"evaluated_types": [SIMILAR, "license"], "providers_run": ["p"], "checked_paths": [], "ingested_paths": [], "missing_paths": [], "manifests_checked": False, "truncated": False} | scan
    scans = spark.createDataFrame([(1, 9, *row.values())], SCANS)
    out = tracking.reconcile_scans(spark.createDataFrame(old, TRACKED), scans, spark.createDataFrame(new, FOUND))
    return {r.finding_key: r for r in out.collect()}


def test_a_scan_detects_and_again_changes_nothing(spark):
    first = after(spark, [], [found("a"), found("b"), found("c", "info"), found("a", "blocking")])
    assert {k: (r.action, r.to_status) for k, r in first.items()} == {"a": ("detected", "open"), "b": ("detected", "open")}
    again = after(spark, [tracked("a", "open"), tracked("b", "in_review")], [found("a"), found("b")])
    assert {r.action for r in again.values()} == {"seen"} and again["b"].to_status == "in_review" and again["a"].last_seen_scan_id == 9


def test_reopened_still_detected_and_decided(spark):
    got = after(spark, [tracked("a", "resolved"), tracked("b", "open", pending=True), tracked("c", "accepted_risk"), tracked("d", "accepted_risk")], [found("a"), found("b"), found("c")])
    assert {k: (r.action, r.to_status) for k, r in got.items()} == {"a": ("reopened", "open"), "b": ("still_detected", "open"), "c": ("seen", "accepted_risk"), "d": ("kept", "accepted_risk")}


@pytest.mark.parametrize(
    "row,scan,want",
    [
        (tracked("a", "open"), {"checked_paths": ["a.js"]}, "resolved"),
        (tracked("a", "open"), {}, "kept"),
        (tracked("a", "open"), {"checked_paths": ["a.js"], "truncated": True}, "kept"),
        (tracked("a", "open"), {"checked_paths": ["a.js"], "providers_run": ["q"]}, "kept"),
        (tracked("a", "open", provider=None), {"checked_paths": ["a.js"], "providers_run": []}, "resolved"),
        (tracked("a", "open"), {"missing_paths": ["a.js"], "providers_run": []}, "resolved"),
        (tracked("a", "open"), {"checked_paths": ["a.js"], "evaluated_types": ["license"]}, "kept"),
        (tracked("license:dependency:x", "open", None, "license"), {"manifests_checked": True}, "resolved"),
        (tracked("license:dependency:x", "open", None, "license"), {}, "kept"),
        (tracked("license:file:L", "in_review", "L", "license"), {"ingested_paths": ["L"]}, "resolved"),
        (tracked("x", "open", kind="other"), {"checked_paths": ["a.js"], "evaluated_types": ["other"]}, "kept"),
        (tracked("a", "open"), {"checked_paths": None, "missing_paths": None}, "kept"),
    ],
)
def test_a_lost_finding_is_resolved_only_with_proof(spark, row, scan, want):
    assert [r.action for r in after(spark, [row], [], **scan).values()] == [want]


def test_counts_and_empty_tables(spark):
    assert after(spark, [], []) == {}
    out = spark.createDataFrame([(1, "detected"), (1, "reopened"), (1, "kept")], "repository_id bigint, action string")
    assert tracking.reconcile_counts(out).first().asDict() == {"repository_id": 1, "detected": 1, "reopened": 1, "still_detected": 0, "resolved": 0}


def test_missing_paths_need_a_complete_tree(spark):
    old = spark.createDataFrame([(1, "a", "open"), (1, "b", "open"), (2, "a", "open"), (1, "c", "resolved"), (1, None, "open")], "repository_id bigint, file_path string, status string")
    tree = spark.createDataFrame([(1, "b")], "repository_id bigint, path string")
    got = tracking.missing_paths(old, tree, spark.createDataFrame([(1,)], "repository_id bigint"))
    assert [tuple(r) for r in got.collect()] == [(1, "a")]


def test_rescan_unverified_rechecked_and_deleted(spark):
    previous = spark.createDataFrame([("r", i, p) for i, p in ((1, "kept"), (2, "unchecked"), (3, "checked"), (4, "gone"))], "repo string, finding_id bigint, path string")
    following = spark.createDataFrame([("r", 1)], "repo string, finding_id bigint")
    paths = lambda *p: spark.createDataFrame([("r", x) for x in p], "repo string, path string")
    run = lambda complete: {r.finding_id: r.state for r in tracking.rescan_resolution(previous, following, paths("checked"), paths("unchecked", "checked"), complete, ["repo"]).collect()}
    whole = spark.createDataFrame([("r",)], "repo string")
    assert run(whole) == {2: "unverified", 3: "resolved", 4: "resolved"}
    assert run(whole.where("false")) == {2: "unverified", 3: "resolved", 4: "unverified"}


def test_names_that_files_are_looked_up_by(spark):
    files = spark.createDataFrame([(1, "a/package.json"), (2, "package.json"), (3, "b/go.mod"), (4, "a/go.mod")], "id bigint, path string").withColumn("scan", F.lit(1))
    got = sorted((r.id, r.looked_up_as) for r in tracking.by_basename(files, ["scan"], [F.col("id")]).collect())
    assert got == [(1, "a/package.json"), (2, "package.json"), (3, "b/go.mod"), (3, "go.mod"), (4, "a/go.mod")]


def test_intake_reasons(spark):
    rows = [("src/a.js", 10, "x"), ("docs/a.js", 10, "x"), ("node_modules/a.js", 10, "x"), ("a/.git/x.js", 1, ""), ("a.min.js", 1, "x"), ("a.tar", 1, ""), ("a.md", 1, ""), ("b.py", 99, "x"), ("c.py", 1, "a\0b"), ("d.ts", 1, "PK\x03\x04"), ("e.ts", None, None)]
    df = spark.createDataFrame(rows, "path string, size int, source string")
    got = [r[0] for r in df.select(X.intake_reason("path", "size", "source", ["docs"], 50)).collect()]
    assert got == [None, "user_excluded", "excluded_directory", "excluded_directory", "excluded_directory", "nested_archive", "unsupported_type", "file_too_large", "binary", "binary", None]
    tree = [r[0] for r in df.select(X.tree_reason("path", "size", ["docs"], 50)).collect()]
    assert tree == [None, "user_excluded", "excluded_directory", None, None, "unsupported_type", "unsupported_type", "file_too_large", None, None, None]


def test_small_intake_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(X.commit_state(lit(409), lit("Git Repository is empty."))) == "empty_repository" and one(X.commit_state(lit(409), lit("x"))) is None
    assert one(X.selection_root(F.array(lit("a/b"), lit("a/c"), lit("d")))) == "a" and one(X.selection_root(F.array(lit("a/b"), lit("c/d")))) is None
    assert [one(X.repository_input(lit(x))) for x in (" a/b/ ", "github.com/a/b", "http://x.y/z", "", "what")] == ["https://github.com/a/b", "https://github.com/a/b", "http://x.y/z", "", "what"]
    assert one(X.is_private_upload(lit("zip"))) and not one(X.is_private_upload(lit(None).cast("string"))) and one(X.retryable(lit("SCAN_BUSY")))
    assert one(X.nothing_to_scan(lit(0), lit("github"), lit(None).cast("boolean"))) and one(X.nothing_to_scan(lit(3), lit("files"), lit(True))) and not one(X.nothing_to_scan(lit(3), lit("github"), lit(True)))
    rules, valid = X.exclusion_rules(F.array(lit("b/"), lit("a"), lit("b")))
    assert one(rules) == ["a", "b"] and one(valid)
    assert not one(X.exclusion_rules(F.array(lit("*.js")))[1]) and not one(X.exclusion_rules(F.array(lit("../a")))[1])


def test_edits_fold_and_records_are_canonical(spark):
    changes = F.array(F.struct(F.lit("ab\nc").alias("text"), F.lit(0).alias("removed")), F.struct(F.lit("x").alias("text"), F.lit(4).alias("removed")), F.struct(F.lit(None).cast("string").alias("text"), F.lit(2).alias("removed")))
    assert spark.range(1).select(provenance.folded_edit(changes).alias("e")).first().e.asDict() == {"chars": 5, "lines": 1, "removed": 6, "replacement": True}
    event = {"repositoryId": F.lit("r"), "filePath": F.lit("ü\"f"), "eventTimestamp": F.lit("2026-09-15 09:02:00+00"), "metadata": F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))}
    other = event | {"eventTimestamp": F.lit("2026-09-15T09:02:00.000Z")}
    a, b = spark.range(1).select(provenance.canonical_record(event, F.lit(None).cast("string")), provenance.canonical_record(other, F.lit(None).cast("string"))).first()
    want = dict.fromkeys(provenance.EVENT_FIELDS) | {"repositoryId": "r", "filePath": 'ü"f', "eventTimestamp": "2026-09-15T09:02:00.000Z", "metadata": {"a": "1", "b": "2"}}
    assert a == b == json.dumps(want, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
