import random

from pyspark.sql import functions as F

from tracemill.operators import similarity
from tracemill.plans import corpus_build, portable_scan, source_search

BODY = "\n".join(f"export const value{i} = compute{i}(source, {i});" for i in range(14)) + "\n"


def test_corpus_build(spark):
    files = spark.createDataFrame([(1, 1, "src/a.js", BODY), (2, 2, "vendor/a.js", BODY), (3, 2, "dist/a.js", "// c\n" + BODY), (4, 2, "b.js", "x")], "file_id bigint, release_id bigint, path string, source string")
    releases = spark.createDataFrame([(1, 1, "1", "MIT", "permissive", "2015-01-01"), (2, 2, "1", None, None, "2019-01-01")], "id bigint, project_id bigint, version string, license_spdx string, license_family string, first_published string")
    projects = spark.createDataFrame([(1, "npm", "a", 1, 10), (2, "npm", "b", 2, 5)], "id bigint, ecosystem string, name string, rank int, downloads bigint")
    c = corpus_build.build(files, releases, projects)
    assert c.blobs.count() == 2 and c.blobs.select("shape_hash").distinct().count() == 1
    assert {r.file_id: r.rank_in_cluster for r in c.ranked.collect()} == {1: 1, 3: 2}
    assert {r.reason: r.files for r in c.reasons.collect()} == {"kept": 3, "excluded_path": 1}


def test_source_search(spark):
    # in a corpus of one document every fingerprint would count as common
    docs = spark.createDataFrame([(1, "javascript", BODY), (2, "javascript", "let unrelated = 1;"), (3, "typescript", "type A = B;")], "file_id bigint, language string, source string")
    files = spark.createDataFrame([(5, "src/x.js", "javascript", BODY), (6, "y.js", "javascript", ""), (7, "z.js", "javascript", "let q = 1")], "file_id bigint, path string, language string, source string")
    rows = source_search.scan(files, docs)
    got = {r.file_id: r.classification for r in rows.collect()}
    assert got == {5: "strong_match", 6: "insufficient_evidence", 7: "insufficient_evidence"}
    assert tuple(source_search.summary(rows).first()) == (1, 0, 2, 3)


def test_portable_scan(spark):
    renamed = BODY.replace("value", "other").replace("source", "src")
    files = spark.createDataFrame([(1, "a.js", renamed), (2, "LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE"), (3, "README", "x")], "file_id bigint, path string, content string")
    corpus = portable_scan.fingerprints(spark.createDataFrame([(9, "c.js", BODY)], "file_id bigint, path string, content string")).select(F.col("file_id").alias("doc_id"), "hash")
    entries = spark.createDataFrame([(9, "lib", "GPL-3.0", False)], "doc_id bigint, title string, license string, idiom boolean")
    s = portable_scan.run(files, corpus, entries)
    m = s.matches.first()
    assert m.containment == 1.0 and m.band == "strong_match" and m.severity == "blocking"
    assert [r.severity for r in s.findings.collect()] == ["blocking", "blocking"]
    assert s.summary.first().risk == "blocking"


def _sets(spark):
    rng = random.Random(11)
    probes = {i: frozenset(rng.sample(range(25), rng.randrange(1, 25))) for i in range(90)} | {200: frozenset(range(5)), 201: frozenset(range(5)), 202: frozenset()}
    docs = {i: (frozenset(rng.sample(range(40), rng.randrange(1, 12))), i % 3) for i in range(120)} | {500: (frozenset(range(5)), 1), 501: (frozenset(range(5)), 1), 502: (frozenset(range(5)), 2)}
    found = {(p, d): len(x & y) / len(y) for p, x in probes.items() for d, (y, _) in docs.items() if len(x & y) / len(y) >= 0.55}
    p = similarity.classes(spark.createDataFrame([(i, sorted(x)) for i, x in probes.items()], "probe_id bigint, hashes array<bigint>"), "probe_id")
    d = similarity.classes(spark.createDataFrame([(i, sorted(x), m) for i, (x, m) in docs.items()], "doc_id bigint, hashes array<bigint>, mark int"), "doc_id", "mark")
    return docs, found, p, d


def test_containing_equals_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_PROBES", 20)
    monkeypatch.setattr(similarity, "_DOCS", 9)
    docs, want, p, d = _sets(spark)
    got = similarity.containing(p, d, 0.55).collect()
    assert len(got) == len(want) and {(r.probe_id, r.doc_id): r.containment for r in got} == want
    assert all(r.shared / r.doc_size == r.containment and r.mark == docs[r.doc_id][1] for r in got)


def test_portable_matches_make_no_row_for_a_common_hash(spark):
    files = spark.createDataFrame([(i, f"{i}.js", BODY) for i in range(3)], "file_id bigint, path string, content string")
    corpus = portable_scan.fingerprints(files).select(F.col("file_id").alias("doc_id"), "hash")
    entries = spark.createDataFrame([(i, "lib", "MIT", i == 1) for i in range(3)], "doc_id bigint, title string, license string, idiom boolean")
    s = portable_scan.run(files, corpus, entries)
    plan = s.matches._jdf.queryExecution().toString()
    assert not any("Join" in line and "hash#" in line for line in plan.splitlines())
    # pairs of whole classes come from one place, where they have been counted
    assert "CoGroups" in plan and s.matches.count() == 9
    assert {(r.doc_id, r.band, r.severity) for r in s.matches.collect()} == {(0, "strong_match", "review"), (1, "common_pattern", "info"), (2, "strong_match", "review")}


def test_the_best_match_of_each_mark_tells_the_bands(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_PROBES", 20)
    monkeypatch.setattr(similarity, "_DOCS", 9)
    docs, want, p, d = _sets(spark)
    most = {}
    for (probe, doc), c in want.items():
        most[probe, docs[doc][1]] = max(c, most.get((probe, docs[doc][1]), 0))
    got = {}
    for r in similarity.containing(p, d, 0.55, best=True).collect():
        assert want[r.probe_id, r.doc_id] == r.containment
        got[r.probe_id, r.mark] = max(r.containment, got.get((r.probe_id, r.mark), 0))
    assert got == most
    # one match of a file with copies, not one for each of them
    files = spark.createDataFrame([(i, f"{i}.js", BODY) for i in range(30)], "file_id bigint, path string, content string")
    corpus = portable_scan.fingerprints(files).select(F.col("file_id").alias("doc_id"), "hash")
    entries = spark.createDataFrame([(i, "lib", "MIT", False) for i in range(30)], "doc_id bigint, title string, license string, idiom boolean")
    s = portable_scan.run(files, corpus, entries)
    assert s.best.count() == 30 and [tuple(r) for r in similarity.strongest_counts(s.best).collect()] == [("strong_match", 30)] == [tuple(r) for r in similarity.strongest_counts(s.matches).collect()]


def test_findings_are_the_first_of_all_matches(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_PROBES", 20)
    monkeypatch.setattr(similarity, "_DOCS", 9)
    docs, want, p, d = _sets(spark)
    rank = lambda mark, c: c + 2.0 * ((mark == 1) & (c >= 0.85))
    order = sorted(((rank(docs[doc][1], c), probe, doc) for (probe, doc), c in want.items()), reverse=True)
    for top in (1, 7, 40):
        got = {(r.probe_id, r.doc_id) for r in similarity.containing(p, d, 0.55, top=top, rank=rank).collect()}
        assert {(probe, doc) for score, probe, doc in order if score >= order[top - 1][0]} <= got <= set(want)
        assert top > 1 or len(got) < len(want)
    # caps over ties: the key decides, and a cap that cuts says so
    files = spark.createDataFrame([(i, f"{i % 2}{i}.js", BODY) for i in range(6)] + [(9, "LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE")], "file_id bigint, path string, content string")
    corpus = portable_scan.fingerprints(files.where("file_id < 4")).select(F.col("file_id").alias("doc_id"), "hash")
    entries = spark.createDataFrame([(0, "a", "GPL-3.0", False), (1, "b", "MIT", True), (2, "c", None, False), (3, "d", "MIT", False)], "doc_id bigint, title string, license string, idiom boolean")
    found = portable_scan.run(files, corpus, entries, actionable=8, informational=2).findings.collect()
    keys = lambda docs: sorted(f"similarity:{i % 2}{i}.js:{d}" for i in range(6) for d in docs)
    assert sorted(r.finding_key for r in found if r.severity == "blocking") == sorted(["license:LICENSE", *keys([0])])
    assert sorted(r.finding_key for r in found if r.severity == "review") == keys([2, 3])[:1]
    assert {r.actionable: r.truncated for r in found} == {True: True, False: False}
    assert sorted(r.finding_key for r in found if r.severity == "info") == keys([1])[:2]
