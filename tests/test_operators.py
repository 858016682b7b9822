import io
import json
import random
import tarfile
import zipfile

from pyspark.sql import functions as F

from tracemill import queries
from tracemill.constants import SearchSettings
from tracemill.functions.columns import language_family
from tracemill.operators import corpus, history, license, provenance, search, similarity
from tracemill.sources import archives, registries, tables
from tracemill.streaming import events as stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_containment_counts_each_hash_once(spark):
    probe = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 3)], "probe_id int, hash bigint")
    corpus_ = spark.createDataFrame([(7, 2), (7, 3), (7, 4), (7, 3)], "doc_id int, hash bigint")
    r = similarity.containment(probe, corpus_).first()
    assert (r.shared, r.doc_size, round(r.containment, 4)) == (2, 3, 0.6667)


def test_blob_containment_holds_hashes_of_many_blobs(spark, tmp_path):
    rng = random.Random(6)
    common = list(range(20))
    sets = {i: set(common) for i in range(40)}
    sets |= {i: set(common) | {1000 + i * 100 + k for k in range(rng.randrange(0, 30))} for i in range(40, 80)}
    sets |= {i: set(rng.sample(range(60), rng.randrange(1, 40))) for i in range(80, 120)}
    data = [(i, [(h, n) for n, h in enumerate(sorted(s))]) for i, s in sets.items()] + [(0, [(h, 0) for h in common]), (120, [])]
    spark.createDataFrame(data, "blob_id bigint, fp_preserving array<struct<hash:bigint,position:int>>").write.parquet(str(tmp_path / "fingerprints.parquet"))
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) / len(sets[b]) >= 0.55}
    got = queries.blob_containment(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.probe_id, r.doc_id, r.shared) for r in got} == want
    assert all(r.containment == round(r.shared / len(sets[r.doc_id]), 6) and (r.band == "strong_match") == (r.containment >= 0.85) for r in got)


def test_copies_of_one_shape_stay_searchable(spark, tmp_path):
    body = "\n".join(f"export const value{i} = compute{i}(source, {i});" for i in range(14)) + "\n"
    others = [(100 + i, "javascript", "\n".join(f"let a{i}x{k} = other{k * i}.call{i}({k});" for k in range(12))) for i in range(45)]
    blobs = [(i, "javascript", f"// copy {i}\n{body}") for i in range(35)] + others
    spark.createDataFrame(blobs, "id bigint, language string, source string").write.parquet(str(tmp_path / "blobs.parquet"))
    spark.createDataFrame([(i, "src/a.js") for i, _, _ in blobs], "blob_id bigint, path string").write.parquet(str(tmp_path / "scan_files.parquet"))
    spark.createDataFrame([(1, "javascript", "src/x.js", body)], "arrival_id bigint, language string, path string, source string").write.parquet(str(tmp_path / "arrivals.parquet"))
    short = queries.search_shortlists(spark, str(tmp_path)).collect()
    assert {r.nth for r in short} == set(range(1, 21)) and {r.doc_id for r in short} <= set(range(35))
    # 35 blobs hold every hash, but one shape
    assert {r.doc_id for r in queries.search_findings(spark, str(tmp_path)).collect()} == {r.doc_id for r in short}


def test_the_extension_tells_an_unnamed_language(spark, tmp_path):
    source = "# a comment\nx = 1\n"
    spark.createDataFrame([(1, None, source), (2, "Python", source), (3, None, source), (4, None, source)], "id bigint, language string, source string").write.parquet(str(tmp_path / "blobs.parquet"))
    spark.createDataFrame([(1, "a/b.py"), (3, "a.js"), (3, "c.ts"), (3, "d.ts"), (4, None)], "blob_id bigint, path string").write.parquet(str(tmp_path / "scan_files.parquet"))
    got = {r.file_id: r.language for r in queries._sources(spark, str(tmp_path)).collect()}
    assert got == {1: "python", 2: "python", 3: "typescript", 4: "javascript"}
    shape = {r.file_id: r.shape for r in queries.token_counts(spark, str(tmp_path)).collect()}
    assert shape[1] == shape[2]


def test_bands(spark):
    cases = [(0.54, False, "CLEAR", "clear"), (0.95, True, "CLEAR", "common_pattern"), (0.95, True, "BLOCKING", "strong_match"), (0.6, False, "BLOCKING", "review_suggested"), (0.85, False, "CLEAR", "strong_match"), (0.7, False, "CLEAR", "review_suggested")]
    df = spark.createDataFrame(cases, "s double, i boolean, p string, want string")
    assert all(r[0] == r[1] for r in df.select(similarity.band("s", F.col("i"), F.col("p")), "want").collect())


def test_a_failing_provider_is_reported(spark):
    probe = spark.createDataFrame([(1, 1)], "probe_id int, hash bigint")
    good = spark.createDataFrame([(5, 1)], "doc_id int, hash bigint")
    found, failed = similarity.matches(probe, {"good": good, "bad": good.drop("hash")})
    assert failed == ["bad"] and found.count() == 1


def test_upstream_prefers_the_original(spark):
    data = [
        (1, "s", "left-pad", "src/index.js", "2015-01-01T00:00:00Z", 1000, "MIT", "npm", 1, 10, "1.0.0", 100),
        (2, "s", "other", "node/left-pad/index.js", "2018-01-01T00:00:00Z", 5, None, "npm", 9, 11, "1.0.0", 100),
        (3, "s", "left-pad", "dist/index.js", "2015-01-01T00:00:00Z", 1000, "MIT", "npm", 1, 10, "1.0.0", 100),
        (4, None, "x", "a.js", None, None, None, "npm", 2, 12, "1", 101),
    ]
    df = spark.createDataFrame(data, "file_id bigint, shape_hash string, name string, path string, first_published string, downloads bigint, license_spdx string, ecosystem string, rank int, project_id bigint, version string, blob_id bigint")
    got = {r.file_id: r for r in corpus.upstream_rank(df).collect()}
    assert set(got) == {1, 2, 3} and got[1].rank_in_cluster == 1 and got[1].probability > 0.5 and got[2].vendored == 1.0
    assert abs(sum(r.probability for r in got.values()) - 1) < 1e-9
    assert corpus.export_pack(corpus.upstream_rank(df)).count() == 1


def test_document_frequency_is_exact(spark):
    prints = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 1)], "cluster string, hash bigint")
    held = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2)], "cluster string, project_id bigint")
    assert rows(corpus.document_frequency(prints, held)) == [(1, 3, 2)]


def test_license_forms(spark):
    plain = [("GPL-3.0 OR MPL-2.0", "MPL-2.0"), ("MIT AND Custom-Thing", "Unknown"), ("BSD", "Unknown"), ("(MIT)", "MIT"), ("MIT AND GPL-2.0-only", "GPL-2.0"), (None, "Unknown"), ("", "Unknown"), ("Apache-2.0+", "Apache-2.0")]
    df = spark.createDataFrame(plain, "l string, want string")
    assert all(r[0] == r[1] for r in df.select(license.plain_license("l"), "want").collect())
    full = [(["(MIT OR GPL-3.0-only)"], "MIT OR GPL-3.0-only", "permissive"), (["MIT AND GPL-2.0-only"], "MIT AND GPL-2.0-only", "copyleft"), (["SEE LICENSE IN x"], None, "unknown"), (["License :: OSI Approved :: MIT License"], "MIT", "permissive"), ([None], None, "unknown"), (["BSD"], "BSD-3-Clause", "permissive"), (["UNLICENSED"], None, "unknown")]
    df = spark.createDataFrame(full, "v array<string>, spdx string, family string")
    for r in df.select(license.registry_license("v").alias("g"), "spdx", "family").collect():
        assert (r.g.spdx, r.g.family) == (r.spdx, r.family)


def test_worst_policy(spark):
    df = spark.createDataFrame([(1, "CLEAR"), (1, "UNKNOWN"), (2, "UNKNOWN"), (3, "REVIEW"), (3, "BLOCKING")], "k int, s string")
    assert rows(df.groupBy("k").agg(license.worst_policy("s"))) == [(1, "CLEAR"), (2, "UNKNOWN"), (3, "BLOCKING")]
    assert df.where("k > 9").agg(license.worst_policy("s")).first()[0] == "CLEAR"


def test_manifests(spark):
    files = [
        (1, "package.json", json.dumps({"dependencies": {"a": "1"}, "devDependencies": {"a": "2", "b": "3"}})),
        (1, "requirements.txt", "flask==1.0\n# c\n\nx>=2 # y"),
        (1, "go.mod", "module m\n\nrequire (\n\tgithub.com/x/y v1.2.3\n)"),
        (1, "Cargo.toml", '[package]\nname="p"\n[dependencies]\nserde = "1.0"\n[dev]\nz = "1"'),
        (2, "package.json", "{broken"),
    ]
    deps = license.dependencies(spark.createDataFrame(files, "scan_id int, path string, content string"))
    got = [r[1:4] for r in rows(deps)]
    assert got == [("cargo", "serde", "1.0"), ("go", "github.com/x/y", "v1.2.3"), ("npm", "a", "1"), ("npm", "b", "3"), ("pypi", "flask", "1.0"), ("pypi", "x", "2")]
    sbom = json.loads(license.bill_of_materials(deps).first().sbom)
    assert sbom["bomFormat"] == "CycloneDX" and len(sbom["components"]) == 6 and sbom["components"][0]["purl"] == "pkg:npm/a@1"


def test_edit_signals(spark):
    cases = [(5000, 130, 200, False, "ai_assisted_signal"), (500, 20, 100, True, "human_modified_ai"), (900, 3, None, False, "imported"), (5, 0, 300, False, "human_signal"), (60, 1, 50, False, "ai_assisted_signal"), (0, 0, 10, False, "unknown")]
    df = spark.createDataFrame(cases, "c int, l int, ms bigint, r boolean, want string")
    assert all(r[0] == r[1] for r in df.select(provenance.signal(F.col("c"), F.col("l"), F.col("ms"), F.col("r")), "want").collect())


def test_a_tampered_event_breaks_its_chain(spark):
    events = spark.createDataFrame([("r", i, f"c{i}", None if i == 1 else "t") for i in range(4)], "repo string, n int, body string, tool string")
    chain = provenance.build_chains(events, "repo", ["n"], {"contentHash": "body", "tool": "tool", "repositoryId": "repo"})
    body = {"contentHash": F.col("body"), "tool": F.col("tool"), "repositoryId": F.col("repo")}
    check = lambda ev: provenance.verify_chains(chain.join(ev.drop("repo"), "n"), "repo", ["n"], F.sha2(provenance.canonical_event(body, F.col("previous_hash")), 256)).first()
    assert check(events).intact
    broken = check(events.withColumn("body", F.when(F.col("n") == 2, "x").otherwise(F.col("body"))))
    assert not broken.intact and broken.first_break.n == 2


def test_reconciliation(spark):
    tracked = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False)], "repo int, key string, proof boolean")
    seen = spark.createDataFrame([(1, "a"), (1, "a"), (1, "d")], "repo int, key string")
    got = history.reconcile(tracked, seen, ["repo", "key"], F.col("proof"))
    assert {r.key: r.action for r in got.collect()} == {"a": "still_detected", "b": "resolved", "c": "unverified", "d": "detected"}
    again = history.reconcile(seen, seen, ["repo", "key"])
    assert {r.action for r in again.collect()} == {"still_detected"}


def test_budgets(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 10), (2, 1, 500)], "k int, n int, size int")
    assert rows(history.budget_cut(df, ["k"], [F.col("n")], "size", 9, 100)) == [(1, 1, 50)]
    assert rows(history.budget_greedy(df, ["k"], ["n"], "size", 9, 100)) == [(1, 1, 50), (1, 3, 10)]


def test_rejected_hits_do_not_count(spark):
    df = spark.createDataFrame([("u", i, i) for i in range(4)] + [("u", 70, 9)], "u string, s int, id int").select("u", F.timestamp_seconds("s").alias("at"), "id")
    got = {r.id: r.allowed for r in history.rate_limited(df, "u", "at", "id", 2, 60_000).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 9: True}


def test_fold_is_ordered(spark):
    data = [(1, 0, 9, 0.0, 1, "strong_match", 30), (1, 1, 9, 0.0, 1, "possible_common_pattern", 40), (1, 2, 9, 0.0, 1, "possible_common_pattern", 10)]
    df = spark.createDataFrame(data, "file_id int, region int, doc_id int, score double, nth int, classification string, matched_tokens int")
    r = search.best_per_source(df).first()
    assert r.classification == "possible_common_pattern" and r.matched_tokens == 40


def _function(names, values):
    lines = [f"  const {n} = compute{n.title()}({v}, source.{n});" for n, v in zip(names, values)]
    return "export function run(source) {\n" + "\n".join(lines) + "\n  return source;\n}\n"


def test_search_finds_a_copy_and_not_a_shape(spark):
    names = ["alpha", "bravo", "delta", "gamma", "kappa", "lambda1", "omega", "sigma"]
    copy = _function(names, range(8))
    renamed = _function([f"zz{i}" for i in range(4)], range(100, 104))  # a run of fewer than 80 tokens
    other = "\n".join(f"if (k{i} > {i}) {{ throw new E{i}(); }}" for i in range(20))
    docs = search.documents(spark.createDataFrame([(1, "javascript", copy), (2, "javascript", other), (3, "python", "x = 1")], "file_id bigint, language string, source string"))
    asked = spark.createDataFrame([(10, "typescript", copy), (11, "typescript", renamed), (12, "javascript", ""), (13, "javascript", None)], "file_id bigint, language string, source string")
    regions = search.regions(asked)
    found = search.verify(search.retrieve(regions, search.postings(docs), docs), regions, docs)
    best = {(r.file_id, r.doc_id): r.classification for r in search.best_per_source(found).collect()}
    assert best[10, 1] == "strong_match" and best.get((11, 1)) != "strong_match" and (10, 3) not in best
    assert SearchSettings().shortlist == 20


def test_shortlists_of_hashes_alone_equal_those_of_whole_documents(spark):
    rng = random.Random(5)
    bodies = ["\n".join(f"let {rng.choice('abc')}{k % 9} = call{rng.randrange(4)}({k % 5}, '{rng.choice('xy')}');" for k in range(rng.randrange(1, 30))) for _ in range(14)]
    files = spark.createDataFrame([(i, "python" if i % 5 == 4 else "javascript", b) for i, b in enumerate([*bodies, bodies[0], "", "// c"])], "file_id bigint, language string, source string")
    asked = spark.createDataFrame([(100 + i, "typescript", b + bodies[i + 1]) for i, b in enumerate(bodies[:6])] + [(200, "javascript", None), (201, "python", "x")], "file_id bigint, language string, source string")
    docs, whole = search.documents(files), search.regions(asked)
    stop = corpus.stoplist(search.postings(docs).select("representation", "hash", "doc_id").distinct().groupBy("representation", "hash").agg(F.count("*").alias("clusters")), 9, 7)
    assert stop.count() > 0
    want = rows(search.retrieve(whole, search.postings(docs, stop), docs))
    regions = search.prints(asked, regional=True)
    met = search.seen(regions.select("representation", F.explode("hashes").alias("h")).select("representation", search.unsigned("h").alias("hash")))
    held = search.prints(files, only=met)
    # no token leaves a worker, and of the documents nothing that no region has
    assert not {"preserving", "normalized", "lines"} & set(held.columns)
    assert held.select(F.sum(F.size("hashes"))).first()[0] < search.prints(files).select(F.sum(F.size("hashes"))).first()[0]
    sizes = held.where("representation = 'preserving'").groupBy(language_family("language").alias("family")).agg(F.count("*").alias("total"))
    flat = search.flat(held, met).withColumnRenamed("file_id", "doc_id").drop("region").join(stop, ["representation", "hash"], "left_anti")
    assert want and rows(search.ranked(search.flat(regions, met).drop("first", "last"), flat, sizes).select("file_id", "region", "doc_id", "score", "matched", "common", "rare", "first", "last", "nth")) == want


def test_archives(tmp_path, spark):
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.py", "x = 1\n")
        z.writestr("../b.py", "x")
        z.writestr("c.bin", b"\xff\xfe")
        z.writestr("d.py", "0" * 200_000)
    (tmp_path / "x.zip").write_bytes(zipped.getvalue())
    (tmp_path / "y.zip").write_bytes(b"nothing")
    got = {(r.path, r.reason) for r in archives.read_archives(spark, str(tmp_path / "*.zip"), "zip").collect()}
    assert got == {("a.py", None), ("../b.py", "unsafe_path"), ("c.bin", "not_utf8"), ("d.py", "file_too_large"), (None, "not_a_zip")}
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as t:
        for name, body in (("package/src/a.js", b"a"), ("package/" + "l" * 150 + ".js", b"b")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
        link = tarfile.TarInfo("package/link")
        link.type, link.linkname = tarfile.SYMTYPE, "x"
        t.addfile(link)
    assert [(p, r) for p, _, _, r in archives.tar_entries(packed.getvalue())] == [("src/a.js", None), ("l" * 150 + ".js", None), ("link", "special_file")]
    assert archives.tar_entries(b"?")[0][3] == "invalid_tar"


def test_registries(spark):
    text = spark.createDataFrame([("1. [a](https://www.npmjs.org/package/a)\n2. [b](https://www.npmjs.org/package/b)\n3. [a](https://www.npmjs.org/package/a)",)], "value string")
    assert rows(registries.seed_npm(text, 5)) == [(1, "a"), (2, "b")]
    doc = json.dumps({"name": "a", "dist-tags": {"latest": "2"}, "time": {"created": "2015-01-01T00:00:00Z", "2": "2016-01-01T00:00:00Z"}, "license": "MIT", "repository": {"url": "u"}, "versions": {"2": {"dist": {"tarball": "t", "integrity": "i"}}}})
    r = registries.npm_releases(spark.createDataFrame([(doc,)], "value string")).first()
    assert (r.version, r.license_raw, r.first_published, r.archive_url) == ("2", "MIT", "2015-01-01T00:00:00Z", "t")
    doc = json.dumps({"info": {"name": "p", "version": "1", "license": "", "classifiers": ["License :: OSI Approved :: MIT License"]}, "releases": {"0": [{"upload_time_iso_8601": "2014"}], "1": [{"upload_time_iso_8601": "2015"}]}, "urls": [{"packagetype": "sdist", "url": "s", "digests": {"sha256": "00"}}]})
    r = registries.pypi_releases(spark.createDataFrame([(doc,)], "value string")).first()
    assert (r.license_raw, r.first_published, r.archive_url) == ("License :: OSI Approved :: MIT License", "2014", "s")


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(tables.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(tables.union_first([old, new], "k")) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(history.new_events(new.union(new), old, "k")) == [(3, "d")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert rows(tables.read_ledger(spark, str(tmp_path / "l.jsonl"), "a int")) == [(1,), (2,)]
    tables.write_pack(old.withColumn("source", F.lit("s")), new, new, str(tmp_path / "pack"))
    assert "source" not in spark.read.parquet(str(tmp_path / "pack" / "manifest")).columns


def test_streams(spark, tmp_path):
    data = [(f"{i % 2}", i * 1000, i) for i in range(8)] + [("0", 0, 0)]
    df = spark.createDataFrame(data, "key string, ms bigint, hit_id bigint")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    limited = stream.drain(spark, stream.rate_limited(source(), 2, 60_000), "t1")
    assert limited.where("allowed").count() == 4 and limited.count() == 9
    chained = stream.drain(spark, stream.chained(source().select(F.col("key").alias("stream"), F.col("hit_id").alias("event_id"), F.lit("b").alias("body"))), "t2")
    assert chained.where("previous_hash is null").count() == 2
    timed = source().withColumn("at", F.timestamp_millis(F.col("ms") + 86_400_000))
    assert stream.drain(spark, stream.once(timed, "hit_id", "at"), "t3").count() == 8


def test_the_report_equals_that_of_all_places_compared_as_spelled(spark):
    rng = random.Random(12)
    body = lambda k, n: "\n".join(rng.choice((f"const v{k}x{i} = call{k * i}(source{k}, '{i}');", f"if (a{i} > {i}) {{ b{k}.push(c{i}[{i}]); }}", f"for (const e{i} of list{k}) {{ total{k} += e{i} * {i}; }}")) for i in range(n))
    texts = [body(k, 40) for k in range(24)]
    rename = lambda t: t.replace("v", "w").replace("source", "origin").replace("call", "make")
    docs = [(100 + k, "javascript", t) for k, t in enumerate(texts)] + [(200, "javascript", ""), (201, "python", texts[0])]
    asked = [(k, "test/a.js" if k == 3 else f"src/{k}.js", "javascript", f"{body(60 + k, 8)}\n{(rename(t) if k % 2 else t)[: 400 + 90 * k]}\n// end\n{texts[k - 1][:300]}") for k, t in enumerate(texts[:14])]
    asked += [(50 + k, f"lib/{k}.js", "javascript", body(90 + k, 25)) for k in range(12)] + [(90, "e.js", "javascript", "// nothing")]
    files = spark.createDataFrame(asked, "file_id bigint, path string, language string, source string")
    documents = spark.createDataFrame(docs, "file_id bigint, language string, source string")
    whole, regions = search.documents(documents), search.regions(files)
    shortlist = search.retrieve(regions, search.postings(whole), whole)
    want = search.report(search.best_per_source(search.verify(shortlist, regions, whole)), files, 9).collect()
    found = search.reported(shortlist, search.prints(files, regional=True, plain=True), search.prints(documents, plain=True), files, documents, 9)
    assert {r.classification: r.rank for r in want} == {"strong_match": 2, "possible_common_pattern": 1} and found.collect() == want
    # a place that moves has no spelled tokens
    assert {t for _, t in search.outline(shortlist, search.prints(files, regional=True, plain=True), search.prints(documents, plain=True)).dtypes} == {"bigint", "int", "double"}
