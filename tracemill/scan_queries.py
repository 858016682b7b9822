"""Queries of intake, scans and events, and the SQL that checks them; they join the registry of tracemill.queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import kernels as K
from .constants import PIPELINE
from .functions import arrow as A
from .functions import columns as X
from .operators import provenance, similarity, tracking
from .plans import portable_scan
from .queries import _EDITS, _PIPELINE_TOKENS, _TOKENS, _signals, _sources, query
from .session import table

_KNOWN = r"regexp_matches(path, '(?i)\.(ts|tsx|mts|cts|js|jsx|mjs|cjs|py)$')"
_OUTSIDE = r"regexp_matches(path, '(?i)(^|/)(node_modules|vendor|vendors|dist|build|coverage|\.next|\.nuxt|\.venv|venv|__pycache__|generated|fixtures|snapshots)(/|$)')"
_RULED = "(path = 'docs' OR starts_with(path, 'docs/') OR path = 'src/app' OR starts_with(path, 'src/app/'))"
RULES = ["docs", "src/app"]
MOST_BYTES = 4000


@query(rf"""
SELECT f.id, reason, coalesce(reason IN ('file_too_large', 'binary'), false) AS incomplete FROM (
  SELECT f.id, CASE WHEN {_RULED} THEN 'user_excluded'
    WHEN {_OUTSIDE} OR regexp_matches(path, '(^|/)\.(git|svn|hg)(/|$)') OR regexp_matches(path, '(?i)\.(min|generated)\.[^.]+$') THEN 'excluded_directory'
    WHEN regexp_matches(path, '(?i)\.(zip|tar|gz|tgz|bz2|xz|7z|rar)$') THEN 'nested_archive'
    WHEN NOT {_KNOWN} THEN 'unsupported_type'
    WHEN f.bytes > {MOST_BYTES} THEN 'file_too_large'
    WHEN regexp_matches(b.source, '[\x00-\x08\x0e-\x1f]') THEN 'binary' END AS reason
  FROM scan_files f JOIN blobs b ON b.id = f.blob_id) f
""")
def upload_cascade(spark, folder):
    """Why each file would be left out of an upload, and whether that makes the scan incomplete."""
    files, blobs = table(spark, folder, "scan_files"), table(spark, folder, "blobs").select(F.col("id").alias("blob_id"), "source")
    rows = files.join(blobs, "blob_id").select("id", X.intake_reason("path", "bytes", "source", RULES, MOST_BYTES).alias("reason"))
    return rows.select("id", "reason", X.incomplete("reason").alias("incomplete"))


@query(f"""
SELECT id, CASE WHEN NOT {_KNOWN} THEN 'unsupported_type' WHEN {_RULED} THEN 'user_excluded' WHEN {_OUTSIDE} THEN 'excluded_directory'
  WHEN coalesce(bytes, 0) > {MOST_BYTES} THEN 'file_too_large' END AS reason FROM scan_files
""")
def tree_cascade(spark, folder):
    """Why each entry of a repository tree would be left out."""
    return table(spark, folder, "scan_files").select("id", X.tree_reason("path", "bytes", RULES, MOST_BYTES).alias("reason"))


@query(r"""
SELECT id, regexp_matches(path, '(^|/)(node_modules|dist|build|vendor|\.git|\.next|target|out|coverage|\.venv|venv|__pycache__|\.cache)(/|$)') AS ignored,
  NOT contains(path, '.') OR regexp_matches(lower(path), '\.(js|jsx|mjs|cjs|ts|tsx|py|go|rs|rb|java|c|h|cpp|cc|cs|php|json|md|txt|toml|yaml|yml|lock)$') AS text,
  regexp_matches(lower(path), '\.(js|jsx|mjs|cjs|ts|tsx|mts|cts|py|go|rs|rb|java|c|h|cpp|cc|cs|php|swift|kt)$') AS code
FROM scan_files WHERE path IS NOT NULL
""")
def edge_files(spark, folder):
    """Ignored directories, texts and code as the hosted scan tells them."""
    files = table(spark, folder, "scan_files").where("path is not null")
    return files.select("id", X.ignored_segment("path").alias("ignored"), X.is_text_file("path").alias("text"), X.is_code_file("path").alias("code"))


@query(r"""
WITH r AS (SELECT release_id, list(CASE WHEN id % 50 = 0 THEN path || '*' WHEN id % 3 = 0 THEN regexp_replace(path, '[^/]*$', '') ELSE path END) AS rules FROM scan_files WHERE path IS NOT NULL AND release_id IS NOT NULL GROUP BY 1),
t AS (SELECT release_id, rules, list_transform(rules, lambda x: regexp_replace(x, '/$', '')) AS plain FROM r),
v AS (SELECT release_id, plain, len(rules) <= 100 AND len(list_filter(rules, lambda x: regexp_matches(x, '[*?\[\]{}]'))) = 0
  AND len(list_filter(plain, lambda x: x = '' OR length(x) > 512 OR regexp_matches(x, '[\\:%\x00-\x1f\x7f]') OR regexp_matches(x, '(^|/)(\.{0,2})(/|$)'))) = 0 AS valid FROM t)
SELECT release_id, valid, CASE WHEN valid THEN array_to_string(list_sort(list_distinct(plain)), '|') END AS rules FROM v
""")
def exclusion_rules(spark, folder):
    """Paths and directories of each release taken as exclusion rules, some of them with globs."""
    files = table(spark, folder, "scan_files").where("path is not null and release_id is not null")
    rule = F.when(F.col("id") % 50 == 0, F.concat("path", F.lit("*"))).when(F.col("id") % 3 == 0, F.regexp_replace("path", "[^/]*$", "")).otherwise(F.col("path"))
    rows = files.groupBy("release_id").agg(F.collect_list(rule).alias("rules"))
    rules, valid = X.exclusion_rules("rules")
    return rows.select("release_id", valid.alias("valid"), F.array_join(rules, "|").alias("rules"))


@query(r"""
WITH p AS (SELECT release_id, count(DISTINCT split_part(path, '/', 1)) AS n, min(split_part(path, '/', 1)) AS root FROM scan_files WHERE contains(path, '/') GROUP BY 1)
SELECT r.release_id, CASE WHEN p.n = 1 THEN p.root END AS root FROM (SELECT DISTINCT release_id FROM scan_files WHERE path IS NOT NULL AND release_id IS NOT NULL) r LEFT JOIN p USING (release_id)
""")
def selection_roots(spark, folder):
    """The first directory that all nested files of a release lie in."""
    files = table(spark, folder, "scan_files").where("path is not null and release_id is not null")
    roots = files.groupBy("release_id").agg(F.collect_set(F.concat(F.substring_index("path", "/", 1), F.when(F.contains("path", F.lit("/")), "/x").otherwise(""))).alias("paths"))
    return roots.select("release_id", X.selection_root("paths").alias("root"))


@query(r"""
SELECT id, CASE WHEN regexp_matches(t, '(?i)^https?://') THEN t WHEN regexp_matches(t, '(?i)^github\.com/') THEN 'https://' || t
  WHEN regexp_full_match(t, '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') THEN 'https://github.com/' || t ELSE t END AS address
FROM (SELECT id, regexp_replace(trim(regexp_replace(repository, CASE id % 3 WHEN 0 THEN '^https://' WHEN 1 THEN '^https://github\.com/' ELSE '^$' END, '')), '/+$', '') AS t FROM releases)
""")
def repository_inputs(spark, folder):
    """Repository addresses pasted with and without scheme and host."""
    cut = F.when(F.col("id") % 3 == 0, F.regexp_replace("repository", "^https://", "")).when(F.col("id") % 3 == 1, F.regexp_replace("repository", r"^https://github\.com/", "")).otherwise(F.col("repository"))
    return table(spark, folder, "releases").select("id", X.repository_input(cut).alias("address"))


_COVERED = r"CASE WHEN regexp_matches(lower(path), '\.(ts|tsx|mts|cts)$') THEN 'typescript' WHEN regexp_matches(lower(path), '\.(js|jsx|mjs|cjs)$') THEN 'javascript' WHEN regexp_matches(lower(path), '\.py$') THEN 'python' ELSE 'unknown' END"


@query(f"SELECT count(DISTINCT repository) AS repositories, count(*) AS files, array_to_string(list_sort(list(DISTINCT {_COVERED})), ',') AS languages FROM scan_files")
def index_coverage(spark, folder):
    """What an index of all files would cover."""
    files = table(spark, folder, "scan_files")
    return files.agg(F.count_distinct("repository").alias("repositories"), F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set(X.language("path"))), ",").alias("languages"))


@query("""
WITH b AS (SELECT id, release_id, path, regexp_extract(path, '[^/]*$') AS base FROM scan_files WHERE path IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY release_id, base ORDER BY id) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM b AS o WHERE o.release_id IS NOT DISTINCT FROM b.release_id AND o.path = b.base))
SELECT id, release_id, path AS looked_up_as FROM b UNION ALL SELECT id, release_id, base FROM n WHERE n = 1
""")
def manifest_map(spark, folder):
    """Names under which the files of a release are looked up: full paths, and base names where the first file has them."""
    files = table(spark, folder, "scan_files").where("path is not null").select("id", F.coalesce("release_id", F.lit(-1)).alias("release_id"), "path")
    found = tracking.by_basename(files, ["release_id"], [F.col("id")])
    return found.select("id", F.when(F.col("release_id") >= 0, F.col("release_id")).alias("release_id"), "looked_up_as")


# --- events


_SOURCES = "CASE WHEN signal IN ('ai_assisted_signal', 'bulk_insert_signal') THEN 'ai' WHEN signal IN ('human_signal', 'human_modified_ai') THEN 'human' WHEN signal = 'imported' THEN 'imported' ELSE 'unknown' END"


@query(_EDITS + f"SELECT {_SOURCES} AS source_type, CASE WHEN signal = 'imported' THEN 'external' ELSE 'developer' END AS actor_type, count(*) AS events FROM s GROUP BY 1, 2")
def edit_sources(spark, folder):
    """Edits by who they are put down to."""
    shape = F.col("signal")
    return _signals(spark, folder).groupBy(provenance.source_type(shape).alias("source_type"), provenance.actor_type(shape).alias("actor_type")).agg(F.count("*").alias("events"))


@query("""
WITH c AS (SELECT user_id, date_trunc('hour', ts) AS hour, coalesce(props, '') AS text, CASE WHEN event_type = 'purchase' THEN abs(coalesce(value, 0))::BIGINT ELSE 0 END AS removed FROM events WHERE user_id IS NOT NULL)
SELECT user_id, epoch_us(hour) AS hour, count(*) AS changes, sum(length(text))::BIGINT AS chars, sum(length(text) - length(replace(text, ',', '')))::BIGINT AS lines, sum(removed)::BIGINT AS removed, bool_or(removed > 0 AND length(text) > 0) AS replacement FROM c GROUP BY 1, 2
""")
def folded_edits(spark, folder):
    """The events of a user's hour taken as the changes of one edit; commas stand for line breaks."""
    events = table(spark, folder, "events").where("user_id is not null")
    removed = F.when(F.col("event_type") == "purchase", F.rint(F.abs(F.coalesce("value", F.lit(0.0)))).cast("bigint")).otherwise(0)
    change = F.struct(F.translate(F.coalesce("props", F.lit("")), ",", "\n").alias("text"), removed.alias("removed"))
    rows = events.groupBy("user_id", F.unix_micros(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("hour")).agg(F.collect_list(change).alias("changes"))
    return rows.select("user_id", "hour", F.size("changes").cast("bigint").alias("changes"), provenance.folded_edit("changes").alias("e")).select("user_id", "hour", "changes", "e.*")


@query(r"""
SELECT event_id, sha256(concat('{"actorType":"', CASE WHEN event_type = 'view' THEN 'external' ELSE 'developer' END, '","commitSha":null,"contentHash":"', sha256(coalesce(props, '')),
  '","diffHash":null,"eventTimestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.'), lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0'), 'Z","filePath":"f/', user_id, '.py","metadata":',
  CASE WHEN event_id % 2 = 0 THEN concat('{"a":"', event_type, '","b":"x \"y\""}') ELSE '{}' END,
  ',"ownerId":null,"parentEventId":', CASE WHEN event_id % 3 = 0 THEN concat('"', event_id - 1, '"') ELSE 'null' END, ',"previousEventHash":null,"provider":null,"repositoryId":"', user_id, '","sourceType":"', event_type, '","tool":null}')) AS event_hash
FROM events WHERE user_id IS NOT NULL
""")
def event_hashes(spark, folder):
    """The hash of every event in its full canonical form, unchained."""
    events = table(spark, folder, "events").where("user_id is not null")
    user = F.col("user_id").cast("string")
    fields = {
        "actorType": F.when(F.col("event_type") == "view", "external").otherwise("developer"),
        "contentHash": F.sha2(F.coalesce("props", F.lit("")), 256),
        "eventTimestamp": F.col("ts"),
        "filePath": F.concat(F.lit("f/"), user, F.lit(".py")),
        # the keys come out of order, so that sorting them matters
        "metadata": F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("b"), F.lit('x "y"'), F.lit("a"), F.col("event_type"))),
        "parentEventId": F.when(F.col("event_id") % 3 == 0, F.col("event_id") - 1),
        "repositoryId": user,
        "sourceType": F.col("event_type"),
    }
    return events.select("event_id", F.sha2(provenance.canonical_record(fields, F.lit(None).cast("string")), 256).alias("event_hash"))


# --- scans


_SCANS = """
WITH v AS (
  SELECT project_id, id AS release_id, lead(id) OVER (PARTITION BY project_id ORDER BY coalesce(version_published, TIMESTAMP '1970-01-01'), id) AS next_id FROM releases
), p AS (SELECT release_id, path, min(id) AS id FROM scan_files WHERE path IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, CASE id % 3 WHEN 0 THEN 'license:file:' WHEN 1 THEN 'license:dependency:' ELSE 'similarity:' END || path AS finding_key, CASE WHEN id % 3 = 2 THEN 'structural_similarity' ELSE 'license' END AS type FROM p),
old AS (SELECT v.release_id AS repository_id, k.*, CASE id % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'open' WHEN 2 THEN 'in_review' ELSE 'accepted_risk' END AS status, 'p' || (id % 4) AS provider FROM v JOIN k USING (release_id) WHERE v.next_id IS NOT NULL),
new AS (SELECT v.release_id AS repository_id, k.*, 'p' || (id % 4) AS provider FROM v JOIN k ON k.release_id = v.next_id WHERE k.id % 5 <> 0)
"""


def _scans(spark, folder):
    """Each release taken as a tracked state and its successor as the next scan, with what they found and proved."""
    releases, files = table(spark, folder, "releases"), table(spark, folder, "scan_files")
    order = Window.partitionBy("project_id").orderBy(F.coalesce("version_published", F.lit("1970-01-01").cast("timestamp_ntz")), "id")
    steps = releases.select(F.col("id").alias("repository_id"), F.lead("id").over(order).alias("next_id")).where("next_id is not null")
    paths = files.where("path is not null").groupBy("release_id", "path").agg(F.min("id").alias("id"))
    kind = F.when(F.col("id") % 3 == 2, "structural_similarity").otherwise("license")
    key = F.concat(F.when(F.col("id") % 3 == 0, "license:file:").when(F.col("id") % 3 == 1, "license:dependency:").otherwise("similarity:"), "path")
    found = paths.select("release_id", "id", "path", kind.alias("type"), key.alias("finding_key"), F.concat(F.lit("p"), (F.col("id") % 4).cast("string")).alias("provider_id"))
    status = F.element_at(F.array(F.lit("resolved"), F.lit("open"), F.lit("in_review"), F.lit("accepted_risk")), (F.col("id") % 4 + 1).cast("int"))
    old = steps.join(found.withColumnRenamed("release_id", "repository_id"), "repository_id")
    tracked = old.select("repository_id", "finding_key", "type", "provider_id", F.lit("t").alias("title"), F.col("path").alias("file_path"), F.lit("review").alias("severity"), F.lit("review_suggested").alias("band"), status.alias("status"), (F.col("id") % 2 == 1).alias("remediation_pending"), F.lit(0).cast("bigint").alias("last_seen_scan_id"))
    new = steps.join(found.withColumnRenamed("release_id", "next_id"), "next_id")
    findings = new.select(F.col("next_id").alias("scan_id"), "finding_key", "type", "provider_id", F.lit("u").alias("title"), F.col("path").alias("file_path"), F.when(F.col("id") % 5 == 0, "info").when(F.col("id") % 7 == 0, "blocking").otherwise("review").alias("severity"), F.lit("strong_match").alias("band"), F.lit(None).cast("timestamp").alias("created_at"))
    listed = lambda m: F.collect_list(F.when(F.col("id") % m == 0, F.col("path")))
    proof = old.groupBy("repository_id").agg(listed(2).alias("checked_paths"), listed(7).alias("ingested_paths"), listed(11).alias("missing_paths"))
    scans = steps.join(proof, "repository_id", "left").select(
        "repository_id", F.col("next_id").alias("scan_id"), F.array(F.lit("license"), F.lit("structural_similarity")).alias("evaluated_types"), F.array(F.lit("p0"), F.lit("p2")).alias("providers_run"),
        "checked_paths", "ingested_paths", "missing_paths", (F.col("repository_id") % 2 == 0).alias("manifests_checked"), (F.col("repository_id") % 7 == 0).alias("truncated"),
    )
    return tracked, scans, findings


@query(
    _SCANS
    + """
SELECT repository_id, finding_key, action, from_status, CASE WHEN action IN ('detected', 'reopened') THEN 'open' WHEN action = 'resolved' THEN 'resolved' ELSE from_status END AS to_status, severity FROM (
  SELECT coalesce(o.repository_id, n.repository_id) AS repository_id, coalesce(o.finding_key, n.finding_key) AS finding_key, o.status AS from_status, CASE WHEN n.id IS NULL THEN 'review' WHEN n.id % 7 = 0 THEN 'blocking' ELSE 'review' END AS severity,
    CASE WHEN o.id IS NULL THEN 'detected' WHEN n.id IS NOT NULL THEN CASE WHEN o.status = 'resolved' THEN 'reopened' WHEN o.status IN ('open', 'in_review') AND o.id % 2 = 1 THEN 'still_detected' ELSE 'seen' END
      WHEN o.status IN ('open', 'in_review') AND o.repository_id % 7 <> 0 AND (
        EXISTS (SELECT 1 FROM old x WHERE x.repository_id = o.repository_id AND x.path = o.path AND x.id % 11 = 0)
        OR o.type = 'structural_similarity' AND o.id % 2 = 0 AND o.provider IN ('p0', 'p2')
        OR o.finding_key LIKE 'license:dependency:%' AND o.repository_id % 2 = 0
        OR o.finding_key LIKE 'license:file:%' AND o.id % 7 = 0) THEN 'resolved' ELSE 'kept' END AS action
  FROM old o FULL JOIN new n ON o.repository_id = n.repository_id AND o.finding_key = n.finding_key)
"""
)
def scan_reconciliation(spark, folder):
    """What each next scan does to the findings tracked so far."""
    return tracking.reconcile_scans(*_scans(spark, folder)).select("repository_id", "finding_key", "action", "from_status", "to_status", "severity")


@query(
    _SCANS
    + """
SELECT repository_id, count_if(r = 'resolved') AS resolved, count_if(r = 'unverified') AS unverified FROM (
  SELECT o.repository_id, CASE WHEN o.id % 2 = 0 OR (o.repository_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM v JOIN p ON p.release_id = v.next_id WHERE v.release_id = o.repository_id AND p.path = o.path)) THEN 'resolved' ELSE 'unverified' END AS r
  FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.repository_id = o.repository_id AND n.finding_key = o.finding_key)) GROUP BY 1
"""
)
def rescan_resolutions(spark, folder):
    """Findings that the next scan lacks, and whether it proves that they are gone."""
    tracked, scans, findings = _scans(spark, folder)
    following = findings.where("severity <> 'info'").join(scans.select("scan_id", "repository_id"), "scan_id").select("repository_id", F.col("finding_key").alias("finding_id"))
    tree = findings.join(scans.select("scan_id", "repository_id"), "scan_id").select("repository_id", F.col("file_path").alias("path"))
    previous = tracked.select("repository_id", F.col("finding_key").alias("finding_id"), F.col("file_path").alias("path"))
    checked = scans.select("repository_id", F.explode(F.array_compact("checked_paths")).alias("path"))
    found = tracking.rescan_resolution(previous, following, checked, tree, scans.where(F.col("repository_id") % 3 != 0), ["repository_id"])
    return found.groupBy("repository_id").agg(F.count_if(F.col("state") == "resolved").alias("resolved"), F.count_if(F.col("state") == "unverified").alias("unverified"))


_PORTABLE = (
    _TOKENS[: _TOKENS.index("), w AS")]
    + f"""
), every AS (
  SELECT 'd' AS side, id, source, lang FROM s UNION ALL
  SELECT 'q', arrival_id, source, {_COVERED} FROM arrivals WHERE source IS NOT NULL AND {_COVERED} <> 'unknown'
), w AS (
  SELECT side, id, lang, list_filter(regexp_extract_all(source, '{_PIPELINE_TOKENS}'), lambda x: x[1] <> '#' AND x[1:2] NOT IN ('//', '/*')) AS t FROM every
), k AS (
  SELECT side, id, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^["''`0-9]') THEN 'LIT' WHEN NOT regexp_matches(x, '^[A-Za-z_$]') THEN x
    WHEN lang = 'python' AND list_contains({sorted(K.KEYWORDS["pipeline"]["python"])}, x) OR lang = 'javascript' AND list_contains({sorted(K.KEYWORDS["pipeline"]["javascript"])}, x)
      OR lang = 'typescript' AND list_contains({sorted(K.KEYWORDS["pipeline"]["typescript"])}, x) THEN 'kw:' || x ELSE 'ID' END) AS kinds FROM w
), g AS (
  SELECT side, id, i, array_to_string(kinds[i:i + 4], chr(1)) || chr(1) AS gram FROM k, unnest(range(1, len(kinds) - 3)) AS u(i) WHERE len(kinds) >= 5
), f AS (
  SELECT gram, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(gram, ''), lambda x: unicode(x)::BIGINT)), lambda h, u: xor(h, u) * 16777619 % 4294967296) AS hash FROM (SELECT DISTINCT gram FROM g)
), h AS (SELECT side, id, list(hash ORDER BY i) AS h FROM g JOIN f USING (gram) GROUP BY 1, 2),
prints AS (SELECT DISTINCT side, id, list_min(h[s:s + 3]) AS hash FROM h, unnest(range(1, greatest(len(h) - 3, 1) + 1)) AS u(s)),
sizes AS (SELECT id, count(*) AS n FROM prints WHERE side = 'd' GROUP BY 1),
shared AS (SELECT q.id AS probe_id, d.id AS doc_id, count(*) AS shared FROM prints q JOIN prints d USING (hash) WHERE q.side = 'q' AND d.side = 'd' GROUP BY 1, 2),
scored AS (SELECT probe_id, doc_id, shared, shared / n AS containment, CASE doc_id % 3 WHEN 0 THEN 'CLEAR' WHEN 1 THEN 'BLOCKING' ELSE 'UNKNOWN' END AS policy FROM shared JOIN sizes ON id = doc_id WHERE shared / n >= 0.55),
banded AS (SELECT *, CASE WHEN doc_id % 10 = 0 AND policy = 'CLEAR' THEN 'common_pattern' WHEN containment >= 0.85 THEN 'strong_match' ELSE 'review_suggested' END AS band FROM scored),
matched AS (SELECT *, CASE WHEN band = 'common_pattern' THEN 'info' WHEN band = 'strong_match' AND policy = 'BLOCKING' THEN 'blocking' ELSE 'review' END AS severity FROM banded)
"""
)


def _portable(spark, folder):
    """The arrivals scanned against the blobs by the portable pipeline; a third of the blobs each is clear, blocking and of no licence."""
    files = table(spark, folder, "arrivals").where("source is not null").select(F.col("arrival_id").alias("file_id"), "path", F.col("source").alias("content"))
    prints = _sources(spark, folder).select(F.col("file_id").alias("doc_id"), A.hash_sets(F.col("source"), F.col("language"), PIPELINE).alias("hashes"))
    license = F.when(F.col("doc_id") % 3 == 0, "MIT").when(F.col("doc_id") % 3 == 1, "GPL-3.0")
    entries = table(spark, folder, "blobs").select(F.col("id").alias("doc_id")).select("doc_id", F.concat(F.lit("blob "), "doc_id").alias("title"), license.alias("license"), (F.col("doc_id") % 10 == 0).alias("idiom"))
    return portable_scan.run(files, prints, entries)


@query(_PORTABLE + "SELECT probe_id, doc_id, shared, round(containment, 6) AS containment, band, severity FROM matched")
def portable_matches(spark, folder):
    """Matches of the arrivals among the blobs, with band and severity."""
    return _portable(spark, folder).matches.select("probe_id", "doc_id", "shared", F.round("containment", 6).alias("containment"), "band", "severity")


@query(
    _PORTABLE
    + """, top AS (SELECT probe_id, max(CASE band WHEN 'strong_match' THEN 3 WHEN 'review_suggested' THEN 2 ELSE 1 END) AS rank FROM matched GROUP BY 1)
SELECT CASE rank WHEN 3 THEN 'strong_match' WHEN 2 THEN 'review_suggested' ELSE 'common_pattern' END AS band, count(*) AS files FROM top GROUP BY 1
"""
)
def portable_bands(spark, folder):
    """Files by their strongest band."""
    return similarity.strongest_counts(_portable(spark, folder).best)


@query(
    _PORTABLE
    + """, ranked AS (
  SELECT a.path, m.doc_id, m.severity, row_number() OVER (PARTITION BY m.severity = 'info' ORDER BY CASE m.severity WHEN 'blocking' THEN 0 WHEN 'review' THEN 1 ELSE 2 END, round(m.containment, 3) DESC, concat_ws(':', 'similarity', a.path, m.doc_id)) AS n
  FROM matched m JOIN arrivals a ON a.arrival_id = m.probe_id)
SELECT severity, count(*) AS findings FROM ranked WHERE n <= CASE WHEN severity = 'info' THEN 40 ELSE 200 END GROUP BY 1
"""
)
def portable_severities(spark, folder):
    """Findings of the report by severity, after the caps."""
    return _portable(spark, folder).findings.groupBy("severity").agg(F.count("*").alias("findings"))
