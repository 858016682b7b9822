"""Registry of the core queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import constants as C
from . import kernels as K
from .constants import PIPELINE
from .functions import arrow as A
from .functions import columns as X
from .operators import corpus, history, license, provenance, search, similarity
from .session import materialise, release, table
from .streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "shape_clusters"

IS_CODE = "coalesce(lower(trim(language)) <> 'text', true)"


def query(sql: str | None = None):
    """Registers a query under its name, with the SQL that checks it."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def _tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, n) for n in names]


def _spelled(language: str):
    """python, typescript or javascript; null for null."""
    low = F.lower(F.trim(language))
    return F.when(low.isin("py", "python"), "python").when(low.isin("ts", "typescript"), "typescript").when(low.isNotNull(), "javascript")


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, language, source) of the code blobs, the language in its usual spelling; where it is null, the extension of a path tells it."""
    name = _spelled("language")
    code = table(spark, folder, "blobs").where(F.expr(IS_CODE) & F.col("source").isNotNull()).select(F.col("id").alias("file_id"), name.alias("language"), "source")
    unnamed = code.where("language is null")
    seen = table(spark, folder, "scan_files").select(F.col("blob_id").alias("file_id"), X.language("path").alias("told")).where("told <> 'unknown'").join(unnamed.select("file_id"), "file_id", "left_semi")
    # of several paths the most frequent language counts, then the alphabetically first
    told = seen.groupBy("file_id", "told").agg(F.count("*").alias("n")).groupBy("file_id").agg(F.max_by("told", F.struct("n", -F.ascii("told"))).alias("told"))
    # sources whose language is named are not moved
    named = unnamed.join(told, "file_id", "left").select("file_id", F.coalesce("told", F.lit("javascript")).alias("language"), "source")
    return code.where("language is not null").unionByName(named)


def _occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.occurrences(*_tables(spark, folder, "blobs", "scan_files", "releases", "projects"))


# --- duplicates and frequencies


@query("""
SELECT h AS exact_hash, count(*) AS blobs, min(id) AS first_id FROM (
  SELECT id, sha256(regexp_replace(regexp_replace(source, '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g')) AS h FROM blobs WHERE source IS NOT NULL
) GROUP BY h
""")
def exact_clusters(spark, folder):
    """Blobs of one cleaned source."""
    blobs = table(spark, folder, "blobs").where("source is not null").select("id", X.exact_hash("source").alias("exact_hash"))
    return blobs.groupBy("exact_hash").agg(F.count("*").alias("blobs"), F.min("id").alias("first_id"))


_OCCURRENCES = """
WITH o AS (
  SELECT f.id AS file_id, f.path, b.id AS blob_id, b.shape_hash, b.language, r.project_id, r.version, r.license_spdx, r.first_published, p.ecosystem, p.name, p.rank, p.downloads
  FROM scan_files f JOIN blobs b ON b.id = f.blob_id JOIN releases r ON r.id = f.release_id JOIN projects p ON p.id = r.project_id
)
"""


@query(_OCCURRENCES + "SELECT shape_hash, count(*) AS occurrences, count(DISTINCT project_id) AS project_count FROM o WHERE shape_hash IS NOT NULL GROUP BY 1")
def shape_clusters(spark, folder):
    """Files of one shape, and the projects that hold it."""
    return corpus.clusters(_occurrences(spark, folder), "shape_hash")


_FREQUENCY = """
WITH prints AS (
  SELECT DISTINCT b.shape_hash AS cluster, x.hash AS hash FROM fingerprints f JOIN blobs b ON b.id = f.blob_id, unnest(f.fp_preserving) AS u(x) WHERE b.shape_hash IS NOT NULL
), held AS (
  SELECT DISTINCT b.shape_hash AS cluster, r.project_id FROM scan_files f JOIN blobs b ON b.id = f.blob_id JOIN releases r ON r.id = f.release_id WHERE b.shape_hash IS NOT NULL
), frequency AS (
  SELECT p.hash, count(DISTINCT p.cluster) AS clusters, count(DISTINCT h.project_id) AS projects
  FROM prints p LEFT JOIN held h USING (cluster) GROUP BY 1 HAVING count(DISTINCT p.cluster) >= 2
)
"""


def _frequency(spark, folder):
    blobs, files, releases, prints = _tables(spark, folder, "blobs", "scan_files", "releases", "fingerprints")
    shapes = blobs.where("shape_hash is not null").select(F.col("id").alias("blob_id"), F.col("shape_hash").alias("cluster"))
    hashes = prints.join(shapes, "blob_id").select("cluster", F.explode("fp_preserving.hash").alias("hash"))
    held = files.select("blob_id", F.col("release_id").alias("id")).distinct().join(releases.select("id", "project_id"), "id").join(shapes, "blob_id").select("cluster", "project_id")
    return corpus.document_frequency(hashes, held)


@query(_FREQUENCY + "SELECT hash, clusters, projects FROM frequency")
def fingerprint_frequency(spark, folder):
    """Clusters and projects that hold each fingerprint, from two clusters up."""
    return _frequency(spark, folder)


@query(_FREQUENCY + "SELECT 'preserving' AS representation, hash FROM frequency WHERE clusters >= 30")
def stoplist(spark, folder):
    """Fingerprints too common to tell anything."""
    return corpus.stoplist(_frequency(spark, folder).withColumn("representation", F.lit("preserving")))


_RANKED = (
    _OCCURRENCES
    + rf"""
, base AS (
  SELECT *, lower(path) AS p, regexp_replace(lower(name), '^@[^/]+/', '') AS pkg, string_split(lower(path), '/') AS seg,
    try_cast(CASE WHEN regexp_full_match(first_published, '\d{{4}}-\d{{2}}-\d{{2}}.*') THEN first_published END AS TIMESTAMPTZ) AS published,
    greatest(coalesce(downloads, 0), 0) AS dl
  FROM o WHERE shape_hash IS NOT NULL
), v AS (
  SELECT DISTINCT a.file_id FROM base a, unnest(a.seg[:-2]) AS d(s)
  JOIN (SELECT DISTINCT shape_hash, name, pkg FROM base) n ON n.shape_hash = a.shape_hash AND n.pkg = d.s WHERE n.name <> a.name
), f AS (
  SELECT b.*,
    1.0 / (1.0 + greatest(CASE WHEN published IS NOT NULL AND min(published) OVER w IS NOT NULL
      THEN (epoch_ms(published) - epoch_ms(min(published) OVER w)) / 86400000.0 ELSE 3650.0 END, 0.0) / 180.0) AS origin,
    log10(1.0 + dl) / log10(1.0 + greatest(max(dl) OVER w, 1)) AS authority,
    (regexp_replace(seg[-1], '\.[a-z]+$', '') IN (pkg, replace(pkg, '-', '_')) OR list_contains(seg, pkg) OR list_contains(seg, replace(pkg, '-', '_'))
      OR (len(list_filter(regexp_split_to_array(pkg, '[^a-z0-9]+'), lambda t: length(t) > 1)) > 0
        AND len(list_filter(regexp_split_to_array(pkg, '[^a-z0-9]+'), lambda t: length(t) > 1 AND NOT contains(p, t))) = 0))::INT AS name_match,
    (regexp_matches(p, '^(src|lib)/') OR len(seg) = 1 OR seg[1] = replace(pkg, '-', '_'))::INT AS primary_source,
    regexp_matches(path, '{C.DERIVED_PATH}')::INT AS derived, regexp_matches(path, '{C.AUXILIARY_PATH}')::INT AS auxiliary,
    (v.file_id IS NOT NULL)::INT AS vendored, coalesce(length(license_spdx) > 0, false)::INT AS license_known
  FROM base b LEFT JOIN v ON v.file_id = b.file_id WINDOW w AS (PARTITION BY shape_hash)
), s AS (
  SELECT *, 2.5 * origin + authority + 1.5 * name_match + 0.8 * primary_source - 2.0 * derived - auxiliary - 3.0 * vendored + 0.3 * license_known AS score FROM f
), ranked AS (
  SELECT *, exp(score - max(score) OVER w) / sum(exp(score - m)) OVER w AS probability
  FROM (SELECT *, max(score) OVER (PARTITION BY shape_hash) AS m FROM s) WINDOW w AS (PARTITION BY shape_hash)
)
"""
)


def _ranked(spark, folder):
    shaped = F.col("first_published").rlike(r"^\d{4}-\d{2}-\d{2}")
    rows = _occurrences(spark, folder).withColumn("downloads", F.greatest(F.coalesce("downloads", F.lit(0)), F.lit(0)))
    return corpus.upstream_rank(rows, F.when(shaped, F.try_to_timestamp("first_published")))


@query(_RANKED + "SELECT file_id, round(score, 6) AS score, round(probability, 6) AS probability, vendored::DOUBLE AS vendored FROM ranked")
def upstream_rank(spark, folder):
    """Score and probability of every occurrence of a shape to be its upstream."""
    return _ranked(spark, folder).select("file_id", F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"), "vendored")


@query(
    _RANKED
    + rf"""
, placed AS (SELECT *, row_number() OVER (PARTITION BY shape_hash ORDER BY score DESC, coalesce(first_published, ''), path, file_id) AS place FROM ranked),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY ecosystem, name ORDER BY path, file_id) AS nth FROM placed
  WHERE place = 1 AND NOT regexp_matches(path, '{C.AUXILIARY_PATH}') AND NOT regexp_matches(path, '{C.DERIVED_PATH}')
)
SELECT concat(ecosystem, ':', name, '@', version, ':', path) AS document_id, file_id, blob_id, path, version, license_spdx, round(probability, 6) AS probability
FROM kept WHERE nth <= 8 ORDER BY rank NULLS LAST, ecosystem, path, file_id LIMIT 1000
"""
)
def corpus_pack(spark, folder):
    """The exported documents: likely upstreams in rank order, eight of a project, the first thousand."""
    return corpus.export_pack(_ranked(spark, folder)).withColumn("probability", F.round("probability", 6))


@query("""
SELECT ecosystem, status, count(*) AS projects, sum(CASE WHEN downloads > 0 THEN downloads ELSE 0 END)::BIGINT AS downloads FROM projects GROUP BY 1, 2
""")
def corpus_statistics(spark, folder):
    """Projects by ecosystem and status."""
    return table(spark, folder, "projects").groupBy("ecosystem", "status").agg(F.count("*").alias("projects"), F.sum(F.when(F.col("downloads") > 0, F.col("downloads")).otherwise(0)).alias("downloads"))


# --- files


_LANGUAGE = "CASE WHEN regexp_matches(lower(path), '\\.(ts|tsx|mts|cts)$') THEN 'typescript' WHEN regexp_matches(lower(path), '\\.(js|jsx|mjs|cjs)$') THEN 'javascript' WHEN regexp_matches(lower(path), '\\.py$') THEN 'python' ELSE 'unknown' END"


@query(f"""
SELECT reason, count(*) AS files FROM (
  SELECT CASE WHEN regexp_matches(f.path, '{C.SKIPPED_PATH}') THEN 'excluded_path'
    WHEN {_LANGUAGE} = 'unknown' THEN 'unsupported_type'
    WHEN strlen(b.source) > 100000 THEN 'too_large'
    WHEN contains(b.source, chr(0)) THEN 'binary'
    WHEN regexp_matches(b.source[:600], '{C.GENERATED_HEAD}') THEN 'generated'
    WHEN list_max(list_transform(string_split(b.source, chr(10)), lambda x: length(x))) > 1000 OR length(b.source) / greatest(len(string_split(b.source, chr(10))), 1) > 250 THEN 'minified'
    ELSE 'kept' END AS reason
  FROM scan_files f JOIN blobs b ON b.id = f.blob_id
) GROUP BY 1
""")
def file_selection(spark, folder):
    """Files that enter the corpus, and the first reason for which others do not."""
    files, blobs = _tables(spark, folder, "scan_files", "blobs")
    return corpus.reason_counts(files.join(blobs.select(F.col("id").alias("blob_id"), "source"), "blob_id").select("path", "source"))


@query(f"""
SELECT {_LANGUAGE} AS language, regexp_matches(path, '{C.AUXILIARY_PATH}') AS auxiliary, regexp_matches(path, '{C.AUXILIARY_SCAN_PATH}') AS auxiliary_scan,
  regexp_matches(path, '{C.DERIVED_PATH}') AS derived, list_has_any(string_split(lower(path), '/'), {C.EXCLUDED_SEGMENTS}) AS excluded, count(*) AS files
FROM scan_files GROUP BY 1, 2, 3, 4, 5
""")
def path_classes(spark, folder):
    """Files by what their paths say."""
    files = table(spark, folder, "scan_files")
    keys = [X.language("path").alias("language"), X.auxiliary("path").alias("auxiliary"), X.auxiliary("path", True).alias("auxiliary_scan"), X.derived("path").alias("derived"), X.in_excluded_directory("path").alias("excluded")]
    return files.groupBy(*keys).agg(F.count("*").alias("files"))


@query("""
SELECT id, path FROM scan_files
WHERE NOT (path = 'src' OR starts_with(path, 'src/') OR path = 'docs/snippets' OR starts_with(path, 'docs/snippets/') OR path = 'app' OR starts_with(path, 'app/'))
""")
def user_exclusions(spark, folder):
    """Files outside the excluded files and directories."""
    return table(spark, folder, "scan_files").where(~X.excluded_by("path", ["src", "docs/snippets", "app"])).select("id", "path")


@query(r"""
SELECT id, length(path) > 0 AND length(path) <= 512 AND NOT regexp_matches(path, '[\\:%\x00-\x1f\x7f]') AND NOT starts_with(path, '/')
  AND len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) = 0 AS safe,
  regexp_replace(path, '^[^/]*/', '') AS inside, nfc_normalize(path) AS normal FROM (SELECT id, CASE WHEN id % 7 = 0 THEN concat('e', chr(769), '/', path) ELSE path END AS path FROM scan_files)
""")
def safe_paths(spark, folder):
    """Which paths are plain and relative, what they are inside their root, and their composed form; some get a decomposed directory."""
    files = table(spark, folder, "scan_files").select("id", F.when(F.col("id") % 7 == 0, F.concat(F.lit("e\u0301/"), "path")).otherwise(F.col("path")).alias("path"))
    return files.select("id", X.safe_path("path").alias("safe"), X.strip_root("path").alias("inside"), A.normal_form(F.col("path")).alias("normal"))


_PRIORITY = f"CASE WHEN regexp_matches(path, '{C.AUXILIARY_SCAN_PATH}') THEN 100 ELSE 0 END + CASE WHEN regexp_matches(path, '(?i)^(src|lib|packages|app|pkg)/') THEN -1 ELSE 0 END + len(string_split(path, '/'))"


@query(f"""
SELECT id, release_id FROM (
  SELECT id, release_id, count(*) OVER w > 8 OR sum(coalesce(bytes, 0)) OVER w > 20000 AS over FROM scan_files
  WINDOW w AS (PARTITION BY release_id ORDER BY {_PRIORITY}, path, id ROWS UNBOUNDED PRECEDING)
) WHERE NOT over
""")
def file_budget(spark, folder):
    """Files of each release up to the first that exceeds eight files or 20,000 bytes, product source first."""
    files = table(spark, folder, "scan_files").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    order = [X.path_priority("path"), F.col("path"), F.col("id")]
    return history.budget_cut(files, ["release_id"], order, "bytes", 8, 20_000).select("id", "release_id")


@query("""
WITH RECURSIVE o AS (
  SELECT id, release_id, coalesce(bytes, 0) AS bytes, row_number() OVER (PARTITION BY release_id ORDER BY path, id) AS n FROM scan_files
), t AS (
  SELECT release_id, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS total, NULL::BIGINT AS id, false AS fits FROM (SELECT DISTINCT release_id FROM o)
  UNION ALL
  SELECT o.release_id, o.n, t.used + (t.used < 8 AND t.total + o.bytes <= 20000)::INT, t.total + CASE WHEN t.used < 8 AND t.total + o.bytes <= 20000 THEN o.bytes ELSE 0 END, o.id, t.used < 8 AND t.total + o.bytes <= 20000
  FROM t JOIN o ON o.release_id = t.release_id AND o.n = t.n + 1
)
SELECT id, release_id FROM t WHERE fits
""")
def upload_budget(spark, folder):
    """Files of each release that fit one after the other into eight files and 20,000 bytes."""
    files = table(spark, folder, "scan_files").select("id", "release_id", "path", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    return history.budget_greedy(files, ["release_id"], ["path", "id"], "bytes", 8, 20_000).select("id", "release_id")


@query(r"""
SELECT id, CASE WHEN repository IS NULL OR trim(repository) = '' THEN 'EMPTY'
    WHEN regexp_matches(trim(repository), '^[a-z]+://[^/]*@') THEN 'CREDENTIALS'
    WHEN n IS NULL THEN 'UNSUPPORTED' END AS error, n AS name
FROM (SELECT *, CASE
    WHEN regexp_full_match(trim(repository), 'https://github\.com/[A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9._-]{1,100}?(\.git)?/?') THEN regexp_replace(trim(repository), '^https://github\.com/(.*?)(\.git)?/?$', '\1')
    WHEN regexp_full_match(trim(repository), '[A-Za-z0-9][A-Za-z0-9-]{0,38}/[A-Za-z0-9._-]{1,100}?(\.git)?') THEN regexp_replace(trim(repository), '(\.git)?$', '') END AS n FROM releases)
""")
def repository_names(spark, folder):
    """Owner and name of each release's repository address, or why there is none."""
    name, error = X.repository_of("repository")
    return table(spark, folder, "releases").select("id", error.alias("error"), name.alias("name"))


# --- licences


_DETECT = "CASE " + " ".join(f"WHEN regexp_matches(source, '{p}') THEN '{n}'" for n, p in license.SIGNATURES) + " ELSE 'Unknown' END"
_POLICY = "CASE " + " ".join(f"WHEN l IN ({', '.join(repr(x) for x in names)}) THEN '{status}'" for status, names in license.POLICY.items()) + " ELSE 'UNKNOWN' END"


@query(f"SELECT id, l AS license, {_POLICY} AS policy FROM (SELECT id, {_DETECT} AS l FROM blobs WHERE source IS NOT NULL AND NOT {IS_CODE})")
def license_texts(spark, folder):
    """The licence whose signature each licence file carries, and its policy."""
    texts = table(spark, folder, "blobs").where("source is not null").where(f"not {IS_CODE}")
    found = license.detect("source")
    return texts.select("id", found.alias("license"), license.policy(found).alias("policy"))


@query(f"""
SELECT release_id, CASE WHEN bool_or(p = 'BLOCKING') THEN 'BLOCKING' WHEN bool_or(p = 'REVIEW') THEN 'REVIEW' WHEN bool_or(p = 'UNKNOWN') AND NOT bool_or(p = 'CLEAR') THEN 'UNKNOWN' ELSE 'CLEAR' END AS policy
FROM (SELECT release_id, {_POLICY} AS p FROM (SELECT f.release_id, {_DETECT} AS l FROM scan_files f JOIN blobs b ON b.id = f.blob_id WHERE f.path IS NOT NULL AND string_split(f.path, '/')[-1] IN ({", ".join(repr(x) for x in license.LICENSE_FILES)}) AND b.source IS NOT NULL))
GROUP BY 1
""")
def license_policy(spark, folder):
    """The worst policy among the licence files of each release."""
    files, blobs = _tables(spark, folder, "scan_files", "blobs")
    texts = files.where(license.is_license_file(F.col("path"))).join(blobs.where("source is not null").select(F.col("id").alias("blob_id"), license.policy(license.detect("source")).alias("status")), "blob_id")
    return texts.groupBy("release_id").agg(license.worst_policy("status").alias("policy"))


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


_ONE_PLAIN = f"""coalesce({_map(license.PLAIN)}[regexp_replace(regexp_replace(lower(trim(regexp_replace(trim(x), '^\\(+|\\)+$', '', 'g'))), '-(only|or-later)$', ''), '\\+$', '')], 'Unknown')"""
_BARE = "trim(CASE WHEN regexp_full_match(trim(x), '\\(.*\\)') THEN trim(x)[2:-2] ELSE trim(x) END)"
_ONE_NAME = f"""coalesce({_map({a: i for i, names in license.REGISTRY.items() for a in names})}[lower({_BARE})], CASE WHEN regexp_full_match({_BARE}, '[A-Za-z0-9.+-]{{1,40}}') THEN {_BARE} END)"""


@query(rf"""
WITH c AS (SELECT id, license_spdx, license_raw, regexp_replace(trim(license_spdx), '^\((.*)\)$', '\1') AS c FROM releases),
p AS (SELECT *, list_transform(regexp_split_to_array(c, '(?i)\sOR\s'), lambda x: {_ONE_PLAIN}) AS options, list_transform(regexp_split_to_array(c, '(?i)\sAND\s'), lambda x: {_ONE_PLAIN}) AS parts FROM c),
plain AS (SELECT id, CASE WHEN c IS NULL OR c = '' THEN 'Unknown'
  WHEN regexp_matches(c, '(?i)\sOR\s') THEN coalesce(list_filter({license.PERMISSIVENESS}, lambda n: list_contains(options, n))[1], 'Unknown')
  WHEN regexp_matches(c, '(?i)\sAND\s') THEN CASE WHEN list_contains(parts, 'Unknown') THEN 'Unknown' ELSE list_filter({license.PERMISSIVENESS}, lambda n: list_contains(parts, n))[-1] END
  ELSE parts[1] END AS plain FROM p),
v AS (SELECT id, n, v, regexp_replace(v, '^License :: (OSI Approved :: )?', '') AS text FROM (SELECT id, 1 AS n, license_spdx AS v FROM releases UNION ALL SELECT id, 2, license_raw FROM releases) WHERE length(v) > 0),
i AS (SELECT id, n, v, text, regexp_replace(text, '^\((.*)\)$', '\1') AS inner_text FROM v),
w AS (SELECT id, n, v, text, list_transform(regexp_split_to_array(inner_text, '\s+(?:OR|AND|WITH)\s+'), lambda x: {_ONE_NAME}) AS ids, regexp_extract_all(inner_text, '\s+(OR|AND|WITH)\s+', 1) AS words, {_ONE_NAME.replace("(x)", "(text)")} AS whole FROM i),
e AS (SELECT id, n, CASE WHEN regexp_matches(v, '(?i)^see license in|^unlicensed$') OR regexp_full_match(text, '(?i)OSI Approved') THEN NULL
  WHEN len(list_filter(ids, lambda x: x IS NULL)) > 0 THEN CASE WHEN length(text) <= 60 THEN whole END
  ELSE array_to_string(list_transform(range(1, len(ids) + 1), lambda k: concat_ws(' ', ids[k], words[k])), ' ') END AS spdx FROM w),
d AS (SELECT id, spdx, min(n) AS n FROM e WHERE spdx IS NOT NULL GROUP BY 1, 2),
j AS (SELECT id, string_agg(spdx, ' OR ' ORDER BY n) AS spdx FROM d GROUP BY 1)
SELECT r.id, r.plain, j.spdx, CASE WHEN j.spdx IS NULL THEN 'unknown'
  WHEN len(list_filter(string_split(j.spdx, ' OR '), lambda alt: len(list_filter(regexp_split_to_array(alt, ' (AND|WITH) '), lambda x: regexp_matches(x, '{license.COPYLEFT}'))) = 0)) = 0 THEN 'copyleft' ELSE 'permissive' END AS family
FROM plain r LEFT JOIN j USING (id)
""")
def license_names(spark, folder):
    """Both normal forms of every release's licence fields."""
    full = license.registry_license(F.array("license_spdx", "license_raw"))
    return table(spark, folder, "releases").select("id", license.plain_license("license_spdx").alias("plain"), full["spdx"].alias("spdx"), full["family"].alias("family"))


@query(r"""
WITH l AS (SELECT project_id, name, max_by(version, (coalesce(version_published, TIMESTAMP '1970-01-01'), r.id)) AS version FROM releases r JOIN projects p ON p.id = r.project_id GROUP BY project_id, name)
SELECT project_id AS scan_id, concat('pkg:npm/', replace(name, '@', '%40'), '@^', version) AS purl FROM l
UNION ALL SELECT project_id, concat('pkg:npm/', replace(name, '@', '%40'), '-dev@1.0.0') FROM l
UNION ALL SELECT project_id, concat('pkg:pypi/', regexp_extract(name, '^[A-Za-z0-9._-]+'), CASE WHEN regexp_matches(version, '^[A-Za-z0-9.]') THEN concat('@', regexp_extract(version, '^[A-Za-z0-9.]+')) ELSE '' END) FROM l WHERE regexp_matches(name, '^[A-Za-z0-9._-]')
""")
def manifest_dependencies(spark, folder):
    """Package addresses of manifests that name each project's latest release, some of them twice."""
    releases, projects = _tables(spark, folder, "releases", "projects")
    latest = corpus.latest_versions(releases.select("project_id", "version", "version_published", "id"), ["project_id"], [F.coalesce("version_published", F.lit("1970-01-01").cast("timestamp_ntz")), F.col("id")])
    named = latest.join(projects.select(F.col("id").alias("project_id"), "name"), "project_id")
    # the same name again, as a development dependency and on a later line: the first counts
    package = F.to_json(F.struct(F.create_map("name", F.concat(F.lit("^"), "version")).alias("dependencies"), F.create_map(F.col("name"), F.lit("0.0.0"), F.concat("name", F.lit("-dev")), F.lit("1.0.0")).alias("devDependencies")))
    lines = F.concat(F.lit("# needs\n"), "name", F.lit("=="), "version", F.lit("\n"), "name", F.lit(">=9 # again\n"))
    manifests = named.select(F.col("project_id").alias("scan_id"), F.explode(F.array(F.struct(F.lit("package.json").alias("path"), package.alias("content")), F.struct(F.lit("requirements.txt").alias("path"), lines.alias("content")))).alias("m")).select("scan_id", "m.*")
    return license.dependencies(manifests).select("scan_id", X.purl("ecosystem", "name", "version").alias("purl"))


@query("""
SELECT project_id AS scan_id, concat('{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"components":[', string_agg(concat('{"type":"library","name":', to_json(name), ',"version":', to_json(version),
  ',"purl":"pkg:', ecosystem, '/', replace(name, '@', '%40'), '@', version, '"}'), ',' ORDER BY r.id), ']}') AS sbom FROM releases r JOIN projects p ON p.id = r.project_id GROUP BY 1
""")
def bill_of_materials(spark, folder):
    """A bill of materials of each project's releases taken as dependencies."""
    releases, projects = _tables(spark, folder, "releases", "projects")
    rows = releases.join(projects.select(F.col("id").alias("project_id"), "ecosystem", "name"), "project_id")
    return license.bill_of_materials(rows.select(F.col("project_id").alias("scan_id"), "ecosystem", "name", "version", F.col("id").alias("nth")))


# --- tokens, fingerprints and search


_QUOTED = r"""\"(?:[^\"\\]|\\.)*\"|''(?:[^''\\]|\\.)*''"""
_SCRIPT_TOKENS = _QUOTED + r"""|`(?:[^`\\]|\\.)*`|\b\d+(?:\.\d+)?\b|//[^\n]*|/\*[\s\S]*?\*/|#?[A-Za-z_$][A-Za-z0-9_$]*|=>|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|\*\*|\.\.\.|[{}()\[\];,.:?=<>+\-*/%&|!^~]"""
_PYTHON_TOKENS = r"""\"\"\"[\s\S]*?\"\"\"|''''''[\s\S]*?''''''|""" + _QUOTED + r"""|\b\d+(?:\.\d+)?\b|#[^\n]*|[A-Za-z_][A-Za-z0-9_]*|==|!=|<=|>=|\*\*|//|:=|\.\.\.|[{}()\[\];,.:?=<>+\-*/%&|!^~]"""
_TOKENS = f"""
WITH told AS (
  SELECT blob_id, first(l ORDER BY n DESC, l) AS l FROM (SELECT blob_id, {_LANGUAGE} AS l, count(*) AS n FROM scan_files GROUP BY 1, 2) WHERE l <> 'unknown' GROUP BY 1
), s AS (
  SELECT b.id, b.source, CASE WHEN b.language IS NULL THEN coalesce(t.l, 'javascript') WHEN lower(trim(b.language)) IN ('py', 'python') THEN 'python' WHEN lower(trim(b.language)) IN ('ts', 'typescript') THEN 'typescript' ELSE 'javascript' END AS lang
  FROM blobs b LEFT JOIN told t ON t.blob_id = b.id WHERE b.source IS NOT NULL AND coalesce(lower(trim(b.language)) <> 'text', true)
), w AS (
  SELECT id, lang, CASE WHEN lang = 'python' THEN list_filter(regexp_extract_all(source, '{_PYTHON_TOKENS}'), lambda x: x[1] <> '#')
    ELSE list_filter(regexp_extract_all(source, '{_SCRIPT_TOKENS}'), lambda x: x[1:2] NOT IN ('//', '/*')) END AS t FROM s
), k AS (
  SELECT id, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^["''`0-9]') THEN 'lit:' || x WHEN NOT regexp_matches(x, '^#?[A-Za-z_$]') THEN x
    WHEN lang = 'python' AND list_contains({sorted(K.KEYWORDS["search"]["python"])}, x) OR lang = 'javascript' AND list_contains({sorted(K.KEYWORDS["search"]["javascript"])}, x)
      OR lang = 'typescript' AND list_contains({sorted(K.KEYWORDS["search"]["typescript"])}, x) THEN 'kw:' || x ELSE 'id:' || x END) AS kept FROM w
)
"""


@query(
    _TOKENS
    + """
SELECT id AS file_id, len(kept) AS tokens, len(list_distinct(kept)) AS kinds, len(list_distinct(list_transform(kept, lambda x: CASE WHEN x[1:4] = 'lit:' THEN 'LIT' WHEN x[1:3] = 'id:' THEN 'ID' ELSE x END))) AS plain_kinds,
  sha256(array_to_string(kept, chr(1))) AS shape FROM k
"""
)
def token_counts(spark, folder):
    """Tokens and distinct kinds of every code blob in both representations."""
    rows = _sources(spark, folder)
    kept, plain = A.kinds(F.col("source"), F.col("language")), A.kinds(F.col("source"), F.col("language"), normalised=True)
    both = rows.select("file_id", kept.alias("kept"), plain.alias("plain"))
    return both.select("file_id", F.size("kept").alias("tokens"), F.size(F.array_distinct("kept")).alias("kinds"), F.size(F.array_distinct("plain")).alias("plain_kinds"), X.shape_hash("kept").alias("shape"))


_PIPELINE_TOKENS = _QUOTED + r"""|`(?:[^`\\]|\\.)*`|\b\d+(?:\.\d+)?\b|//[^\n]*|/\*[\s\S]*?\*/|#[^\n]*|[A-Za-z_$][A-Za-z0-9_$]*|=>|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|\.\.\.|[{}()\[\];,.:?=<>+\-*/%&|!^~]"""


@query(
    _TOKENS[: _TOKENS.index("), w AS")]
    + f"""
), w AS (
  SELECT id, lang, list_filter(regexp_extract_all(source, '{_PIPELINE_TOKENS}'), lambda x: x[1] <> '#' AND x[1:2] NOT IN ('//', '/*')) AS t FROM s
), k AS (
  SELECT id, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '^["''`0-9]') THEN 'LIT' WHEN NOT regexp_matches(x, '^[A-Za-z_$]') THEN x
    WHEN lang = 'python' AND list_contains({sorted(K.KEYWORDS["pipeline"]["python"])}, x) OR lang = 'javascript' AND list_contains({sorted(K.KEYWORDS["pipeline"]["javascript"])}, x)
      OR lang = 'typescript' AND list_contains({sorted(K.KEYWORDS["pipeline"]["typescript"])}, x) THEN 'kw:' || x ELSE 'ID' END) AS kinds FROM w
), g AS (
  SELECT id, i, array_to_string(kinds[i:i + 4], chr(1)) || chr(1) AS gram FROM k, unnest(range(1, len(kinds) - 3)) AS u(i) WHERE len(kinds) >= 5
), f AS (
  SELECT gram, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(gram, ''), lambda x: unicode(x)::BIGINT)), lambda h, u: xor(h, u) * 16777619 % 4294967296) AS hash FROM (SELECT DISTINCT gram FROM g)
), h AS (SELECT id, list(hash ORDER BY i) AS h FROM g JOIN f USING (gram) GROUP BY 1),
x AS (SELECT id, h, s, h[s:s + 3] AS part FROM h, unnest(range(1, greatest(len(h) - 3, 1) + 1)) AS u(s))
SELECT DISTINCT id AS file_id, list_min(part) AS hash, s + len(part) - list_position(list_reverse(part), list_min(part)) - 1 AS position FROM x
"""
)
def pipeline_fingerprints(spark, folder):
    """Winnowed fingerprints of the one-lexer engine (five tokens, windows of four)."""
    kinds = A.kinds(F.col("source"), F.col("language"), "pipeline")
    prints = _sources(spark, folder).select("file_id", A.fingerprints(kinds, PIPELINE).alias("f"))
    return prints.select("file_id", F.explode("f").alias("p")).select("file_id", "p.hash", "p.position")


@query("""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents
), g AS (
  SELECT doc_id, i AS position, md5(array_to_string(t[i + 1:i + 5], ' ')) AS h FROM w, unnest(range(0, len(t) - 4)) AS u(i) WHERE len(t) >= 5
), m AS (
  SELECT doc_id, min({'h': h, 'back': -position}) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS x,
    position, max(position) OVER (PARTITION BY doc_id) AS last FROM g
)
SELECT DISTINCT doc_id, x.h AS hash, -x.back AS position FROM m WHERE position <= greatest(last - 3, 0)
""")
def text_fingerprints(spark, folder):
    """Winnowed five-word shingles of the documents, in one pass without a shuffle."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    rows = table(spark, folder, "documents").select("doc_id", words.alias("t")).where(F.size("t") >= 5)
    found = rows.select("doc_id", F.explode(A.text_fingerprints(F.col("t"), 5, 4)).alias("p"))
    return found.select("doc_id", "p.hash", "p.position")


_CONTAINED = """
WITH f AS (
  SELECT DISTINCT g.blob_id, x.hash FROM fingerprints g, unnest(g.fp_preserving) AS u(x)
),
size AS (SELECT blob_id, count(*) AS n FROM f GROUP BY 1)
"""


@query(
    _CONTAINED
    + """
SELECT a.blob_id AS probe_id, b.blob_id AS doc_id, count(*) AS shared, round(count(*) / any_value(s.n)::DOUBLE, 6) AS containment,
  CASE WHEN count(*) / any_value(s.n)::DOUBLE >= 0.85 THEN 'strong_match' ELSE 'review_suggested' END AS band
FROM f a JOIN f b ON a.hash = b.hash AND a.blob_id <> b.blob_id JOIN size s ON s.blob_id = b.blob_id
GROUP BY 1, 2 HAVING count(*) / any_value(s.n)::DOUBLE >= 0.55
"""
)
def blob_containment(spark, folder):
    """Blobs whose fingerprints another blob holds to 0.55 or more, over all fingerprints."""
    prints = table(spark, folder, "fingerprints").groupBy(F.col("blob_id").alias("id")).agg(F.flatten(F.collect_list("fp_preserving.hash")).alias("hashes"))
    found = similarity.contained(prints, 0.55)
    return found.select("probe_id", "doc_id", "shared", F.round("containment", 6).alias("containment"), similarity.band(F.col("containment"), F.lit(False), F.lit("CLEAR")).alias("band"))


def _search(spark, folder, plain=False):
    """Arrivals searched in the corpus of blobs: arrivals, sources, the shortlists, and the prints of both sides.

    Of the blobs only hashes that a region has are kept; whatever is on the stoplist is left out before anything is moved.
    """
    told = F.when(X.language("path") != "unknown", X.language("path"))
    asked = table(spark, folder, "arrivals").where("source is not null").select(F.col("arrival_id").alias("file_id"), F.coalesce(_spelled("language"), told, F.lit("javascript")).alias("language"), "source", "path")
    sources = _sources(spark, folder)
    regions = materialise(search.prints(asked, regional=True, plain=plain))
    met = search.seen(regions.select("representation", F.explode("hashes").alias("h")).select("representation", search.unsigned("h").alias("hash")))
    docs = materialise(search.prints(sources, only=met, plain=plain))
    frequency = materialise(search.shape_frequency(docs))
    kept = frequency.join(corpus.stoplist(frequency), ["representation", "hash"], "left_anti").select("representation", "hash")
    told_apart = search.seen(kept)
    held = search.flat(docs, told_apart).withColumnRenamed("file_id", "doc_id").join(kept, ["representation", "hash"], "left_semi")
    sizes = docs.where("representation = 'preserving'").groupBy(X.language_family("language").alias("family")).agg(F.count("*").alias("total"))
    return asked, sources, search.ranked(search.flat(regions, told_apart).drop("first", "last"), held.drop("region"), sizes), regions, docs


_SHORTLISTS = (
    _TOKENS.replace(
        """), w AS""",
        """), every AS (
  SELECT 'd' AS side, id, source, lang FROM s UNION ALL
  SELECT 'q', arrival_id, source, CASE WHEN language IS NULL THEN CASE WHEN LANGUAGE_OF_PATH <> 'unknown' THEN LANGUAGE_OF_PATH ELSE 'javascript' END WHEN lower(trim(language)) IN ('py', 'python') THEN 'python' WHEN lower(trim(language)) IN ('ts', 'typescript') THEN 'typescript' ELSE 'javascript' END
  FROM arrivals WHERE source IS NOT NULL
), w AS""".replace("LANGUAGE_OF_PATH", _LANGUAGE),
    )
    .replace("x[1:2] NOT IN ('//', '/*')) END AS t FROM s", "x[1:2] NOT IN ('//', '/*')) END AS t, side FROM every")
    .replace("SELECT id, list_transform(t", "SELECT side, id, CASE lang WHEN 'python' THEN 'python' ELSE 'script' END AS family, list_transform(t")
    + """, spelled AS (
  SELECT side, id, family, 'preserving' AS representation, kept AS kinds FROM k UNION ALL
  SELECT side, id, family, 'normalized', list_transform(kept, lambda x: CASE WHEN x[1:4] = 'lit:' THEN 'LIT' WHEN x[1:3] = 'id:' THEN 'ID' ELSE x END) FROM k
), cut AS (
  SELECT side, id, family, representation, 0 AS region, kinds FROM spelled WHERE side = 'd' UNION ALL
  SELECT side, id, family, representation, n, kinds[begins + 1:begins + 120] FROM (
    SELECT *, unnest(range(0, len(starts))) AS n, unnest(starts) AS begins FROM (
      SELECT *, CASE WHEN len(kinds) <= 120 THEN [0::BIGINT] ELSE list_append(range(0, len(kinds) - 120, 60), len(kinds) - 120) END AS starts FROM spelled WHERE side = 'q' AND len(kinds) > 0))
), g AS (
  SELECT side, id, family, representation, region, i, array_to_string(kinds[i:i + 6], chr(1)) || chr(1) AS gram FROM cut, unnest(range(1, len(kinds) - 5)) AS u(i) WHERE len(kinds) >= 7
), f AS (
  SELECT gram, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(gram, ''), lambda x: unicode(x)::BIGINT)), lambda h, u: xor(h, u) * 16777619 % 4294967296) AS hash FROM (SELECT DISTINCT gram FROM g)
), h AS (SELECT side, id, family, representation, region, list(hash ORDER BY i) AS h FROM g JOIN f USING (gram) GROUP BY ALL),
x AS (SELECT *, h[s:s + 3] AS part FROM h, unnest(range(1, greatest(len(h) - 3, 1) + 1)) AS u(s)),
prints AS (SELECT DISTINCT side, id, family, representation, region, list_min(part) AS hash FROM x),
shapes AS (SELECT id, sha256(array_to_string(kept, chr(1))) AS shape FROM k WHERE side = 'd'),
stop AS (
  SELECT representation, hash FROM (SELECT DISTINCT representation, hash, shape FROM prints JOIN shapes USING (id) WHERE side = 'd')
  GROUP BY 1, 2 HAVING count(*) >= CASE representation WHEN 'preserving' THEN 30 ELSE 8 END
), held AS (SELECT representation, hash, family, id AS doc_id FROM prints WHERE side = 'd' AND NOT EXISTS (SELECT 1 FROM stop WHERE stop.representation = prints.representation AND stop.hash = prints.hash)),
totals AS (SELECT family, count(*) AS total FROM k WHERE side = 'd' GROUP BY 1),
weights AS (
  SELECT representation, hash, family, df / total >= 0.6 AS common, (ln((total + 1.0) / (df + 1.0)) + 1.0) * CASE WHEN df / total >= 0.6 THEN 0.2 ELSE 1.0 END AS weight
  FROM (SELECT representation, hash, family, count(*) AS df FROM held GROUP BY 1, 2, 3) JOIN totals USING (family)
), scored AS (
  SELECT q.id AS file_id, q.region, d.doc_id, round(sum(w.weight), 9) AS score, count(*) AS matched, count_if(w.common) AS common, count_if(q.representation = 'preserving' AND NOT w.common) AS rare
  FROM prints q JOIN weights w USING (representation, hash, family) JOIN held d USING (representation, hash, family) WHERE q.side = 'q' GROUP BY 1, 2, 3
), placed AS (SELECT *, row_number() OVER (PARTITION BY file_id, region ORDER BY score DESC, doc_id) AS nth FROM scored)
"""
)


@query(_SHORTLISTS + "SELECT file_id, region, doc_id, round(score, 6) AS score, matched, common, rare, nth FROM placed WHERE nth <= 20")
def search_shortlists(spark, folder):
    """The twenty best candidates of every region of the arrivals."""
    return _search(spark, folder)[2].select("file_id", "region", "doc_id", F.round("score", 6).alias("score"), "matched", "common", "rare", "nth")


@query()
def search_findings(spark, folder):
    """Verified findings of the arrivals, folded per source and cut for the report."""
    asked, sources, found, regions, docs = _search(spark, folder, plain=True)
    shortlist = materialise(found)
    del found
    release(spark)
    return search.reported(shortlist, regions, docs, asked, sources)


# --- events and history


_EDITS = """
WITH e AS (
  SELECT event_id, user_id, ts, CAST(floor(abs(coalesce(value, 0)) * 10) AS BIGINT) AS chars, CAST(floor(abs(coalesce(value, 0)) / 5) AS BIGINT) AS lines, event_type = 'purchase' AS replacement,
    epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ms FROM events
), s AS (
  SELECT event_id, user_id, ms, CASE
    WHEN lines >= 8 AND ms IS NOT NULL AND ms <= 400 THEN CASE WHEN replacement THEN 'human_modified_ai' ELSE 'ai_assisted_signal' END
    WHEN chars >= 400 AND (ms IS NULL OR ms > 400) THEN 'imported'
    WHEN chars > 0 AND chars <= 40 AND (ms IS NULL OR ms >= 150) THEN CASE WHEN replacement THEN 'human_modified_ai' ELSE 'human_signal' END
    WHEN chars > 40 AND ms IS NOT NULL AND ms < 150 THEN 'ai_assisted_signal' ELSE 'unknown' END AS signal FROM e
)
"""


def _edits(spark, folder):
    """Events taken as edits of one file per user."""
    size = F.abs(F.coalesce("value", F.lit(0.0)))
    return table(spark, folder, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("at"), F.floor(size * 10).cast("bigint").alias("chars"), F.floor(size / 5).cast("bigint").alias("lines"), (F.col("event_type") == "purchase").alias("replacement")
    )


def _signals(spark, folder):
    timed = provenance.elapsed(_edits(spark, folder), ["user_id"], "at", "event_id")
    return timed.withColumn("signal", provenance.signal(F.col("chars"), F.col("lines"), F.col("elapsed_ms"), F.col("replacement")))


@query(_EDITS + "SELECT event_id, ms AS elapsed_ms, signal FROM s")
def edit_signals(spark, folder):
    """The shape of every edit."""
    return _signals(spark, folder).select("event_id", "elapsed_ms", "signal")


@query(_EDITS + f"SELECT n.signal, count(s.event_id) AS events FROM (SELECT unnest({provenance.SIGNALS}) AS signal) n LEFT JOIN s ON s.signal = n.signal GROUP BY 1")
def edit_composition(spark, folder):
    """Edits by shape, absent shapes included."""
    return provenance.composition(_signals(spark, folder))


def _chain(spark, folder):
    fields = {"repositoryId": "user", "contentHash": "digest", "sourceType": "event_type"}
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.col("user_id").cast("string").alias("user"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("digest"), F.col("ts").cast("timestamp").alias("at"))
    chain = provenance.build_chains(events, "user_id", ["at", "event_id"], fields)
    return chain, events


@query(r"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, event_type, sha256(coalesce(props, '')) AS digest, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events WHERE user_id IS NOT NULL
), c AS (
  SELECT user_id, seq, event_id, NULL::VARCHAR AS previous_hash,
    sha256(concat('{"contentHash":"', digest, '","previousEventHash":null,"repositoryId":"', user_id, '","sourceType":"', event_type, '"}')) AS event_hash FROM e WHERE seq = 0
  UNION ALL
  SELECT e.user_id, e.seq, e.event_id, c.event_hash,
    sha256(concat('{"contentHash":"', e.digest, '","previousEventHash":"', c.event_hash, '","repositoryId":"', e.user_id, '","sourceType":"', e.event_type, '"}')) FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1
)
SELECT * FROM c
""")
def hash_chains(spark, folder):
    """The hash chain of every user's events."""
    return _chain(spark, folder)[0].select("user_id", "seq", "event_id", "previous_hash", "event_hash")


_CHAIN = r"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, event_type, sha256(coalesce(props, '')) AS digest, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events WHERE user_id IS NOT NULL
), c AS (
  SELECT user_id, seq, event_id, NULL::VARCHAR AS previous_hash,
    sha256(concat('{"contentHash":"', digest, '","previousEventHash":null,"repositoryId":"', user_id, '","sourceType":"', event_type, '"}')) AS event_hash FROM e WHERE seq = 0
  UNION ALL
  SELECT e.user_id, e.seq, e.event_id, c.event_hash,
    sha256(concat('{"contentHash":"', e.digest, '","previousEventHash":"', c.event_hash, '","repositoryId":"', e.user_id, '","sourceType":"', e.event_type, '"}')) FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1
)
"""


@query(
    _CHAIN
    + r""", d AS (
  SELECT c.user_id, c.event_id, CASE WHEN c.user_id % 5 = 0 AND c.seq IN (1, 2) THEN 3 - c.seq ELSE c.seq END AS seq,
    CASE WHEN c.event_id % 97 = 0 THEN sha256('forged') ELSE e.digest END AS digest, e.event_type,
    CASE WHEN c.event_id % 89 = 0 THEN sha256('elsewhere') ELSE c.previous_hash END AS previous_hash, c.event_hash
  FROM c JOIN e USING (event_id)
), r AS (
  SELECT user_id, seq, previous_hash IS NOT DISTINCT FROM lag(event_hash) OVER (PARTITION BY user_id ORDER BY seq) AND event_hash =
    sha256(concat('{"contentHash":"', digest, '","previousEventHash":', CASE WHEN previous_hash IS NULL THEN 'null' ELSE concat('"', previous_hash, '"') END, ',"repositoryId":"', user_id, '","sourceType":"', event_type, '"}')) AS ok FROM d
)
SELECT user_id, count(*) AS events, bool_and(ok) AS intact, min(CASE WHEN NOT ok THEN seq END) AS first_break FROM r GROUP BY 1
"""
)
def chain_checks(spark, folder):
    """Whether every chain recomputes, link by link, after some contents were forged, some links bent and some events swapped."""
    chain, events = _chain(spark, folder)
    forged = F.when(F.col("event_id") % 97 == 0, F.sha2(F.lit("forged"), 256)).otherwise(F.col("digest"))
    full = chain.join(events.select("event_id", "user", forged.alias("digest"), "event_type"), "event_id")
    full = full.withColumn("previous_hash", F.when(F.col("event_id") % 89 == 0, F.sha2(F.lit("elsewhere"), 256)).otherwise(F.col("previous_hash")))
    full = full.withColumn("seq", F.when((F.col("user_id") % 5 == 0) & F.col("seq").isin(1, 2), 3 - F.col("seq")).otherwise(F.col("seq")))
    body = {"repositoryId": F.col("user"), "contentHash": F.col("digest"), "sourceType": F.col("event_type")}
    recomputed = F.sha2(provenance.canonical_event(body, F.col("previous_hash")), 256)
    found = provenance.verify_chains(full, "user_id", ["seq"], recomputed)
    return found.select("user_id", "events", "intact", F.col("first_break.seq").alias("first_break"))


@query(
    _CHAIN
    + """
SELECT user_id, concat('{"_type":"https://in-toto.io/Statement/v1","subject":[{"name":"', user_id, '","digest":{"sha256":"', max_by(event_hash, seq), '"}}],"predicateType":"https://tracemill.example/provenance/v1","predicate":{"eventCount":',
  count(*), ',"firstEventHash":"', min_by(event_hash, seq), '","lastEventHash":"', max_by(event_hash, seq), '"}}') AS statement FROM c GROUP BY 1
"""
)
def attestations(spark, folder):
    """A statement around the ends of every chain."""
    return provenance.attestation(_chain(spark, folder)[0], "user_id", ["at", "event_id"])


_STEPS = """
WITH v AS (
  SELECT project_id, id AS release_id, lead(id) OVER (PARTITION BY project_id ORDER BY coalesce(version_published, TIMESTAMP '1970-01-01'), id) AS next_id FROM releases
), p AS (SELECT DISTINCT release_id, regexp_replace(path, '^(\\./)+', '') AS path FROM scan_files WHERE path IS NOT NULL),
a AS (SELECT v.release_id, p.path FROM v JOIN p ON p.release_id = v.release_id WHERE v.next_id IS NOT NULL),
b AS (SELECT v.release_id, p.path FROM v JOIN p ON p.release_id = v.next_id)
"""


@query(
    _STEPS
    + """
SELECT release_id, count_if(a IS NULL) AS detected, count_if(a IS NOT NULL AND b IS NOT NULL) AS still_detected, count_if(b IS NULL AND NOT starts_with(a, 'docs/')) AS resolved, count_if(b IS NULL AND starts_with(a, 'docs/')) AS unverified
FROM (SELECT coalesce(a.release_id, b.release_id) AS release_id, a.path AS a, b.path AS b FROM a FULL JOIN b ON a.release_id = b.release_id AND a.path = b.path) GROUP BY 1
"""
)
def release_changes(spark, folder):
    """Paths that each release's successor adds, keeps and drops; documents were not checked again, so their loss is not proven."""
    releases, files = _tables(spark, folder, "releases", "scan_files")
    order = Window.partitionBy("project_id").orderBy(F.coalesce("version_published", F.lit("1970-01-01").cast("timestamp_ntz")), "id")
    steps = releases.select(F.col("id").alias("release_id"), F.lead("id").over(order).alias("next_id")).where("next_id is not null")
    paths = files.where("path is not null").select("release_id", F.regexp_replace("path", r"^(\./)+", "").alias("path")).distinct()
    before = steps.join(paths, "release_id").select("release_id", "path")
    after = steps.join(paths.withColumnRenamed("release_id", "next_id"), "next_id").select("release_id", "path")
    return history.action_counts(history.reconcile(before, after, ["release_id", "path"], ~F.col("path").startswith("docs/")), ["release_id"])


@query("SELECT release_id, path, id FROM (SELECT *, row_number() OVER (PARTITION BY release_id, path ORDER BY ingested_at NULLS FIRST, id) AS n FROM scan_files) WHERE n = 1")
def first_ingestions(spark, folder):
    """The first ingestion of every path of a release."""
    files = table(spark, folder, "scan_files").select("release_id", "path", "id", "ingested_at")
    return history.first_per(files, ["release_id", "path"], [F.col("ingested_at"), F.col("id")]).select("release_id", "path", "id")


@query("SELECT repository, id FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY ingested_at DESC NULLS LAST, id DESC) AS n FROM (SELECT * FROM scan_files ORDER BY ingested_at DESC NULLS LAST, id DESC LIMIT 80)) WHERE n = 1")
def latest_scans(spark, folder):
    """The latest file of each repository among the eighty latest of all."""
    files = table(spark, folder, "scan_files").select("repository", "id", "ingested_at")
    return history.latest_of_recent(files, "repository", [F.col("ingested_at").desc_nulls_last(), F.desc("id")], 80).select("repository", "id")


@query("SELECT repository, id, nth, n > 8 AS truncated FROM (SELECT repository, id, row_number() OVER (PARTITION BY repository ORDER BY path, id) AS nth, count(*) OVER (PARTITION BY repository) AS n FROM scan_files) WHERE nth <= 8")
def capped_files(spark, folder):
    """Eight files of each repository, and whether it has more."""
    files = table(spark, folder, "scan_files").select("repository", "id", "path")
    return history.capped(files, ["repository"], [F.col("path"), F.col("id")], 8).select("repository", "id", F.col("nth").cast("bigint").alias("nth"), "truncated")


@query("SELECT date_trunc('month', ingested_at)::TIMESTAMP AS month, count(*) AS files, count(DISTINCT repository) AS repositories FROM scan_files GROUP BY 1")
def monthly_ingestions(spark, folder):
    """Files and repositories by month."""
    files = table(spark, folder, "scan_files").select(X.month_start("ingested_at").cast("timestamp_ntz").alias("month"), "repository")
    return files.groupBy("month").agg(F.count("*").alias("files"), F.count_distinct("repository").alias("repositories"))


_LIMITS = """
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events WHERE user_id IS NOT NULL
), t AS (
  SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS ms, []::BIGINT[] AS held, false AS allowed, 0::BIGINT AS retry_after_ms FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, n, event_id, ms, CASE WHEN len(h) < 3 THEN list_append(h, ms) ELSE h END, len(h) < 3, CASE WHEN len(h) < 3 THEN 0 ELSE h[1] + 60000 - ms END
  FROM (SELECT e.user_id, e.n, e.event_id, e.ms, list_filter(t.held, lambda x: x > e.ms - 60000) AS h FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1)
)
"""


@query(_LIMITS + "SELECT user_id, ms, event_id, allowed, retry_after_ms FROM t WHERE n > 0")
def rate_limits(spark, folder):
    """Events that pass a limit of three per user and minute."""
    events = table(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"), "event_id")
    return history.rate_limited(events, "user_id", "at", "event_id", 3, 60_000)


@query("SELECT user_id, count(*) AS n, md5(array_to_string(list_sort(list(event_id::VARCHAR)), chr(10))) AS digest FROM events GROUP BY 1")
def content_digests(spark, folder):
    """One digest over the sorted members of each group."""
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.col("event_id").cast("string"))).alias("ids"))
    return rows.select("user_id", "n", F.md5(F.array_join("ids", "\n")).alias("digest"))


@query("""
WITH r AS (SELECT DISTINCT f.blob_id, x.position // 6 + 1 AS a, (x.position + 4) // 6 + 1 AS b FROM fingerprints f, unnest(f.fp_preserving) AS u(x)),
m AS (SELECT *, max(b) OVER (PARTITION BY blob_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY blob_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
i AS (SELECT blob_id, island, min(a) AS a, max(b) AS b FROM g GROUP BY 1, 2)
SELECT blob_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE concat(a, '–', b) END, ', ' ORDER BY a) AS ranges FROM i GROUP BY 1
""")
def merged_ranges(spark, folder):
    """The lines that a blob's fingerprints cover, at six tokens a line, merged with a gap of one."""
    at = F.col("p.position")
    r = F.struct((F.floor(at / 6) + 1).cast("int").alias("start"), (F.floor((at + 4) / 6) + 1).cast("int").alias("end"))
    rows = table(spark, folder, "fingerprints").select("blob_id", F.explode("fp_preserving").alias("p")).groupBy("blob_id").agg(F.collect_set(r).alias("r"))
    return rows.select("blob_id", X.format_ranges(X.merge_ranges("r", 1)).alias("ranges"))


# --- streams


@query("SELECT event_id FROM events")
def stream_once(spark, folder):
    """Events of a stream that delivers every third of them again, a while later; each comes out once."""
    rows = stream.table_stream(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    again = stream.table_stream(spark, folder, "events").where("event_id % 3 = 0").select("event_id", (F.col("ts").cast("timestamp") + F.expr("interval 5 minutes")).alias("ts"))
    return stream.drain(spark, stream.once(rows.unionByName(again), "event_id", "ts", "1 day"), "once").select("event_id")


@query(_EDITS + "SELECT event_id, ms AS elapsed_ms, signal FROM s")
def stream_edits(spark, folder):
    """The shape of every edit of a stream."""
    size = F.abs(F.coalesce("value", F.lit(0.0)))
    rows = stream.table_stream(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("file"), F.col("ts").cast("timestamp").alias("at"), "event_id", F.floor(size * 10).cast("bigint").alias("chars"), F.floor(size / 5).cast("bigint").alias("lines"), (F.col("event_type") == "purchase").alias("replacement")
    )
    return stream.drain(spark, stream.classified_edits(rows, "3650 days"), "edits").select("event_id", "elapsed_ms", "signal")


@query(r"""
WITH RECURSIVE e AS (
  SELECT user_id::VARCHAR AS stream, event_id, to_json(coalesce(props, ''))::VARCHAR AS body, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events
), c AS (
  SELECT stream, seq, event_id, NULL::VARCHAR AS previous_hash, sha256(concat('{"body":', body, ',"previousEventHash":null}')) AS event_hash FROM e WHERE seq = 0
  UNION ALL
  SELECT e.stream, e.seq, e.event_id, c.event_hash, sha256(concat('{"body":', e.body, ',"previousEventHash":"', c.event_hash, '"}')) FROM c JOIN e ON e.stream = c.stream AND e.seq = c.seq + 1
)
SELECT * FROM c
""")
def stream_chains(spark, folder):
    """Hash chains over a stream."""
    rows = stream.table_stream(spark, folder, "events").select(F.col("user_id").cast("string").alias("stream"), "event_id", F.coalesce("props", F.lit("")).alias("body"))
    return stream.drain(spark, stream.chained(rows), "chains")


@query(_LIMITS + "SELECT user_id::VARCHAR AS key, ms, event_id AS hit_id, allowed FROM t WHERE n > 0")
def stream_rate_limits(spark, folder):
    """The rate limit over a stream."""
    rows = stream.table_stream(spark, folder, "events").select(F.col("user_id").cast("string").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("hit_id"))
    return stream.drain(spark, stream.rate_limited(rows, 3, 60_000), "limits")
