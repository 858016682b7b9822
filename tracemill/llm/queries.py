"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .arrivals import repeats
from .corpus import code_blobs
from .handwritten import code_files, contained, line_sets, not_handwritten
from .leakage import leaks
from .licenses import findings, licenses
from .near_duplicates import near_duplicates
from .packing import pack, token_counts
from .shared_spans import shared_spans
from .survivorship import shape_origins_of
from .syntax import rates, verdicts, with_language
from .truncation import source_rates, truncated

CODE_SIMILARITY = 0.6
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _licenses(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return licenses(*(table(spark, folder, name) for name in ("blobs", "scan_files", "releases")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return findings(*_licenses(spark, folder))


def p5_files(spark: SparkSession, folder: str) -> DataFrame:
    """The licences of every code file: its own, with their coverage and altered tokens, or else those of its release."""
    own, release = F.col("own"), F.col("release")
    applies = F.when(F.size(own) > 0, own).otherwise(release)
    return _licenses(spark, folder)[1].select("id", F.array_join(applies, " OR ").alias("licenses"), (F.size(own) > 0).alias("own_statement"), "coverage", F.array_join("alterations", " ").alias("altered"), "finding")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = near_duplicates(code_blobs(spark, folder), "id", "source", CODE_SIMILARITY).pairs()
    return pairs.select(F.col("a").alias("blob_id_a"), F.col("b").alias("blob_id_b"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per code blob with its class and the number of its links."""
    classes = near_duplicates(code_blobs(spark, folder), "id", "source", CODE_SIMILARITY).classes()
    return classes.select(F.col("id").alias("blob_id"), "class_id", "links")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = shape_origins_of(spark, folder).where("origin_project_id is not null")
    return found.select("shape_hash", "origin_project_id", "top_project_id")


def p1_merged(spark: SparkSession, folder: str) -> DataFrame:
    """The merged record of every shape that two or more projects hold."""
    rows = shape_origins_of(spark, folder)
    return rows.select("shape_hash", "projects", "origin_project_id", F.unix_micros("origin_at").alias("origin_micros"), "top_project_id", "downloads")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = shared_spans(code_blobs(spark, folder), "id", "source", 240).pairs()
    return pairs.select(F.col("a").alias("blob_id_a"), F.col("b").alias("blob_id_b"))


def p2_shared(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each code blob stands in another one too."""
    found = shared_spans(code_blobs(spark, folder), "id", "source", 240).coverage()
    return found.select(F.col("id").alias("blob_id"), "chars", "shared_chars", F.round("share", 6).alias("share"))


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(with_language(table(spark, folder, "blobs"), table(spark, folder, "scan_files")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder).where("verdict in ('failed', 'truncated')").select(F.col("id").alias("blob_id"))


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the files of each repository and language that do not parse."""
    return rates(_verdicts(spark, folder), table(spark, folder, "scan_files"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeats(code_blobs(spark, folder), table(spark, folder, "arrivals"), CODE_SIMILARITY).select("arrival_id", "kind")


def p4_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Repeats of each batch by kind."""
    arrivals = table(spark, folder, "arrivals")
    found = repeats(code_blobs(spark, folder), arrivals, CODE_SIMILARITY)
    kinds = arrivals.join(found, "arrival_id", "left").groupBy("batch_no")
    return kinds.agg(F.count("*").alias("files"), F.count_if(F.col("kind") == "exact").alias("exact"), F.count_if(F.col("kind") == "near").alias("near"))


def _not_handwritten(spark: SparkSession, folder: str) -> DataFrame:
    return not_handwritten(*(table(spark, folder, name) for name in ("blobs", "scan_files", "releases", "projects")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _not_handwritten(spark, folder).where("size(reasons) > 0").select("file_id")


def p7_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Code files by the set of reasons they are not written by hand for."""
    return _not_handwritten(spark, folder).groupBy(F.concat_ws("+", "reasons").alias("reasons")).agg(F.count("*").alias("files"))


def p7_contained(spark: SparkSession, folder: str) -> DataFrame:
    """The projects that hold four fifths of the lines of a code blob, or the blob itself."""
    rows, known, names = code_files(*(table(spark, folder, name) for name in ("blobs", "scan_files", "releases", "projects")))
    found = contained(line_sets(known), rows.where("project is not null").select("blob_id", "project"))
    return found.join(names, "project").select("blob_id", F.col("name").alias("project"), F.round("share", 6).alias("share"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document assigned to a container of each capacity."""
    sizes = token_counts(table(spark, folder, "documents"), "doc_id", "text", VOCABULARY)
    containers = table(spark, folder, "containers").select("container", F.col("capacity_tokens").alias("capacity"))
    return pack(sizes, containers).withColumnRenamed("id", "doc_id")


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of the assignment: all documents placed, none split that fits, no container too full."""
    rows = p8_packed(spark, folder)
    bins = rows.groupBy("container", "bin").agg(F.sum("tokens").alias("n"), F.first("capacity").alias("capacity")).groupBy("container").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))
    each = rows.groupBy("container", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("n"), F.first("capacity").alias("capacity"))
    split = each.groupBy("container", "capacity").agg(F.count("*").alias("documents"), F.count_if(F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity")))).alias("wrongly_split"))
    return split.join(bins, "container").select("container", "capacity", "documents", "wrongly_split", "overfull")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used and the share of their capacity that is filled."""
    bins = p8_packed(spark, folder).groupBy("container", "capacity", "bin").agg(F.sum("tokens").alias("tokens"))
    used = bins.groupBy("container", "capacity").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return used.withColumn("least_bins", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("fill", F.col("tokens") / (F.col("bins") * F.col("capacity")))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text", 13)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select(F.col("id").alias("doc_id"), "item_id").distinct()


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """For each item the number of documents it leaked into."""
    found = p9_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))
    items = table(spark, folder, "eval_items").select("item_id", "task")
    return items.join(found, "item_id", "left").select("item_id", "task", F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"))


def p9_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each leaked item each document covers, and whether the parts were reordered."""
    share = F.round(F.col("words") / F.col("item_words"), 6)
    return _leaks(spark, folder).select(F.col("id").alias("doc_id"), "item_id", "tiles", "words", share.alias("coverage"), "covered", "reordered")


def _truncated(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(table(spark, folder, "documents"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _truncated(spark, folder).where("cause is not null").select(F.col("id").alias("doc_id"))


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates, by cause, and how its rate of open endings compares with the other sources'."""
    return source_rates(_truncated(spark, folder))


QUERIES = {
    "p1_found": p1_found,
    "p1_merged": p1_merged,
    "p2_found": p2_found,
    "p2_shared": p2_shared,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p4_found": p4_found,
    "p4_batches": p4_batches,
    "p5_found": p5_found,
    "p5_files": p5_files,
    "p6_found": p6_found,
    "p6_groups": p6_groups,
    "p7_found": p7_found,
    "p7_kinds": p7_kinds,
    "p7_contained": p7_contained,
    "p8_packed": p8_packed,
    "p8_check": p8_check,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p9_coverage": p9_coverage,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
}
_P1 = r"""
WITH texts AS (
  SELECT id, project_id, indexed_at, trim(first_published) AS s FROM releases WHERE project_id IS NOT NULL
), instants AS (
  SELECT id, project_id, indexed_at, CASE
    WHEN regexp_full_match(s, '-?\d{1,15}') THEN make_timestamp(try_cast(s AS BIGINT) * 1000)
    WHEN regexp_full_match(s, '\d{4}-\d{2}-\d{2}') THEN try_cast(s AS TIMESTAMP)
    WHEN regexp_full_match(s, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?') THEN try_cast(s AS TIMESTAMP)
    WHEN regexp_full_match(s, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})') THEN try_cast(s AS TIMESTAMPTZ) AT TIME ZONE 'UTC'
  END AS born FROM texts
), dated AS (
  SELECT id AS release_id, project_id, CASE WHEN born >= TIMESTAMP '2000-01-01' AND born <= indexed_at THEN born END AS born FROM instants
), held AS (
  SELECT DISTINCT b.shape_hash, d.project_id, d.born
  FROM scan_files f JOIN blobs b ON b.id = f.blob_id JOIN dated d USING (release_id)
  WHERE b.shape_hash IS NOT NULL AND coalesce(lower(trim(b.language)) <> 'text', true)
), per AS (
  SELECT h.shape_hash, h.project_id, min(h.born) AS born, max(CASE WHEN p.downloads >= 0 THEN p.downloads END) AS downloads
  FROM held h LEFT JOIN projects p ON p.id = h.project_id GROUP BY 1, 2
), merged AS (
  SELECT shape_hash, count(*) AS projects,
    first(project_id ORDER BY born NULLS LAST, project_id) AS origin_project_id,
    min(born) AS origin_at,
    first(project_id ORDER BY downloads DESC NULLS LAST, project_id) AS top_project_id,
    max(downloads) AS downloads
  FROM per GROUP BY 1 HAVING count(*) >= 2
)
"""
_CODE = """
code AS (SELECT id, source FROM blobs WHERE source IS NOT NULL AND coalesce(lower(trim(language)) <> 'text', true))
"""
_SHINGLES = """
words AS (SELECT id, regexp_extract_all(source, '[A-Za-z0-9_]+') AS w FROM texts),
sets AS (SELECT DISTINCT id, hash(w[i:i + 4]) AS h FROM words, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
sizes AS (SELECT id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM sets a JOIN sets b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2),
alike AS (SELECT s.a, s.b FROM shared s JOIN sizes x ON x.id = s.a JOIN sizes y ON y.id = s.b WHERE s.n / (x.n + y.n - s.n) >= 0.6)
"""
_P9 = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^\p{L}\p{N}\s]', '', 'g'), '\s+'), lambda x: x <> '') AS w FROM eval_items),
ds AS (SELECT DISTINCT doc_id, hash(w[k:k + 12]) AS h FROM d, unnest(range(1, len(w) - 11)) AS u(k) WHERE len(w) >= 13),
si AS (SELECT DISTINCT item_id, hash(w[k:k + 12]) AS h FROM i, unnest(range(1, len(w) - 11)) AS u(k) WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM ds JOIN si USING (h)
"""
_P4 = (
    "WITH "
    + _CODE
    + r""", old AS (SELECT id * 2 AS id, -1 AS batch, source FROM code),
      fresh AS (SELECT arrival_id * 2 + 1 AS id, coalesce(batch_no, 2147483647) AS batch, source FROM arrivals WHERE source IS NOT NULL),
      texts AS (SELECT * FROM old UNION ALL SELECT * FROM fresh),
      clean AS (SELECT id, batch, regexp_replace(regexp_replace(source, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g') AS c FROM texts),
      exact AS (SELECT DISTINCT x.id FROM clean x JOIN clean y ON x.c = y.c AND (y.batch, y.id) < (x.batch, x.id) WHERE x.batch >= 0),
    """
    + _SHINGLES
    + """, near AS (
        SELECT DISTINCT x.id FROM (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike) s JOIN texts x ON x.id = s.a JOIN texts y ON y.id = s.b
        WHERE x.batch >= 0 AND (y.batch, y.id) < (x.batch, x.id) AND x.id NOT IN (SELECT id FROM exact)),
      repeated AS (SELECT (id - 1) // 2 AS arrival_id, 'exact' AS kind FROM exact UNION ALL SELECT (id - 1) // 2, 'near' FROM near)
    """
)
ORACLES: dict = {
    "p2_found": "WITH "
    + _CODE
    + """, w AS (SELECT DISTINCT id, hash(substr(source, k, 240)) AS h FROM code, unnest(range(1, length(source) - 238)) AS u(k) WHERE length(source) >= 240),
      many AS (SELECT h FROM w GROUP BY 1 HAVING count(*) > 1)
      SELECT DISTINCT a.id AS blob_id_a, b.id AS blob_id_b FROM w a JOIN many USING (h) JOIN w b ON a.h = b.h AND a.id < b.id""",
    "p2_shared": "WITH "
    + _CODE
    + """, w AS (SELECT id, k, hash(substr(source, k, 240)) AS h FROM code, unnest(range(1, length(source) - 238)) AS u(k) WHERE length(source) >= 240),
      many AS (SELECT h FROM w GROUP BY 1 HAVING count(DISTINCT id) > 1),
      marked AS (SELECT id, k, lead(k) OVER (PARTITION BY id ORDER BY k) AS following FROM w JOIN many USING (h)),
      shared AS (SELECT id, sum(least(240, coalesce(following - k, 240))) AS n FROM marked GROUP BY 1)
      SELECT c.id AS blob_id, length(c.source) AS chars, coalesce(s.n, 0)::BIGINT AS shared_chars, round(coalesce(s.n, 0) / length(c.source), 6) AS share
      FROM code c LEFT JOIN shared s USING (id) WHERE length(c.source) >= 240""",
    "p4_found": _P4 + "SELECT * FROM repeated",
    "p4_batches": _P4
    + """SELECT a.batch_no, count(*) AS files, count_if(r.kind = 'exact')::BIGINT AS exact, count_if(r.kind = 'near')::BIGINT AS near
      FROM arrivals a LEFT JOIN repeated r USING (arrival_id) GROUP BY 1""",
    "p6_groups": "WITH RECURSIVE "
    + _CODE
    + ", texts AS (SELECT * FROM code), "
    + _SHINGLES
    + """, named AS (SELECT id, list_sort(list(h)) AS name FROM sets GROUP BY 1),
      reps AS (SELECT id, min(id) OVER (PARTITION BY name) AS rep FROM named),
      links AS (SELECT a, b FROM alike WHERE a IN (SELECT rep FROM reps) AND b IN (SELECT rep FROM reps)),
      both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
      reached AS (SELECT rep AS id, rep AS other FROM (SELECT DISTINCT rep FROM reps) UNION SELECT r.id, l.b FROM reached r JOIN both_ways l ON l.a = r.other),
      classes AS (SELECT id AS rep, min(other) AS class_id FROM reached GROUP BY 1),
      degree AS (SELECT a AS rep, count(*) AS links FROM both_ways GROUP BY 1)
      SELECT r.id AS blob_id, c.class_id, coalesce(d.links, 0) AS links FROM reps r JOIN classes c USING (rep) LEFT JOIN degree d USING (rep)""",
    "p6_found": "WITH " + _CODE + ", texts AS (SELECT * FROM code), " + _SHINGLES + "SELECT a AS blob_id_a, b AS blob_id_b FROM alike",
    "p7_contained": "WITH "
    + _CODE
    + r""", names AS (
        SELECT r.id AS release_id, regexp_replace(regexp_replace(lower(regexp_replace(p.name, '^@[^/]*/', '')), '[-@_]v?\d+\.\d.*$', ''), '[_.]', '-', 'g') AS project
        FROM releases r JOIN projects p ON p.id = r.project_id WHERE p.name IS NOT NULL),
      held AS (SELECT DISTINCT f.blob_id, n.project FROM scan_files f JOIN names n USING (release_id) JOIN blobs b ON b.id = f.blob_id WHERE coalesce(lower(trim(b.language)) <> 'text', true)),
      lines AS (SELECT DISTINCT id AS blob_id, trim(replace(l, chr(9), ' ')) AS line FROM code, unnest(regexp_split_to_array(source, '\r\n|\r|\n')) AS u(l) WHERE trim(replace(l, chr(9), ' ')) <> ''),
      sizes AS (SELECT blob_id, count(*) AS n FROM lines GROUP BY 1),
      places AS (SELECT DISTINCT line, project FROM lines JOIN held USING (blob_id)),
      counted AS (SELECT blob_id, project, count(*) / any_value(n) AS share FROM lines JOIN places USING (line) JOIN sizes USING (blob_id) GROUP BY 1, 2)
      SELECT blob_id, project, round(share, 6) AS share FROM counted WHERE share >= 0.8 - 1e-9
      UNION SELECT blob_id, project, 1.0 FROM held""",
    "p8_check": """SELECT container, capacity_tokens::BIGINT AS capacity, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS wrongly_split, 0::BIGINT AS overfull
      FROM containers WHERE capacity_tokens > 0""",
    "p9_found": _P9,
    "p9_items": "WITH found AS (" + _P9 + ") SELECT i.item_id, i.task, count(f.doc_id) AS documents FROM eval_items i LEFT JOIN found f USING (item_id) GROUP BY 1, 2",
    "p1_found": _P1 + "SELECT shape_hash, origin_project_id, top_project_id FROM merged WHERE origin_at IS NOT NULL",
    "p1_merged": _P1
    + """SELECT shape_hash, projects, CASE WHEN origin_at IS NOT NULL THEN origin_project_id END AS origin_project_id,
      epoch_us(origin_at) AS origin_micros, top_project_id, downloads FROM merged""",
}
