"""The portable pipeline: fingerprints, containment, bands, licences, risk and the summary of a scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PIPELINE
from ..functions import arrow as A
from ..functions import columns as X
from ..operators import history, license, similarity
from ..session import materialise


@dataclass(frozen=True)
class Scan:
    """matches per (file, document); of each file and kind of document one of the best; findings in report order, cut to the caps; the summary row."""

    matches: DataFrame
    best: DataFrame
    findings: DataFrame
    summary: DataFrame


def fingerprints(files: DataFrame) -> DataFrame:
    """(file_id, hash, position) of files (file_id, path, content), lexed by the one-lexer engine."""
    language = X.language("path")
    prints = files.select("file_id", A.fingerprints(A.kinds(F.col("content"), language, "pipeline"), PIPELINE).alias("f"))
    return prints.select("file_id", F.explode("f").alias("p")).select("file_id", "p.hash", "p.position")


def hash_sets(files: DataFrame) -> DataFrame:
    """(file_id, hashes) of files (file_id, path, content): the distinct hashes of fingerprints()."""
    return files.select("file_id", A.hash_sets(F.col("content"), X.language("path"), PIPELINE).alias("hashes"))


#: marks of documents: idioms of a clear licence only inform, those of a blocking one can block
_INFORMS, _BLOCKS, _OTHER = 0, 1, 2


def run(files: DataFrame, corpus: DataFrame, entries: DataFrame, actionable: int = 200, informational: int = 40) -> Scan:
    """Scan files (file_id, path, content) against corpus hashes (doc_id, hash), or sets of them (doc_id, hashes), with entries (doc_id, title, license, idiom)."""
    code = files.where(X.language("path") != "unknown")
    probes = similarity.classes(hash_sets(code), "file_id")
    if "hashes" not in corpus.columns:
        corpus = corpus.groupBy("doc_id").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    known = entries.select("doc_id", "title", F.coalesce("license", F.lit("Unknown")).alias("license"), F.coalesce("idiom", F.lit(False)).alias("idiom"))
    policy = license.policy("license")
    mark = F.when(F.col("idiom") & (policy == "CLEAR"), _INFORMS).when(policy == "BLOCKING", _BLOCKS).otherwise(_OTHER)
    docs = similarity.classes(corpus.join(known.select("doc_id", mark.alias("mark")), "doc_id"), "doc_id", "mark")

    def judged(found: DataFrame) -> DataFrame:
        """Band and severity hang on nothing of a document but its mark."""
        informs, policy = F.col("mark") == _INFORMS, F.when(F.col("mark") == _BLOCKS, "BLOCKING").when(F.col("mark") == _INFORMS, "CLEAR").otherwise("REVIEW")
        return found.withColumn("band", similarity.band("containment", informs, policy)).withColumn("severity", similarity.severity(F.col("band"), policy)).where("band <> 'clear'").drop("mark")

    matches = judged(similarity.containing(probes, docs, similarity.LEAST))
    best = judged(similarity.containing(probes, docs, similarity.LEAST, best=True))

    paths = files.select(F.col("file_id").alias("probe_id"), "path")

    def similar(docs: DataFrame, top: int) -> DataFrame:
        first = lambda mark, c: c + 2.0 * ((mark == _BLOCKS) & (c >= similarity.STRONG))
        found = judged(similarity.containing(probes, docs, similarity.LEAST, top=top, rank=first))
        return found.join(paths, "probe_id").join(known.select("doc_id", "title"), "doc_id").select(
            F.lit("similarity").alias("type"), "severity", "path", F.concat_ws(":", F.lit("similarity"), "path", "doc_id").alias("finding_key"), F.round("containment", 3).alias("confidence"),
            F.concat(X.percent("containment"), F.lit(" of the fingerprints of "), "title", F.lit(" ("), "shared", F.lit(" of "), "doc_size", F.lit(")")).alias("why"),
        )

    texts = files.where(license.is_license_file(F.col("path"))).withColumn("license", license.detect("content")).withColumn("policy", license.policy("license"))
    level = F.when(F.col("policy") == "BLOCKING", "blocking").when(F.col("policy") == "CLEAR", "info").otherwise("review")
    licensed = texts.select(F.lit("license").alias("type"), level.alias("severity"), "path", F.concat_ws(":", F.lit("license"), "path").alias("finding_key"), F.lit(1.0).alias("confidence"), F.concat("license", F.lit(": "), "policy").alias("why"))

    order = [F.when(F.col("severity") == "blocking", 0).when(F.col("severity") == "review", 1).otherwise(2), F.desc("confidence"), F.col("finding_key")]
    most = max(actionable, informational)
    # one more than the most, which tells whether anything is left out
    first = lambda found, kind: found.unionByName(licensed).where(kind).orderBy(*order).limit(most + 1)
    acts = F.col("severity") != "info"
    drafts = first(similar(docs.where(F.col("mark") != _INFORMS), most + 1), acts).unionByName(first(similar(docs.where(F.col("mark") == _INFORMS), most + 1), ~acts)).withColumn("actionable", acts)
    cut = history.capped(drafts, ["actionable"], order, most).where(F.when(F.col("actionable"), F.col("nth") <= actionable).otherwise(F.col("nth") <= informational))

    totals = code.agg(F.count("*").alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines"))
    bands = best.agg(F.bool_or(F.col("severity") == "blocking").alias("blocking"), F.bool_or(F.col("severity") == "review").alias("review"))
    overall = texts.agg(license.worst_policy("policy").alias("policy"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    risk = F.when(yes("blocking") | (F.col("policy") == "BLOCKING"), "blocking").when(yes("review") | (F.col("policy") == "REVIEW"), "review").when(F.col("policy") == "UNKNOWN", "unknown").otherwise("clear")
    digest = files.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", F.octet_length("content").cast("string")))), "\n"), 256), 1, 16).alias("content_hash"))
    # four single rows side by side
    one = lambda df: df.withColumn("_", F.lit(1))
    summary = one(totals).join(one(bands), "_").join(one(overall), "_").join(one(digest), "_").select("files", "lines", "policy", risk.alias("risk"), "content_hash")
    return Scan(matches, best, cut.drop("nth"), summary)
