"""The source search as one plan: regions, shortlists, evidence, findings and the envelope of a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SearchSettings
from ..functions import columns as X
from ..operators import search
from ..session import materialise


def scan(files: DataFrame, documents: DataFrame, stoplist: DataFrame | None = None, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """Report rows for files (file_id, path, language, source) against documents (file_id, language, source).

    Every file without a finding gives one row of class insufficient_evidence that says why.
    """
    docs = materialise(search.documents(documents))
    regions = materialise(search.regions(files))
    shortlist = search.retrieve(regions, search.postings(docs, stoplist), docs, settings)
    found = materialise(search.best_per_source(search.verify(shortlist, regions, docs, settings)))
    lines = files.select("file_id", "source")
    shown = search.report(found, files).join(lines, "file_id", "left").withColumn("excerpt", X.excerpt("source", F.col("line_start"), F.col("line_end"), 1)).drop("source")
    explained = shown.withColumn("explanation", F.when(F.col("classification") == "strong_match", "long run with the source's own names and literals").otherwise("common structure without evidence of a source"))
    lexed = regions.select("file_id").distinct().withColumn("lexed", F.lit(True))
    empty = files.select("file_id", "path").join(found.select("file_id").distinct(), "file_id", "left_anti").join(lexed, "file_id", "left")
    reason = F.when(F.col("lexed"), "no document with enough in common").otherwise("no tokens to compare")
    rest = empty.select("file_id", "path", F.lit("insufficient_evidence").alias("classification"), reason.alias("explanation"))
    return explained.unionByName(rest, allowMissingColumns=True)


def summary(rows: DataFrame) -> DataFrame:
    """(strong, possible, insufficient, total) of a report."""
    count = lambda c: F.count_if(F.col("classification") == c)
    return rows.agg(count("strong_match").alias("strong"), count("possible_common_pattern").alias("possible"), count("insufficient_evidence").alias("insufficient"), F.count("*").alias("total"))
