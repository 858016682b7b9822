"""Source files that do not parse in their language."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import is_code, language_name, language_of_path
from .grammars import check, line_of


def with_language(blobs: DataFrame, files: DataFrame) -> DataFrame:
    """(id, language, source) of code blobs; where the column names no language, the extension of a path does.

    Of several paths the most frequent language counts, then the alphabetically first.
    """
    code = blobs.where(is_code(F.col("language")) & F.col("source").isNotNull() & F.col("id").isNotNull()).select("id", language_name(F.col("language")).alias("language"), "source")
    unnamed = code.where("language is null").drop("language")
    seen = files.select(F.col("blob_id").alias("id"), language_of_path(F.col("path")).alias("language")).where("language is not null").join(unnamed.select("id"), "id", "left_semi")
    counted = seen.groupBy("id", "language").agg(F.count("*").alias("n"))
    top = counted.groupBy("id").agg(F.max_by("language", F.struct("n", -F.ascii("language"))).alias("language"))
    return code.where("language is not null").union(unnamed.join(top, "id", "left").select("id", "language", "source"))


def verdicts(sources: DataFrame) -> DataFrame:
    """(id, language, verdict, token, line) of sources (id, language, source).

    verdict is valid, failed (token and line tell where), truncated (the text ends too early), or undecided where
    the language is unknown or the nesting is deeper than the parser follows. An empty source is valid.
    """

    def run(batches):
        sys.setrecursionlimit(20_000)
        for batch in batches:
            out: list[tuple] = []
            for i, language, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if language not in ("python", "javascript", "typescript"):
                    out.append((i, language, "undecided", None, None))
                    continue
                text = source.as_py()
                try:
                    verdict, n = check(text, language)
                except RecursionError:
                    out.append((i, language, "undecided", None, None))
                    continue
                out.append((i, language, verdict, n, line_of(text, language, n)) if verdict != "valid" else (i, language, verdict, None, None))
            columns = zip(*out) if out else [[]] * 5
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["id", "language", "verdict", "token", "line"])

    return sources.select("id", "language", "source").mapInArrow(run, "id bigint, language string, verdict string, token bigint, line bigint")


def rates(found: DataFrame, files: DataFrame) -> DataFrame:
    """(repository, language, files, failed, truncated, undecided, rate): every ingested file counts; a null repository is one of its own.

    rate is the share of failed and truncated files among those that could be decided, null where there is none.
    """
    held = files.select("repository", F.col("blob_id").alias("id")).groupBy("repository", "id").agg(F.count("*").alias("n"))
    joined = held.join(found.select("id", "language", "verdict").dropDuplicates(["id"]), "id")
    each = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0))
    out = joined.groupBy("repository", "language").agg(F.sum("n").alias("files"), each("failed").alias("failed"), each("truncated").alias("truncated"), each("undecided").alias("undecided"))
    return out.withColumn("rate", F.try_divide(F.col("failed") + F.col("truncated"), F.col("files") - F.col("undecided")))
