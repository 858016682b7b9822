"""Views of the source corpus shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def language_name(column: Column) -> Column:
    """python, javascript, typescript or text from any usual spelling; null where none is recognised."""
    low = F.lower(F.trim(column))
    return (
        F.when(low.isin("python", "py", "python3"), F.lit("python"))
        .when(low.isin("javascript", "js", "ecmascript", "jsx", "mjs", "cjs", "node"), F.lit("javascript"))
        .when(low.isin("typescript", "ts", "tsx", "mts", "cts"), F.lit("typescript"))
        .when(low.isin("text", "txt", "plain", "plaintext"), F.lit("text"))
    )


def language_of_path(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(extension.isin("py", "pyi"), F.lit("python"))
        .when(extension.isin("js", "jsx", "mjs", "cjs"), F.lit("javascript"))
        .when(extension.isin("ts", "tsx", "mts", "cts"), F.lit("typescript"))
    )


def is_code(language: Column) -> Column:
    """A row whose language is not text; a null language counts as code."""
    return F.coalesce(F.lower(F.trim(language)) != "text", F.lit(True))


def code_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """(id, source) of the blobs that hold code and whose source is known."""
    blobs = table(spark, folder, "blobs")
    return blobs.where(is_code(F.col("language")) & F.col("source").isNotNull()).select("id", "source")


def canonical_source(source: Column) -> Column:
    """Line ends unified and blanks at line ends removed, as for blobs.exact_hash."""
    return F.regexp_replace(F.regexp_replace(source, "\r\n?", "\n"), "(?m)[ \t]+$", "")
