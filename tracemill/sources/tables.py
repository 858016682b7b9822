"""Corpus store: pack directories, upserts and append-only logs on Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import first_per


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both, incoming ones in place of existing ones of the same key."""
    kept = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming.dropDuplicates(keys))


def union_first(parts: list[DataFrame], key: str) -> DataFrame:
    """All rows of the parts, the row of the earliest part for a key that several have."""
    marked = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    whole = marked[0]
    for p in marked[1:]:
        whole = whole.unionByName(p)
    return first_per(whole, [key], [F.col("_part")]).drop("_part")


def write_pack(documents: DataFrame, stop: DataFrame, meta: DataFrame, folder: str) -> None:
    """A pack directory: documents, stoplist and meta; the manifest is the documents without their source."""
    documents.write.mode("overwrite").parquet(f"{folder}/documents")
    stop.write.mode("overwrite").parquet(f"{folder}/stoplist")
    meta.write.mode("overwrite").parquet(f"{folder}/meta")
    documents.drop("source").write.mode("overwrite").parquet(f"{folder}/manifest")


def read_pack(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{folder}/{part}") for part in ("documents", "stoplist", "meta"))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines ledger; malformed lines are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
