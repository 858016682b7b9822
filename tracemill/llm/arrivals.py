"""Repeats among arriving files: exact by their cleaned source, near by the prefix index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .history import PrefixIndex


def history_index(history: DataFrame, threshold: float = 0.8, k: int = 5, path: str | None = None) -> PrefixIndex:
    """An index of the sources of a history (id, source); ids must not be negative."""
    return PrefixIndex.build(history.where("source is not null and id is not null").select((F.col("id") * 2).alias("ref"), F.col("source").alias("text")), threshold, k, path)


def deliver(index: PrefixIndex, arrivals: DataFrame) -> DataFrame:
    """(arrival_id, kind, of) for arrivals that repeat the index or an earlier arrival; the new ones are added to the index.

    arrivals has (arrival_id, batch_no, source), one batch or several; of counts the different earlier texts that make it
    `near`. Other columns are ignored, and the hash a sender claims is not used. Ids must not be negative. Arrivals
    without a source repeat nothing; an arrival without a batch number comes after all that have one. Exact repeats
    are neither probed nor posted: what repeats them repeats the earlier text too. Of history, only the names in the
    shards of the batch, the postings and the texts of candidates are read.
    """
    new = arrivals.where("source is not null and arrival_id is not null").select((F.col("arrival_id") * 2 + 1).alias("ref"), F.coalesce(F.col("batch_no").cast("int"), F.lit(2**31 - 1)).alias("batch"), F.col("source").alias("text"))
    new = new.dropDuplicates(["ref"])
    seen = materialise(index.exact(new))
    fresh = new.join(seen.where("not repeated"), "ref", "left_semi")
    index.append(fresh)
    near = index.probe(fresh).groupBy(F.col("a").alias("ref")).agg(F.count("*").alias("of"))
    exact = seen.where("repeated").select("ref", F.lit("exact").alias("kind"), F.lit(None).cast("bigint").alias("of"))
    found = exact.union(near.select("ref", F.lit("near"), "of"))
    return materialise(found.select(F.floor(F.col("ref") / 2).cast("bigint").alias("arrival_id"), "kind", "of"))


def repeats(history: DataFrame, arrivals: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """deliver() of all arrivals to an index of the history (id, source) that is made for it and dropped again."""
    index = history_index(history, threshold, k)
    try:
        return deliver(index, arrivals)
    finally:
        index.drop()
