"""Connected components over a distributed edge list (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: every neighbour is linked to the least id around its centre.

    The least id comes from a partial aggregation and is joined back, so no neighbourhood is gathered in one task.
    """
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a <> b").distinct()


def components(pairs: DataFrame, a: str, b: str, most_rounds: int = 64) -> DataFrame:
    """(id, component): every id that occurs in a pair with the least id it is connected to.

    Null ends are ignored; an empty edge list gives an empty result. Rounds grow with the logarithm of the
    longest chain; each is checkpointed.
    """
    edges = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    edges = materialise(edges.where("a <> b").distinct())
    before = None
    for _ in range(most_rounds):
        edges = materialise(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("component"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
