"""Successive snapshots: reconciliation, first and latest observations, budgets, caps and rate limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reconcile(tracked: DataFrame, observed: DataFrame, keys: list[str], rechecked: Column | None = None) -> DataFrame:
    """(keys, known, seen, action): detected, still_detected, resolved or unverified.

    One full outer join of the distinct keys. A tracked key that is not observed is resolved only where `rechecked`
    holds, a condition on the columns of tracked; without proof it stays unverified.
    """
    left = tracked.dropDuplicates(keys).withColumn("known", F.lit(True))
    proof = rechecked if rechecked is not None else F.lit(True)
    left = left.select(*keys, "known", F.coalesce(proof, F.lit(False)).alias("proven"))
    right = observed.select(*keys).distinct().withColumn("seen", F.lit(True))
    both = left.join(right, keys, "full_outer")
    known, seen = F.coalesce("known", F.lit(False)), F.coalesce("seen", F.lit(False))
    action = F.when(known & seen, "still_detected").when(seen, "detected").when(F.col("proven"), "resolved").otherwise("unverified")
    return both.select(*keys, known.alias("known"), seen.alias("seen"), action.alias("action"))


def action_counts(actions: DataFrame, keys: list[str]) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return actions.groupBy(*keys).agg(*[count(a) for a in ("detected", "still_detected", "resolved", "unverified")])


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_of_recent(df: DataFrame, key: str, order: list[Column], recent: int) -> DataFrame:
    """The latest row of each key among the `recent` latest rows of all: the limit comes first."""
    return first_per(df.orderBy(*order).limit(recent), [key], order)


def capped(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each key in order, with their number and whether the key had more."""
    part = Window.partitionBy(*keys)
    return df.withColumn("nth", F.row_number().over(part.orderBy(*order))).withColumn("truncated", F.count("*").over(part) > most).where(F.col("nth") <= most)


def budget_cut(df: DataFrame, keys: list[str], order: list[Column], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Rows taken in order until the first that would exceed a budget; everything from there on is left out."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = (F.count("*").over(running) > most_rows) | (F.sum(size).over(running) > most_size)
    return df.withColumn("over", over).where(~F.col("over")).drop("over")


def budget_greedy(df: DataFrame, keys: list[str], order: list[str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Rows taken in order as long as they fit; one that does not is skipped and the next is tried.

    The decision depends on all earlier ones. Sorted rows stream through one Arrow pass with two counters as state.
    """
    columns = df.columns
    at = [columns.index(k) for k in keys]
    of_size = columns.index(size)
    schema = df.schema

    def run(frames):
        current, rows, total = None, 0, 0
        for frame in frames:
            keep = []
            for row in frame.itertuples(index=False, name=None):
                key = tuple(row[i] for i in at)
                if key != current:
                    current, rows, total = key, 0, 0
                n = 0 if pd.isna(row[of_size]) else int(row[of_size])
                fits = rows < most_rows and total + n <= most_size
                keep.append(fits)
                if fits:
                    rows, total = rows + 1, total + n
            yield frame[keep]

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def rate_limited(hits: DataFrame, key: str, at: str, tie: str, most: int = 10, window_ms: int = 600_000) -> DataFrame:
    """(key, at, tie, allowed, retry_after_ms): at most `most` allowed hits in any window; rejected hits do not count.

    Streams sorted rows with the allowed times of the current key as state, `most` numbers at most.
    """
    types = dict(hits.dtypes)
    schema = f"`{key}` {types[key]}, ms bigint, `{tie}` {types[tie]}, allowed boolean, retry_after_ms bigint"

    def run(frames):
        current, allowed = object(), []
        for frame in frames:
            out = []
            for k, ms, t in frame.itertuples(index=False, name=None):
                if k != current:
                    current, allowed = k, []
                allowed = [x for x in allowed if x > ms - window_ms]
                if len(allowed) < most:
                    allowed.append(ms)
                    out.append((k, ms, t, True, 0))
                else:
                    out.append((k, ms, t, False, int(allowed[0] + window_ms - ms)))
            yield pd.DataFrame(out, columns=[key, "ms", tie, "allowed", "retry_after_ms"])

    rows = hits.where(F.col(key).isNotNull()).select(key, F.unix_millis(at).alias("ms"), tie)
    return rows.repartition(key).sortWithinPartitions(key, "ms", tie).mapInPandas(run, schema)


def visible_to(rows: DataFrame, repositories: DataFrame, user: str) -> DataFrame:
    """Rows (repository_id, owner_id) of a user's own or of a demo repository (id, is_demo)."""
    demo = repositories.where("is_demo").select(F.col("id").alias("repository_id"), F.lit(True).alias("_demo")).distinct()
    return rows.join(demo, "repository_id", "left").where((F.col("owner_id") == user) | F.coalesce("_demo", F.lit(False))).drop("_demo")


def new_events(incoming: DataFrame, accepted: DataFrame, key: str) -> DataFrame:
    """Idempotent insert: incoming events whose key was not accepted before, each once."""
    return incoming.dropDuplicates([key]).join(accepted.select(key), key, "left_anti")
