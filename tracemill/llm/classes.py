"""Classes of equal texts, one representative for all copies, and the choice of the texts that few ids name."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 1 << 27
TASK_BYTES = 64 << 20
UNKNOWN_BYTES = 1 << 60


def fixed_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of a fixed size (16 MB for the default) of 64-bit hashes, a one-column table: three bits of one word for each.

    Only its words reach the driver, at most bits / 64 of them whatever the number of hashes.
    """
    words = bits >> 6
    h = F.col(hashes.columns[0])
    bit = lambda by: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, by).bitwiseAND(F.lit(63)).cast("int"))
    mask = bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))
    found = hashes.where(h.isNotNull()).select(F.shiftrightunsigned(h, 64 - int(math.log2(words))).cast("int").alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros(words, dtype=np.uint64)
    table[found["word"].to_numpy(dtype=np.int64)] = found["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return table


def maybe_in(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of the hashes (unsigned) may be in a filter; those that are not in it mostly are told so."""
    word = table[(x >> np.uint64(64 - int(math.log2(len(table))))).astype(np.int64)]
    ok = np.ones(len(x), dtype=bool)
    for by in (0, 6, 12):
        ok &= (word >> ((x >> np.uint64(by)) & np.uint64(63))) & np.uint64(1) == 1
    return ok


def possible(rows: DataFrame, key: str, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows whose key may be among the ids, a one-column table; callers join them with the ids, which is exact.

    A filter of a fixed size is sent to the rows. The more ids, the more rows pass that the join drops again; no row of an
    id is ever lost.
    """
    shared = rows.sparkSession.sparkContext.broadcast(fixed_filter(ids.select(F.xxhash64(ids.columns[0]).alias("h")), bits))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(maybe_in(shared.value, hashes.to_numpy(dtype=np.int64).view(np.uint64)))

    return rows.where(maybe(F.xxhash64(key)))


def tasks_for(df: DataFrame, growth: float) -> int:
    """Partitions for a shuffle of `growth` times the bytes that df is read from, so that a task holds about TASK_BYTES.

    Where the size is not known (rows that come from no file), the session's number.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(size * growth / TASK_BYTES)) if size < UNKNOWN_BYTES else least


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of ids from links (a, b) between representatives, plus the pairs within a class."""
    copies = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1")
    both = links.select("a", "b").union(copies.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
    left = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    wide = both.join(left, "a").join(right, "b").where("a <> b or x < y")
    return wide.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
