"""Deduplicating batches against all history with an incremental inverted index of rare-token prefixes.

Tokens are the runs of k consecutive words. All sets are ordered alike, rarest token first, so two sets of
similarity t or more share a token among the first n - ceil(t n) + 1 of each. Only these prefixes are posted. The
postings are bucketed by token: a probe moves the batch's prefixes to them and leaves history where it lies, reads
none of its texts but those of candidates, and an append adds the batch's postings and texts. The order is fixed when the index is made: the level of the token in a
table of the MOST_FREQUENT tokens of the history, then the token's hash. It steers speed alone; any order gives the
same result.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .corpus import canonical_source
from .hashing import shingle_sets
from .near_duplicates import verified

LOCAL = 3
MOST_FREQUENT = 1 << 17
HISTORY = -(2**31)
POSTING = "token bigint, ref bigint, batch int, pos int, n int, shard int"
STORED = "name binary, ref bigint, batch int, text string"


def named(texts: DataFrame) -> DataFrame:
    """(name, ref, batch, text): texts (ref, batch, text) that are not null, with the SHA-256 of the cleaned text."""
    return texts.where("text is not null").select(F.unhex(F.sha2(canonical_source(F.col("text")), 256)).alias("name"), "ref", "batch", "text")


def shard(name: str, shards: int) -> Column:
    """The shard of a name: the partition that a shuffle on the name puts it into."""
    return F.pmod(F.hash(name), F.lit(shards)).cast("int")


def frequent_tokens(texts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens of texts (ref, text), sorted, and the binary logarithms of their counts.

    All tokens are counted in blocks; those seen LOCAL times in a block are summed over the blocks, and the
    MOST_FREQUENT greatest sums make the table, whatever the size of the input.
    """

    def run(batches):
        for batch in batches:
            sets, _ = shingle_sets(batch.column(0).to_pylist(), k)
            token, n = np.unique(sets, return_counts=True)
            often = n >= LOCAL
            yield pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(n[often])], names=["token", "n"])

    counted = texts.select("text").mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()
    token = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    at = np.argsort(token)
    return token[at], np.log2(top["n"].to_numpy(dtype=np.float64))[at].astype(np.uint8)


def rarity(sets: np.ndarray, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 for tokens outside the table of frequent ones, else the logarithm of their count."""
    token, level = order
    if not len(token):
        return np.zeros(len(sets), dtype=np.uint8)
    at = np.minimum(np.searchsorted(token, sets), len(token) - 1)
    return np.where(token[at] == sets, level[at], 0)


def prefixes(texts: DataFrame, order: tuple[np.ndarray, np.ndarray], threshold: float, k: int) -> DataFrame:
    """(token, ref, batch, pos, n, shard): the rarest tokens of each text (ref, batch, text, shard), as many as the threshold asks for."""
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        for batch in batches:
            sets, offsets = shingle_sets(batch.column(2).to_pylist(), k)
            kind = rarity(sets, shared.value)
            tokens, sizes, full = [], [], []
            for i in range(batch.num_rows):
                a, b = offsets[i], offsets[i + 1]
                if a == b:
                    continue
                n = int(b - a)
                keep = n - math.ceil(threshold * n - 1e-9) + 1
                tokens.append(sets[a:b][np.argsort(kind[a:b], kind="stable")[:keep]])
                sizes.append(n)
                full.append(i)
            if not full:
                continue
            lengths = np.array([len(t) for t in tokens])
            at = pa.array(np.repeat(full, lengths))
            pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(pos.astype(np.int32)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), lengths)), batch.column(3).take(at)],
                names=["token", "ref", "batch", "pos", "n", "shard"],
            )

    return texts.select("ref", "batch", "text", "shard").mapInArrow(run, POSTING)


@dataclass
class PrefixIndex:
    """An index that lies in a folder of its own; open() finds it again in another application.

    texts/ holds (name, ref, batch, text) in one folder per shard of the name, a hash of the cleaned text; a batch
    reads the names of its own shards and the texts of the shards that its candidates lie in. postings/ is bucketed by
    token. order/ and meta/ hold what is fixed when the index is made.
    """

    spark: SparkSession
    path: str
    threshold: float
    k: int
    buckets: int
    order: tuple[np.ndarray, np.ndarray]
    name: str

    @classmethod
    def build(cls, history: DataFrame, threshold: float = 0.8, k: int = 5, path: str | None = None, buckets: int | None = None) -> PrefixIndex:
        """Index the texts (ref, text) of a history. Texts that are equal once cleaned are posted once; null texts are left out.

        There are as many shards and buckets as the session has shuffle partitions, so that a task writes whole shards.
        """
        spark = history.sparkSession
        index = cls(spark, path or scratch_path(spark, "index"), threshold, k, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), (None, None), "")
        index._store(named(history.select("ref", F.lit(HISTORY).alias("batch"), "text")))
        index.order = frequent_tokens(index.texts(), k)
        token, level = index.order
        spark.createDataFrame(pd.DataFrame({"token": token.view(np.int64), "level": level.astype(np.int32)}), "token bigint, level int").write.parquet(f"{index.path}/order")
        spark.createDataFrame([(threshold, k, index.buckets)], "threshold double, k int, buckets int").write.parquet(f"{index.path}/meta")
        index._attach()
        index._post(index.texts())
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PrefixIndex:
        """The index that an earlier application left in a folder."""
        meta = spark.read.parquet(f"{path}/meta").first()
        order = spark.read.parquet(f"{path}/order").orderBy("token").toPandas()  # at most MOST_FREQUENT rows
        token = order["token"].to_numpy(dtype=np.int64).view(np.uint64)
        at = np.argsort(token)
        index = cls(spark, path, meta["threshold"], meta["k"], meta["buckets"], (token[at], order["level"].to_numpy(dtype=np.uint8)[at]), "")
        index._attach()
        return index

    def _attach(self) -> None:
        """Name the postings in the session's catalog, so that their buckets are known."""
        self.name = f"postings_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {self.name} ({POSTING}) USING parquet CLUSTERED BY (token) INTO {self.buckets} BUCKETS LOCATION '{self.path}/postings'")

    def _store(self, texts: DataFrame) -> None:
        """Add texts (name, ref, batch, text), of equal names the earliest."""
        once = texts.groupBy("name").agg(F.min(F.struct("batch", "ref")).alias("first"), F.first("text").alias("text"))
        rows = once.select("name", "first.ref", "first.batch", "text", shard("name", self.buckets).alias("shard"))
        rows.write.partitionBy("shard").mode("append").option("compression", "zstd").parquet(f"{self.path}/texts")

    def _post(self, texts: DataFrame) -> None:
        prefixes(texts, self.order, self.threshold, self.k).write.insertInto(self.name)

    def texts(self, shards: DataFrame | None = None) -> DataFrame:
        """(name, ref, batch, text, shard) of the given shards, a one-column table, or of all; other shards are not read."""
        stored = self.spark.read.schema(f"{STORED}, shard int").parquet(f"{self.path}/texts")
        if shards is None:
            return stored
        return stored.where(F.col("shard").isin([r[0] for r in shards.distinct().collect()]))  # at most as many as there are shards

    def append(self, batch: DataFrame) -> None:
        """Add texts (ref, batch, text) whose names the index does not hold yet."""
        rows = named(batch)
        self._store(rows)
        self._post(rows.withColumn("shard", shard("name", self.buckets)))

    def postings(self) -> DataFrame:
        return self.spark.table(self.name)

    def exact(self, batch: DataFrame) -> DataFrame:
        """(ref, repeated): whether a text (ref, batch, text) equals an earlier one, of the index or the batch, once both are cleaned."""
        fresh = materialise(named(batch).select("name", "ref", "batch"))
        held = self.texts(fresh.select(shard("name", self.buckets))).select("name", "ref", "batch")
        first = held.union(fresh).groupBy("name").agg(F.min(F.struct("batch", "ref")).alias("first"))
        return fresh.join(first, "name").select("ref", (F.struct("batch", "ref") > F.col("first")).alias("repeated"))

    def candidates(self, batch: DataFrame) -> DataFrame:
        """(a, b, shard): a text (ref, batch, text) of the batch and an earlier one that may reach the threshold, with its shard.

        A pair is kept only if the sizes allow it and if the common prefix tokens, plus the most that can follow
        the last of them, reach the overlap that the threshold needs.
        """
        t = self.threshold
        x = prefixes(batch.withColumn("shard", F.lit(0)), self.order, t, self.k).select("token", F.col("ref").alias("a"), F.col("batch").alias("batch_a"), F.col("pos").alias("pos_a"), F.col("n").alias("n_a"))
        y = self.postings().select("token", F.col("ref").alias("b"), F.col("batch").alias("batch_b"), F.col("pos").alias("pos_b"), F.col("n").alias("n_b"), "shard")
        earlier = (F.col("batch_b") < F.col("batch_a")) | ((F.col("batch_b") == F.col("batch_a")) & (F.col("b") < F.col("a")))
        sized = (F.col("n_b") >= F.col("n_a") * t - 1e-6) & (F.col("n_a") >= F.col("n_b") * t - 1e-6)
        left_over = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
        need = F.ceil((F.col("n_a") + F.col("n_b")) * (t / (1 + t)) - 1e-6)
        met = x.join(y, "token").where(earlier & sized)
        # pos and n are functions of (a, b, token); the last common token has the greatest positions in both
        grouped = met.groupBy("a", "b").agg(F.count("*").alias("common"), F.min(left_over).alias("rest"), F.first(need).alias("need"), F.first("shard").alias("shard"))
        return grouped.where("common + rest - 1 >= need").select("a", "b", "shard")

    def probe(self, batch: DataFrame) -> DataFrame:
        """(a, b, similarity): the earlier texts b that a text a of the batch repeats nearly."""
        found = materialise(self.candidates(batch))
        texts = self.texts(found.select("shard")).select(F.col("ref").alias("id"), "text")
        return verified(found, batch.select(F.col("ref").alias("id"), "text"), texts, self.k, self.threshold)

    def close(self) -> None:
        """Forget the name in the catalog; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def drop(self) -> None:
        """Delete the index."""
        self.close()
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
