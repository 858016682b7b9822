"""Near-duplicate records with small edits: SetSketch registers, banded, estimated jointly, then verified.

Similarity is the Jaccard index of the sets of k consecutive words. Texts of fewer than k words have an empty
set and are similar to nothing. Texts with equal sets form a class; candidates, estimates and verification run
over one representative of each class, and members are expanded only where a result asks for pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .classes import expand_pairs, possible
from .hashing import mix, shingle_sets


@dataclass(frozen=True)
class Sketch:
    """SetSketch with exponential registers: base, rate, and bands x rows registers.

    A pair of similarity s is missed with probability (1 - s**rows)**bands: 4e-5 at 0.6 and below 1e-13 at 0.8
    for the values here.
    """

    bands: int = 42
    rows: int = 3
    base: float = 1.001
    rate: float = 20.0
    top: int = 65535

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def registers(sets: np.ndarray, offsets: np.ndarray, p: Sketch) -> np.ndarray:
    """One row of registers for each non-empty set: floor(1 - log_base(least exponential)), cut to 0..top."""
    full = np.flatnonzero(np.diff(offsets))
    starts = offsets[full]
    out = np.empty((len(full), p.registers), dtype=np.uint16)
    rng = np.random.default_rng(7)
    for i, odd in enumerate(rng.integers(1, 1 << 63, p.registers, dtype=np.uint64) | np.uint64(1)):
        least = np.minimum.reduceat(sets * odd, starts)
        u = (least.astype(np.float64) + 1.0) / 2.0**64
        h = -np.log1p(-np.minimum(u, 1 - 1e-16)) / p.rate
        out[:, i] = np.clip(np.floor(1.0 - np.log(h) / math.log(p.base)), 0, p.top)
    return out


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, p: Sketch, doubt: float = 5.0) -> np.ndarray:
    """Whether the joint likelihood leaves room for the threshold.

    With known set sizes the likelihood of similarity J depends on the counts of registers that are greater,
    less and equal. J is estimated by its maximum on a grid; a pair is dropped only if the estimate lies
    `doubt` standard errors below the threshold.
    """
    m, base = p.registers, p.base
    more, less = (a > b).sum(1), (a < b).sum(1)
    equal = m - more - less
    u, v = na / (na + nb), nb / (na + nb)
    grid = np.linspace(0.0, 1.0, 101)
    best, score = np.zeros(len(a)), np.full(len(a), -np.inf)
    log_b = math.log(base)
    share = lambda x: -np.log1p(-x * (base - 1) / base) / log_b
    for j in grid:
        pm, pl = share(np.clip(u - v * j, 0, 1)), share(np.clip(v - u * j, 0, 1))
        pe = np.clip(1 - pm - pl, 1e-12, 1)
        s = more * np.log(np.clip(pm, 1e-12, 1)) + less * np.log(np.clip(pl, 1e-12, 1)) + equal * np.log(pe)
        better = s > score
        best[better], score[better] = j, s[better]
    return best >= threshold - doubt * math.sqrt(threshold * (1 - threshold) / m) - 0.01


def sketches(df: DataFrame, id_col: str, text_col: str, k: int, p: Sketch) -> DataFrame:
    """(id, n, lo, hi, registers, bands): set size, a 128-bit name of the set, its registers and band keys."""

    def run(batches):
        salts = mix(np.arange(1, p.bands + 1, dtype=np.uint64))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            sets, offsets = shingle_sets(texts, k)
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            if not len(full):
                continue
            starts = offsets[full]
            regs = registers(sets, offsets, p)
            keys = np.tile(salts, (len(full), 1))
            grouped = regs.reshape(len(full), p.bands, p.rows).astype(np.uint64)
            for r in range(p.rows):
                keys = mix(keys ^ (grouped[:, :, r] + np.uint64(1)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(full)),
                    pa.array(sizes[full], pa.int64()),
                    pa.array(np.add.reduceat(sets, starts).view(np.int64)),
                    pa.array(np.bitwise_xor.reduceat(mix(sets), starts).view(np.int64)),
                    pa.array([row.tobytes() for row in regs], pa.binary()),
                    pa.ListArray.from_arrays(np.arange(0, keys.size + 1, p.bands, dtype=np.int32), keys.reshape(-1).view(np.int64)),
                ],
                names=["id", "n", "lo", "hi", "registers", "bands"],
            )

    narrow = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    return narrow.mapInArrow(run, "id bigint, n bigint, lo bigint, hi bigint, registers binary, bands array<bigint>")


def verified(pairs: DataFrame, texts_a: DataFrame, texts_b: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) whose exact similarity reaches the threshold; the texts are (id, text).

    Texts that surely are in no pair are left where they lie; the others are shuffled to their pairs.
    """

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            where: dict = {}
            texts = []
            for ids, column in ((a, batch.column(2)), (b, batch.column(3))):
                for i, t in zip(ids, column):
                    if i not in where:
                        where[i] = len(texts)
                        texts.append(t.as_py())
            sets, offsets = shingle_sets(texts, k)
            out = []
            for x, y in zip(a, b):
                i, j = where[x], where[y]
                s, t = sets[offsets[i] : offsets[i + 1]], sets[offsets[j] : offsets[j + 1]]
                at = np.searchsorted(s, t)
                common = int((s[np.minimum(at, len(s) - 1)] == t).sum()) if len(s) and len(t) else 0
                out.append(common / (len(s) + len(t) - common) if common else 0.0)
            keep = [i for i, s in enumerate(out) if s and s >= threshold]
            yield pa.RecordBatch.from_arrays([pa.array([z[i] for i in keep], t) for z, t in ((a, pa.int64()), (b, pa.int64()), (out, pa.float64()))], names=["a", "b", "similarity"])

    pairs = materialise(pairs.select("a", "b"))
    side = lambda texts, i: possible(texts, "id", pairs.select(i)).select(F.col("id").alias(i), F.col("text").alias(f"text_{i}"))
    left, right = side(texts_a, "a"), side(texts_b, "b")
    wide = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return wide.mapInArrow(run, "a bigint, b bigint, similarity double")


@dataclass(frozen=True)
class NearDuplicates:
    """links: (a, b, similarity) between representatives; members: (id, rep) of every text with a non-empty set."""

    links: DataFrame
    members: DataFrame

    def pairs(self) -> DataFrame:
        """(a, b), a < b: every pair of similar texts, copies included."""
        return expand_pairs(self.links, self.members)

    def classes(self) -> DataFrame:
        """(id, class_id, links): one row per text; links counts the representatives linked to its own."""
        from .components import components

        links = materialise(self.links)
        of = components(links, "a", "b").withColumnRenamed("id", "rep")
        degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
        return (
            self.members.join(of, "rep", "left").join(degree, "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
        )


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, k: int = 5, p: Sketch = Sketch()) -> NearDuplicates:
    """Find all pairs of texts with similarity of at least threshold.

    Rows with a null id or text are left out; repeated rows of one id count once; other columns are ignored.
    The join on band keys is a hash-partitioned equi-join that adaptive execution splits where a key is hot.
    """
    once = sketches(df, id_col, text_col, k, p)
    found = materialise(once)
    name = ["n", "lo", "hi"]
    classes = found.groupBy(*name).agg(F.min("id").alias("rep"))
    members = found.select("id", *name).join(classes, name).select("id", "rep").distinct()
    reps = found.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    keyed = reps.select("id", F.explode("bands").alias("key"))
    x, y = keyed.withColumnRenamed("id", "a"), keyed.withColumnRenamed("id", "b")
    candidates = x.join(y, "key").where("a < b").select("a", "b").distinct()

    @F.pandas_udf("boolean")
    def plausible(ra, rb, na, nb):
        import pandas as pd

        as_rows = lambda s: np.frombuffer(b"".join(s), dtype=np.uint16).reshape(len(s), -1)
        return pd.Series(likely(as_rows(ra), as_rows(rb), na.to_numpy(float), nb.to_numpy(float), threshold, p))

    side = lambda i: reps.select(F.col("id").alias(i), F.col("registers").alias(f"r{i}"), F.col("n").alias(f"n{i}"))
    # sizes alone rule out pairs: the smaller set holds at least threshold of the larger
    sized = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-6
    likely_pairs = candidates.join(side("a"), "a").join(side("b"), "b").where(sized).where(plausible("ra", "rb", "na", "nb")).select("a", "b")
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    return NearDuplicates(verified(likely_pairs, texts, texts, k, threshold).dropDuplicates(["a", "b"]), members)
