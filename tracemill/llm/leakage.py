"""Evaluation texts inside training texts, by greedy string tiling.

Words are what white space separates, case-folded, with everything but letters and digits removed. A run of `least`
words shared with an item is a seed. The Karp-Rabin hashes of all runs of the items form a table; the documents are read
once, their runs are tested against a filter of fixed size of that table, and documents with hits are joined with it.
For each document and item with common hashes the longest common runs are marked repeatedly and without overlap, in
document and item alike, until none of `least` words is left. What the tiles cover of an item tells passages whose
parts were reordered from those that merely share a phrase.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .classes import FILTER_BITS, fixed_filter, maybe_in
from .hashing import mix

LEAST_COVER = 0.8
_DROP = re.compile(r"[^\w\s]+|_+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MOST_WORDS = 1 << 20


def words(text: str) -> list[str]:
    """The words of a text in order; those left empty are not listed."""
    return _DROP.sub("", text.casefold()).split()


class _Words(dict):
    """Hashes of words, kept between texts until there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > _MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def run_hashes(listed: list[str], k: int, known: _Words) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k words."""
    n = len(listed) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    x = np.fromiter((known[w] for w in listed), dtype=np.uint64, count=len(listed))
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * _MULTIPLIER + x[i : i + n]
    return mix(h)


def tiles(doc: list[str], item: list[str], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (in document, in item, words) of the common runs, longest first, nothing marked twice."""
    starts = defaultdict(list)
    for i in range(len(item) - least + 1):
        starts[tuple(item[i : i + least])].append(i)
    first = {run[0] for run in starts}
    # seeds on one diagonal that follow each other are one maximal run
    seeds = sorted((d - i, d) for d in range(len(doc) - least + 1) if doc[d] in first for i in starts.get(tuple(doc[d : d + least]), ()))
    runs: list[list[int]] = []
    for diagonal, at in seeds:
        if runs and runs[-1][0] == diagonal and at <= runs[-1][1] + runs[-1][2] - least + 1:
            runs[-1][2] = at + least - runs[-1][1]
        else:
            runs.append([diagonal, at, least])
    in_doc, in_item = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool)
    waiting = [(n, at, at - diagonal) for diagonal, at, n in runs]
    out = []
    while waiting:
        waiting.sort(key=lambda r: (r[0], -r[1], -r[2]))
        n, d, i = waiting.pop()
        free = ~(in_doc[d : d + n] | in_item[i : i + n])
        if free.all():
            in_doc[d : d + n] = True
            in_item[i : i + n] = True
            out.append((d, i, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        waiting += [(int(b - a), d + int(a), i + int(a)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]
    return out


def leaks(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, least: int = 13, cover: float = LEAST_COVER, bits: int = FILTER_BITS) -> DataFrame:
    """(id, item_id, tiles, words, item_words, longest, covered, reordered): the items of which a document holds a run of at least `least` words.

    words counts the item's words covered by tiles, so a passage with reordered parts is covered in full; covered tells
    whether that is a share of at least `cover`, reordered whether it is and the parts stand in another order than in the
    item. Items of fewer than `least` words and rows with null ids or texts give nothing.
    """
    narrow = lambda df, i, t: df.select(F.col(i).cast("bigint").alias("id"), F.col(t).cast("string").alias("text")).where("id is not null and text is not null")
    asked = narrow(items, item_col, item_text_col).distinct()

    def seeds(batches):
        known = _Words()
        for batch in batches:
            hashes = [np.unique(run_hashes(words(t.as_py()), least, known)) for t in batch.column(1)]
            ids = np.repeat(batch.column(0).to_numpy(), [len(h) for h in hashes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)), pa.array(ids)], names=["hash", "item_id"])

    held = materialise(asked.mapInArrow(seeds, "hash bigint, item_id bigint"))
    shared = documents.sparkSession.sparkContext.broadcast(fixed_filter(held.select("hash"), bits))

    def hits(batches):
        known, table = _Words(), shared.value
        for batch in batches:
            found, at = [], []
            for n, t in enumerate(batch.column(1)):
                h = run_hashes(words(t.as_py()), least, known)
                h = np.unique(h[maybe_in(table, h)])
                if len(h):
                    at.append(n)
                    found.append(h.view(np.int64))
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(found, pa.list_(pa.int64()))], names=["id", "text", "hashes"])

    hit = materialise(narrow(documents, id_col, text_col).mapInArrow(hits, "id bigint, text string, hashes array<bigint>"))
    pairs = hit.select("id", F.explode("hashes").alias("hash")).join(held, "hash").select("id", "item_id").distinct()
    wide = pairs.join(asked.select(F.col("id").alias("item_id"), F.col("text").alias("item")), "item_id").join(hit.select("id", "text"), "id")

    def tiled(batches):
        last, doc = None, []
        for batch in batches:
            out: list[tuple] = []
            for i, item_id, text, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                value = text.as_py()
                if value != last:
                    last, doc = value, words(value)
                whole = words(item.as_py())
                found = tiles(doc, whole, least)
                if found:
                    total = sum(t[2] for t in found)
                    covered = total >= cover * len(whole)
                    in_order = [t[1] for t in sorted(found)]
                    out.append((i, item_id, len(found), total, len(whole), max(t[2] for t in found), covered, covered and in_order != sorted(in_order)))
            types = [pa.int64()] * 6 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], names=["id", "item_id", "tiles", "words", "item_words", "longest", "covered", "reordered"])

    return wide.select("id", "item_id", "text", "item").mapInArrow(tiled, "id bigint, item_id bigint, tiles bigint, words bigint, item_words bigint, longest bigint, covered boolean, reordered boolean")
