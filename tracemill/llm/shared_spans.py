"""Long exact spans shared between records, found through difference-cover anchors.

A window is hashed only where its byte offset modulo PERIOD lies in a perfect difference set. Whatever the two
offsets of a common span of at least `length` characters, some shift below PERIOD puts both on the cover, so the
two texts share an anchor inside the span. Candidates are then extended on the texts. An anchor that occurs more
than HOT times is not paired: the windows of exactly `length` characters around it are hashed instead, which
separate the texts that really continue alike from those that merely share a heading. Such a window gives pairs
one place each; for the coverage every place of it is marked, without pairing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .classes import expand_pairs, possible, tasks_for
from .hashing import window_hashes

HOT = 64
LOW = np.uint64(0xFFFF)
MOST_CLASHES = 1000
# ids of texts that a task remembers at once
MOST_SEEN = 1 << 20


def difference_cover(q: int) -> tuple[int, list[int]]:
    """Period q*q+q+1 and a perfect difference set of q+1 residues, for a prime q (Singer's construction)."""
    period = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                s, zeros = (0, 0, 1), []
                for i in range(period):
                    if s[0] == 0:
                        zeros.append(i)
                    s = (s[1], s[2], (a * s[2] + b * s[1] + c * s[0]) % q)
                if len(zeros) == q + 1 and len({(x - y) % period for x in zeros for y in zeros}) == period:
                    return period, zeros
    raise ValueError(f"{q} is not a prime")


def cover_for(length: int) -> tuple[int, list[int], int]:
    """Period, residues and window width for spans of at least length: the largest cover up to 0.6 x length."""
    q = max((q for q in range(2, 200) if all(q % d for d in range(2, q)) and q * q + q + 1 <= 0.6 * length), default=None)
    if q is None:
        return 1, [0], length
    period, residues = difference_cover(q)
    return period, residues, length - period + 1


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)


def anchors(texts: DataFrame, length: int) -> DataFrame:
    """(key, id): the windows at cover positions of texts (id, text), 48 bits of hash over the low 16 bits of the position.

    Packed, a row costs the shuffle little more than the hash. Copies that a task meets again add nothing. Positions of long texts are known up to a multiple
    of 2**16, which the extension resolves.
    """
    period, residues, width = cover_for(length)
    cover = np.array(residues)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, ids = [], []
            if len(seen) > MOST_SEEN:
                seen.clear()
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i in seen:
                    continue
                seen.add(i)
                codes = _bytes(t.as_py())
                last = len(codes) - width
                if last < 0:
                    continue
                pos = (np.arange(0, last + 1, period)[:, None] + cover).reshape(-1)
                pos = pos[pos <= last]
                h = window_hashes(codes, pos, pos + width)
                keys.append((h & ~LOW) | (pos.astype(np.uint64) & LOW))
                ids.append(np.full(len(pos), i, dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(ids))], names=["key", "id"])

    return texts.mapInArrow(run, "key bigint, id bigint")


def _meet(batches):
    """From rows sorted by (key, id): the pairs of rows of each hash with up to HOT rows, or the rows of a larger one.

    Rows that equal texts have in common are met once. Keeps at most HOT rows of the hash that is still open;
    rows of a larger one pass through as they come.
    """
    none = np.zeros(0, np.int64)
    kept, hot, last = (none, none), None, None

    def emit(keys, ids, closed):
        nonlocal hot
        h, pos = keys >> 16, (keys & 0xFFFF).astype(np.int32)
        rest = (none, none)
        n = len(keys)
        if not n:
            return rest, None
        new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        sizes = np.diff(np.append(new, n))
        group = np.repeat(np.arange(len(new)), sizes)
        is_hot = sizes > HOT
        if hot is not None and h[0] == hot:
            is_hot[0] = True
        if not closed:
            if is_hot[-1]:
                hot = h[-1]
            else:
                n, hot = int(new[-1]), None
                rest = (keys[n:], ids[n:])
        row_hot = is_hot[group[:n]]
        first, second = [ids[:n][row_hot]], [none]
        at = [pos[:n][row_hot]]
        other = [np.zeros(0, np.int32)]
        start = np.flatnonzero(~row_hot)
        for d in range(1, HOT):
            start = start[start + d < n]
            start = start[group[start] == group[start + d]]
            if not len(start):
                break
            two = start[ids[start] != ids[start + d]]
            swap = ids[two] > ids[two + d]
            x, y = np.where(swap, two + d, two), np.where(swap, two, two + d)
            first.append(ids[x])
            second.append(ids[y])
            at.append(pos[x])
            other.append(pos[y])
        a, b = np.concatenate(first), np.concatenate(second)
        alone = np.arange(len(a)) < len(a) - len(b)
        pad = np.zeros(len(a) - len(b), np.int64)
        columns = [
            pa.array(a),
            pa.array(np.concatenate([pad, b]), mask=alone),
            pa.array(np.concatenate(at)),
            pa.array(np.concatenate([pad.astype(np.int32), *other])),
        ]
        return rest, pa.RecordBatch.from_arrays(columns, names=["a", "b", "pos_a", "pos_b"])

    for batch in batches:
        keys, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        if not len(keys):
            continue
        fresh = np.append(last != (keys[0], ids[0]), (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1]))
        last = (keys[-1], ids[-1])
        kept, out = emit(np.concatenate([kept[0], keys[fresh]]), np.concatenate([kept[1], ids[fresh]]), closed=False)
        if out is not None and out.num_rows:
            yield out
    _, out = emit(*kept, closed=True)
    if out is not None and out.num_rows:
        yield out


def _runs(a: np.ndarray, b: np.ndarray, shift: int, least: int):
    """Stretches (start in a, bytes) of at least `least` bytes on which a[x] equals b[x - shift]."""
    low, high = max(0, shift), min(len(a), len(b) + shift)
    if high - low < least:
        return
    apart = np.flatnonzero(a[low:high] != b[low - shift : high - shift])
    edges = np.concatenate([[-1], apart, [high - low]])
    for k in np.flatnonzero(np.diff(edges) > least):
        yield low + int(edges[k]) + 1, int(edges[k + 1] - edges[k]) - 1


def _whole_characters(a: np.ndarray, start: int, size: int) -> tuple[int, int, int]:
    """The part of a stretch that holds whole characters, as start, bytes and characters."""
    part = a[start : start + size]
    heads = np.flatnonzero((part & 0xC0) != 0x80)
    if not len(heads):
        return start, 0, 0
    after = start + size
    if after < len(a) and (a[after] & 0xC0) == 0x80:
        return start + int(heads[0]), int(heads[-1] - heads[0]), len(heads) - 1
    return start + int(heads[0]), size - int(heads[0]), len(heads)


def _names(texts: DataFrame) -> Column:
    """A 64-bit name of the column text that differs between all different texts.

    Names are hashes; where a second, independent one tells two texts of a name apart (two of 10**8 texts clash with
    probability 3e-4), that name is replaced by the second hash, so texts are one only if 128 bits agree.
    """
    first, second = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    both = texts.groupBy(first.alias("name")).agg(F.min(second).alias("low"), F.max(second).alias("high"))
    clashing = [r[0] for r in both.where("low <> high").select("name").limit(MOST_CLASHES + 1).collect()]
    if len(clashing) > MOST_CLASHES:
        raise ValueError(f"more than {MOST_CLASHES} names of 64 bits clash")
    return F.when(first.isin(clashing), second).otherwise(first) if clashing else first


@dataclass(frozen=True)
class SharedSpans:
    """met and continued: (a, b, pos_a, pos_b), places where two distinct texts have an anchor or a hot window in common;
    members: (id, rep); texts: (id, text), copies not removed; hot: (id, start), the windows of `length` characters
    around hot anchors that stand in other texts too.

    The ids of places, texts and reps are 64-bit names of the texts, so copies need no join before the search. met has
    at most HOT partners for an anchor of a text; with the places in hot it marks all that is shared. continued
    adds the pairs of hot groups, a place for each.
    """

    met: DataFrame
    continued: DataFrame
    members: DataFrame
    texts: DataFrame
    hot: DataFrame
    length: int

    def spans(self, hot: bool = True) -> DataFrame:
        """(a, b, start_a, start_b, bytes, chars) of the texts that share a span, without those of hot windows if asked.

        Every pair has a span; the spans of a pair that only hot anchors join may lack some, whose places are in hot.
        """
        places = self.met.union(self.continued) if hot else self.met
        candidates = materialise(places.groupBy("a", "b").agg(F.collect_set(F.pmod(F.col("pos_a") - F.col("pos_b"), F.lit(1 << 16))).alias("shifts")))
        known = distinct_texts(self.texts, candidates.select(F.col("a").alias("id")).union(candidates.select("b")))
        text = lambda i: known.select(F.col("id").alias(i), F.col("text").alias(f"t{i}"))
        wide = candidates.join(text("a"), "a").join(text("b"), "b").select("a", "b", "shifts", "ta", "tb")
        length = self.length
        return wide.mapInArrow(lambda batches: _extended(batches, length), "a bigint, b bigint, start_a bigint, start_b bigint, bytes bigint, chars bigint")

    def pairs(self) -> DataFrame:
        """(a, b), a < b: the records that share a span, copies included."""
        return expand_pairs(self.spans().select("a", "b").distinct(), self.members)

    def coverage(self) -> DataFrame:
        """(id, chars, shared_chars, share): how much of each record stands in another one too.

        A copy shares all of itself. Records shorter than the least length are not listed. Hot groups are not paired.
        """
        spans = materialise(self.spans(hot=False))
        marks = spans.select(F.col("a").alias("id"), F.col("start_a").alias("start"), "bytes").union(spans.select("b", "start_b", "bytes"))
        ranges = marks.groupBy("id", "start").agg(F.max("bytes").alias("bytes")).groupBy("id").agg(F.collect_list(F.struct("start", "bytes")).alias("ranges"))
        windows = self.hot.groupBy("id").agg(F.collect_list("start").alias("windows"))
        length = self.length

        def run(batches):
            for batch in batches:
                n, shared = [], []
                for text, found, at in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                    codes = _bytes(text.as_py())
                    is_head = (codes & 0xC0) != 0x80
                    edges = np.zeros(len(codes) + 1, dtype=np.int64)
                    for r in found or ():
                        edges[r["start"]] += 1
                        edges[r["start"] + r["bytes"]] -= 1
                    if at.is_valid:
                        heads = np.append(np.flatnonzero(is_head), len(codes))
                        starts = at.values.to_numpy()
                        np.add.at(edges, starts, 1)
                        np.add.at(edges, heads[np.searchsorted(heads, starts) + length], -1)
                    n.append(int(is_head.sum()))
                    shared.append(int((is_head & (np.cumsum(edges[:-1]) > 0)).sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(shared, pa.int64())], names=["rep", "chars", "shared_chars"])

        once = self.texts.groupBy("id").agg(F.first("text").alias("text"))
        sizes = once.join(ranges, "id", "left").join(windows, "id", "left").select("id", "text", "ranges", "windows").mapInArrow(run, "rep bigint, chars bigint, shared_chars bigint")
        classes = self.members.groupBy("rep").agg(F.count("*").alias("copies"))
        whole = self.members.join(sizes, "rep").join(classes, "rep")
        shared = F.when(F.col("copies") > 1, F.col("chars")).otherwise(F.col("shared_chars"))
        return whole.select("id", "chars", shared.alias("shared_chars"), (shared / F.col("chars")).alias("share"))

    def partners(self) -> DataFrame:
        """(id, partners): the number of records that share a span with each record that shares one."""
        pairs = self.pairs()
        return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("partners"))


def distinct_texts(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text), each id once, of at least the texts (id, text) that are among the ids."""
    return possible(texts, "id", ids).groupBy("id").agg(F.first("text").alias("text"))


def _extended(batches, length: int):
    """The spans of at least `length` characters of pairs (a, b, shifts, text a, text b), along the given shifts."""
    for batch in batches:
        out: list[tuple] = []
        last, codes_b = None, None
        for a, b, shifts, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
            codes_a = _bytes(ta.as_py())
            if b != last:
                last, codes_b = b, _bytes(tb.as_py())
            for shift in (x for low in shifts for x in range(low - ((len(codes_b) + low) >> 16 << 16), len(codes_a), 1 << 16)):
                for start, size in _runs(codes_a, codes_b, shift, length):
                    s, n, chars = _whole_characters(codes_a, start, size)
                    if chars >= length:
                        out.append((a, b, s, s - shift, n, chars))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(6)], names=["a", "b", "start_a", "start_b", "bytes", "chars"])


def shared_spans(df: DataFrame, id_col: str, text_col: str, length: int = 240) -> SharedSpans:
    """Spans of at least length characters that stand in more than one record.

    Rows with a null id or text, and texts shorter than length, share nothing. Equal texts are searched once.
    """
    known = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where((F.length("text") >= length) & F.col("id").isNotNull())
    name = _names(known)
    named = known.select(name.alias("id"), "text")
    members = known.select("id", name.alias("rep")).distinct()
    period, _, _ = cover_for(length)

    hashed = anchors(named, length).repartition(tasks_for(df, 4.0), F.shiftright("key", 16)).sortWithinPartitions("key", "id")
    met = materialise(hashed.mapInArrow(_meet, "a bigint, b bigint, pos_a int, pos_b int"))
    alone = met.where("b is null")
    hot = alone.groupBy(F.col("a").alias("id")).agg(F.collect_set("pos_a").alias("at"))

    def around(batches):
        """Keys of the windows of exactly `length` characters that hold a hot anchor in their first period."""
        for batch in batches:
            keys, ids, starts, leads = [], [], [], []
            for i, t, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                codes = _bytes(t.as_py())
                heads = np.flatnonzero((codes & 0xC0) != 0x80)
                pos = np.sort((np.array(at, dtype=np.int64)[:, None] + np.arange(0, len(codes), 1 << 16)).reshape(-1))
                first = heads[: max(0, len(heads) - length + 1)]
                near = np.searchsorted(pos, first)
                ok = (near < len(pos)) & (pos[np.minimum(near, len(pos) - 1)] - first < period)
                chosen = np.flatnonzero(ok)
                if not len(chosen):
                    continue
                ends = np.append(heads, len(codes))[chosen + length]
                h = window_hashes(codes, first[chosen], ends).view(np.int64)
                lead = np.zeros(len(h), dtype=bool)
                lead[np.unique(h, return_index=True)[1]] = True
                keys.append(h)
                ids.append(np.full(len(h), i, dtype=np.int64))
                starts.append(first[chosen].astype(np.int32))
                leads.append(lead)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(starts)), pa.array(np.concatenate(leads))], names=["key", "id", "start", "lead"])

    keyed = distinct_texts(named, hot.select("id")).join(hot, "id").select("id", "text", "at").mapInArrow(around, "key bigint, id bigint, start int, lead boolean")
    keyed = materialise(keyed.distinct())
    # windows that stand in the same set of records tell the same pairs; one of them is enough, at its first place
    once = keyed.where("lead")
    sets = once.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)")).alias("s")).where("n > 1")
    chosen = once.join(sets.groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    side = lambda i: chosen.select("key", F.col("id").alias(i), F.col("start").alias(f"pos_{i}"))
    continued = side("a").join(side("b"), "key").where("a < b").select("a", "b", "pos_a", "pos_b")

    everywhere = keyed.join(sets.select("key"), "key", "left_semi").select("id", "start")
    return SharedSpans(met.where("b is not null").select("a", "b", "pos_a", "pos_b"), continued, members, named, everywhere, length)
