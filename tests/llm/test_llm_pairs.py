import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import hashing
from tracemill.llm.arrivals import deliver, history_index, repeats
from tracemill.llm.classes import possible
from tracemill.llm.components import components
from tracemill.llm.near_duplicates import Sketch, near_duplicates
from tracemill.llm.shared_spans import HOT, cover_for, difference_cover, shared_spans

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, times):
    w = t.split()
    for _ in range(times):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return " ".join(w)


def shingles(t, k=5):
    w = re.findall(r"[A-Za-z0-9_]+", t or "")
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a & b else 0.0


@pytest.fixture(scope="module")
def family():
    rng = random.Random(5)
    base = [text(rng, 120) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base:
        for times in (1, 3, 6, 10, 20):
            rows.append((len(rows), edited(rng, t, times)))
    rows += [(len(rows), base[0]), (len(rows) + 1, base[0].replace(" ", "\n"))]
    rows += [(900, None), (901, ""), (902, "one two three"), (903, "ü " * 4), (None, base[1])]
    return rows


def test_near_duplicates_equal_brute_force(spark, family):
    df = spark.createDataFrame(family, "id bigint, text string").withColumn("rep", F.lit(1)).withColumn("a", F.lit("x"))
    sets = {i: shingles(t) for i, t in family if i is not None}
    want = {(i, j) for i in sets for j in sets if i < j and jaccard(sets[i], sets[j]) >= 0.6}
    found = near_duplicates(df, "id", "text", 0.6)
    assert {tuple(r) for r in found.pairs().collect()} == want
    classes = {r.id: r.class_id for r in found.classes().collect()}
    assert all(classes[i] == classes[j] for i, j in want)
    assert set(classes) == {i for i in sets if sets[i]}
    again = near_duplicates(df.union(df), "id", "text", 0.6)
    assert {tuple(r) for r in again.pairs().collect()} == want


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    found = near_duplicates(df, "id", "text")
    assert found.pairs().count() == 0 and found.classes().count() == 0


def test_a_threshold_that_is_met_exactly_counts(spark):
    # 8 shingles each, 6 in common: 6 / 10
    a, b = " ".join(WORDS[:12]), " ".join(WORDS[:10] + ["x", "y"])
    assert jaccard(shingles(a), shingles(b)) == 0.6
    df = spark.createDataFrame([(1, a), (2, b)], "id bigint, text string")
    assert near_duplicates(df, "id", "text", 0.6).pairs().count() == 1


def test_registers_are_mergeable():
    p = Sketch()
    from tracemill.llm.near_duplicates import registers

    a, b = np.sort(np.random.default_rng(1).integers(0, 1 << 63, (2, 300), dtype=np.uint64), axis=1)
    whole = np.unique(np.concatenate([a, b]))
    each = registers(np.concatenate([a, b]), np.array([0, 300, 600]), p)
    assert (np.maximum(each[0], each[1]) == registers(whole, np.array([0, len(whole)]), p)[0]).all()


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    t = "alpha beta_1 gamma " * 50 + "é ü delta"
    whole, _ = hashing.word_hashes([t, None, "x"])
    monkeypatch.setattr(hashing, "PIECE", 7)
    cut, offsets = hashing.word_hashes([t, None, "x"])
    assert (whole == cut).all() and offsets.tolist() == [0, 151, 151, 152]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a bigint, b bigint"), "a", "b").collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_difference_covers_are_perfect():
    for q in (2, 3, 5, 7, 11, 13):
        period, residues = difference_cover(q)
        assert sorted((a - b) % period for a in residues for b in residues if a != b) == list(range(1, period))
    assert cover_for(240)[2] + cover_for(240)[0] - 1 <= 240
    assert cover_for(5) == (1, [0], 5) or cover_for(5)[2] >= 1


def common(a, b, length):
    windows = {a[i : i + length] for i in range(len(a) - length + 1)}
    return any(b[i : i + length] in windows for i in range(len(b) - length + 1))


def test_shared_spans_equal_brute_force(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz \n(){};é😀"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    parts = [noise(n) for n in (239, 240, 241, 300, 500)]
    rows = []
    for i in range(60):
        t = noise(rng.randrange(0, 400))
        for p in rng.sample(parts, rng.randrange(0, 3)):
            t += p + noise(rng.randrange(0, 150))
        rows.append((i, t))
    rows += [(60, max((t for _, t in rows), key=len)), (61, None), (62, ""), (63, "0" * 700), (64, "x" + "0" * 300), (65, "0" * 239)]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("key", F.lit(1))
    by = {i: t for i, t in rows if t}
    want = {(i, j) for i in by for j in by if i < j and common(by[i], by[j], 240)}
    found = shared_spans(df, "id", "text", 240)
    assert {tuple(r) for r in found.pairs().collect()} == want
    share = {r.id: r for r in found.coverage().collect()}
    assert share[60].share == 1.0 and all(0 <= r.share <= 1 for r in share.values())
    assert {i for i, r in share.items() if r.shared_chars} == {x for pair in want for x in pair}
    assert {r.id for r in found.partners().collect()} == {x for pair in want for x in pair}


def test_a_heading_shared_by_many_is_no_span(spark):
    rng = random.Random(2)
    head = "".join(rng.choice("abcdef ") for _ in range(200))
    longer = head + "".join(rng.choice("abcdef ") for _ in range(60))
    rows = [(i, (longer if i % 50 == 0 else head) + "".join(rng.choice("ghijkl") for _ in range(120))) for i in range(HOT + 90)]
    got = {tuple(r) for r in shared_spans(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", 240).pairs().collect()}
    held = [i for i, t in rows if t.startswith(longer)]
    assert got == {(a, b) for a in held for b in held if a < b}


def test_coverage_holds_every_span_of_a_hot_group(spark):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    head, tail = noise(250), noise(260)
    rows = [(i, head + noise(20 + i % 133) + tail) for i in range(798)]
    rows[0] = (0, head + "-" * 50 + head + "+" * 50 + tail)
    holders = {}
    for i, t in rows:
        for k in range(len(t) - 239):
            holders.setdefault(t[k : k + 240], set()).add(i)
    want = {}
    for i, t in rows:
        marked = set()
        for k in range(len(t) - 239):
            if len(holders[t[k : k + 240]]) > 1:
                marked.update(range(k, k + 240))
        want[i] = (len(t), len(marked))
    found = shared_spans(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", 240)
    assert {r.id: (r.chars, r.shared_chars) for r in found.coverage().collect()} == want
    assert {r.partners for r in found.partners().collect()} == {797}


@pytest.mark.parametrize("n", [HOT - 1, HOT, HOT + 1])
def test_coverage_on_both_sides_of_a_hot_group(spark, n):
    rng = random.Random(n)
    noise = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    part = noise(300)
    rows = [(i, noise(i) + part + noise(50)) for i in range(n)]
    found = shared_spans(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", 240)
    windows = Counter(w for _, t in rows for w in {t[k : k + 240] for k in range(len(t) - 239)})
    want = {i: len({x for k in range(len(t) - 239) if windows[t[k : k + 240]] > 1 for x in range(k, k + 240)}) for i, t in rows}
    assert {r.id: r.shared_chars for r in found.coverage().collect()} == want
    assert found.pairs().count() == n * (n - 1) // 2


def test_clashing_names_are_told_apart(spark, monkeypatch):
    from tracemill.llm import shared_spans as module

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id bigint, text string")
    constant = lambda *c: F.lit(5).cast("bigint") if len(c) == 1 else F.hash(*c).cast("bigint")
    monkeypatch.setattr(module.F, "xxhash64", constant)
    names = [r[0] for r in df.select(module._names(df)).collect()]
    assert names[0] == names[2] != names[1]


def test_the_filter_loses_no_id(spark):
    rows, ids = spark.range(20_000).withColumn("x", F.lit("text")), spark.range(0, 20_000, 7).withColumnRenamed("id", "k")
    for bits in (1 << 8, 1 << 12, 1 << 20):
        kept = possible(rows, "id", ids, bits)
        assert kept.join(ids.withColumnRenamed("k", "id"), "id").count() == ids.count()
    assert kept.count() < 1.01 * ids.count()
    assert possible(rows, "id", ids.where("false")).count() == 0
    assert possible(rows.withColumn("id", F.lit(None).cast("bigint")), "id", ids).count() <= 20_000


def test_shared_spans_of_nothing(spark):
    found = shared_spans(spark.createDataFrame([], "id bigint, text string"), "id", "text", 240)
    assert found.pairs().count() == 0 and found.coverage().count() == 0


def test_positions_beyond_the_packed_bits(spark):
    rng = random.Random(3)
    part = "".join(rng.choice("abcdefgh") for _ in range(400))
    long = "".join(rng.choice("ijklmnop") for _ in range(150_000)) + part
    df = spark.createDataFrame([(1, long), (2, "zz" + part)], "id bigint, text string")
    assert [tuple(r) for r in shared_spans(df, "id", "text", 240).pairs().collect()] == [(1, 2)]


def _plain_repeats(old, new, threshold):
    clean = lambda s: re.sub(r"(?m)[ \t]+$", "", s.replace("\r\n", "\n").replace("\r", "\n"))
    seen, sets, out = {clean(s) for _, s in old if s is not None}, [shingles(s) for _, s in old if s is not None], set()
    for i, b, s in sorted((x for x in new if x[2] is not None), key=lambda x: (x[1] if x[1] is not None else 1 << 40, x[0])):
        if clean(s) in seen:
            out.add((i, "exact"))
        elif any(jaccard(shingles(s), x) >= threshold for x in sets):
            out.add((i, "near"))
        seen.add(clean(s))
        sets.append(shingles(s))
    return out


@pytest.fixture(scope="module")
def deliveries():
    rng = random.Random(11)
    old = [(i, text(rng, rng.randrange(3, 150))) for i in range(40)] + [(40, None), (41, ""), (42, "same text here and there again")]
    new = []
    for i in range(60):
        kind = rng.randrange(4)
        s = rng.choice(old)[1] if kind < 3 else text(rng, 80)
        if kind == 1 and s and len(s.split()) > 20:
            s = edited(rng, s, rng.randrange(1, 12))
        if kind == 2 and s:
            s = s.replace(" ", " \r\n", 1)
        new.append((i, rng.choice([1, 2, 3, None]), s))
    new += [(60, 1, new[5][2]), (61, 1, "only four words here")]
    return old, new


def test_repeats_equal_brute_force(spark, deliveries):
    old, new = deliveries
    h = spark.createDataFrame(old, "id bigint, source string").withColumn("name", F.lit("clash"))
    a = spark.createDataFrame(new, "arrival_id bigint, batch_no int, source string").withColumn("ref", F.lit(0)).withColumn("kind", F.lit("clash"))
    got = {(r.arrival_id, r.kind) for r in repeats(h, a, 0.6).collect()}
    assert got == _plain_repeats(old, new, 0.6)
    assert repeats(h, a.where("false"), 0.6).count() == 0
    assert {r.kind for r in repeats(h.where("false"), a, 0.6).collect()} <= {"exact", "near"}


def test_one_delivery_equals_batch_after_batch(spark, deliveries):
    old, new = deliveries
    h = spark.createDataFrame(old, "id bigint, source string")
    rows = spark.createDataFrame(new, "arrival_id bigint, batch_no int, source string").where("batch_no is not null")
    want = {tuple(r) for r in repeats(h, rows, 0.6).collect()}
    index, got = history_index(h, 0.6), set()
    for n in (1, 2, 3):
        got |= {tuple(r) for r in deliver(index, rows.where(F.col("batch_no") == n)).collect()}
    assert got == want and want
    index.drop()


OPENED = """
import sys
from pyspark.sql import SparkSession
from tracemill.llm.arrivals import deliver
from tracemill.llm.history import PrefixIndex
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.checkpoint.dir", "file://" + sys.argv[1] + "/other").config("spark.sql.warehouse.dir", sys.argv[1] + "/warehouse").getOrCreate()
index = PrefixIndex.open(spark, sys.argv[1] + "/index")
rows = spark.createDataFrame(eval(sys.argv[2]), "arrival_id bigint, batch_no int, source string")
print("RESULT", sorted(tuple(r) for r in deliver(index, rows).collect()))
"""


def test_an_index_is_opened_by_another_process(spark, deliveries, tmp_path):
    old, new = deliveries
    h = spark.createDataFrame(old, "id bigint, source string")
    rows = spark.createDataFrame(new, "arrival_id bigint, batch_no int, source string").where("batch_no is not null")
    want = sorted(tuple(r) for r in repeats(h, rows, 0.6).collect())
    index = history_index(h, 0.6, path=str(tmp_path / "index"))
    first = [tuple(r) for r in deliver(index, rows.where("batch_no = 1")).collect()]
    index.close()
    later = [x for x in new if x[1] in (2, 3)]
    out = subprocess.run([sys.executable, "-c", OPENED, str(tmp_path), repr(later)], capture_output=True, text=True, timeout=300)
    got = next(eval(x[7:]) for x in out.stdout.splitlines() if x.startswith("RESULT"))
    assert sorted(first + got) == want


def test_a_batch_reads_the_texts_of_its_shards_only(spark, tmp_path):
    rng = random.Random(8)
    h = spark.createDataFrame([(i, text(rng, 60)) for i in range(200)], "id bigint, source string")
    index = history_index(h, 0.6, path=str(tmp_path / "index"))
    one = index.texts(spark.createDataFrame([(1,)], "shard int"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "(shard#" in plan and "= 1)]" in plan
    assert 0 < one.count() < 200 and {r.shard for r in one.collect()} == {1}
    batch = spark.createDataFrame([(1, 1, h.where("id = 7").first().source + " more")], "arrival_id bigint, batch_no int, source string")
    assert [tuple(r) for r in deliver(index, batch).collect()] == [(1, "near", 1)]
    index.drop()
