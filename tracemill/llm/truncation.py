"""Texts cut off by field limits or in transfer.

Three lengths are taken of every text, without a mark that a system sets where it cuts: characters, bytes and words. For each source and measure the hazard of a
length is the share of texts that end at it among those that reach it. A length whose hazard stands out from the
hazard of its neighbours, under false-discovery control, is a limit of that source. A text is truncated if its ending is
incomplete: at a limit every doubtful ending counts, elsewhere (a cut in transfer) only an open one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

CLOSERS = "\"'`»”’)\\]}"
# endings that a system sets where it cuts
_WORDED = r"\[(more|truncated|cut|snip|continued|\.\.\.|…)\]|\((more|truncated|continued)\)|<(truncated|snip)>|\bread more"
MARKERS = rf"(?i)(…|{_WORDED})$"
CUT = rf"(?i)(\.\.\.|…|\s?({_WORDED}))$"
BLANKS = " \t\r\n\f\x0b"
# no mark with the blank before it is longer
_LONGEST_MARK = 16


def ending(text: Column) -> Column:
    """complete, open or doubtful; of a null or empty text complete.

    complete: a terminal mark (with closing marks behind it), or a last line that is a list item, code, an
    address, a status, a signature or a heading. doubtful: closing marks, an ellipsis, a quoted line without an end, a
    version number that may go on, or an open code block. A footnote or a smiley completes. open: everything else, and the marks that a system sets where it cuts.
    """
    body = F.rtrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    last = F.trim(F.substring_index(body, "\n", -1))
    inside = (F.size(F.split(body, r"(?m)^[ \t]*(```|~~~)")) - 1) % 2 == 1
    return (
        F.when(body == "", "complete")
        .when(last.rlike(MARKERS), "open")
        .when(last.rlike(r"\.\.\.$"), "doubtful")
        .when(last.rlike(r"^[ \t]*(```|~~~)"), "complete")
        .when(inside, "doubtful")
        .when(last.rlike(r"^([-*+•]|\d+[.)]|[a-z][.)])[ \t]+\S"), "complete")
        .when(last.rlike(r"^[A-Z][\w -]{0,20}: \S+( \S+)?$"), "complete")
        .when(last.rlike(r"^(--|—|– )\s*\S"), "complete")
        .when(last.rlike(r"(https?://|www\.)\S+$|\S+@\S+\.\w+>?$"), "complete")
        .when(last.rlike(r"^(#{1,6} |[|])"), "complete")
        .when(last.rlike(r"^>") & ~last.rlike(r"[.!?。！？][" + CLOSERS + r"*_]*$"), "doubtful")
        .when(last.rlike(r"(?i)\bv(ersion|ersión)? ?\d+(\.\d+)?\.$"), "doubtful")
        .when(last.rlike(r"[.!?。！？][" + CLOSERS + r"*_]*$"), "complete")
        .when(last.rlike(r"([:;]-?[)D(P]|\[\d+\])$"), "complete")
        .when(last.rlike(r"[" + CLOSERS + r"]$"), "doubtful")
        .otherwise("open")
    )


def _poisson_tail(c: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """P(X >= c) for Poisson counts, summed from c upwards until the terms vanish."""
    out = np.ones(len(c))
    for i, (k, m) in enumerate(zip(c, rate)):
        if k <= m:
            continue
        term = math.exp(k * math.log(m) - m - math.lgamma(k + 1))
        total, j = 0.0, k
        while term > total * 1e-12 and term > 0:
            total += term
            j += 1
            term *= m / j
        out[i] = min(1.0, total)
    return out


def limits(lengths: DataFrame, q: float = 0.001, reach: float = 0.1, alone: bool = False) -> DataFrame:
    """(source, measure, length, n, hazard, expected): the lengths whose hazard is significant.

    lengths has (source, measure, length), one row per different text. Neighbours are the lengths within `reach` of the
    length, at least 20 on each side; their hazard is the number of texts that end there over the number of times a
    text reached one of these lengths. expected is the number of texts that would end at the length with that hazard, or
    the mean number at the neighbours where that is greater: hazards rise by nature where the longest texts end.
    The counts per length are aggregated first, so windows run over distinct lengths and not over texts. alone: a
    length must also stand four standard errors above the three on either side.
    """
    counts = lengths.where("length > 0").groupBy("source", "measure", "length").agg(F.count("*").alias("n"))
    part = Window.partitionBy("source", "measure").orderBy(F.col("length").desc())
    risk = counts.withColumn("at_risk", F.sum("n").over(part.rowsBetween(Window.unboundedPreceding, 0)))
    # between two observed lengths as many texts are at risk as reach the greater one
    shorter = F.lag("length", 1, 0).over(Window.partitionBy("source", "measure").orderBy("length"))
    risk = risk.withColumn("exposed", F.col("at_risk") * F.least(F.col("length") - shorter, F.ceil((F.col("length") + 200) * math.sinh(reach))))
    # the reach grows with the length, so lengths are laid out on a logarithmic axis
    risk = risk.withColumn("axis", F.floor(F.log(F.col("length").cast("double") + 200.0) * 1_000_000))
    near = Window.partitionBy("source", "measure").orderBy("axis").rangeBetween(-int(reach * 1_000_000), int(reach * 1_000_000))
    around = risk.withColumn("others", F.sum("n").over(near) - F.col("n")).withColumn("reached", F.sum("exposed").over(near) - F.col("at_risk"))
    usual = (F.col("others") + 0.5) / F.greatest(F.col("reached"), F.lit(1))
    mean = (F.col("others") + 0.5) / F.floor((F.col("length") + 200) * 2 * math.sinh(reach))
    expected = F.greatest(F.col("at_risk") * F.least(usual, F.lit(1.0)), mean, F.lit(1e-3))

    @F.pandas_udf("double")
    def tail(c, rate):
        import pandas as pd

        return pd.Series(_poisson_tail(c.to_numpy(float), rate.to_numpy(float)))

    tested = around.withColumn("expected", expected).withColumn("p", tail(F.col("n").cast("double"), expected))
    ranked = Window.partitionBy("source", "measure").orderBy("p")
    whole = Window.partitionBy("source", "measure")
    passed = tested.withColumn("rank", F.row_number().over(ranked)).withColumn("m", F.count("*").over(whole))
    cut = F.max(F.when(F.col("p") <= F.col("rank") * q / F.col("m"), F.col("p"))).over(whole)
    passed = passed.withColumn("cut", cut).where(F.col("p") <= F.col("cut"))
    if alone:
        near = Window.partitionBy("source", "measure").orderBy("length")
        beside = F.greatest(F.coalesce(F.max("n").over(near.rangeBetween(-3, -1)), F.lit(0)), F.coalesce(F.max("n").over(near.rangeBetween(1, 3)), F.lit(0)))
        spikes = counts.withColumn("beside", beside).where(F.col("n") > F.col("beside") + 4 * F.sqrt(F.col("beside") + 1.0))
        passed = passed.join(spikes.select("source", "measure", "length"), ["source", "measure", "length"], "left_semi")
    # a limit in one measure also thickens the lengths in the others; the measure with the thickest single length is true,
    # and all_limits tests the others again without the texts at its limits
    thickest = F.max(F.struct("n", "measure")).over(Window.partitionBy("source"))
    passed = passed.withColumn("thickest", thickest).where("measure = thickest.measure")
    return passed.select("source", "measure", "length", "n", (F.col("n") / F.col("at_risk")).alias("hazard"), "expected")


def _at_limit(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (source, sizes, ...) with a column limited: whether one of the sizes is a limit of the source."""
    key = lambda measure, length: F.concat_ws(":", measure, length.cast("string"))
    at = found.groupBy("source").agg(F.map_from_entries(F.collect_set(F.struct(key(F.col("measure"), F.col("length")), F.lit(True)))).alias("at"))
    limited = F.exists("sizes", lambda s: F.coalesce(F.col("at")[key(s.measure, s.length)], F.lit(False)))
    return rows.join(at, "source", "left").withColumn("limited", limited).drop("at")


def all_limits(rows: DataFrame, q: float = 0.001) -> DataFrame:
    """The limits of each source in all measures, from rows (source, name, sizes); texts of one name and source count once.

    Each round accepts the limits of one measure of a source and goes on without the texts that stand at them, until
    no length is significant. What an accepted limit explains is gone then; a limit of its own is found. Lengths
    that are common in a source by nature lie side by side, so after the first round a limit must stand alone.
    """
    rest, found = materialise(rows.groupBy("source", "name").agg(F.min("sizes").alias("sizes"))), None
    while True:
        new = materialise(limits(rest.select("source", F.explode("sizes").alias("s")).select("source", "s.measure", "s.length"), q, alone=found is not None))
        found = new if found is None else found.union(new)
        if new.isEmpty():
            return found
        rest = materialise(_at_limit(rest, new).where(~F.col("limited")).drop("limited"))


def truncated(df: DataFrame, id_col: str, text_col: str, source_col: str, q: float = 0.001) -> DataFrame:
    """(id, source, ending, cause): cause is `limit`, `transfer` or null for every row with an id.

    Null texts count as empty, a null source is a source of its own. Repeated rows stay repeated.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = F.rtrim(text, F.lit(BLANKS))
    mark = F.regexp_extract(F.right(kept, F.lit(_LONGEST_MARK)), CUT, 0)
    # a mark goes with the blanks behind it; without one the text is measured as it is
    base = F.when(mark != "", kept).otherwise(text)
    inside = F.trim(kept, F.lit(BLANKS))
    words = F.when(inside == "", 0).otherwise(F.size(F.split(inside, r"\s+"))) - F.when(mark.rlike(r"^\s"), 1).otherwise(0)
    rows = materialise(
        df.where(F.col(id_col).isNotNull()).select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
            F.array(
                F.struct(F.lit("chars").alias("measure"), (F.length(base) - F.length(mark)).alias("length")),
                F.struct(F.lit("bytes").alias("measure"), (F.octet_length(base) - F.octet_length(mark)).alias("length")),
                F.struct(F.lit("words").alias("measure"), words.alias("length")),
            ).alias("sizes"),
            F.xxhash64(text).alias("name"),
            ending(F.col(text_col).cast("string")).alias("ending"),
        )
    )
    joined = _at_limit(rows.drop("name"), all_limits(rows, q))
    cause = F.when(F.col("limited") & (F.col("ending") != "complete"), "limit").when(F.col("ending") == "open", "transfer")
    return joined.select("id", "source", "ending", cause.alias("cause"))


def source_rates(found: DataFrame) -> DataFrame:
    """(source, documents, at_limit, in_transfer, rate, open_rate, usual_open_rate, excess_p) of truncated().

    open_rate is the share of open endings among the texts of the source that stand at no limit, usual_open_rate the same
    over all other sources, and excess_p the probability of as many or more by chance at that rate.
    """

    @F.pandas_udf("double")
    def tail(c, rate):
        import pandas as pd

        return pd.Series(_poisson_tail(c.to_numpy(float), rate.to_numpy(float)))

    rows = found.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("cause") == "limit").alias("at_limit"), F.count_if(F.col("cause") == "transfer").alias("in_transfer"))
    everywhere = rows.agg(F.sum("in_transfer").alias("all_open"), F.sum(F.col("documents") - F.col("at_limit")).alias("all_free"))
    free = F.col("documents") - F.col("at_limit")
    with_all = rows.join(F.broadcast(everywhere), F.lit(True))  # one row
    usual = (F.col("all_open") - F.col("in_transfer") + 0.5) / (F.col("all_free") - free + 1)
    return with_all.select(
        "source", "documents", "at_limit", "in_transfer", ((F.col("at_limit") + F.col("in_transfer")) / F.col("documents")).alias("rate"),
        F.try_divide(F.col("in_transfer"), free).alias("open_rate"), usual.alias("usual_open_rate"), tail(F.col("in_transfer").cast("double"), free * usual).alias("excess_p"),
    )
