"""Edit events: shape classification, composition, hash chains and attestation."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import EditThresholds

SIGNALS = ["human_signal", "bulk_insert_signal", "ai_assisted_signal", "human_modified_ai", "imported", "unknown"]


def elapsed(events: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Milliseconds since the previous event of the same key, null for the first."""
    before = F.lag(F.unix_millis(at)).over(Window.partitionBy(*keys).orderBy(at, tie))
    return events.withColumn("elapsed_ms", F.unix_millis(at) - before)


def signal(chars, lines, elapsed_ms, replacement, t: EditThresholds = EditThresholds()) -> Column:
    """The shape of one edit, biased towards unknown. The rules are tried in order."""
    timed = elapsed_ms.isNotNull()
    burst = (lines >= t.bulk_lines) & timed & (elapsed_ms <= t.bulk_ms)
    swapped = lambda otherwise: F.when(replacement, "human_modified_ai").otherwise(otherwise)
    return (
        F.when(burst, swapped("ai_assisted_signal"))
        .when((chars >= t.imported_chars) & (~timed | (elapsed_ms > t.bulk_ms)), "imported")
        .when((chars > 0) & (chars <= t.human_chars) & (~timed | (elapsed_ms >= t.human_ms)), swapped("human_signal"))
        .when((chars > t.human_chars) & timed & (elapsed_ms < t.human_ms), "ai_assisted_signal")
        .otherwise("unknown")
    )


def composition(signals: DataFrame, column: str = "signal") -> DataFrame:
    """(signal, events) for all six signals, zeros included."""
    spark = signals.sparkSession
    all_of = spark.createDataFrame([(s,) for s in SIGNALS], f"{column} string")
    return all_of.join(signals.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("events"))


def source_type(shape) -> Column:
    """Who an edit of that shape is put down to: ai, human, imported or unknown."""
    return F.when(shape.isin("ai_assisted_signal", "bulk_insert_signal"), "ai").when(shape.isin("human_signal", "human_modified_ai"), "human").when(shape == "imported", "imported").otherwise("unknown")


def actor_type(shape) -> Column:
    return F.when(shape == "imported", "external").otherwise("developer")


def folded_edit(changes) -> Column:
    """struct<chars, lines, removed, replacement> of an event's changes, an array of struct<text, removed>."""
    c = F.col(changes) if isinstance(changes, str) else changes
    total = lambda of: F.aggregate(F.transform(c, of), F.lit(0).cast("bigint"), lambda a, b: a + b)
    size = lambda x: F.coalesce(F.length(x["text"]), F.lit(0)).cast("bigint")
    gone = lambda x: F.coalesce(x["removed"], F.lit(0)).cast("bigint")
    breaks = lambda x: (size(x) - F.coalesce(F.length(F.replace(x["text"], F.lit("\n"), F.lit(""))), F.lit(0))).cast("bigint")
    return F.struct(total(size).alias("chars"), total(breaks).alias("lines"), total(gone).alias("removed"), F.exists(c, lambda x: (gone(x) > 0) & (size(x) > 0)).alias("replacement"))


# fixed values: the fields of an event that are hashed, in order of their names
EVENT_FIELDS = "actorType commitSha contentHash diffHash eventTimestamp filePath metadata ownerId parentEventId previousEventHash provider repositoryId sourceType tool".split()


def canonical_record(event: dict[str, Column], previous: Column) -> Column:
    """Canonical JSON of the whole event: all fields in order, null where they are missing, metadata {} and with sorted keys.

    eventTimestamp is a timestamp and is written as an instant with milliseconds and Z, however it was spelled.
    """
    at = event["eventTimestamp"].cast("timestamp")
    stamp = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    empty = F.create_map().cast("map<string,string>")
    meta = F.map_from_entries(F.array_sort(F.map_entries(F.coalesce(event.get("metadata", F.lit(None)).cast("map<string,string>"), empty))))
    value = lambda name: stamp if name == "eventTimestamp" else meta if name == "metadata" else previous if name == "previousEventHash" else event.get(name, F.lit(None)).cast("string")
    return F.to_json(F.struct(*[value(n).alias(n) for n in EVENT_FIELDS]), {"ignoreNullFields": "false"})


def canonical_event(fields: dict[str, Column], previous: Column) -> Column:
    """Canonical JSON of an event: keys sorted, nulls kept, the timestamp with milliseconds and Z."""
    named = fields | {"previousEventHash": previous}
    return F.to_json(F.struct(*[named[k].alias(k) for k in sorted(named)]), {"ignoreNullFields": "false"})


def _canonical(row: dict, previous: str | None) -> str:
    return json.dumps({**row, "previousEventHash": previous}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def build_chains(events: DataFrame, key: str, order: list[str], fields: dict[str, str]) -> DataFrame:
    """(key, *order, seq, previous_hash, event_hash): SHA-256 chain of the events of each key in order.

    fields maps canonical names to string columns. The chain is sequential by nature; one group is folded in Arrow
    batches sorted by the shuffle, with only the last hash as state, so a long chain is never held in memory.
    """
    columns = [key, *order, *dict.fromkeys(fields.values())]
    columns = list(dict.fromkeys(columns))
    names = {canonical: columns.index(c) for canonical, c in fields.items()}
    types = dict(events.select(*columns).dtypes)
    kept = [key, *order]
    schema = ", ".join([f"`{c}` {types[c]}" for c in kept] + ["seq bigint", "previous_hash string", "event_hash string"])

    def run(frames):
        current, last, seq = object(), None, 0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if row[0] != current:
                    current, last, seq = row[0], None, 0
                body = {n: None if pd.isna(row[i]) else str(row[i]) for n, i in names.items()}
                digest = hashlib.sha256(_canonical(body, last).encode()).hexdigest()
                out.append((*[row[columns.index(c)] for c in kept], seq, last, digest))
                last, seq = digest, seq + 1
            yield pd.DataFrame(out, columns=[*kept, "seq", "previous_hash", "event_hash"])

    sorted_rows = events.select(*columns).where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order)
    return sorted_rows.mapInPandas(run, schema)


def verify_chains(chain: DataFrame, key: str, order: list[str], recomputed: Column) -> DataFrame:
    """(key, events, intact, first_break): whether every link names its predecessor and every hash recomputes."""
    before = F.lag("event_hash").over(Window.partitionBy(key).orderBy(*order))
    checked = chain.withColumn("ok", F.col("previous_hash").eqNullSafe(before) & F.coalesce(recomputed == F.col("event_hash"), F.lit(False)))
    position = F.struct(*order)
    broken = F.min(F.when(~F.col("ok"), position))
    return checked.groupBy(key).agg(F.count("*").alias("events"), F.bool_and("ok").alias("intact"), broken.alias("first_break"))


def attestation(chain: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, statement): an in-toto statement around the ends of each chain."""
    position = F.struct(*order)
    ends = chain.groupBy(key).agg(F.count("*").alias("events"), F.min_by("event_hash", position).alias("first"), F.max_by("event_hash", position).alias("last"))
    subject = F.array(F.struct(F.col(key).cast("string").alias("name"), F.struct(F.col("last").alias("sha256")).alias("digest")))
    predicate = F.struct(F.col("events").alias("eventCount"), F.col("first").alias("firstEventHash"), F.col("last").alias("lastEventHash"))
    body = F.struct(F.lit("https://in-toto.io/Statement/v1").alias("_type"), subject.alias("subject"), F.lit("https://tracemill.example/provenance/v1").alias("predicateType"), predicate.alias("predicate"))
    return ends.select(key, F.to_json(body).alias("statement"))
