"""Streaming twins of the event operators: edits, idempotent ingestion, hash chains and rate limits."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.provenance import signal
from ..session import scratch_path


KEEP_MS = 7 * 86_400_000
# a watermark begins at 1970, so hits are dated ahead to keep those of that time
AHEAD_MS = 365 * 86_400_000


def classified_edits(edits: DataFrame, watermark: str = "7 days") -> DataFrame:
    """(file, at, event_id, elapsed_ms, signal) of a stream (file, at timestamp, event_id, chars, lines, replacement).

    State is the time of the last event of each file. Events of one trigger are taken in order of their time; state
    goes once the watermark has passed the file's last event by the watermark again.
    """

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        last = state.get[0] if state.exists else None
        ms = rows["at"].astype("datetime64[ms]").astype("int64")
        before = [last, *ms.tolist()[:-1]]
        rows = rows.assign(file=key[0], elapsed_ms=pd.Series([None if b is None else int(m - b) for m, b in zip(ms, before)], index=rows.index, dtype="Int64"))
        state.update((int(ms.iloc[-1]),))
        state.setTimeoutTimestamp(max(int(ms.iloc[-1]), state.getCurrentWatermarkMs()) + KEEP_MS)
        yield rows[["file", "at", "event_id", "chars", "lines", "replacement", "elapsed_ms"]]

    timed = edits.withWatermark("at", watermark).groupBy("file").applyInPandasWithState(
        step, "file string, at timestamp, event_id bigint, chars bigint, lines bigint, replacement boolean, elapsed_ms bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    return timed.withColumn("signal", signal(F.col("chars"), F.col("lines"), F.col("elapsed_ms"), F.col("replacement")))


def once(events: DataFrame, key: str, at: str, watermark: str = "1 day") -> DataFrame:
    """Each event once, as long as its repeats arrive within the watermark."""
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])


def chained(events: DataFrame) -> DataFrame:
    """(stream, seq, event_id, previous_hash, event_hash) of a stream (stream, event_id, body).

    State is the last link of each stream, which never goes: a later event must continue its chain. Events of one trigger are
    taken in order of their ids, those of later triggers come after them.
    """

    def step(key, frames, state: GroupState):
        rows = pd.concat(list(frames)).sort_values("event_id")
        last, seq = state.get if state.exists else (None, 0)
        out = []
        for event, body in zip(rows["event_id"], rows["body"]):
            digest = hashlib.sha256(json.dumps({"body": body, "previousEventHash": last or None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
            out.append((key[0], seq, event, last or None, digest))
            last, seq = digest, seq + 1
        state.update((last, seq))
        yield pd.DataFrame(out, columns=["stream", "seq", "event_id", "previous_hash", "event_hash"])

    return events.groupBy("stream").applyInPandasWithState(step, "stream string, seq bigint, event_id bigint, previous_hash string, event_hash string", "last string, seq bigint", "append", GroupStateTimeout.NoTimeout)


def rate_limited(hits: DataFrame, most: int = 10, window_ms: int = 600_000, watermark: str = "1 day") -> DataFrame:
    """(key, ms, hit_id, allowed) of a stream (key, ms, hit_id); state is the times allowed in the window, `most` at most.

    The state of a key goes once the watermark has passed its last hit by the window; hits that come later than the
    watermark are too late for any decision and are left out, as in every stream with a watermark.
    """

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        allowed = list(state.get[0]) if state.exists else []
        out = []
        rows = pd.concat(list(frames)).sort_values(["ms", "hit_id"])
        for ms, hit in zip(rows["ms"], rows["hit_id"]):
            allowed = [x for x in allowed if x > ms - window_ms]
            ok = len(allowed) < most
            if ok:
                allowed.append(int(ms))
            out.append((key[0], ms, hit, ok))
        state.update((allowed,))
        state.setTimeoutTimestamp(max(int(rows["ms"].iloc[-1]) + AHEAD_MS, state.getCurrentWatermarkMs()) + window_ms + 1)
        yield pd.DataFrame(out, columns=["key", "ms", "hit_id", "allowed"])

    timed = hits.withColumn("at", F.timestamp_millis(F.col("ms") + AHEAD_MS)).withWatermark("at", watermark)
    return timed.groupBy("key").applyInPandasWithState(step, "key string, ms bigint, hit_id bigint, allowed boolean", "allowed array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what its source holds now, into a table of the shared folder, and read that."""
    target = scratch_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a test folder as a file stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
