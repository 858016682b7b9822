"""Filling containers of fixed capacity by hierarchical residual packing.

Each group of items is packed best-fit, largest first. Bins that are nearly full are closed; the others go on as
items, groups are merged, and best-fit is repeated until one group is left or a round no longer saves bins. Groups
hold about GROUP items in every round, so no task grows with the input. An item is split only if it exceeds the capacity: whole containers are cut off it and the
rest is packed like any other item.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GROUP = 4096
NEARLY = 0.985
LEAST_GAIN = 0.02


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str, pattern: str = PATTERN) -> DataFrame:
    """(id, tokens) of every row with an id, by a byte-pair vocabulary; a null text has none.

    vocabulary is the path of its file (a few MB) on the driver, which sends it to the workers.
    """
    with open(vocabulary, "rb") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "tokens"])

    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "id bigint, tokens bigint")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: the fullest that still takes it, largest items first."""
    rooms: list[int] = []  # the distinct free rooms, ascending
    bins: dict[int, list[int]] = {}
    out, opened = [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        at = bisect_left(rooms, sizes[i])
        if at < len(rooms):
            room = rooms[at]
            b = bins[room].pop()
            if not bins[room]:
                del bins[room]
                rooms.pop(at)
        else:
            room, b = capacity, opened
            opened += 1
        out[i] = b
        left = room - sizes[i]
        if left not in bins:
            bins[left] = []
            insort(rooms, left)
        bins[left].append(b)
    return out


def _round(items: DataFrame, number: int, groups: int) -> DataFrame:
    """(container, capacity, item, bin, fill): one best-fit round over (container, capacity, item, size)."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item", ignore_index=True)
        capacity, group = int(frame["capacity"].iloc[0]), int(frame["part"].iloc[0])
        chosen = pd.Series(best_fit(frame["size"].tolist(), capacity))
        fill = frame["size"].groupby(chosen).transform("sum")
        name = (number << 56) + (group << 20) + chosen
        return pd.DataFrame({"container": frame["container"], "capacity": frame["capacity"], "item": frame["item"], "bin": name.astype("int64"), "fill": fill.astype("int64")})

    spread = items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(number)), F.lit(groups)))
    return spread.groupBy("container", "part").applyInPandas(pack, "container string, capacity bigint, item bigint, bin bigint, fill bigint")


def pack(sizes: DataFrame, containers: DataFrame, group: int = GROUP, nearly: float = NEARLY) -> DataFrame:
    """(container, capacity, id, piece, tokens, bin): every item (id, tokens) assigned for each container (container, capacity).

    Containers without a positive capacity are left out, repeated rows of one count once.
    piece counts the parts of a split item from 0; the bin numbers of a container are distinct for all its bins and
    negative where a whole bin is a part of one item.
    """
    kinds = containers.where("capacity > 0").groupBy("container").agg(F.max(F.col("capacity").cast("bigint")).alias("capacity"))
    listed = kinds.agg(F.collect_list(F.struct("container", "capacity")).alias("kinds"))  # one row
    each = materialise(sizes.select("id", "tokens")).join(F.broadcast(listed), F.lit(True)).select("id", "tokens", F.explode("kinds").alias("k")).select("id", "tokens", "k.container", "k.capacity")
    whole = F.floor(F.col("tokens") / F.col("capacity"))
    cut = each.withColumn("whole", F.when(F.col("tokens") > F.col("capacity"), whole).otherwise(0).cast("bigint"))
    rest = F.col("tokens") - F.col("whole") * F.col("capacity")
    items = materialise(cut.where((F.col("whole") == 0) | (rest > 0)).select("container", "capacity", F.col("id").alias("item"), rest.alias("size"), "whole"))
    parts = cut.where("whole > 0").select("container", "capacity", "id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece"))
    # the bin of a whole part is named by its item and number, apart from the others by the sign
    split = parts.select("container", "capacity", "id", "piece", F.col("capacity").alias("tokens"), (F.xxhash64("id", "piece").bitwiseAND(F.lit((1 << 63) - 1)) * -1 - 1).alias("bin"))

    most = items.groupBy("container").count().agg(F.max("count")).first()[0] or 0
    groups = max(1, -(-most // group))
    current = items.select("container", "capacity", "item", "size")
    maps: list[DataFrame] = []
    number = 0
    while True:
        done = materialise(_round(current, number, groups))
        maps.append(done.select("container", F.col("item").alias(f"from_{number}"), F.col("bin").alias(f"to_{number}")))
        if groups == 1:
            break
        current = done.where(F.col("fill") < F.col("capacity") * nearly).select("container", "capacity", F.col("bin").alias("item"), F.col("fill").alias("size")).distinct()
        before, most = most, current.groupBy("container").count().agg(F.max("count")).first()[0] or 0
        # groups stay of one size; where merging has stopped to help (all items over half a container, say), so does the packing
        if not most or (number and most > (1 - LEAST_GAIN) * before):
            break
        groups = max(1, -(-most // group))
        number += 1
    # each round's bins are far fewer than those before, so the maps are put together from the last one back
    whole_way = maps[-1].select("container", F.col(f"from_{number}").alias("bin"), F.col(f"to_{number}").alias("at")) if maps else None
    for i in range(len(maps) - 2, -1, -1):
        step = maps[i].select("container", F.col(f"from_{i}").alias("item"), F.col(f"to_{i}").alias("bin"))
        whole_way = step.join(whole_way, ["container", "bin"], "left").select("container", F.col("item").alias("bin"), F.coalesce("at", "bin").alias("at"))
    out = items.join(whole_way.withColumnRenamed("bin", "item"), ["container", "item"])
    packed = out.select("container", "capacity", F.col("item").alias("id"), F.col("whole").alias("piece"), F.col("size").alias("tokens"), F.col("at").alias("bin"))
    return packed.union(split)
