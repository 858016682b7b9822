"""Best representative of each duplicate group, field by field.

Every surviving attribute is the greatest composite (usable, source priority, order..., value) of its group, so one
aggregation chooses all attributes at once; it is done per (group, entity) first, then per group, and combines on the
map side, so a group that holds a third of all rows costs no more than its distinct entities.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table
from .corpus import is_code


@dataclass(frozen=True)
class Attribute:
    """A field to survive: whether a row's value is usable, what ranks it (greatest first), and the value itself.

    priority is the trust in the row's source, which ranks before the order; without one all sources are alike. Rows that are not usable rank below all that are; if `required`, a group without a usable row gets null.
    Ties go to the smaller tie value.
    """

    name: str
    value: Column
    usable: Column
    order: tuple[Column, ...]
    tie: Column
    required: bool = False
    priority: Column | None = None


def survivors(df: DataFrame, key: list[str], attributes: list[Attribute], *more: Column) -> DataFrame:
    """One row per key with the surviving value of every attribute, and any further aggregates by their aliases.

    A null key forms a group like any other; the aggregates keep their own columns.
    """
    composites = []
    for a in attributes:
        usable = F.coalesce(a.usable, F.lit(False))
        ranks = [F.when(usable, o).alias(f"o{i}") for i, o in enumerate(a.order)]
        trusted = [F.coalesce(a.priority, F.lit(0)).alias("priority")] if a.priority is not None else []
        composites.append(F.max(F.struct(usable.alias("usable"), *trusted, *ranks, (-a.tie).alias("tie"), a.value.alias("value"))).alias(a.name))
    out = df.groupBy(*key).agg(*composites, *more)
    kept = [c for c in out.columns if c not in {*key, *(a.name for a in attributes)}]
    value = lambda a: F.when(F.col(f"{a.name}.usable"), F.col(f"{a.name}.value")) if a.required else F.col(f"{a.name}.value")
    return out.select(*key, *[value(a).alias(a.name) for a in attributes], *kept)


def instant(text: Column) -> Column:
    """The moment a registry string denotes: ISO date or date-time, zone optional (then UTC), or milliseconds since 1970."""
    s = F.trim(text)
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?\s*(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2})?)?$"
    full = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00"))).otherwise(F.regexp_replace(s, " ", "T"))
    full = F.regexp_replace(F.regexp_replace(full, ",", "."), "T(?=[+-]|Z|z)", "")
    full = F.regexp_replace(full, "z$", "Z")
    full = F.when(full.rlike(r"(Z|[+-]\d{2}:?\d{2}|[+-]\d{2})$") & ~full.rlike(r"^\d{4}-\d{2}-\d{2}$"), full).otherwise(F.concat(full, F.lit("Z")))
    return F.when(s.rlike(r"^-?\d{1,15}$"), F.timestamp_millis(s.try_cast("bigint"))).when(s.rlike(iso), full.try_cast("timestamp"))


def shape_origins(blobs: DataFrame, files: DataFrame, releases: DataFrame, projects: DataFrame, since: str = "2000-01-01") -> DataFrame:
    """(shape_hash, projects, origin_project_id, origin_at, top_project_id, downloads) of shapes that two or more projects hold.

    Blobs without a shape, and files whose blob or release is unknown, hold nothing. A project that is not listed
    has no downloads. origin_* are null where no publication time is usable.
    """
    shapes = blobs.where(is_code(F.col("language")) & F.col("shape_hash").isNotNull()).select(F.col("id").alias("blob_id"), "shape_hash").distinct()
    at = instant(F.col("first_published"))
    usable = (at >= F.lit(since).cast("timestamp")) & (at <= F.col("indexed_at").cast("timestamp"))
    dated = releases.where("project_id is not null").select(F.col("id").alias("release_id"), "project_id", F.when(usable, at).alias("at"))
    held = files.select("release_id", "blob_id").distinct().join(shapes, "blob_id").select("release_id", "shape_hash").distinct()
    per_project = held.join(dated, "release_id").groupBy("shape_hash", "project_id").agg(F.min("at").alias("at"))
    counts = projects.groupBy(F.col("id").alias("project_id")).agg(F.max(F.when(F.col("downloads") >= 0, F.col("downloads"))).alias("downloads"))
    rows = per_project.join(counts, "project_id", "left")
    tie = F.col("project_id")
    attributes = [
        Attribute("origin_project_id", F.col("project_id"), F.col("at").isNotNull(), (-F.unix_micros("at"),), tie, required=True),
        Attribute("origin_at", F.col("at"), F.col("at").isNotNull(), (-F.unix_micros("at"),), tie, required=True),
        Attribute("top_project_id", F.col("project_id"), F.col("downloads").isNotNull(), (F.col("downloads"),), tie),
        Attribute("downloads", F.col("downloads"), F.col("downloads").isNotNull(), (F.col("downloads"),), tie),
    ]
    merged = survivors(rows, ["shape_hash"], attributes, F.count("*").alias("projects"))
    return merged.where("projects >= 2").select("shape_hash", "projects", "origin_project_id", "origin_at", "top_project_id", "downloads")


def shape_origins_of(spark, folder: str) -> DataFrame:
    return shape_origins(*(table(spark, folder, name) for name in ("blobs", "scan_files", "releases", "projects")))
