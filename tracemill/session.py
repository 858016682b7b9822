"""Session factory, table access and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH_KEY = "spark.checkpoint.dir"


def session(app: str = "tracemill", **conf: str) -> SparkSession:
    """Local session with the settings all plans assume (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The folder all executors share, read from the session; a local session that names none gets one of its own."""
    named = spark.conf.get(SCRATCH_KEY, None) or spark.sparkContext.getConf().get(SCRATCH_KEY, None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"{SCRATCH_KEY} must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tracemill-")
    spark.conf.set(SCRATCH_KEY, f"file://{folder}")
    return f"file://{folder}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/tracemill/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch(spark))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let the cleaner remove the shuffle files and checkpoints of what is no longer referred to; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def utc(column: str):
    """A zone-less timestamp column read as UTC."""
    return F.to_timestamp(F.col(column))
