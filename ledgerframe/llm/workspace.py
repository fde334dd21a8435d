"""Shared working tables: where lineage is cut, and how results survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{tempfile.gettempdir()}/ledgerframe-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later steps start from files that all executors see."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files that no plan refers to any more: its cleaner acts when the JVM collects garbage."""
    if hasattr(spark, "_jvm"):
        spark._jvm.System.gc()


def broadcast_if_small(rows: DataFrame, most: int = 1 << 21) -> DataFrame:
    """The rows marked for a broadcast join if there are at most so many; beyond that Spark shuffles both sides. For narrow, stored rows."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def most_frequent(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows with the largest counts, at most `most`. The cut is found on a histogram of the counts (a row for each
    step of about 2 %), so no sort and no top list of each partition goes through one task or the driver; of the step
    at the cut, rows are taken by their hash as far as there is room.
    """
    step = F.floor(F.log2(F.col(n)) * 32).cast("int")
    left, cut = most, None
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["step"]):
        if row["rows"] > left:
            cut = row["step"]
            break
        left -= row["rows"]
    if cut is None:
        return counts
    share = F.pmod(F.xxhash64(*counts.columns), F.lit(1 << 12))
    part = 0
    for row in sorted(counts.where(step == cut).groupBy(share.alias("share")).agg(F.count("*").alias("rows")).collect(), key=lambda r: r["share"]):
        left -= row["rows"]
        if left < 0:
            break
        part = row["share"] + 1
    return counts.where((step > cut) | ((step == cut) & (share < part)))
