"""Shared-folder staging: the only place where operators cut lineage. Its paths are those of ``rostra.plans.shared``."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from rostra.plans.shared import mark, new_path, release, remove, scratch, shared_dir

__all__ = ["ARROW_BYTES", "bound_batches", "drop", "mark", "new_path", "release", "remove", "scratch", "settle", "shared_dir", "stage"]

#: Bytes of one Arrow batch sent to a Python worker: whole texts may be megabytes long.
ARROW_BYTES = 8 << 20


def stage(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: one computation, no lineage behind it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    out = df.coalesce(partitions) if partitions else df
    out.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def drop(staged: DataFrame) -> None:
    """Delete what stage() wrote, once all that reads it is written."""
    remove(staged.sparkSession, staged.staged_path)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, for megabyte texts; a smaller setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BYTES:
        spark.conf.set(key, ARROW_BYTES)


def settle(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of plans that nothing refers to any more (their results are staged)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
