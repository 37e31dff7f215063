"""Scratch tables, markers of finished batches and samples by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkflow.scratch import Table, bound_batches, exists, new_path, remove, shared_dir

__all__ = ["Table", "bound_batches", "collect_garbage", "committed", "exists", "new_path", "plan_bytes", "remove", "sampled", "shared_dir", "trim"]


def committed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the subfolders of ``folder`` that a writer has finished; its marker comes last."""
    if not exists(spark, folder):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted(n for n in (s.getPath().getName() for s in found) if exists(spark, f"{folder}/{n}/_SUCCESS"))


def sampled(share: Column | float, *by: str | Column) -> Column:
    """Whether a row is in a sample of ``share``, by the hash of ``by``: to 53 bits, so any share of any table is met."""
    return F.pmod(F.xxhash64(*by, F.lit(5)), F.lit(1 << 53)).cast("double") < share * F.lit(2.0**53)


def plan_bytes(df: DataFrame) -> int:
    """What Catalyst expects the input to weigh, from file sizes; sets numbers of buckets and first guesses, never what is computed.

    Where Catalyst has no idea, 4 KB a row.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else df.count() << 12


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete what plans no longer referenced have left, and gives the driver's free memory back."""
    import gc

    gc.collect()
    trim()
    spark._jvm.System.gc()


def trim() -> None:
    """Gives the memory that this process has freed back to the system; glibc and Arrow keep it otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)
