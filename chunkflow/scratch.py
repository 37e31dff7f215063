"""Tables that cut lineage, kept in the folder that all executors share, and bounds on Arrow batches.

The folder is ``spark.checkpoint.dir`` when the session names one. Where it is unset a local folder
serves, but only if the master is local too: on a cluster each executor would write to its own disk.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DEFAULT = "file:///tmp/checkpoints/chunkflow"
_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master.partition("[")[0] != "local":
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return (named or LOCAL_DEFAULT).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of its own, removed when the program ends if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _left[path] = spark
    return path


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _left.pop(path, None)


def bound_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches of ``size`` bytes at most, unless the session asks for smaller ones: rows of texts are large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > size:
        spark.conf.set(name, str(size))


class Table:
    """A DataFrame written once to the shared folder; ``drop()`` when nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


@atexit.register
def _clean() -> None:
    for path, spark in list(_left.items()):
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone; the folder is scratch space
            pass
