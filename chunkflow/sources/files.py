"""Files as rows: content, sizes and blocks in; restored content and packet streams out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkflow.operators.chunk import split_blocks


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, content). Content is read only by plans that use it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    return read_files(spark, path).select("path", "length")


def read_blocks(spark: SparkSession, path: str, size: int = 4 << 20) -> DataFrame:
    """(path, block_no, offset, length, data)."""
    return split_blocks(read_files(spark, path), "path", "content", size)


def read_ranges(spark: SparkSession, path: str, size: int = 4 << 20) -> DataFrame:
    """``read_blocks`` for files of any size: each task opens a file at its block and reads no more.

    Blocks are dealt to tasks by place, so one large file is read by many of them.
    """
    schema = "path string, block_no int, offset long, length long, data binary"
    sizes = file_sizes(spark, path).filter("length > 0")
    at = sizes.withColumn("offset", F.explode(F.expr(f"sequence(0L, length - 1, {size}L)"))).select("path", F.expr(f"cast(offset div {size} as int)").alias("block_no"), "offset", F.least(F.lit(size).cast("long"), F.col("length") - F.col("offset")).alias("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for i, (name, _, offset, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                where, base = fs.FileSystem.from_uri(name)
                with where.open_input_file(base) as f:
                    data = f.read_at(length, offset)
                if len(data) != length:
                    raise OSError(f"{name} has changed while it was read")
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([data], pa.binary())], names=["path", "block_no", "offset", "length", "data"])

    return at.repartition("path", "block_no").mapInArrow(run, schema)


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    """(path, stream): raw packet streams, one to a file."""
    return read_files(spark, path).select("path", F.col("content").alias("stream"))


def write_files(df: DataFrame, name: str, content: str, folder: str) -> DataFrame:
    """Writes each row's ``content`` to ``folder/name`` on a file system that executors share; (path, length) once done.

    A file is written beside its place and moved there, so a task that runs twice leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        for batch in batches:
            paths, sizes = [], []
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{base}/.{n}.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as out:
                    out.write(c or b"")
                where.move(part, f"{base}/{n}")
                paths.append(f"{base}/{n}")
                sizes.append(len(c or b""))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "length"])

    return df.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "path string, length long")
