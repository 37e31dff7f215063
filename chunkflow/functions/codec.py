"""LZ4 blocks and XXH3 hashes as Arrow functions; SQL has no built-in for either."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkflow.scratch import bound_batches

#: The largest input of an LZ4 block.
LZ4_MOST = 0x7E000000
#: Effort of the encoder; None is its own default. All blocks decode alike.
LEVELS = {"fast": None, "default": 3, "high": 12}


def lz4_bound(n: int) -> int:
    """The most bytes that ``n`` bytes can take; 0 where a block cannot hold them."""
    return n + n // 255 + 16 if 0 <= n <= LZ4_MOST else 0


def lz4_bound_column(n: Column) -> Column:
    return F.when(n.between(0, LZ4_MOST), n + F.floor(n / 255) + 16).otherwise(0)


def _append(df: DataFrame, name: str, kind: T.DataType, fn) -> DataFrame:  # noqa: ANN001
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = {n: batch.column(n) for n in batch.schema.names if n != name}
            yield pa.RecordBatch.from_pydict(kept | {name: fn(batch)})

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def compress(df: DataFrame, column: str, to: str = "compressed", level: str = "default") -> DataFrame:
    """Adds the LZ4 block of ``column``; null for null and empty values, an error beyond an LZ4 block."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {sorted(LEVELS)}")

    def fn(batch: pa.RecordBatch) -> pa.Array:
        codec = pa.Codec("lz4_raw", compression_level=LEVELS[level])
        out = []
        for v in batch.column(column).to_pylist():
            if v is not None and len(v) > LZ4_MOST:
                raise ValueError("the value is too long for an LZ4 block")
            out.append(codec.compress(v, asbytes=True) if v else None)
        return pa.array(out, pa.binary())

    return _append(df, to, T.BinaryType(), fn)


def decompress(df: DataFrame, column: str, size: str, to: str = "data") -> DataFrame:
    """Adds the bytes of the block in ``column`` if they are ``size`` many, else null."""

    def fn(batch: pa.RecordBatch) -> pa.Array:
        codec = pa.Codec("lz4_raw")
        out = []
        for v, n in zip(batch.column(column).to_pylist(), batch.column(size).to_pylist(), strict=True):
            try:
                out.append(codec.decompress(v, n, asbytes=True) if v and n and 0 < n <= LZ4_MOST else None)
            except (OSError, pa.ArrowException):
                out.append(None)
        return pa.array(out, pa.binary())

    return _append(df, to, T.BinaryType(), fn)


def xxh3(df: DataFrame, column: str, to: str = "xxh3") -> DataFrame:
    """Adds the XXH3-64 of ``column`` (seed 0) as 16 hexadecimal digits."""

    def fn(batch: pa.RecordBatch) -> pa.Array:
        import xxhash

        return pa.array([None if v is None else xxhash.xxh3_64_hexdigest(v) for v in batch.column(column).to_pylist()], pa.string())

    return _append(df, to, T.StringType(), fn)
