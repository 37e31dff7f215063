"""Chunks and blocks of byte columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkflow.config import SMALL, ChunkConfig
from chunkflow.functions.gear import cut_points, rolling
from chunkflow.scratch import bound_batches

#: Bytes of values whose chunks leave a task together.
TOGETHER = 2 << 20


def chunk_bytes(df: DataFrame, key: str, content: str, cfg: ChunkConfig = SMALL, data: bool = True, hashed: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, chunk_no, offset, length, data): content-defined chunks of each value, which tile it.

    Text counts as its UTF-8 bytes. Null and empty values have no chunk. Each value is cut by itself:
    no shuffle, and a task holds one value and its chunks at a time. Without ``data`` the bytes stay in
    the task. ``hashed`` adds ``hash`` (SHA-256) and ``is_duplicate``, whether an equal chunk came
    earlier in the same value, which needs no shuffle either. ``keep`` names columns to carry along.
    """
    kinds = {c: df.schema[c].dataType for c in (key, *keep)}
    fields = [T.StructField(key, kinds[key]), T.StructField("chunk_no", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]
    fields += [T.StructField("data", T.BinaryType())] * data + [T.StructField("hash", T.StringType()), T.StructField("is_duplicate", T.BooleanType())] * hashed
    schema = T.StructType(fields + [T.StructField(c, kinds[c]) for c in keep])

    def emit(batch: pa.RecordBatch, row: list, no: list, ends: list, first: list, parts: list, digests: list, again: list) -> pa.RecordBatch:
        at, end, start = pa.array(row, pa.int64()), np.array(ends, np.int64), np.array(first, np.int64)
        cols = [batch.column(0).take(at), pa.array(no, pa.int32()), pa.array(start), pa.array(end - start)]
        cols += [pa.array(parts, pa.binary())] * data + [pa.array(digests, pa.string()), pa.array(again, pa.bool_())] * hashed
        return pa.RecordBatch.from_arrays(cols + [batch.column(2 + i).take(at) for i in range(len(keep))], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [[] for _ in range(7)], 0
            for i, scalar in enumerate(batch.column(1)):
                value = scalar.as_py()
                if not value:
                    continue
                ends = cut_points(value, cfg)
                starts = [0, *ends[:-1]]
                out[0] += [i] * len(ends)
                out[1] += range(len(ends))
                out[2] += ends
                out[3] += starts
                if data or hashed:
                    parts = [value[a:b] for a, b in zip(starts, ends, strict=True)]
                    if hashed:
                        digests = [hashlib.sha256(p).hexdigest() for p in parts]
                        seen: set[str] = set()
                        out[5] += digests
                        out[6] += [d in seen or seen.add(d) is not None for d in digests]
                    if data:
                        out[4] += parts
                held += len(value)
                if held > TOGETHER:
                    yield emit(batch, *out)
                    out, held = [[] for _ in range(7)], 0
            yield emit(batch, *out)

    bound_batches(df.sparkSession)
    return df.select(key, F.col(content).cast("binary").alias("_content"), *keep).mapInArrow(run, schema)


def split_blocks(df: DataFrame, key: str, content: str, size: int = 4 << 20) -> DataFrame:
    """(key, block_no, offset, length, data): runs of ``size`` bytes, the last one shorter."""
    c = F.col(content).cast("binary")
    n = F.octet_length(c)
    at = df.select(key, c.alias("_c"), n.cast("long").alias("_n")).filter("_n > 0").withColumn("offset", F.explode(F.expr(f"sequence(0L, _n - 1, {size}L)")))
    return at.select(key, F.expr(f"cast(offset div {size} as int)").alias("block_no"), "offset", F.least(F.lit(size).cast("long"), F.col("_n") - F.col("offset")).alias("length"), F.expr(f"substring(_c, cast(offset + 1 as int), {size})").alias("data"))


def candidates(df: DataFrame, key: str, content: str, cfg: ChunkConfig = SMALL) -> DataFrame:
    """(key, strict, relaxed): how many bytes of each value may end a chunk under either mask."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("strict", T.LongType()), T.StructField("relaxed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strict, relaxed = [], []
            for value in batch.column(1).to_pylist():
                # A window reaching over the start is no candidate.
                h = rolling(np.frombuffer(value or b"", np.uint8), cfg)[cfg.bits - 1 :]
                strict.append(int((h == 0).sum()))
                relaxed.append(int((h & np.uint64((1 << (cfg.bits - 2)) - 1) == 0).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(strict), pa.array(relaxed)], names=schema.names)

    bound_batches(df.sparkSession)
    return df.select(key, F.col(content).cast("binary").alias("_content")).mapInArrow(run, schema)
