"""Packets: framing of chunks, streams of packets, and their decoding with an account of errors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkflow.functions import codec, header
from chunkflow.functions.scalar import mib_per_second, percent
from chunkflow.scratch import bound_batches

#: Bytes of streams whose packets leave a task together.
TOGETHER = 2 << 20
PACKET = "stream_id long, seq long, type short, offset long, length long, original_length long, payload binary, status string"
#: Errors that end a stream, and those of single packets.
FRAMING = ("truncated_header", "bad_magic", "unknown_type", "truncated_payload")
PER_PACKET = ("bad_dedup_length", "decompress_failed", "hash_not_found")


def wire_hash(hash_: str | Column = "hash") -> Column:
    """The eight bytes that stand for a chunk: the first of its hexadecimal hash."""
    return F.unhex(F.substring(hash_, 1, 16))


def encode_packets(marked: DataFrame, key: str, compression: str = "lz4", uniques_first: bool = False, seed: int = 42, level: str = "default") -> DataFrame:
    """(stream_id, seq, type, offset, length, original_length, header, payload) of marked chunks.

    A repeated chunk becomes a reference of eight bytes; others carry their bytes, as an LZ4 block or,
    with ``compression="none"``, as they are. Only bytes that are sent reach the codec. Packets go by
    ``chunk_no`` where there is one and all are sent, else by offset; ``uniques_first`` sends data before
    references, each in an order that ``seed`` shuffles; decoding does not depend on it.
    """
    if compression not in ("lz4", "none"):
        raise ValueError("compression must be lz4 or none")
    numbered = "chunk_no" in marked.columns and not uniques_first
    rows = marked.select(F.col(key).cast("long").alias("stream_id"), "offset", F.col("length").alias("original_length"), "is_duplicate", *(["chunk_no"] if numbered else []), wire_hash().alias("_hash"), F.when(~F.col("is_duplicate"), F.col("data")).alias("payload"))
    rows = codec.compress(rows, "payload", "payload", level) if compression == "lz4" else rows
    rows = rows.withColumn("payload", F.when(F.col("is_duplicate"), F.col("_hash")).otherwise(F.col("payload"))).drop("_hash")
    order = [F.col("is_duplicate"), F.xxhash64("offset", F.lit(seed)), F.col("offset")] if uniques_first else [F.col("offset")]
    # Chunks of whole values are numbered already; else one file's chunks are one partition of a window.
    seq = F.col("chunk_no") if numbered else F.row_number().over(Window.partitionBy("stream_id").orderBy(*order)) - 1
    kind = F.when(F.col("is_duplicate"), header.REFERENCE).otherwise(header.DATA)
    size = F.octet_length("payload").cast("long")
    return rows.select("stream_id", seq.cast("long").alias("seq"), kind.cast("short").alias("type"), "offset", size.alias("length"), "original_length", header.encode(kind, F.col("offset"), size, F.col("original_length")).alias("header"), "payload")


def to_streams(packets: DataFrame) -> DataFrame:
    """(stream_id, stream): all packets of a stream, one after another."""
    rows = packets.select("stream_id", "seq", F.concat("header", "payload").alias("b"))
    return rows.groupBy("stream_id").agg(F.expr("listagg(b) WITHIN GROUP (ORDER BY seq)").alias("stream"))


def send_report(packets: DataFrame, seconds: float | None = None, *by: str) -> DataFrame:
    """What a sender counts: bytes read and chunked, compressed and sent; chunks in all, repeated and unique.

    ``compressed_percent`` is compressed bytes of unique chunks over all bytes read, ``duplicate_percent`` is
    by number of chunks. ``seconds`` is the time taken, for ``read_mib_s`` and ``sent_mib_s``.
    """
    repeated = F.col("type") == header.REFERENCE
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = packets.groupBy(*by).agg(
        zero(F.col("original_length")).alias("bytes_read"),
        zero(F.col("original_length")).alias("bytes_chunked"),
        zero(F.when(~repeated, F.col("length"))).alias("bytes_compressed"),
        zero(F.col("length") + header.SIZE).alias("bytes_sent"),
        F.count("*").alias("chunks_total"),
        F.count_if(repeated).alias("chunks_duplicate"),
        F.count_if(~repeated).alias("chunks_unique"),
    )
    share = lambda a, b: F.round(F.coalesce(percent(F.col(a), F.col(b)), F.lit(0.0)), 6)
    out = out.withColumn("compressed_percent", share("bytes_compressed", "bytes_read")).withColumn("duplicate_percent", share("chunks_duplicate", "chunks_total"))
    if seconds is None:
        return out
    rate = lambda c: F.round(mib_per_second(F.col(c), F.lit(seconds)), 6)
    return out.withColumn("read_mib_s", rate("bytes_read")).withColumn("sent_mib_s", rate("bytes_sent"))


def decode_packets(streams: DataFrame) -> DataFrame:
    """Packets of ``streams(stream_id, stream)`` with a ``status``.

    Framing errors end a stream with a row that names them; a reference whose payload is not eight
    bytes, or a data packet that cannot be decompressed later, is an error of its own and the stream
    goes on. Bytes after the last whole packet are an error too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = struct.Struct("<2sBQII")
        schema = pa.schema([("stream_id", pa.int64()), ("seq", pa.int64()), ("type", pa.int16()), ("offset", pa.int64()), ("length", pa.int64()), ("original_length", pa.int64()), ("payload", pa.binary()), ("status", pa.string())])
        def emit(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 8, schema, strict=True)], schema=schema)

        for batch in batches:
            rows, held = [], 0
            for sid, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, at, seq = value.as_py() or b"", 0, 0
                while at < len(data):
                    if len(data) - at < header.SIZE:
                        rows.append((sid, seq, None, None, None, None, None, "truncated_header"))
                        break
                    magic, kind, offset, length, original = head.unpack_from(data, at)
                    at += header.SIZE
                    offset = offset if offset < 1 << 63 else None
                    status = "bad_magic" if magic != bytes.fromhex(header.MAGIC) or offset is None else "unknown_type" if kind not in (header.DATA, header.REFERENCE) else "truncated_payload" if len(data) - at < length else None
                    if status:
                        rows.append((sid, seq, kind, offset, length, original, None, status))
                        break
                    payload = data[at : at + length]
                    at += length
                    rows.append((sid, seq, kind, offset, length, original, payload, "bad_dedup_length" if kind == header.REFERENCE and length != 8 else "ok"))
                    seq += 1
                held += len(data)
                if held > TOGETHER:
                    yield emit(rows)
                    rows, held = [], 0
            yield emit(rows)

    bound_batches(streams.sparkSession)
    return streams.select(F.col("stream_id").cast("long"), "stream").mapInArrow(run, PACKET)


def packet_schema() -> T.StructType:
    return T._parse_datatype_string(PACKET)
