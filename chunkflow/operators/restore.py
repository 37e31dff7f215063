"""Content out of packets: references resolved, chunks put back, gaps and overlaps reported."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkflow.functions import codec, header
from chunkflow.operators.dedup import content_hash
from chunkflow.operators.packet import wire_hash


def resolve_refs(packets: DataFrame, compression: str = "lz4") -> DataFrame:
    """Adds ``data``, ``status`` and ``warning`` to decoded packets.

    A reference gets the bytes of the first data packet of its stream with that hash, if it came
    earlier; else ``hash_not_found``. Only what was decompressed whole can be referred to. A size that
    is not the announced one is a warning.
    """
    read = F.col("status") == "ok"
    is_data, is_ref = read & (F.col("type") == header.DATA), read & (F.col("type") == header.REFERENCE)
    own = packets.withColumn("data", F.when(is_data, F.col("payload")))
    own = codec.decompress(own, "data", "original_length", "data") if compression == "lz4" else own
    own = own.withColumn("status", F.when(is_data & F.col("data").isNull(), "decompress_failed").otherwise(F.col("status")))
    # One pass: packets meet by stream and hash, and a reference looks back. Others have places of their own.
    good, wanted = F.col("data").isNotNull(), read & (F.col("type") == header.REFERENCE)
    own = own.withColumn("_key", F.when(good, wire_hash(content_hash())).when(wanted, F.col("payload")).otherwise(F.encode(F.col("seq").cast("string"), "utf-8")))
    back = Window.partitionBy("stream_id", "_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.first(F.when(good, F.col("data")), ignorenulls=True).over(back)
    out = own.withColumn("_earlier", earlier).withColumn("data", F.when(wanted, F.col("_earlier")).otherwise(F.col("data")))
    out = out.withColumn("status", F.when(is_ref & F.col("data").isNull(), "hash_not_found").otherwise(F.col("status"))).drop("_key", "_earlier")
    off = F.octet_length("data") != F.col("original_length")
    return out.withColumn("warning", F.when(off, "size_mismatch"))


def reassemble(resolved: DataFrame) -> DataFrame:
    """(stream_id, content): each packet's bytes at its offset.

    Where packets overlap the later one wins, and gaps hold zeros. A file is put together in one task.
    """
    rows = resolved.filter("data IS NOT NULL AND offset IS NOT NULL").select("stream_id", "seq", "offset", "data")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        offsets, data = table.column("offset").to_pylist(), table.column("data").to_pylist()
        out = bytearray(max(o + len(d) for o, d in zip(offsets, data, strict=True)))
        for o, d in zip(offsets, data, strict=True):
            out[o : o + len(d)] = d
        return pa.table({"stream_id": table.column("stream_id").slice(0, 1), "content": pa.array([bytes(out)], pa.binary())})

    return rows.groupBy("stream_id").applyInArrow(run, "stream_id long, content binary")


def coverage(resolved: DataFrame) -> DataFrame:
    """(stream_id, kind, start, end): gaps before packets, and stretches written before."""
    w = Window.partitionBy("stream_id").orderBy("offset", "end", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = resolved.filter("data IS NOT NULL").select("stream_id", "seq", "offset", (F.col("offset") + F.octet_length("data")).alias("end"))
    reach = rows.withColumn("reach", F.coalesce(F.max("end").over(w), F.lit(0)))
    gap = reach.filter("offset > reach").select("stream_id", F.lit("gap").alias("kind"), F.col("reach").alias("start"), F.col("offset").alias("end"))
    over = reach.filter("offset < reach").select("stream_id", F.lit("overlap").alias("kind"), F.col("offset").alias("start"), F.least("end", "reach").alias("end"))
    return gap.unionByName(over)


def progress(resolved: DataFrame, every: int = 10) -> DataFrame:
    """(stream_id, packets, written, furthest) after each ``every`` packets of a stream that were written."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("data").cast("long")
    rows = resolved.filter("status = 'ok' AND data IS NOT NULL")
    run = rows.select("stream_id", F.row_number().over(w).cast("long").alias("packets"), F.sum(size).over(w).alias("written"), F.max(F.col("offset") + size).over(w).alias("furthest"))
    return run.filter(F.col("packets") % every == 0)


def restore_stats(resolved: DataFrame, *by: str) -> DataFrame:
    """Packets done, payload bytes read, bytes written, size of the file, errors and warnings."""
    done = (F.col("status") == "ok") & F.col("data").isNotNull()
    size = F.octet_length("data").cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return resolved.groupBy(*by).agg(
        F.count_if(done).alias("total_packets"),
        zero(F.sum(F.octet_length("payload"))).alias("payload_bytes"),
        zero(F.sum(F.when(done, size))).alias("written_bytes"),
        zero(F.max(F.when(done, F.col("offset") + size))).alias("file_size"),
        F.count_if(F.col("status") != "ok").alias("errors"),
        F.count_if(F.col("warning").isNotNull()).alias("warnings"),
    )


def verify(source: DataFrame, restored: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, source_size, restored_size, same_size, same_content): every key of either side."""
    side = lambda d, n: d.select(key, F.octet_length(F.col(content).cast("binary")).cast("long").alias(f"{n}_size"), F.sha2(F.col(content).cast("binary"), 256).alias(f"{n}_hash"))
    both = side(source, "source").join(side(restored, "restored"), key, "full_outer")
    equal = lambda n: F.coalesce(F.col(f"source_{n}") == F.col(f"restored_{n}"), F.lit(False))
    return both.select(key, "source_size", "restored_size", equal("size").alias("same_size"), equal("hash").alias("same_content"))
