"""Deduplication and restoration of unbounded inputs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkflow.functions import header
from chunkflow.operators.dedup import content_hash
from chunkflow.operators.packet import wire_hash
from chunkflow.operators.restore import reassemble, resolve_refs


def first_occurrences(stream: DataFrame, keys: list[str], event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows whose ``keys`` did not come before. With ``event_time`` state older than ``late`` is dropped.

    A time without zone is read as UTC, since a watermark needs a zoned one.
    """
    if event_time is None:
        return stream.dropDuplicates(keys)
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)


def collect_packets(packets: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of decoded packets to ``store``, and ends when what is there has been read.

    A micro-batch has a folder of its own, overwritten when it is repeated after a failure.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return packets.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RESOLVED = "stream_id long, seq long, offset long, data binary, status string"
_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, with one bound on its memory in each executor."""
    before = {k: spark.conf.get(k, None) for k in _ON_DISK}
    for k, v in _ON_DISK.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def resolve_stream(packets: DataFrame) -> DataFrame:
    """(stream_id, seq, offset, data, status) of a stream of decoded, uncompressed packets, each as soon as it can be.

    Errors and data packets go on at once. References meet data packets by stream and hash in a join whose
    state holds both, a row each, so neither the length of a stream nor the order of arrival matters. A
    reference takes a chunk of its hash that has a lesser number, and goes on once, however often it or
    the chunk was sent; one that is never found is never emitted. ``state_on_disk`` is for streams whose
    chunks exceed the executors' memory.
    """
    ok = F.col("status").eqNullSafe("ok")
    is_data = ok & (F.col("type") == header.DATA)
    at_once = packets.filter(~ok | is_data).select("stream_id", "seq", F.when(ok, F.col("offset")).alias("offset"), F.when(ok, F.col("payload")).alias("data"), "status")
    sent = packets.filter(is_data).select(F.col("stream_id").alias("_of"), F.col("seq").alias("_seq"), wire_hash(content_hash("payload")).alias("_hash"), F.col("payload").alias("data"))
    refs = packets.filter(ok & ~is_data).select("stream_id", "seq", "offset", F.col("payload").alias("_key"), "status")
    met = refs.join(sent, F.col("stream_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_hash")) & (F.col("_seq") < F.col("seq")))
    found = met.dropDuplicates(["stream_id", "seq", "offset", "_key"]).select("stream_id", "seq", "offset", "data", "status")
    return at_once.union(found)


def restored(spark: SparkSession, store: str, compression: str = "lz4") -> DataFrame:
    """(stream_id, content) of the packets collected so far, in whatever order they came."""
    return reassemble(resolve_refs(spark.read.parquet(store).drop("batch"), compression))
