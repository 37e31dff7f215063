"""Jobs over tables: route, send, restore, verify, and tell the result."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkflow.config import SMALL, ChunkConfig, JobConfig
from chunkflow.functions.scalar import host_of, relay_nodes, target_path, url
from chunkflow.operators import graph
from chunkflow.operators.chunk import chunk_bytes
from chunkflow.operators.packet import decode_packets, encode_packets, send_report, to_streams
from chunkflow.operators.restore import reassemble, resolve_refs, verify
from chunkflow.scratch import Table


def plan_routes(requests: DataFrame, links: DataFrame) -> DataFrame:
    """Route, relays and URLs of ``requests(request_id, src_host, dst_host, file_path, dst_path, port)``.

    The direct route stands in where the links have none. Nothing runs until an action does.
    """
    rows = requests.withColumn("src", host_of(F.col("src_host"))).withColumn("dst", host_of(F.col("dst_host")))
    routes = graph.route_or_direct(links, rows.select("src", "dst").distinct())
    out = rows.join(routes, ["src", "dst"], "left").withColumn("target", target_path(F.col("file_path"), F.col("dst_path")))
    return out.select("request_id", "src", "dst", "nodes", relay_nodes(F.col("nodes")).alias("relays"), "fallback", url("gsiftp", F.col("src"), F.col("port"), F.col("file_path")).alias("source_url"), url("gsiftp", F.col("dst"), F.col("port"), F.col("target")).alias("target_url"))


def packets_of(df: DataFrame, key: str, content: str, cfg: ChunkConfig = SMALL, compression: str = "lz4", uniques_first: bool = False, level: str = "default") -> DataFrame:
    """Packets of a table of values, each cut and marked in one pass."""
    return encode_packets(chunk_bytes(df, key, content, cfg, hashed=True), key, compression, uniques_first, level=level)


def send(df: DataFrame, key: str, content: str, cfg: ChunkConfig = SMALL, compression: str = "lz4", uniques_first: bool = False) -> DataFrame:
    """Packet streams (stream_id, stream) of a table of values."""
    return to_streams(packets_of(df, key, content, cfg, compression, uniques_first))


@dataclass
class RoundTrip:
    restored: DataFrame
    verified: DataFrame


def round_trip(df: DataFrame, key: str, content: str, cfg: ChunkConfig = SMALL, compression: str = "lz4", uniques_first: bool = False) -> RoundTrip:
    """Sends ``content`` as packets, restores it, and compares sizes and hashes of both sides.

    Empty values send nothing and are restored empty.
    """
    return _restore(df, key, content, send(df, key, content, cfg, compression, uniques_first), compression)


def _restore(df: DataFrame, key: str, content: str, streams: DataFrame, compression: str) -> RoundTrip:
    out = reassemble(resolve_refs(decode_packets(streams), compression)).withColumnRenamed("stream_id", key)
    source = df.select(F.col(key).cast("long").alias(key), F.col(content).cast("binary").alias("content"))
    restored = out.unionByName(source.filter("octet_length(content) = 0"))
    return RoundTrip(restored, verify(source, restored, key))


@dataclass
class Outcome:
    """``status``: planned, done or failed. ``accepted`` holds what was restored as it was sent, and nothing else."""

    status: str
    accepted: DataFrame | None = None
    verified: DataFrame | None = None
    report: dict = field(default_factory=dict)
    tables: list[Table] = field(default_factory=list)

    def close(self) -> None:
        """Removes what the job keeps in the shared folder."""
        for t in self.tables:
            t.drop()
        self.tables.clear()


def run(df: DataFrame, key: str, content: str, cfg: JobConfig | None = None) -> Outcome:
    """Sends, restores and verifies a table of values with unique keys; the job has failed unless all of it is the same.

    Streams and restored values are written to the shared folder and kept until ``close``; if a step
    raises, they are removed at once.
    """
    cfg, spark = cfg or JobConfig(), df.sparkSession
    if cfg.dry_run:
        return Outcome("planned")
    if cfg.log_level:
        spark.sparkContext.setLogLevel(cfg.log_level)
    out = Outcome("failed")
    try:
        began = time.monotonic()
        packets = Table(packets_of(df, key, content, cfg.chunks, cfg.compression, cfg.uniques_first, cfg.level), "packets")
        out.tables.append(packets)
        streams = Table(to_streams(packets.df), "streams")
        out.tables.append(streams)
        out.report = send_report(packets.df, time.monotonic() - began).first().asDict()
        trip = _restore(df, key, content, streams.df, cfg.compression)
        restored = Table(trip.restored, "restored")
        out.tables.append(restored)
        source = df.select(F.col(key).cast("long").alias(key), F.col(content).cast("binary").alias("content")).filter("content IS NOT NULL")
        verified = Table(verify(source, restored.df, key), "verified")
        out.tables.append(verified)
    except BaseException:
        out.close()
        raise
    same = F.col("same_size") & F.col("same_content")
    out.verified = verified.df
    out.accepted = restored.df.join(verified.df.filter(same).select(key), key, "left_semi")
    out.status = "failed" if verified.df.filter(~same).limit(1).count() else "done"
    return out
