import struct

import pytest
from pyspark.sql import functions as F

from chunkflow.functions import codec, header
from chunkflow.operators import packet, restore
from chunkflow.plans import job


def frame(kind, offset, payload, original, magic=b"HT"):
    return struct.pack("<2sBQII", magic, kind, offset, len(payload), original) + payload


def test_header_is_little_endian(spark):
    df = spark.createDataFrame([(1, 2**40 + 0xC3, 255, 2**32 - 1), (2, 0, 8, 0), (300, 1, 1, 1)], "t int, o long, l long, n long")
    h = df.select(header.encode(*(F.col(c) for c in "toln")).alias("h"))
    got = [r.h for r in h.collect()]
    assert bytes(got[0]) == struct.pack("<2sBQII", b"HT", 1, 2**40 + 0xC3, 255, 2**32 - 1) and got[2] is None
    x = h.select(header.decode(F.col("h")).alias("x")).collect()
    assert (x[0].x.type, x[0].x.offset, x[0].x.length, x[0].x.original_length) == (1, 2**40 + 0xC3, 255, 2**32 - 1)
    big = spark.createDataFrame([(bytearray(struct.pack("<2sBQII", b"HT", 1, 2**63, 1, 1)),), (bytearray(b"short"),)], "h binary").select(header.decode(F.col("h")).alias("x")).collect()
    assert big[0].x.offset is None and big[1].x is None


@pytest.mark.parametrize(
    "tail, status",
    [(b"HT\x01", "truncated_header"), (frame(1, 0, b"abc", 3, b"XX"), "bad_magic"), (frame(9, 0, b"abc", 3), "unknown_type"), (frame(1, 0, b"abc", 3)[:-1], "truncated_payload"), (frame(2, 0, b"abc", 3) + frame(1, 3, b"z", 1), "bad_dedup_length")],
)
def test_framing_errors_stop_and_others_do_not(spark, tail, status):
    df = spark.createDataFrame([(1, bytearray(frame(1, 0, b"ok", 2) + tail)), (2, None)], "stream_id long, stream binary")
    got = [r.status for r in packet.decode_packets(df).orderBy("seq").collect()]
    assert got == ["ok", status] + (["ok"] if status == "bad_dedup_length" else [])


def test_references_need_an_earlier_packet_and_overlaps_go_to_the_last(spark):
    key = lambda b: __import__("hashlib").sha256(b).digest()[:8]
    stream = frame(2, 9, key(b"abc"), 3) + frame(1, 0, b"abc", 3) + frame(2, 5, key(b"abc"), 4) + frame(1, 1, b"XY", 2)
    df = spark.createDataFrame([(1, bytearray(stream))], "stream_id long, stream binary")
    out = restore.resolve_refs(packet.decode_packets(df), "none").cache()
    assert [(r.status, r.warning) for r in out.orderBy("seq").collect()] == [("hash_not_found", None), ("ok", None), ("ok", "size_mismatch"), ("ok", None)]
    assert bytes(restore.reassemble(out).first().content) == b"aXY\0\0abc"
    assert {(r.kind, r.start, r.end) for r in restore.coverage(out).collect()} == {("overlap", 1, 3), ("gap", 3, 5)}
    s = restore.restore_stats(out).first()
    assert (s.total_packets, s.written_bytes, s.file_size, s.errors, s.warnings) == (3, 8, 8, 1, 1)


def test_lz4_keeps_what_it_can_and_names_what_it_cannot(spark):
    df = spark.createDataFrame([(1, bytearray(b"aaaa" * 100), 400), (2, bytearray(b""), 0), (3, None, 5)], "id int, raw binary, n long")
    back = codec.decompress(codec.compress(df, "raw"), "compressed", "n", "back").orderBy("id").collect()
    assert bytes(back[0].back) == b"aaaa" * 100 and back[1].back is None and back[2].back is None
    bad = spark.createDataFrame([(bytearray(b"\xff\xff\xff"), 10)], "c binary, n long")
    assert codec.decompress(bad, "c", "n").first().data is None
    with pytest.raises(ValueError):
        codec.compress(df, "raw", level="best")
    assert codec.lz4_bound(255) == 272 and codec.lz4_bound(-1) == 0


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("compression", ["lz4", "none"])
def test_round_trip_in_any_order(spark, first, compression):
    texts = ["", "é" * 3000, "same line\n" * 900, "z" * 64]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    done = job.round_trip(df, "id", "text", compression=compression, uniques_first=first)
    assert done.verified.filter("same_size AND same_content").count() == len(texts)


def test_xxh3_of_a_known_value(spark):
    assert codec.xxh3(spark.createDataFrame([(bytearray(b"abc"),)], "b binary"), "b").first().xxh3 == "78af5f94892f3950"


def test_jobs_tell_their_result_and_clean_up(spark):
    from pathlib import Path

    from chunkflow import scratch
    from chunkflow.config import JobConfig

    df = spark.createDataFrame([(1, "é" * 3000), (2, "line\n" * 900), (3, ""), (4, None)], "id long, text string")
    assert job.run(df, "id", "text", JobConfig(dry_run=True)).status == "planned"
    out = job.run(df, "id", "text", JobConfig(level="high", uniques_first=True))
    assert out.status == "done" and {r.id for r in out.accepted.collect()} == {1, 2, 3}
    assert out.report["chunks_total"] == out.report["chunks_unique"] + out.report["chunks_duplicate"] and out.report["read_mib_s"] > 0
    folders = [Path(t.path.removeprefix("file:")) for t in out.tables]
    assert len(folders) == 4 and all(f.exists() for f in folders)
    out.close()
    assert not any(f.exists() for f in folders) and not set(map(str, folders)) & set(scratch._left)


def test_a_job_whose_values_come_back_changed_has_failed(spark, monkeypatch):
    lost = job.to_streams
    monkeypatch.setattr(job, "to_streams", lambda p: lost(p.filter("NOT (stream_id = 2 AND seq = 1)")))
    df = spark.createDataFrame([(1, "é" * 3000), (2, "".join(map(str, range(2000))))], "id long, text string")
    out = job.run(df, "id", "text")
    assert out.status == "failed" and [r.id for r in out.accepted.collect()] == [1]
    out.close()


def test_levels_compress_differently_and_decode_alike(spark):
    import random

    rng = random.Random(0)
    raw = " ".join(rng.choices([f"w{i}" for i in range(300)], k=20_000)).encode()
    df = spark.createDataFrame([(bytearray(raw), len(raw))], "raw binary, n long")
    sizes = {}
    for level in codec.LEVELS:
        r = codec.decompress(codec.compress(df, "raw", level=level), "compressed", "n", "back").first()
        sizes[level] = len(r.compressed)
        assert bytes(r.back) == raw
    assert sizes["high"] <= sizes["default"] < sizes["fast"]


def test_codecs_hold_a_few_long_values_at_a_time(spark):
    import pyarrow as pa
    from pyspark.sql import types as T

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.range(0, 40, 1, 1).select(F.expr("cast(repeat('x', 1048576) as binary)").alias("raw"))
    rows = codec._append(df, "rows", T.LongType(), lambda b: pa.array([b.num_rows] * b.num_rows, pa.int64()))
    assert max(r.rows for r in rows.select("rows").collect()) <= 9


@pytest.mark.parametrize("step", ["chunks", "candidates", "decode"])
def test_steps_on_whole_values_bound_their_batches(spark, step):
    from chunkflow.operators import chunk

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    df = spark.createDataFrame([(1, bytearray(b"abc"))], "stream_id long, stream binary")
    {"chunks": chunk.chunk_bytes, "candidates": chunk.candidates, "decode": lambda d, *_: packet.decode_packets(d)}[step](df, "stream_id", "stream")
    assert int(spark.conf.get(name).rstrip("b")) <= 8 << 20


def test_plans_cut_each_value_once(spark):
    from chunkflow.plans.queries import QUERIES

    for name in ("dedup_report", "dedup_by_source", "packet_headers", "send_report"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1, name


def test_streamed_references_wait_for_their_chunk(spark, tmp_path):
    from chunkflow.streaming import flows

    key = __import__("hashlib").sha256(b"abc").digest()[:8]
    ok = lambda sid, seq, kind, off, data: (sid, seq, kind, off, len(data), 3, bytearray(data), "ok")
    batches = [[ok(1, 4, 2, 12, key), ok(1, 0, 2, 0, key), ok(2, 1, 2, 3, key)], [ok(1, 1, 1, 3, b"abc"), (1, 9, None, None, None, None, None, "bad_magic")], [ok(1, 2, 2, 6, key)]]
    out = f"{tmp_path}/out"
    for b in batches:
        spark.createDataFrame(b, packet.PACKET).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(packet.PACKET).parquet(f"{tmp_path}/in")
        flows.resolve_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r.stream_id, r.seq, r.offset, bytes(r.data) if r.data else None, r.status) for r in spark.read.schema(flows.RESOLVED).parquet(out).collect()}
    assert got == {(1, 1, 3, b"abc", "ok"), (1, 4, 12, b"abc", "ok"), (1, 2, 6, b"abc", "ok"), (1, 9, None, None, "bad_magic")}


def test_streamed_references_go_on_once_and_need_an_earlier_chunk(spark, tmp_path):
    from chunkflow.streaming import flows

    key = __import__("hashlib").sha256(b"abc").digest()[:8]
    ok = lambda sid, seq, kind, off, data: (sid, seq, kind, off, len(data), 3, bytearray(data), "ok")
    rows = [ok(1, 0, 2, 0, key), ok(1, 1, 1, 3, b"abc"), ok(1, 2, 1, 6, b"abc"), ok(1, 5, 2, 9, key), ok(1, 5, 2, 9, key), ok(None, 0, 1, 0, b"abc"), ok(None, 1, 2, 3, key)]
    spark.createDataFrame(rows, packet.PACKET).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(packet.PACKET).parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with flows.state_on_disk(spark):
        flows.resolve_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert spark.conf.get(name) == before
    got = [(r.stream_id, r.seq, r.offset, bytes(r.data)) for r in spark.read.schema(flows.RESOLVED).parquet(f"{tmp_path}/out").collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, 3, b"abc"), (1, 2, 6, b"abc"), (1, 5, 9, b"abc"), (None, 0, 0, b"abc"), (None, 1, 3, b"abc")], key=repr)


def test_files_of_a_packet_stream_follow_the_content(spark, tmp_path, monkeypatch):
    from chunkflow.plans import queries

    monkeypatch.setattr(queries, "PER_FILE", 16 << 10)
    spark.createDataFrame([(i, f"{i} " * 256) for i in range(400)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.packet_files(spark, str(tmp_path), f"{tmp_path}/stream").isStreaming
    per = [r["count"] for r in spark.read.parquet(f"{tmp_path}/stream/in").groupBy(F.input_file_name()).count().collect()]
    assert len(per) > 10 and max(per) < 3 * sum(per) / len(per)  # all first packets of 400 streams are no heap
