import random

import pytest
from pyspark.sql import functions as F

from chunkflow.config import SMALL, ChunkConfig, JobConfig
from chunkflow.functions.gear import _stateful, cut_points
from chunkflow.operators.chunk import chunk_bytes, split_blocks
from chunkflow.operators.dedup import drop_duplicates, mark_duplicates, report

VALUES = [b"", b"a", b"x" * 64, b"x" * 65, b"q" * 1024, b"\xff" * 5000, bytes(random.Random(1).randbytes(9000)), ("çé wörter " * 900).encode()]


def stepwise(data, cfg):
    out, pos = [], 0
    while pos < len(data):
        pos += _stateful(data[pos:], cfg)
        out.append(pos)
    return out


@pytest.mark.parametrize("cfg", [SMALL, ChunkConfig(16, 64, 256, None), ChunkConfig(0, 4, 64, None), ChunkConfig(64, 64, 64, None)])
@pytest.mark.parametrize("data", VALUES)
def test_windowed_cuts_are_those_of_the_rolling_hash(data, cfg):
    ends = cut_points(data, cfg)
    assert ends == stepwise(data, cfg)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert sum(sizes) == len(data) and all(cfg.least < n <= cfg.greatest or cfg.least == cfg.greatest == n for n in sizes[:-1])


def test_blocks_are_cut_by_themselves():
    cfg, data = ChunkConfig(64, 256, 1024, 1000), VALUES[6]
    assert set(range(1000, 9001, 1000)) <= set(cut_points(data, cfg))


@pytest.mark.parametrize("bad", [(5, 4, 8), (0, 3, 8), (-1, 4, 8), (4, 8, 7)])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        ChunkConfig(*bad)
    with pytest.raises(ValueError):
        JobConfig(compression="zip")


def test_chunks_tile_values_and_nulls_have_none(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)] + [(99, None)], "id int, v binary")
    rows = chunk_bytes(df, "id", "v").orderBy("id", "offset").collect()
    got = {}
    for r in rows:
        assert r.offset == len(got.get(r.id, b"")) and r.length == len(r.data)
        got[r.id] = got.get(r.id, b"") + bytes(r.data)
    assert got == {i: v for i, v in enumerate(VALUES) if v}
    blocks = split_blocks(df, "id", "v", 1000).orderBy("id", "offset").collect()
    assert b"".join(bytes(r.data) for r in blocks if r.id == 6) == VALUES[6] and max(r.length for r in blocks) == 1000


def test_first_occurrence_is_by_file_and_offset(spark):
    rows = [(2, 0, 1, b"a"), (1, 5, 1, b"a"), (1, 9, 1, b"a"), (1, 0, 1, b"b"), (2, 1, 1, b"b")]
    df = spark.createDataFrame(rows, "id int, offset long, length long, data binary")
    dup = lambda scope: {(r.id, r.offset) for r in mark_duplicates(df, "id", scope).filter("is_duplicate").collect()}
    assert dup("file") == {(1, 9)} and dup("global") == {(1, 9), (2, 0), (2, 1)}
    assert drop_duplicates(df, "id", "global").count() == 2
    r = report(mark_duplicates(df, "id", "global")).first()
    assert (r.chunks, r.unique_chunks, r.duplicate_bytes, r.duplicate_percent) == (5, 2, 3, 60.0)
    assert report(mark_duplicates(df.limit(0), "id")).first().duplicate_percent == 0.0


def test_expected_totals_of_the_flagship(spark):
    from chunkflow.plans.queries import QUERIES

    r = QUERIES["dedup_report"](spark, "/root/testdata/sf0.001").first()
    assert (r.chunks, r.bytes, r.duplicate_chunks, r.duplicate_bytes) == (2339, 495892, 218, 39666)
    assert F is not None
