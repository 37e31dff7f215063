"""Every registered base query against its SQL on the smallest tables, and the driver's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from chunkflow.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())
    r = duck.sql(ORACLE_SQL[name])
    at = [r.columns.index(c) for c in cols]
    assert len(r.columns) == len(cols)
    assert got == sorted(tuple(repr(x[i]) for i in at) for x in r.fetchall())


@pytest.mark.parametrize("name", ["packet_errors", "restore_faults"])
def test_faults_of_packets_of_any_size(spark, tmp_path, name):
    """Second packets of 1 to 12 bytes, for each fault: a byte is a truncated payload, and eight are no hash."""
    rows = [(6 * n + k, "a" * (1024 + n)) for n in range(1, 13) for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    r = c.sql(ORACLE_SQL[name])
    at = [r.columns.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1


def test_blocks_and_files_from_disk(spark, tmp_path):
    from chunkflow.sources import files

    (tmp_path / "a.bin").write_bytes(b"x" * 2500)
    (tmp_path / "empty").write_bytes(b"")
    assert {r.length for r in files.file_sizes(spark, str(tmp_path)).collect()} == {2500}  # Spark's scans leave out files without bytes
    assert sorted(r.length for r in files.read_blocks(spark, str(tmp_path), 1000).collect()) == [500, 1000, 1000]
    out = files.write_files(spark.createDataFrame([("n", bytearray(b"abc"))], "name string, content binary"), "name", "content", f"file://{tmp_path}/out").collect()
    assert out[0].length == 3 and (tmp_path / "out" / "n").read_bytes() == b"abc"
    assert bytes(files.read_streams(spark, f"{tmp_path}/out").first().stream) == b"abc"


def test_ranges_of_a_file_are_read_by_themselves(spark, tmp_path):
    from chunkflow.sources import files

    data = bytes(range(256)) * 40
    (tmp_path / "large.bin").write_bytes(data)
    rows = files.read_ranges(spark, str(tmp_path), 1000).orderBy("block_no").collect()
    assert b"".join(bytes(r.data) for r in rows) == data and [r.length for r in rows] == [1000] * 10 + [240]


def test_a_cluster_needs_a_named_folder(spark, monkeypatch):
    from chunkflow import scratch

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert scratch.shared_dir(Session) == scratch.LOCAL_DEFAULT
