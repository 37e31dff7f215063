import pytest
from pyspark.sql import functions as F

from chunkflow.functions import scalar
from chunkflow.operators import graph
from chunkflow.plans.queries import DEMO, LINK


@pytest.fixture(scope="module")
def demo(spark):
    return spark.createDataFrame(DEMO, LINK)


def test_relay_beats_the_direct_link(demo):
    r = graph.shortest_path(demo, "GZ", "BJ").first()
    assert (r.nodes, r.total_cost, r.hops, r.is_valid) == (["GZ", "WH", "BJ"], 30.0, 2, True)
    assert {(r.src, r.dst): r.cost for r in graph.with_cost(demo).collect()}["GZ", "BJ"] == 151.51515151515153


@pytest.mark.parametrize("src, dst, cost", [("BJ", "GZ", -1.0), ("GZ", "nowhere", -1.0), ("nowhere", "GZ", -1.0), ("GZ", "GZ", 0.0)])
def test_no_route(demo, src, dst, cost):
    r = graph.shortest_path(demo, src, dst).first()
    assert r.total_cost == cost and not r.is_valid


def test_costs_at_their_limits(spark):
    rows = [(0.0, 1.0, 0.0), (-1.0, 1.0, 0.0), (10.0, 1.0, 1.0), (10.0, 1.0, 2.0), (10.0, 1.0, -0.5)]
    got = [r.c for r in spark.createDataFrame(rows, "b double, l double, p double").select(scalar.link_cost(F.col("b"), F.col("l"), F.col("p")).alias("c")).collect()]
    assert got == [float("inf")] * 4 + [1001.0]


def test_ties_and_negative_costs(spark):
    links = spark.createDataFrame([("a", "c", 1e4, 0.0, 0.0), ("a", "b", 1e4, 0.0, 0.0), ("b", "d", 1e4, 0.0, 0.0), ("c", "d", 1e4, 0.0, 0.0), ("d", "d", 1e4, 0.0, 0.0), ("d", "e", 0.0, 0.0, 0.0)], LINK)
    assert graph.shortest_path(links, "a", "d").first().nodes == ["a", "b", "d"]
    assert graph.shortest_path(links, "a", "e").first().total_cost == -1.0
    with pytest.raises(ValueError):
        graph.shortest_path(spark.createDataFrame([("a", "b", 1e4, -9.0, 0.0)], LINK), "a", "b")


def test_last_write_wins_and_own_direction_wins(spark):
    v = lambda rows: spark.createDataFrame(rows, "src string, dst string, version int, bandwidth_mbps double, latency_ms double, packet_loss_rate double")
    r = graph.upsert_links(v([("a", "b", 1, 1.0, 1.0, 0.0)]), v([("a", "b", 2, 5.0, 1.0, 0.0), ("b", "b", 1, 1.0, 1.0, 0.0)])).collect()
    assert {(x.src, x.dst): x.bandwidth_mbps for x in r} == {("a", "b"): 5.0, ("b", "b"): 1.0}
    both = graph.symmetrise(spark.createDataFrame([("a", "b", 1.0, 1.0, 0.0), ("b", "a", 9.0, 1.0, 0.0), ("b", "c", 4.0, 1.0, 0.0)], LINK)).collect()
    assert {(x.src, x.dst): x.bandwidth_mbps for x in both} == {("a", "b"): 1.0, ("b", "a"): 9.0, ("b", "c"): 4.0, ("c", "b"): 4.0}


def test_routes_as_text(spark):
    df = spark.createDataFrame([("  GZ  WH BJ\n",), ("",)], "t string").select(scalar.parse_route(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [["GZ", "WH", "BJ"], []]
    assert [r.m for r in df.select(scalar.relay_nodes(F.col("n")).alias("m")).collect()] == [["WH"], []]


def test_nodes_known_and_links_cleared(demo, spark):
    got = graph.has_node(demo, spark.createDataFrame([("BJ",), ("nowhere",)], "node string")).collect()
    assert {r.node: r.known for r in got} == {"BJ": True, "nowhere": False}
    assert graph.clear(demo).count() == 0 and graph.clear(demo).columns == demo.columns
