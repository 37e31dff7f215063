"""Directed links as a table: upserts, costs, neighbours and least-cost paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkflow.functions.scalar import hop_count, link_cost, path_valid
from chunkflow.scratch import Table

METRICS = ["bandwidth_mbps", "latency_ms", "packet_loss_rate"]


def with_cost(links: DataFrame) -> DataFrame:
    return links.withColumn("cost", link_cost(*(F.col(m) for m in METRICS)))


def upsert_links(links: DataFrame, changes: DataFrame, version: str = "version") -> DataFrame:
    """One row for each (src, dst), that of the greatest version; greatest metrics among equal versions."""
    m = F.struct(version, *METRICS)
    return links.unionByName(changes).groupBy("src", "dst").agg(F.max(m).alias("m")).select("src", "dst", "m.*")


def symmetrise(links: DataFrame) -> DataFrame:
    """Each link both ways; a link given both ways keeps its own metrics."""
    rows = links.select("src", "dst", *METRICS, F.lit(1).alias("own"))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *METRICS, F.lit(0).alias("own"))
    return rows.unionByName(back).groupBy("src", "dst").agg(F.max(F.struct("own", *METRICS)).alias("m")).select("src", "dst", *(F.col(f"m.{x}") for x in METRICS))


def nodes(links: DataFrame) -> DataFrame:
    return links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()


def neighbors(links: DataFrame) -> DataFrame:
    """(node, neighbor, cost), and nodes without links out with nulls."""
    out = with_cost(links).select(F.col("src").alias("node"), F.col("dst").alias("neighbor"), "cost")
    return nodes(links).join(out, "node", "left")


def has_node(links: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, known) of ``asked(node)``: whether a link starts or ends there."""
    known = nodes(links).withColumn("known", F.lit(True))
    return asked.select("node").join(known, "node", "left").select("node", F.coalesce("known", F.lit(False)).alias("known"))


def clear(links: DataFrame) -> DataFrame:
    """No links, with their columns."""
    return links.limit(0)


def shortest_paths(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst, nodes, total_cost, hops): the least path from each of ``sources(node)`` to all it reaches.

    Among paths of one cost the one of fewest hops, then the least by its nodes. Links of infinite or
    missing cost lead nowhere, and a negative cost is an error. Rounds of relaxation go on while a path
    improves; a round joins only the paths that the one before improved.
    """
    e = with_cost(links).filter(F.col("cost").isNotNull() & (F.col("cost") < float("inf"))).groupBy("src", "dst").agg(F.min("cost").alias("w"))
    held = Table(e, "links")
    e = held.df
    if e.filter("w < 0").limit(1).count():
        raise ValueError("a link has a negative cost")
    key = F.struct(F.col("total_cost"), F.col("hops"), F.col("nodes"))
    start = sources.select(F.col("node").alias("src")).distinct().join(nodes(links).withColumnRenamed("node", "src"), "src", "left_semi")
    old = Table(start.select("src", F.col("src").alias("dst"), F.array("src").alias("nodes"), F.lit(0.0).alias("total_cost"), F.lit(0).alias("hops"), F.lit(True).alias("fresh")), "paths")
    best = old.df
    while True:
        front = best.filter("fresh").select(F.col("src").alias("s"), F.col("dst").alias("via"), "nodes", "total_cost", "hops")
        step = front.join(e, front.via == e.src).filter(~F.array_contains("nodes", F.col("dst")))
        step = step.select(F.col("s").alias("src"), "dst", F.concat("nodes", F.array("dst")).alias("nodes"), (F.col("total_cost") + F.col("w")).alias("total_cost"), (F.col("hops") + 1).alias("hops"))
        both = best.select("src", "dst", key.alias("k"), F.lit(0).alias("new")).unionByName(step.select("src", "dst", key.alias("k"), F.lit(1).alias("new")))
        now = both.groupBy("src", "dst").agg(F.min(F.struct("k", "new")).alias("m")).select("src", "dst", "m.k.nodes", "m.k.total_cost", "m.k.hops", (F.col("m.new") == 1).alias("fresh"))
        now = Table(now, "paths")
        old.drop()
        best, old = now.df, now
        if not best.filter("fresh").limit(1).count():
            break
    held.drop()
    return best.select("src", "dst", "nodes", "total_cost", "hops")


def route(links: DataFrame, requests: DataFrame) -> DataFrame:
    """(src, dst, nodes, total_cost, hops, is_valid) of ``requests(src, dst)``: -1 and no nodes where there is no path.

    A path of one node, from a node to itself, costs nothing and is not valid as a route.
    """
    paths = shortest_paths(links, requests.select(F.col("src").alias("node")).distinct())
    out = requests.join(paths.drop("hops"), ["src", "dst"], "left").withColumn("total_cost", F.coalesce("total_cost", F.lit(-1.0)))
    return out.withColumn("hops", F.when(F.col("nodes").isNotNull(), hop_count(F.col("nodes"))).otherwise(0)).withColumn("is_valid", path_valid(F.col("nodes"), F.col("total_cost")))


def route_or_direct(links: DataFrame, requests: DataFrame) -> DataFrame:
    """``route``, with the direct route from source to target where none is valid (``fallback``)."""
    out = route(links, requests)
    return out.withColumn("fallback", ~F.col("is_valid")).withColumn("nodes", F.when(F.col("is_valid"), F.col("nodes")).otherwise(F.array("src", "dst")))


def shortest_path(links: DataFrame, src: str, dst: str) -> DataFrame:
    return route(links, links.sparkSession.createDataFrame([(src, dst)], "src string, dst string"))
