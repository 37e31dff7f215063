"""Connected components of a table of links, by alternating large and small stars.

Each round sends every link of a node to the least node around it, so depths shrink and the links end
as stars around the least node of each component. Only counts and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkflow.llm.scratch import Table


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component) for every node of ``links(a, b)``; the component is its least node.

    Links with a null end, and links of a node with itself, connect nothing.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    held = Table(e, "links")
    mark = _mark(held.df)
    for _ in range(rounds):
        both = held.df.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(held.df.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        wide = Table(large, "links")
        least = wide.df.groupBy("hi").agg(F.min("lo").alias("m"))
        small = wide.df.join(least, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo"))).distinct()
        now = Table(small, "links")
        held.drop()
        wide.drop()
        held, before = now, mark
        mark = _mark(held.df)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return held.df.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(held.df.select("lo", "lo").distinct())
