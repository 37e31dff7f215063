"""Scalar expressions over links, paths, hosts and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = float("inf")


def link_cost(bandwidth: Column, latency: Column, loss: Column) -> Column:
    """10000 / bandwidth + latency, over the share that is not lost; infinite where nothing gets through."""
    plain = F.lit(10000.0) / bandwidth + latency
    return F.when((bandwidth <= 0) | (loss >= 1), F.lit(INFINITE)).when(loss > 0, plain * (F.lit(1.0) / (F.lit(1.0) - loss))).otherwise(plain)


def path_valid(nodes: Column, cost: Column) -> Column:
    return F.coalesce((F.size(nodes) >= 2) & (cost < INFINITE) & (cost >= 0), F.lit(False))


def hop_count(nodes: Column) -> Column:
    return F.greatest(F.coalesce(F.size(nodes), F.lit(0)) - 1, F.lit(0))


def relay_nodes(nodes: Column) -> Column:
    """A route without its ends."""
    return F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 2, F.lit(0)))


def host_of(address: Column) -> Column:
    """What follows the first @, or all of it."""
    return F.regexp_replace(address, "^[^@]*@", "")


def target_path(source: Column, target: Column) -> Column:
    return F.coalesce(F.nullif(target, F.lit("")), source)


def url(scheme: str, host: Column, port: Column, path: Column) -> Column:
    return F.concat(F.lit(f"{scheme}://"), host, F.lit(":"), port.cast("string"), path)


def route_text(nodes: Column) -> Column:
    return F.array_join(nodes, " ")


def parse_route(text: Column) -> Column:
    """Nodes of a route written with blanks between; an empty one has none."""
    t = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def ratio(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def mib_per_second(n: Column, seconds: Column) -> Column:
    """Null where no time has passed."""
    return n / F.lit(float(1 << 20)) / F.nullif(seconds, F.lit(0.0))
