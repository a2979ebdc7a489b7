"""Connected components of a distributed edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_written, written

#: Above this many edges the minima are a table of their own, so that both sides of the join are plain exchanges and
#: Spark can split a hub's rows; below it one task holds any hub.
MANY = 1_000_000


def _stored(edges: DataFrame, name: str) -> tuple[DataFrame, int, object]:
    """The written edges, their number, and a checksum of them."""
    seen = Observation()
    out = written(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")).alias("sum")), name)
    return out, seen.get["n"], seen.get["sum"]


def _with_minimum(edges: DataFrame, side: str, other: str, n: int) -> tuple[DataFrame, DataFrame | None]:
    """Each row of ``edges`` with the least ``other`` of its ``side``."""
    least = edges.groupBy(side).agg(F.min(other).alias("least"))
    kept = written(least, "minima") if n > MANY else None
    return edges.join(least if kept is None else kept, side), kept


def components(edges: DataFrame) -> DataFrame:
    """node, component: for every node of an edge (columns a and b, any ordered type) the least node it is linked with."""
    now, n, total = _stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    while n:
        both = now.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionByName(now.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        large, least_a = _with_minimum(both, "x", "y", n)
        large, n_large, _ = _stored(large.where("y > x").select(F.col("y").alias("hi"), F.least("x", "least").alias("lo")).distinct(), "large")
        small, least_b = _with_minimum(large, "hi", "lo", n_large)
        # Each node's edge to its minimum, and an edge from every other neighbour to that minimum.
        small = small.select(F.when(F.col("lo") > F.col("least"), F.col("lo")).otherwise(F.col("hi")).alias("hi"), F.col("least").alias("lo"), F.col("hi").alias("own"))
        small = small.select(F.explode(F.array(F.struct("hi", "lo"), F.struct(F.col("own").alias("hi"), "lo"))).alias("e")).select("e.*").distinct()
        after, n_after, total_after = _stored(small, "edges")
        drop_written(now, large, least_a, least_b)
        settled = (n_after, total_after) == (n, total)
        now, n, total = after, n_after, total_after
        if settled:
            break
    roots = now.select("lo").distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots.select(F.col("lo").alias("node"), F.col("lo").alias("component")))
