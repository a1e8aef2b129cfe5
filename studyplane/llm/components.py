"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(both: DataFrame, only_smaller: bool) -> DataFrame:
    """Every node's least neighbour or itself (low); only_smaller: of the neighbours below it."""
    near = both.filter("b < a") if only_smaller else both
    return near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of all nodes in links (a, b), which are of a type that can be ordered.

    Links with a null end and links of a node to itself are left out; repeated links count once. In each step a node's neighbours are
    hung under its least one; sums and joins on a node's key only, so that no node's neighbours come together in memory. The steps end
    when the links are the stars of the components."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before or not state["n"]:
            break
        before = state
        both = _both(edges)
        large = both.join(_least(both, False), "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        small = large.join(_least(large, True), "a")
        edges = written(small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(small.select("a", F.col("low").alias("b"))).filter("a <> b").distinct(), "links")
    return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
