"""Trees of content in tables of (id, parent_id, ord)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import settled


def preorder(nodes: DataFrame, prune_hidden: bool = True) -> DataFrame:
    """nodes with depth and path (ordinals of one width, ten digits at least, so that the order of paths is the preorder walk). nodes: id,
    parent_id, ord, hidden.

    A hidden node prunes what is below it, or is kept like others if not prune_hidden. Orphans and nodes on a cycle are not reached. One join
    a level, each level settled before the next, until one is empty, however deep; a walk deeper than there are nodes is an error."""
    most = nodes.agg(F.max(F.length(F.col("ord").cast("string"))).alias("w"), F.count("*").alias("n")).first()
    step = lambda c: F.lpad(F.col(c).cast("string"), max(10, most["w"] or 0), "0")
    seen = nodes.filter(~F.coalesce("hidden", F.lit(False))) if prune_hidden else nodes
    level = settled(seen.filter("parent_id IS NULL").select("id", "parent_id", step("ord").alias("path"), F.lit(0).alias("depth")))
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        if depth > most["n"]:
            raise ValueError("an id is its own ancestor")
        above = level.select(F.col("id").alias("_up"), F.col("path").alias("_path"))
        level = settled(seen.join(above, F.col("parent_id") == F.col("_up")).select("id", "parent_id", F.concat_ws("/", "_path", step("ord")).alias("path"), F.lit(depth).alias("depth")))
        out = out.unionByName(level)
    return out


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent isn't there."""
    return nodes.filter("parent_id IS NOT NULL").join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
