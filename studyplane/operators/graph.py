"""Connected components of links between rows, by joins and sums on one node at a time."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a local one is set only for local sessions without any."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="studyplane-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        base = _LOCAL[app]
    return base


def settled(df: DataFrame) -> DataFrame:
    """df cut off from its lineage in the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that links lead to) of every node in links (a, b).

    Each round hangs a node's neighbours under the least of them and itself, and then under that one's own, so that paths halve; rounds end
    when nothing moves. Links with a null end and of a node to itself are left out."""
    edges = links.filter("a <> b").select("a", "b")
    both = settled(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settled(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"))
    while True:
        of_neighbours = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near")).withColumnRenamed("a", "node")
        nearer = label.join(of_neighbours, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        up = label.select(F.col("node").alias("component"), F.col("component").alias("above"))
        moved = settled(nearer.join(up, "component", "left").select("node", "before", F.least("component", F.coalesce("above", "component")).alias("component")))
        label = moved.select("node", "component")
        if moved.filter("before <> component").isEmpty():
            return label
