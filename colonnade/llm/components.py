"""Connected components of a graph of any size, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import spread_join
from colonnade.session import stage


def _towards_least(edges: DataFrame) -> DataFrame:
    """Each node's neighbours (`u` to `v`) with the least node among it and them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    return spread_join(edges, least, ["u"], ["v"])


def connected(edges: DataFrame) -> DataFrame:
    """`node` and `root` (the least node it is connected with) of every node of `edges` (`u`, `v`: long) but the roots.

    Alternating large and small stars: larger neighbours move to the least one, then smaller ones do, until every
    node hangs on its root.  Rounds grow with the logarithm of the longest path; each is written to the shared folder.
    No node's neighbours are ever gathered: minima are combined before the shuffle and hot nodes are dealt out.
    """
    edges = stage(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.filter("u <> v").distinct()
        small = _towards_least(large)
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).union(small.select("u", "least"))
        edges = stage(small.filter("u <> v").distinct())
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
