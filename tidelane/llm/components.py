"""Connected components of a graph given as an edge table, by alternating large and small stars.

Each round is a few joins on node ids with map-side minima, written to the shared folder; nothing but a count and a
checksum of the edges reaches the driver. A node with very many neighbours is summed before it moves, and its join is
one that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(edges: DataFrame) -> DataFrame:
    """u, v and the smallest id ``m`` among u and its neighbours in ``edges``."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    return edges.join(low, "u").select("u", "v", F.least("u", "low").alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has long columns a and b. Returns node and component, the smallest node it is connected with; a node
    that is its own component (so every node without an edge too) is absent."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last or not mark[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        edges = written(small.select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct(), "edges")
