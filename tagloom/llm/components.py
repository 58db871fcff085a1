"""Connected components of a graph in a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import settle_table


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the smallest neighbour of u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (u, v; whole numbers) reaches.

    Large-star and small-star steps in turns: nodes are linked to the smallest of their neighbours
    until every edge points at the least node of its component. A step's edges are written, so
    nothing is worked out twice, and no step makes more edges than it was given.
    """
    links = settle_table(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = large.filter("u <> v").distinct()
        # Small star: a node's smaller neighbours, and the node, are linked to the smallest of them.
        small = _least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        links = settle_table(small.select("e.u", "e.v").filter("u <> v").distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = tuple(state)
