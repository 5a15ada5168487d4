"""Connected components of an undirected link table.

Every round replaces both ends of each link by the end's least neighbour
(itself included) under a random order, then drops loops and repeats.  Nodes
that are nobody's least neighbour vanish, so a round leaves a fraction of
them; the rounds' node maps, applied one after the other, give the component.
A hub is met only in aggregates with map-side combine and in joins whose hot
partitions AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from logloom.llm.common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links``: two BIGINT columns.  Returns (node, component): every node
    that has a link to another one, and one common member node per component.

    Nulls and loops are no links; repeated links count once; no links give an
    empty table.
    """
    def order(c):
        return F.struct(F.xxhash64(c, F.lit(7)).alias("h"), c.alias("n"))

    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    node_map = None
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            links.select("b", "a"))
        least = ends.groupBy("node").agg(F.min(order(F.col("other"))).alias("m"))
        parent = cut(least.select("node", F.least("m", order(F.col("node"))).getField("n").alias("parent")))
        # one step further up: parents of parents
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        parent = cut(parent.join(up, "parent").select("node", F.col("grand").alias("parent")))
        pa_, pb = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        links = links.join(pa_, "a").join(pb, "b").where("pa <> pb").select(
            F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        links = cut(links)
        if node_map is None:
            node_map = parent.toDF("node", "component")
        else:
            step = parent.toDF("component", "next")
            node_map = cut(node_map.join(step, "component", "left").select(
                "node", F.coalesce("next", "component").alias("component")))
    if node_map is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return node_map
