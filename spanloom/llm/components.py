"""Connected components by alternating large and small stars, each step one aggregation and one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours to the smallest of them; ``edges`` is (a, b) with a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        moved = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("low"))
        joined = edges.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); a component is named by its smallest node."""
    edges = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        edges = checkpointed(_star(_star(edges, True), False))
        # Done when every node has one edge, to a node that has none to a smaller one.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
