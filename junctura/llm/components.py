"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from junctura.llm.scratch import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a``, ``b``); the component is its smallest node.

    Each round hooks every root that has a smaller neighbour to its smallest one and contracts the links, so the number
    of roots that still have links at least halves. Tables of a round are written before they are joined: both sides of
    a join are then plain exchanges, which adaptive execution splits where a component is large.
    """
    pairs = links.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
    nodes = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    labels = materialize(nodes.withColumn("component", F.col("node")), "components")
    edges = materialize(pairs.where("x > y").distinct(), "contracted")
    while edges.limit(1).count():
        parent = materialize(edges.groupBy(F.col("x").alias("root")).agg(F.min("y").alias("up")), "parents")
        moved = labels.join(parent, F.col("component") == F.col("root"), "left")
        labels = materialize(moved.select("node", F.coalesce("up", "component").alias("component")), "components")
        left = edges.join(parent, F.col("x") == F.col("root"), "left").select(F.coalesce("up", "x").alias("x"), "y")
        both = left.join(parent, F.col("y") == F.col("root"), "left").select("x", F.coalesce("up", "y").alias("y"))
        ordered = both.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
        edges = materialize(ordered.distinct(), "contracted")
    return labels
