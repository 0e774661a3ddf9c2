"""Connected components of a graph of links, by contraction.

In every step each node points to the least of itself and its neighbours and the links are redrawn
between the nodes pointed to, until no link is left. The pointers of all steps together lead each
node to the least node of its component. Per node only a minimum is taken, summed up before the
shuffle, so a node with any number of links is no hot group, and links never leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.session import settle


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the least id reachable) of all ``nodes`` (column ``id``) for the
    ``links`` (columns ``a``, ``b``)."""
    labels = nodes.select("id", F.col("id").alias("component"))
    edges = links.select("a", "b").filter("a <> b")
    while True:
        edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if edges.isEmpty():
            return labels
        ends = edges.select(F.col("a").alias("node"), F.col("a").alias("to")).unionByName(
            edges.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        pointers = settle(ends.groupBy("node").agg(F.min("to").alias("to")))
        moved = pointers.select(F.col("node").alias("component"), F.col("to").alias("_to"))
        labels = settle(
            labels.join(moved, "component", "left").select(
                "id", F.coalesce("_to", "component").alias("component")
            )
        )
        # a link between nodes that point to the same node is done; the others join their targets
        of_a = pointers.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        of_b = pointers.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        edges = (
            edges.join(of_a, "a")
            .join(of_b, "b")
            .select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
            .filter("a <> b")
        )
