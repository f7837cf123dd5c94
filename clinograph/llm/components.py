"""Connected components by contraction in DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, forget


def contract(edges: DataFrame) -> DataFrame:
    """v, c: for each vertex of edges(a, b) with a neighbour the smallest vertex of its component, if not itself.

    Each round hangs every vertex below its smallest neighbour, replaces edge ends by what they hang
    below, and goes on with what is left.  Each round's tables are written; only counts reach the driver.
    """
    spark = edges.sparkSession
    edges = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = durable(both.groupBy("a").agg(F.min("b").alias("p")).where("p < a").select(F.col("a").alias("v"), "p"), "cc-parents")
        if labels is None:
            after = parents.select("v", F.col("p").alias("c"))
        else:  # what hung below a vertex goes on to that vertex's parent
            moved = labels.join(parents.select(F.col("v").alias("c"), "p"), "c", "left").select("v", F.coalesce("p", "c").alias("c"))
            after = moved.unionByName(parents.select("v", F.col("p").alias("c")).join(labels.select("v"), "v", "left_anti"))
        after = durable(after, "cc-labels")
        up = parents.select(F.col("v").alias("u"), "p")
        left = edges.join(up, edges.a == up.u, "left").select(F.coalesce("p", "a").alias("a"), "b")
        left = left.join(up, left.b == up.u, "left").select("a", F.coalesce("p", "b").alias("b"))
        rest = durable(left.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        forget(spark, *(t for t in (edges, parents, labels) if t is not None))
        edges, labels = rest, after
    if labels is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("c"))
    return labels
