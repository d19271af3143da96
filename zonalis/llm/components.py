"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm.shared import narrow, written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges, repeated ones too, to (node, root): each node that has an edge, with the smallest node that it is linked with.

    edges should be a written table, as the first round reads it several times.

    Each round attaches nodes to their smallest neighbour and is written, so lineage stays short and nothing but counts
    reaches the driver. Minima are summed up before they are shuffled, so a node with very many edges is no hot spot.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        new = written(narrow(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()), "edges")
        # Done once the edges are stars: no root of one edge is the leaf of another, and each leaf has one root.
        leaves = new.groupBy("u").agg(F.count(F.lit(1)).alias("roots"))
        open_ = leaves.where("roots > 1").select("u").unionByName(new.select(F.col("v").alias("u")).join(leaves.select("u"), "u", "left_semi"))
        edges = new
        if open_.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
