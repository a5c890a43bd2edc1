"""Connected components of a graph of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. Nodes without links have no row.

    Large-star and small-star steps alternate until nothing changes, about log(nodes) times; every
    step is an aggregation by node and a join, and is written as a table so that lineage stays
    short. A node with many links spreads: its smallest neighbour comes from a combined
    aggregation and its links meet it in a join that AQE can split.
    """
    edges = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    edges = materialize(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        up = large.select(F.col("v").alias("u"), F.col("u").alias("v"))  # from each node to its smaller neighbours
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        small = up.join(least, "u").select(F.col("m").alias("u"), F.col("v").alias("v")).where("u < v")
        new = materialize(small.unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct(), "links")
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            break
        edges = new
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
