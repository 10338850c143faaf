"""Connected components by alternating large and small stars, in DataFrame joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _hooked(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): every v of a u is tied to the least of u and its v's, as is u."""
    least = saved(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")  # a plain table, so that Spark may split the join
    joined = pairs.join(least, "u")
    return joined.select(F.col("v").alias("x"), F.col("m")).unionByName(least.select(F.col("u").alias("x"), "m"))


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any orderable type to (node, comp): comp is the least node that can be reached. Nodes without edges are absent.

    A star round moves every edge towards the least node in sight; the rounds
    end when every node points straight at its root, after about the logarithm
    of the longest path. A node that a third of all edges meet costs a partial
    aggregate and an equi join that Spark may split. Each round is written to
    the shared folder.
    """
    e = saved(edges.where("u != v").select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("m")).distinct(), "edges")
    while True:
        both = e.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(e.select(F.col("m").alias("u"), F.col("x").alias("v")))
        large = _hooked(both).where("x > m").distinct()
        small = _hooked(large.select(F.col("x").alias("u"), F.col("m").alias("v"))).where("x > m").distinct()
        e = saved(small, "edges")
        edges, nodes = e.agg(F.count(F.lit(1)), F.count_distinct("x")).first()
        # Done when each node has one edge and no edge ends at a node that has one: all point straight at their roots.
        if edges == nodes and e.join(e.select(F.col("x").alias("m")), "m", "left_semi").isEmpty():
            break
    return e.select(F.col("x").alias("node"), F.col("m").alias("comp")).unionByName(e.select(F.col("m").alias("node"), F.col("m").alias("comp")).distinct())
