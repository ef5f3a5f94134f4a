"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stilus.llm.common import discard, stage


def connected(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of ``edges`` (a, b): node, component.

    Alternates the large-star and small-star steps until the edges are stars.
    Each is a grouped minimum and an equi-join, so a node with very many
    neighbours is summed within tasks and its join can be split; no step
    gathers a node's neighbours, and nothing but a checksum reaches the
    driver. Every round is written out, and removed after the next. Nodes without an edge to another node
    are not returned; nulls make no edge.
    """
    now = stage(edges.select(F.col("a"), F.col("b")).filter("a <> b").distinct(), "edges")
    seen, last = None, None
    while True:
        if last:
            discard(last)
        check = tuple(now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first())
        if check[0] == 0 or check == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        seen = check
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()
        small = large.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        hung = small.join(least, "u")
        last, now = now, stage(hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).filter("a <> b").distinct(), "edges")
