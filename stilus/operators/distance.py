"""Distances between samples, and what is measured on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(matrix: DataFrame, value: str) -> DataFrame:
    """One vector a sample in vocabulary order: idx (from 0, by group and sample), sample, group, v."""
    from pyspark.sql import Window

    rows = matrix.groupBy("sample", "group").agg(F.sort_array(F.collect_list(F.struct("place", F.col(value).alias("x")))).alias("s"))
    idx = F.row_number().over(Window.orderBy("group", "sample")) - 1
    return rows.select(idx.alias("idx"), "sample", "group", F.transform("s", lambda s: s["x"]).alias("v"))


def pairwise(vectors: DataFrame, metric: str) -> DataFrame:
    """a, b, group_a, group_b, d for all samples with idx of a below that of b.

    ``delta``: mean absolute difference; ``cosine``: 1 - cosine, null with a
    zero vector; ``euclidean``. Pairs come from an equi-join on the partner's
    index; the number of samples has a set limit.
    """
    n = vectors.agg(F.count("*").alias("n"))
    left = vectors.join(F.broadcast(n)).filter("idx + 1 < n").withColumn("other", F.explode(F.expr("sequence(idx + 1, cast(n as int) - 1)")))
    right = vectors.select(F.col("idx").alias("other"), F.col("sample").alias("b"), F.col("group").alias("group_b"), F.col("v").alias("w"))
    add = lambda s, x: s + x
    fold = lambda f: F.aggregate(F.zip_with("v", "w", f), F.lit(0.0), add)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), add)
    if metric == "delta":
        d = fold(lambda x, y: F.abs(x - y)) / F.size("v")
    elif metric == "cosine":
        norm = F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w"))
        d = F.when(norm > 0, 1 - dot("v", "w") / norm)
    else:
        d = F.sqrt(fold(lambda x, y: (x - y) * (x - y)))
    return left.join(right, "other").select(F.col("sample").alias("a"), "b", F.col("group").alias("group_a"), "group_b", d.alias("d"))


def silhouettes(distances: DataFrame, target: str) -> DataFrame:
    """sample, is_target, s: how much nearer each sample is to its own side (the target group or the rest); 0 for a side of one."""
    both = distances.select("a", (F.col("group_a") == target).alias("x"), (F.col("group_b") == target).alias("y"), "d").union(distances.select("b", F.col("group_b") == target, F.col("group_a") == target, "d"))
    mean = both.groupBy("a", "x").agg(F.avg(F.when(F.col("x") == F.col("y"), F.col("d"))).alias("own"), F.avg(F.when(F.col("x") != F.col("y"), F.col("d"))).alias("far"))
    s = F.when(F.col("own").isNull() | (F.greatest("own", "far") == 0), 0.0).otherwise((F.col("far") - F.col("own")) / F.greatest("own", "far"))
    return mean.filter("far is not null").select(F.col("a").alias("sample"), F.col("x").alias("is_target"), s.alias("s"))


def silhouette(distances: DataFrame, target: str) -> DataFrame:
    """One row: the mean silhouette, null if all samples are on one side."""
    return silhouettes(distances, target).agg(F.avg("s").alias("silhouette"))
