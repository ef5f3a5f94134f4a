"""Mixing sources to target weights by hash thresholds.

Each row has a hash in [0, 2**30). A source that is to give part of its tokens
once more gives the rows below a threshold, found without sorting: sum tokens
by source and the hash's top ten bits, find the bucket where the running sum
passes the budget, sum only that bucket by the next ten bits, and once more.
Within a class of sizes, a larger budget has a larger threshold. Sums are
partial within tasks, so a source with most of the rows costs no more than
any other; every step is a grouped sum or a join with one row per source.

A long row at the threshold can miss the budget by half its size. So the
longest rows get their threshold first, and each class of shorter ones then a
threshold that makes up for what has been missed so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stilus.llm.common import WORD, stage, text_of

BITS, LEVELS = 10, 3
#: Classes of rows by size: longer than the first, than the second, and so on.
CLASSES = (2048, 256)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def row_hash(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS * LEVELS)


def cycling_weights(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source, by code point with null last, with repeating weights."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))
    return sizes.withColumn("weight", weight)


def targets(sources: DataFrame, limit: float = 3.0) -> DataFrame:
    """Add to (source, source_size, weight) the target of each source.

    Targets share the sum of all sizes by weight but stop at ``limit`` times
    the source's size; the excess is shared by weight among the others until
    none is above. So each is the smaller of that limit and a common rate
    times its weight, and the rate is the largest of those that result if the
    sources that fill up first, one more each time, are at their limit.
    """
    before = Window.orderBy(F.col("limit") / F.col("weight"), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rate = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    limited = sources.withColumn("limit", F.col("source_size") * F.lit(float(limit)))
    rated = limited.withColumn("rate", rate).withColumn("rate", F.max("rate").over(every))
    return rated.withColumn("target", F.coalesce(F.least("limit", F.col("rate") * F.col("weight")), F.lit(0.0))).drop("limit", "rate")


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """The hash below which each source's rows add up to its budget: source, threshold, left (of the budget; may be negative).

    ``rows``: source, size, hash. ``budgets``: source, budget.
    """
    plan = stage(budgets.select("source", "budget", F.lit(0).cast("long").alias("threshold")), "mix")
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        prefix = F.shiftright("hash", shift + BITS) == F.shiftright("threshold", shift + BITS)
        boundary = rows.join(plan.select(F.col("source").alias("of"), "threshold"), F.col("source").eqNullSafe(F.col("of")) & prefix)
        sums = boundary.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        fits = F.col("n") / 2 + F.col("upto") - F.col("n") <= F.col("budget") if level == LEVELS else F.col("upto") <= F.col("budget")
        running = sums.withColumn("upto", upto).join(plan.select(F.col("source").alias("of"), "budget"), F.col("source").eqNullSafe(F.col("of")))
        passed = running.groupBy("source").agg(
            F.coalesce(F.max(F.when(fits, F.col("upto"))), F.lit(0)).alias("given"),
            F.min(F.when(~fits, F.col("bucket"))).alias("next"),
            F.max("bucket").alias("last"),
        ).withColumnRenamed("source", "of")
        reached = plan.join(passed, F.col("source").eqNullSafe(F.col("of")), "left")
        plan = stage(reached.select("source", (F.col("budget") - F.coalesce("given", F.lit(0))).alias("budget"), F.coalesce(F.shiftleft(F.coalesce("next", F.col("last") + 1), shift), "threshold").alias("threshold")), "mix")
    return plan.withColumnRenamed("budget", "left")


def own_hash() -> Column:
    """By doc_id; by the text where there is none."""
    return row_hash(F.col("doc_id"), F.when(F.col("doc_id").isNull(), text_of())).alias("hash")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(text_of()).alias("size"), own_hash())


def class_of(size: Column) -> Column:
    """0 for the longest rows, and so on."""
    return sum(((size <= most).cast("int") for most in CLASSES), F.lit(0))


def plan_of(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """For each source of ``rows`` (source, size, hash): source_size, target, the copies all rows give, and by class the hash below which rows give one more."""
    own = class_of(F.col("size"))
    classes = [F.coalesce(F.sum(F.when(own == k, F.col("size"))), F.lit(0)).alias(f"size_{k}") for k in range(len(CLASSES) + 1)]
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), *classes)
    aimed = targets(cycling_weights(sizes, weights), limit)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    part = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0)) - F.col("copies")
    plan = stage(aimed.withColumns({"copies": copies, "thresholds": F.expr("cast(array() as array<bigint>)"), "left": F.lit(0.0)}).withColumn("part", part), "mix")
    for k in range(len(CLASSES) + 1):
        found = thresholds(rows.filter(own == k), plan.select("source", (F.col("part") * F.col(f"size_{k}") + F.col("left")).alias("budget")))
        joined = plan.drop("left").join(found.select(F.col("source").alias("of"), "threshold", "left"), F.col("source").eqNullSafe(F.col("of")))
        plan = stage(joined.withColumn("thresholds", F.array_append("thresholds", F.col("threshold"))).drop("of", "threshold"), "mix")
    return plan.select("source", "source_size", "target", "copies", "thresholds")


def _given(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, size, hash and others) with ``copies``: how often the mix takes each."""
    own = plan.select(F.col("source").alias("of"), F.col("copies").alias("all"), "thresholds", "source_size", "target")
    joined = rows.join(own, F.col("source").eqNullSafe(F.col("of")), "left")
    below = F.col("hash") < F.get("thresholds", class_of(F.col("size")))
    return joined.withColumn("copies", F.col("all") + below.cast("long")).drop("of", "all", "thresholds")


def shares(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, source, text).

    Returns doc_id, size (words; null text: 0), source_size, target (of the
    row's source) and taken (words, repeats counted; at most ``limit`` times
    the size, up to whole copies). Sources, null among them, weigh ``weights``
    in turn. The sum taken of a source differs from its target by about half a
    row of the shortest class, if it has enough of them, else by half a longer
    row. Rows of equal doc_id (of equal text, where it is null) share their
    hash and are taken alike, so reruns agree. Other columns are ignored; an empty table gives no rows.
    """
    rows = stage(sized(docs), "sizes")
    given = _given(rows, plan_of(rows, weights, limit))
    return given.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, with all columns unchanged."""
    rows = stage(sized(docs), "sizes")
    plan = plan_of(rows, weights, limit)
    whole = docs.select(F.struct("*").alias("row"), "source", word_count(text_of()).alias("size"), own_hash())
    taken = _given(whole, plan).filter("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return taken.select("row.*")
