"""Feature counts, vocabularies, and the matrix of relative frequencies, in long form.

Counts are grouped sums with partial sums in each task. The dense matrix has a
row for each sample and retained feature; both are small by construction, as
samples and vocabulary have set limits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stilus.functions import features

#: Standard deviations up to this count as constant.
CONSTANT = 1e-12


def counts(samples: DataFrame, kind: str, ngram: int = 1) -> DataFrame:
    """sample, group, size (n-gram length), feature, n."""
    events = samples.select("sample", "group", F.explode(features.events(kind, ngram, F.col("words"), F.col("text"))).alias("e"))
    return events.groupBy("sample", "group", "e.size", "e.feature").agg(F.count("*").alias("n"))


def top_features(counted: DataFrame, top: int) -> DataFrame:
    """The ``top`` features of each size by total count, then name: size, feature, total, place (from 1, over all)."""
    total = counted.groupBy("size", "feature").agg(F.sum("n").alias("total"))
    order = [F.desc("total"), F.col("feature")]
    ranked = total.withColumn("r", F.row_number().over(Window.partitionBy("size").orderBy(*order))).filter(F.col("r") <= top)
    return ranked.withColumn("place", F.row_number().over(Window.orderBy("size", "r"))).drop("r")


def fixed_features(counted: DataFrame, names: list[str]) -> DataFrame:
    """A given vocabulary in its order; features that do not occur have total 0."""
    given = counted.sparkSession.createDataFrame([(1, name, k + 1) for k, name in enumerate(names)], "size int, feature string, place int")
    total = counted.groupBy("feature").agg(F.sum("n").alias("total"))
    return given.join(total, "feature", "left").select("size", "feature", F.coalesce("total", F.lit(0)).alias("total"), "place")


def all_features(counted: DataFrame) -> DataFrame:
    """Every feature by code point."""
    total = counted.groupBy("size", "feature").agg(F.sum("n").alias("total"))
    return total.withColumn("place", F.row_number().over(Window.orderBy("feature")))


def vocabulary(counted: DataFrame, kind: str, top: int, function_words: list[str] | None = None) -> DataFrame:
    if kind == "function":
        return fixed_features(counted, function_words or [])
    if kind == "length":
        return fixed_features(counted, [str(k) for k in range(1, features.LONGEST_WORD + 1)])
    if kind == "characters":
        return all_features(counted)
    return top_features(counted, top)


def frequencies(samples: DataFrame, counted: DataFrame, vocab: DataFrame) -> DataFrame:
    """sample, group, feature, place, freq for each sample and feature; the base is all events of the sample."""
    all_events = samples.select("sample", "group").join(counted.groupBy("sample").agg(F.sum("n").alias("events")), "sample", "left")
    listed = vocab.agg(F.sort_array(F.collect_list(F.struct("place", "feature"))).alias("v"))
    dense = all_events.join(F.broadcast(listed)).select("sample", "group", "events", F.explode("v").alias("v")).select("sample", "group", "events", "v.place", "v.feature")
    filled = dense.join(counted.select("sample", "feature", "n"), ["sample", "feature"], "left")
    base = F.greatest(F.coalesce("events", F.lit(1)), F.lit(1))
    return filled.select("sample", "group", "feature", "place", (F.coalesce("n", F.lit(0)) / base).alias("freq"))


def varying(matrix: DataFrame) -> DataFrame:
    """The features that are not constant over the samples, with their mean and sample deviation."""
    spread = matrix.groupBy("feature").agg(F.avg("freq").alias("mean"), F.stddev_samp("freq").alias("sd"))
    return spread.filter(F.col("sd") > CONSTANT)


def standardised(matrix: DataFrame) -> DataFrame:
    """The matrix of varying features with z, the standardised frequency."""
    return matrix.join(varying(matrix), "feature").withColumn("z", (F.col("freq") - F.col("mean")) / F.col("sd"))


def centroids(matrix: DataFrame, value: str) -> DataFrame:
    """Means of each group: sample (the group), group, feature, place and the value."""
    mean = matrix.groupBy("group", "feature", "place").agg(F.avg(value).alias(value))
    return mean.select(F.col("group").alias("sample"), "group", "feature", "place", value)


def contrasts(standard: DataFrame, target: str) -> DataFrame:
    """How one group differs from the rest: feature, place, effect (of mean z), focus and other (rates in 10,000)."""
    own = F.col("group") == target
    mean = lambda of, c: F.avg(F.when(of, F.col(c)))
    return standard.groupBy("feature", "place").agg((mean(own, "z") - mean(~own, "z")).alias("effect"), (mean(own, "freq") * 10000).alias("focus"), (mean(~own, "freq") * 10000).alias("other"))


def evidence(matrix: DataFrame) -> DataFrame:
    """Samples of each group, those that have the feature, and its mean rate in 10,000."""
    return matrix.groupBy("group", "feature").agg(F.count("*").alias("samples"), F.count_if(F.col("freq") > 0).alias("present"), (F.avg("freq") * 10000).alias("rate"))


def zero_rows(matrix: DataFrame) -> int:
    """Samples that have none of the features."""
    return matrix.groupBy("sample").agg(F.max("freq").alias("m")).filter("m = 0").count()
