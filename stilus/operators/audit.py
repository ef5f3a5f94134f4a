"""Comparison of two versions of a text, place by place, and of spellings after folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(line, text) of both versions, joined by line and word: line, word, before, after (null where one is shorter).

    Lines are joined as texts and split then, so a word moves only with its line, and no array of words is shuffled.
    """
    none = F.expr("cast(array() as array<string>)")
    both = old.select("line", F.col("text").alias("x")).join(new.select("line", F.col("text").alias("y")), "line", "full_outer")
    split = lambda text: F.coalesce(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)), none)
    zipped = F.arrays_zip(split("x").alias("before"), split("y").alias("after"))
    return both.select("line", F.posexplode(zipped).alias("word", "p")).select("line", F.col("word") + 1, "p.before", "p.after").toDF("line", "word", "before", "after")


def changes(pairs: DataFrame) -> DataFrame:
    return pairs.filter(~F.col("before").eqNullSafe(F.col("after")))


def confusions(pairs: DataFrame) -> DataFrame:
    """before, after, occurrences of changed words, most frequent first."""
    counted = changes(pairs).groupBy("before", "after").agg(F.count("*").alias("occurrences"), F.min(F.struct("line", "word")).alias("first"))
    return counted.orderBy(F.desc("occurrences"), "first").drop("first")


def restored_letters(old: DataFrame, new: DataFrame) -> DataFrame:
    """letter, occurrences: letters of the new version where the old one has another at the same place."""
    both = old.select("line", F.col("text").alias("x")).join(new.select("line", F.col("text").alias("y")), "line").filter("x <> y")
    differ = F.filter(F.zip_with(F.split("x", ""), F.split("y", ""), lambda x, y: F.when(x != y, y)), lambda y: y.isNotNull())
    return both.select(F.explode(differ).alias("letter")).groupBy("letter").agg(F.count("*").alias("occurrences"))


def totals(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: words of both, changed tokens, distinct corrections, changed lines."""
    words = pairs.agg(F.count("before").alias("words_before"), F.count("after").alias("words_after"), F.count_if(~F.col("before").eqNullSafe(F.col("after"))).alias("changed_tokens"))
    distinct = changes(pairs).agg(F.count_distinct(F.struct("before", "after")).alias("distinct_corrections"))
    lines = old.join(new.select("line", F.col("text").alias("other")), "line").agg(F.count_if(F.col("text") != F.col("other")).alias("changed_lines"))
    return words.join(F.broadcast(distinct)).join(F.broadcast(lines))


def ambiguous_forms(words: DataFrame, fold: Column) -> DataFrame:
    """folded, forms: folded spellings that stand for several words (column word)."""
    distinct = words.select("word", fold.alias("folded")).distinct()
    return distinct.groupBy("folded").agg(F.sort_array(F.collect_list("word")).alias("forms")).filter(F.size("forms") > 1)


def letter_profile(texts: DataFrame, letters: str) -> DataFrame:
    """How often each of ``letters`` occurs in each group: one column a letter."""
    count = lambda c: F.sum(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit(""))))
    return texts.groupBy("group").agg(*(F.coalesce(count(c), F.lit(0)).alias(c) for c in letters))


def vocabulary_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """feature, change: features that only one of the vocabularies has."""
    a, b = before.select("feature").distinct(), after.select("feature").distinct()
    return b.join(a, "feature", "left_anti").withColumn("change", F.lit("added")).union(a.join(b, "feature", "left_anti").withColumn("change", F.lit("removed")))


def frequency_changes(before: DataFrame, after: DataFrame, least: float = 1e-15) -> DataFrame:
    """One row: the largest absolute difference of (sample, feature, freq), missing as 0, and how many differ."""
    a = before.select("sample", "feature", F.col("freq").alias("x"))
    b = after.select("sample", "feature", F.col("freq").alias("y"))
    change = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return a.join(b, ["sample", "feature"], "full_outer").agg(F.max(change).alias("largest_change"), F.count_if(change > least).alias("changed_cells"))


def prefixed(verses: DataFrame) -> DataFrame:
    """How many verses carry an opening line of their own."""
    return verses.agg(F.count_if(F.coalesce(F.col("opening"), F.lit("")) != "").alias("prefixed"))
