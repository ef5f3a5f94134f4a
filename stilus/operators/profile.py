"""Profile of a table of texts: totals, tags, missing values, duplicates, percentiles.

Expected columns: record (a stable number), author, period, title, text, tags,
count. Every figure is a grouped sum; where the order of first occurrence
decides between equals, it is the smallest record number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stilus.functions import text as tx


def records(poems: DataFrame) -> DataFrame:
    """One row a text: record, period, author, title, words, reported_verses, nonempty_lines, meters, rhyme_tags, tags."""
    tags = tx.parts(F.col("tags"), ",")
    joined = lambda keep: F.array_join(F.filter("_tags", keep), " | ")
    return poems.withColumn("_tags", tags).select(
        "record",
        tx.trimmed(F.col("period")).alias("period"),
        tx.trimmed(F.col("author")).alias("author"),
        tx.trimmed(F.col("title")).alias("title"),
        tx.word_count(F.col("text")).alias("words"),
        tx.first_integer(F.col("count")).alias("reported_verses"),
        tx.line_count(F.col("text")).alias("nonempty_lines"),
        joined(lambda t: t.startswith("بحر ")).alias("meters"),
        joined(lambda t: F.contains(t, F.lit("قافية"))).alias("rhyme_tags"),
        F.array_join("_tags", " | ").alias("tags"),
    )


def period_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("period").agg(F.count("*").alias("poems"), F.count_distinct("author").alias("authors"), F.sum("words").alias("words"), F.sum(F.coalesce("reported_verses", F.lit(0))).alias("reported_verses"), F.min("record").alias("first_record"))


def author_totals(rows: DataFrame) -> DataFrame:
    """By period and author, most texts first, then first seen."""
    own = rows.groupBy("period", "author").agg(F.count("*").alias("poems"), F.sum("words").alias("words"), F.sum(F.coalesce("reported_verses", F.lit(0))).alias("reported_verses"), F.min("record").alias("first_record"))
    return own.orderBy(F.desc("poems"), "first_record")


def tag_counts(rows: DataFrame) -> DataFrame:
    """tag, class, occurrences, most frequent first, then first seen."""
    tags = rows.select("record", F.posexplode(F.split("tags", r" \| ")).alias("pos", "tag")).filter("tag <> ''")
    counted = tags.groupBy("tag").agg(F.count("*").alias("occurrences"), F.min(F.struct("record", "pos")).alias("first"))
    return counted.orderBy(F.desc("occurrences"), "first").select("tag", tx.tag_class(F.col("tag")).alias("class"), "occurrences")


def missing(table: DataFrame, columns: list[str]) -> DataFrame:
    """column, missing: null or blank values of each."""
    blank = [F.count_if(F.coalesce(tx.trimmed(F.col(c).cast("string")), F.lit("")) == "").alias(c) for c in columns]
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns))).alias("p")
    return table.agg(*blank).select(pairs).select("p.*")


def duplicate_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows repeat an earlier one in all columns."""
    return table.groupBy(*columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def text_groups(table: DataFrame, text: str = "text") -> DataFrame:
    """Texts that are not blank, by their hash: digest, n, authors."""
    some = table.filter(tx.trimmed(F.col(text)) != "")
    return some.groupBy(F.sha2(text, 256).alias("digest")).agg(F.count("*").alias("n"), F.count_distinct("author").alias("authors"))


def repeated_texts(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("distinct_texts"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"), F.count_if(F.col("authors") > 1).alias("several_authors"))


def cross_author_examples(table: DataFrame, groups: DataFrame, limit: int = 5) -> DataFrame:
    """The first texts that have more than one author, with all their records in order."""
    several = groups.filter("authors > 1").select("digest")
    rows = table.withColumn("digest", F.sha2("text", 256)).join(several, "digest", "left_semi")
    first = rows.groupBy("digest").agg(F.min("record").alias("first")).orderBy("first").limit(limit)
    return rows.join(first, "digest").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("record", "author", "period", "title"))).alias("records")).orderBy("records")


def authors_in_periods(rows: DataFrame) -> DataFrame:
    return rows.groupBy("author").agg(F.sort_array(F.collect_set("period")).alias("periods")).filter(F.size("periods") > 1)


def spread(rows: DataFrame, column: str) -> DataFrame:
    """total, min, median, mean (two decimals, half to even), max of the values that are there."""
    c = F.col(column)
    return rows.agg(F.sum(c).alias("total"), F.min(c).alias("min"), F.median(c).alias("median"), F.bround(F.avg(c), 2).alias("mean"), F.max(c).alias("max"))


def line_mismatches(rows: DataFrame) -> DataFrame:
    """One row: how many records have not two lines for each reported verse, and how many have verses that cannot be read."""
    bad = F.col("reported_verses").isNotNull() & (F.col("nonempty_lines") != 2 * F.col("reported_verses"))
    return rows.agg(F.count_if(bad).alias("mismatched"), F.count_if(F.col("reported_verses").isNull()).alias("unread"))


def unread_verses(rows: DataFrame) -> DataFrame:
    """The records whose reported verses cannot be read: record."""
    return rows.filter("reported_verses is null").select("record")


def longest(rows: DataFrame, column: str, limit: int = 5) -> DataFrame:
    return rows.orderBy(F.coalesce(F.col(column), F.lit(0)).desc(), "record").limit(limit)


def catalogue(poets: DataFrame, periods: DataFrame) -> DataFrame:
    """One row a poet, in order of first record: period, names, and the titles of all rows, each once, in order.

    ``poets``: record, era_ar, poet_id, author_ar, primary_poem_title,
    poem_titles. ``periods``: period_ar, period, period_name. The scripture's
    rows are left out; an unknown period is an error.
    """
    spaced = lambda c: F.trim(F.replace(c, F.lit("_"), F.lit(" ")))
    rows = poets.withColumn("period_ar", spaced("era_ar")).filter("period_ar <> 'القرآن الكريم' and poet_id <> 'QURAN'")
    joined = rows.join(F.broadcast(periods), "period_ar", "left")
    known = F.when(F.col("period").isNull(), F.raise_error(F.concat(F.lit("unknown period "), "period_ar"))).otherwise(F.col("period"))
    row = F.struct("record", known.alias("period"), "period_name", "period_ar", spaced("author_ar").alias("author"), F.trim("primary_poem_title").alias("primary_poem_title"), tx.parts(F.col("poem_titles"), "|").alias("titles"))
    grouped = joined.groupBy("poet_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    first = F.get("rows", F.lit(0))
    fields = [first[c].alias(c) for c in ("period", "period_name", "period_ar", "author", "primary_poem_title")]
    titles = F.array_distinct(F.flatten(F.transform("rows", lambda r: r["titles"])))
    return grouped.select(first["record"].alias("record"), F.col("poet_id").alias("id"), *fields, titles.alias("poem_titles")).orderBy("record")


def catalogue_summary(poets: DataFrame, period: str | None = None) -> DataFrame:
    own = poets.filter(F.col("period") == period) if period else poets
    return own.agg(F.count("*").alias("poets"), F.count_distinct("period").alias("periods"))
