"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents; more columns, of any name, pass through unchanged. No
stage needs ids to be there or to be different, and an empty table gives none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stilus.llm import cascade, linededup, mixing, packing, partenum
from stilus.llm.common import discard, documents, free_name, stage, text_of


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects (operator 5).

    A null or empty text has too few words and goes; a very long one is judged
    whole. Repeated rows are judged alike, and null ids like any others.
    """
    return cascade.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones, up to a word (operator 7).

    Earlier is by doc_id (null last), then a hash of the row, then the line, so
    there are no ties. A null or blank text stays as it is; one whose dropped
    lines leave no word goes. Repeated rows count as one and are treated alike.
    """
    return linededup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 3): that of the smallest id.

    Rows are told apart by a hash of doc_id and text, so that documents which
    share an id, or have none, are compared as well (null last, ties by the
    hash). Of rows with equal id and text one stays. Null or blank texts are
    near no other text.
    """
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", text_of()))
    groups = partenum.similar_documents(keyed.select(F.col(key).alias("doc_id"), "text"), width=5, percent=80)
    several = stage(groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct(), "several")
    members = several.union(several.select("component", "component").distinct())
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(key).alias("key"))
    placed = keyed.select(place.alias("place"), F.col(key).alias("key")).join(members, "key")
    first = placed.groupBy("component").agg(F.min("place").alias("first"))
    others = members.join(first, "component").filter(F.col("key") != F.col("first.key")).select(F.col("key").alias(key)).distinct()
    left = keyed.join(others, key, "left_anti")
    again = stage(keyed.groupBy(key).count().filter("count > 1").select(key), "again")
    if not again.isEmpty():
        one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")
        repeated = left.join(again, key, "left_semi").groupBy(key).agg(one).select("row.*")
        return left.join(again, key, "left_anti").select(*docs.columns).unionByName(repeated)
    return left.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix by source takes them (operator 4).

    A null source is a source of its own, the last. A null text has no words
    and adds nothing to sizes. Rows of equal id (of equal text, without id)
    are taken alike.
    """
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences (operator 6).

    A null or empty text is its end token; a long one is cut into pieces.
    Repeated rows and null ids are packed like any others.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
