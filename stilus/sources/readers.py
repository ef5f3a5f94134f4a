"""Scans of text, CSV, JSON, XML and index files. All read through Spark, so any store that Spark knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stilus.operators.numbering import numbered

#: Line ends that split a text: all of Unicode's, not only the newline.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: file, text (lines that are no comments, joined by spaces), sha256 of the file's text.

    A byte order mark is dropped; a comment's first character but spaces is #.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    lines = F.filter(F.split(F.regexp_replace("value", "^﻿", ""), LINE_ENDS), lambda x: ~x.rlike(r"(?U)^\s*#"))
    return raw.select("file", F.array_join(lines, " ").alias("text"), F.sha2("value", 256).alias("sha256"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), text: lines that are neither blank nor comments."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split(F.regexp_replace("value", "^﻿", ""), LINE_ENDS), lambda x: x.rlike(r"(?U)\S") & ~x.rlike(r"(?U)^\s*#"))).alias("line", "text"))
    return raw.withColumn("line", F.col("line") + 1)


def csv_records(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """A CSV with header, quoted line breaks and a byte order mark; all strings; record numbers from 2 in the file's order."""
    # Left to itself, the parser takes NUL to escape the escape and drops it.
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', charToEscapeQuoteEscaping='"', encoding="UTF-8")
    rows = rows.toDF(*(c.lstrip("\ufeff") for c in rows.columns)).na.fill("")
    return numbered(rows, "record", first=2).withColumnsRenamed(names or {})


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file (gzip included); an array gives a row an element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def translations(spark: SparkSession, path: str) -> DataFrame:
    """An object of id to a string, or to a list of {start, end, text}: id, parts (a string is one part without times)."""
    raw = spark.read.text(path, wholetext=True)
    parts = "array<struct<start:double,end:double,text:string>>"
    pairs = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "said"))
    single = F.array(F.struct(F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"), F.col("said").alias("text")))
    return pairs.select("id", F.when(F.col("said").startswith("["), F.from_json("said", parts)).otherwise(single).alias("parts"))


def verses(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of XML with verses in attributes: sura, name, aya, opening, text (the opening line and the verse, blanks skipped)."""
    schema = "_index int, _name string, aya array<struct<_index:int,_text:string,_bismillah:string>>"
    rows = spark.read.format("xml").option("rowTag", "sura").schema(schema).load(path)
    each = rows.select(F.col("_index").alias("sura"), F.col("_name").alias("name"), F.explode("aya").alias("a"))
    whole = F.concat_ws(" ", F.nullif("a._bismillah", F.lit("")), F.nullif("a._text", F.lit("")))
    return each.select("sura", "name", F.col("a._index").alias("aya"), F.col("a._bismillah").alias("opening"), whole.alias("text"))


def passage_index(spark: SparkSession, path: str, source_sha256: str, group: str) -> DataFrame:
    """Passages of a stored index (gzip JSON): group, start_word, end_word, text, rows, poets.

    An index built from another state of the source is refused.
    """
    schema = "version int, analysis_source_sha256 string, display_source_sha256 string, passages array<struct<start_word:int,end_word:int,text:string,csv_rows:array<bigint>,poets:array<string>>>"
    document = json_document(spark, path, schema)
    found = document.select("analysis_source_sha256").first()
    if found is None or found[0] != source_sha256:
        raise ValueError(f"{group}: poetry example index is out of date. Rebuild the display sources.")
    each = document.select(F.explode("passages").alias("p"), "display_source_sha256")
    poets = F.coalesce("p.poets", F.expr("cast(array() as array<string>)"))
    return each.select(F.lit(group).alias("group"), "p.start_word", "p.end_word", "p.text", F.col("p.csv_rows").alias("rows"), poets.alias("poets"), "display_source_sha256")


def feature_kinds(spark: SparkSession) -> DataFrame:
    from stilus.functions.features import KINDS

    return spark.createDataFrame([(k, *v) for k, v in KINDS.items()], "id string, label string, description string")
