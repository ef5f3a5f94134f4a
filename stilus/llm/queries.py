"""The queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stilus.llm import cascade, kneser_ney, langid, linededup, mixing, packing, partenum, sanitise, urltree, vptree
from stilus.llm.common import documents, table


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vptree.nearest(vectors, vectors.filter("id % 50 = 0"), k=5)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.perplexity_scores(documents(spark, sf_dir))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.similar_documents(documents(spark, sf_dir), width=3, percent=90)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.measured(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_counts(documents(spark, sf_dir))


#: The rules of the URL filter's query.
URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose id its path ends in: bad if toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels")
    labels = labels.groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    _, path = urltree.host_and_path(F.col("url"))
    keyed = pages.withColumn("doc_id", F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("long"))
    return urltree.judged(keyed.join(labels, "doc_id", "left").select("page_id", "url", "bad"), URL_RULES)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.digests(sanitise.found_spans(documents(spark, sf_dir)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return langid.identify(pages, *langid.fit(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_nearest, op2_lm_scoring, op3_ngram_jaccard, op4_mixing, op5_quality_rules, op6_packing, op7_line_dedup, op8_url_filters, op9_pii, op10_language_id]
    return {f.__name__: f for f in found}


#: The counts and rules of operator 5, window by window and line by line.
QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT id, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT id, count(DISTINCT i + j) AS n FROM rep, range(8) r(j) GROUP BY id),
ln AS (SELECT id, x FROM (SELECT id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT id, count(*) - count(DISTINCT x) AS n FROM ln GROUP BY id),
f AS (SELECT doc_id, text, words, len(words) AS n_words, list_sum(list_transform(words, lambda x: length(x))) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
    len(string_split(text, chr(10))) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_, length(regexp_replace(text, '[^\p{L}\p{M}]', '', 'g')) AS letters,
    length(regexp_replace(text, '[^!]', '', 'g')) AS bangs,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM w LEFT JOIN dup USING (id) LEFT JOIN cov USING (id)),
s AS (SELECT *, regexp_extract_all(low, '[^\x20\x09-\x0D]+') AS lw FROM f),
v AS (SELECT *, len(list_filter(range(2, len(lw) + 1), lambda i: lw[i] = lw[i - 1])) AS stutters, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_symbols > 0.1 * n_words OR n_dup_lines > 2 AND n_dup_lines > 0.3 * n_lines OR stutters > 0.3 * n_words
    OR word_chars / n_words < 1.25 OR word_chars / n_words > 20 OR upper_ > 0.5 * greatest(letters, 1) OR letters < 0.4 * greatest(length(text), 1) OR bangs > 0.3 * n_words) AS kept
FROM v"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": QUALITY_SQL}
