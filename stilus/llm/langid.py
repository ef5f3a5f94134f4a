"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence multiply: how likely each language makes the visible
text (hashed byte trigrams, counted over labelled documents), the language
that the markup declares, the address suffix, and a prior of the host. What
declared values and suffixes say is learned from the pages by grouped sums of
the text's posteriors; so are the host priors, which are smoothed towards
those of the domain and these towards all pages. A page's own text does not
count among the evidence that is gathered for it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stilus.llm.common import stage, text_of
from stilus.llm.textkit import _LOWER, Slab, slabs
from stilus.llm.urltree import host_and_path

BUCKETS = 1 << 15
#: Added to each trigram count; pages' worth of trust in the level above; weight of a trigram, as trigrams overlap.
ADDED, TRUST, TEMPER = 0.5, 5.0, 1 / 3

_HIDDEN = re.compile(r"(?i)<!--|<(script|style)\b")
_ENDS = {None: re.compile("-->"), "script": re.compile(r"(?i)</script\s*>"), "style": re.compile(r"(?i)</style\s*>")}
_TAG = re.compile(r"<[^<>]*>")
#: The attribute itself: not one whose name only ends so, nor the inside of another's value.
_DECLARED = re.compile(r"""(?i)<html(?=[\s/])(?:[^>"']|"[^"]*"|'[^']*')*?[\s"'/]lang\s*=\s*["']?\s*([a-z]{2,8})""")


def shown(page: str) -> str:
    """The page without comments, scripts and styles; one that never ends hides nothing, and is looked for once."""
    pieces, at, endless = [], 0, set()
    for m in _HIDDEN.finditer(page):
        kind = m[1] and m[1].lower()
        if m.start() < at or kind in endless:
            continue
        if end := _ENDS[kind].search(page, m.end()):
            pieces.append(page[at : m.start()])
            at = end.end()
        else:
            endless.add(kind)
    return " ".join([*pieces, page[at:]])


def _trigrams(slab: Slab) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each byte trigram, and where each text's trigrams begin; one inside a single text counts."""
    x = _LOWER[slab.data].astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(slab.n + 1, np.int64)
    h = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17)
    inside = np.zeros(len(x) + 1, np.int64)
    size = np.diff(slab.offsets)
    some = size > 2
    np.add.at(inside, slab.offsets[:-1][some], 1)
    np.add.at(inside, slab.offsets[1:][some] - 2, -1)
    at = np.flatnonzero(np.cumsum(inside)[: len(h)] > 0)
    return h[at].astype(np.int64), np.searchsorted(at, slab.offsets)


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and log probabilities of trigram buckets, from all of ``labelled`` (text, lang).

    Rows without a language are left out; without any labelled row there are
    no languages. Each task sends one row a language, whatever the rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for slab in slabs(batch.column("text")):
                buckets, first = _trigrams(slab)
                own = langs[slab.first : slab.first + slab.n]
                of = np.repeat(own, np.diff(first))
                for lang in set(own):
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, np.int64)
                    sums[lang] += np.bincount(buckets[of == lang], minlength=BUCKETS)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "counts"])

    def total(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
        return pa.table([table.column("lang").slice(0, 1), pa.array([sums.tobytes()], pa.binary())], ["lang", "counts"])

    rows = labelled.filter("lang is not null").select("lang", text_of().alias("text"))
    found = rows.mapInArrow(count, "lang string, counts binary").groupBy("lang").applyInArrow(total, "lang string, counts binary")
    by = sorted((r.lang, np.frombuffer(r.counts, np.int64)) for r in found.collect())
    counts = np.array([c for _, c in by]).reshape(-1, BUCKETS) + ADDED
    return [lang for lang, _ in by], np.log(counts / counts.sum(axis=1, keepdims=True))


def _read(model: np.ndarray):
    """Each page's declared language, and its text's log likelihoods less the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [shown(x) for x in batch.column("html").to_pylist()]
            declared = [m[1].lower() if (m := _DECLARED.search(x)) else None for x in pages]
            texts = pa.array([html.unescape(_TAG.sub(" ", x)) for x in pages], pa.large_string())
            for slab in slabs(texts):
                buckets, first = _trigrams(slab)
                score, sums = np.zeros((slab.n, len(model))), np.zeros(len(buckets) + 1)
                for k, own in enumerate(model):
                    np.cumsum(own[buckets], out=sums[1:])
                    score[:, k] = (sums[first[1:]] - sums[first[:-1]]) * TEMPER
                score -= score.max(axis=1, keepdims=True, initial=-np.inf) if len(model) else 0
                kept = [batch.column(k).slice(slab.first, slab.n) for k in range(batch.num_columns - 1)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(slab.n + 1, dtype=np.int32) * len(model)), pa.array(score.ravel()))
                yield pa.RecordBatch.from_arrays([*kept, pa.array(declared[slab.first : slab.first + slab.n], pa.string()), lists], [*batch.schema.names[:-1], "declared", "text_score"])

    return run


def identify(pages: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """The language of every row of ``pages`` (page_id, url, html).

    Returns page_id, host, declared (null: none), text_lang (by the text
    alone), lang and confidence (its posterior). A page without text, or a
    null one, goes by the other evidence; a null URL has an empty host. Ties
    go to the language that comes first. Without any trained language the
    declared one is taken, text_lang and confidence being null. Repeated rows
    are judged alike; an empty table gives no rows; other columns are ignored.
    """
    host, _ = host_and_path(F.col("url"))
    parts = F.split("host", r"\.")
    rows = pages.select("page_id", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    read = rows.mapInArrow(_read(model), f"page_id {kind}, host string, declared string, text_score array<double>")
    if not languages:
        nothing = F.lit(None)
        return read.select("page_id", "host", "declared", nothing.cast("string").alias("text_lang"), F.col("declared").alias("lang"), nothing.cast("double").alias("confidence"))
    names = [f"p{k}" for k in range(len(languages))]
    total = F.aggregate(F.transform("text_score", F.exp), F.lit(0.0), lambda a, x: a + x)
    seen = read.withColumn("domain", F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))).withColumn("suffix", F.element_at(parts, -1))
    seen = stage(seen.select("*", *(F.exp(F.get("text_score", F.lit(k))) / total for k in range(len(languages)))).toDF(*seen.columns, *names), "pages")

    def summed(by: list[str], tag: str) -> DataFrame:
        return seen.groupBy(*by).agg(*(F.sum(n).alias(f"{tag}_{n}") for n in names), F.count("*").alias(f"{tag}_n"))

    everything = [float(x or 0) for x in seen.agg(*(F.sum(n) for n in names)).first()]
    n = sum(everything)
    overall = [(x + 1) / (n + len(names)) for x in everything]
    joined = seen
    for by, tag in ((["host"], "h"), (["domain"], "d"), (["suffix"], "s"), (["declared"], "c")):
        joined = joined.join(summed(by, tag).withColumnRenamed(by[0], f"_{tag}"), F.col(by[0]).eqNullSafe(F.col(f"_{tag}"))).drop(f"_{tag}")

    def posterior(k: int) -> Column:
        p = F.col(names[k])
        others = lambda tag: F.greatest(F.col(f"{tag}_{names[k]}") - p, F.lit(0.0))
        count = lambda tag: F.col(f"{tag}_n") - 1
        domain = (others("d") + TRUST * overall[k]) / (count("d") + TRUST)
        prior = (others("h") + TRUST * domain) / (count("h") + TRUST)

        def lift(tag: str) -> Column:
            share = (count(tag) + 1) / max(n, 1.0)
            return (others(tag) + TRUST * share) / (everything[k] + TRUST) / share

        said = F.when(F.col("declared").isNull(), 0.0).otherwise(F.log(lift("c")))
        return F.get("text_score", F.lit(k)) + F.log(prior) + said + F.log(lift("s"))

    scored = joined.withColumn("scores", F.array(*(posterior(k) for k in range(len(names)))))
    best = F.array_max("scores")
    place = lambda scores, top: F.element_at(F.array(*map(F.lit, languages)), F.array_position(scores, top).cast("int"))
    confidence = 1 / F.aggregate(F.transform("scores", lambda x: F.exp(x - best)), F.lit(0.0), lambda a, x: a + x)
    return scored.select("page_id", "host", "declared", place(F.col("text_score"), F.array_max("text_score")).alias("text_lang"), place(F.col("scores"), best).alias("lang"), confidence.alias("confidence"))
