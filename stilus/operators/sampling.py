"""Word streams of groups of texts, and fixed-length samples cut from them.

A group's texts in their order are one word stream. Positions in it come from
prefix sums of word counts over blocks of texts and then within blocks, so no
task holds more than a block of rows of one group. Chunks are chosen from the
totals alone; only texts that overlap a chosen chunk have their words cut.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stilus.storage import stage

#: Texts of one group whose positions a task sums up together.
BLOCK = 4096
#: Texts of chosen chunks are looked up by broadcasting so many places; beyond, by shuffling.
BROADCAST = 1_000_000

# An error that clients know, and two warnings that go with results.
NO_CHUNKS = "{} has no complete chunks at this size. Reduce words per sample."
FEW_CHUNKS = "{}: only {} complete non-overlapping chunks available; requested {}."
ONE_CHUNK = "{}: one sample cannot establish within-group cohesion; its silhouette contribution is zero."


def counted(texts: DataFrame, words: Column) -> DataFrame:
    """Word counts (group, ord, n), written once: totals and positions need no more of the texts."""
    return stage(texts.select("group", "ord", F.size(words).cast("long").alias("n")), "counts")


def located(counts: DataFrame) -> DataFrame:
    """``counts`` (group, ord, n) with begin, the words of the group before the text.

    ``ord`` is a whole number that orders the texts of a group and does not repeat in it.
    """
    blocked = counts.withColumn("block", F.floor(F.col("ord") / BLOCK))
    blocks = blocked.groupBy("group", "block").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.partitionBy("group").orderBy("block")) - F.col("total")
    within = F.sum("n").over(Window.partitionBy("group", "block").orderBy("ord")) - F.col("n")
    based = blocks.select(F.col("group").alias("_g"), F.col("block").alias("_b"), before.alias("base"))
    placed = blocked.withColumn("within", within).join(based, (F.col("group") == F.col("_g")) & (F.col("block") == F.col("_b")))
    return placed.select("group", "ord", "n", (F.col("base") + F.col("within")).alias("begin"))


def totals(texts: DataFrame, words: Column) -> DataFrame:
    return texts.groupBy("group").agg(F.sum(F.size(words).cast("long")).alias("total"))


def totals_of(counts: DataFrame) -> DataFrame:
    return counts.groupBy("group").agg(F.sum("n").alias("total"))


def even_chunks(total: DataFrame, width: int, count: int) -> DataFrame:
    """Up to ``count`` complete chunks of each group, spread evenly from the first to the last."""
    have = total.withColumn("available", F.expr(f"total div {width}")).filter("available > 0")
    last = count - 1
    spread = F.expr(f"(2 * j * (available - 1) + {last}) div {2 * last}") if last else F.lit(0)
    chosen = have.withColumn("j", F.explode(F.expr(f"sequence(0, least({count}, available) - 1)")))
    return chosen.select("group", F.when(F.col("available") > count, spread).otherwise(F.col("j")).cast("long").alias("chunk"))


def seeded_indices(seed: int, ordinal: int, available: int, count: int) -> list[int]:
    """A sample without replacement from an own random stream for each group, in order."""
    stream = np.random.default_rng(np.random.SeedSequence([seed, ordinal]))
    return sorted(stream.choice(available, min(available, count), replace=False).tolist())


def seeded_chunks(total: DataFrame, groups: Sequence[str], width: int, count: int, seed: int, chosen: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Chunks drawn for ``chosen`` of ``groups`` (all), and warnings; a group without a complete chunk is an error.

    A group's place among ``groups`` starts its random stream, so that a
    choice of other groups does not change its samples.
    """
    have = {r.group: r.total // width for r in total.filter(F.col("group").isin(list(groups))).collect()}
    rows, warnings = [], []
    for ordinal, group in enumerate(groups):
        if chosen is not None and group not in chosen:
            continue
        available = have.get(group, 0)
        if not available:
            raise ValueError(NO_CHUNKS.format(group))
        if available < count:
            warnings.append(FEW_CHUNKS.format(group, available, count))
        if min(available, count) == 1:
            warnings.append(ONE_CHUNK.format(group))
        rows += [(group, c) for c in seeded_indices(seed, ordinal, available, count)]
    return total.sparkSession.createDataFrame(rows, "group string, chunk long"), warnings


def cut(texts: DataFrame, words: Column, chosen: DataFrame, width: int, counts: DataFrame | None = None) -> DataFrame:
    """One row a chosen chunk: group, chunk, words (array of ``width``).

    ``counts``: what ``counted`` gives, if it is there. Only the texts that
    overlap a chunk are read again; each gives a word to one at least, so there
    are no more of them than chosen words.
    """
    placed = located(counted(texts, words) if counts is None else counts).filter("n > 0")
    wanted = chosen.select(F.col("group").alias("_g"), "chunk", (F.col("chunk") * width).alias("low"), ((F.col("chunk") + 1) * width).alias("high"))
    overlap = (F.col("group") == F.col("_g")) & (F.col("begin") < F.col("high")) & (F.col("begin") + F.col("n") > F.col("low"))
    first = F.greatest(F.col("low") - F.col("begin"), F.lit(0))
    last = F.least(F.col("high") - F.col("begin"), F.col("n"))
    hits = stage(placed.join(wanted, overlap).select("group", "ord", "chunk", "begin", (first + 1).cast("int").alias("at"), (last - first).cast("int").alias("size")), "hits")
    met = texts.join(F.broadcast(hits) if hits.count() <= BROADCAST else hits, ["group", "ord"])
    pieces = met.select("group", "chunk", F.struct("begin", F.slice(words, F.col("at"), F.col("size")).alias("piece")).alias("p"))
    gathered = pieces.groupBy("group", "chunk").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return gathered.select("group", "chunk", F.flatten(F.transform("ps", lambda p: p["piece"])).alias("words"))


def samples(texts: DataFrame, words: Column, chosen: DataFrame, width: int, counts: DataFrame | None = None) -> DataFrame:
    """``cut`` with sample (an id), text (the words joined) and sha256 of the text."""
    return cut(texts, words, chosen, width, counts).select(
        F.format_string("%s-%d", "group", "chunk").alias("sample"), "group", "chunk", "words", F.array_join("words", " ").alias("text")
    ).withColumn("sha256", F.sha2("text", 256))


def catalog(groups: DataFrame, total: DataFrame) -> DataFrame:
    """Word count of each of ``groups`` (group, name, ord), 0 where there is no text, in their order."""
    return groups.join(total, "group", "left").select("group", "name", "ord", F.coalesce("total", F.lit(0)).alias("words")).orderBy("ord")
