"""Line deduplication by a deletion-neighbourhood join.

A line is a sequence of words. Equal lines are found by one hash. For lines
within one edited word, every line gives the keys of all sequences with at
most one word deleted: lines of equal length that differ in one word agree
without it, and a line with a word more agrees without it with the other.
Two lines that share such a key are compared word by word.

All variants of all lines would be as many as the corpus has words, so an
exact filter comes first: of two lines within one edit, the first or the
second half agrees, and only lines that share a half with another line take
part. Groups of equal or similar lines are handled by their earliest member,
found by grouped minima, so a very common line is never gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stilus.llm.common import WORD, free_name, packs, stage, text_of
from stilus.llm.sharing import shared
from stilus.llm.textkit import Sequences, Slab, mix, slabs

_U = np.uint64
#: Lines of fewer words stay (1: those without a word); lines of at least NEAR words may differ by a word.
LEAST, NEAR = 1, 8
#: Texts are looked up by broadcasting their keys and line numbers up to so many bytes; beyond, by shuffling.
BROADCAST = 16 << 20
#: Pairs with one line that a task compares, about.
TOGETHER = 128


def _lines(slab: Slab, least: int):
    """Hashes of the slab's words; and of its lines of enough words: text, number in the text, first word and end."""
    starts, ends, first = slab.lines
    w_starts, w_ends, _ = slab.words
    words = slab.hashes(w_starts, w_ends, lower=True)
    a, b = np.searchsorted(w_starts, starts), np.searchsorted(w_starts, ends)
    owner = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
    number = np.arange(len(starts)) - first[owner]
    long = b - a >= least
    return words, owner[long], number[long], a[long], b[long]


def _halves(seq: Sequences, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of the halves that a line shares with one within an edit: as the shorter, or equal, and as the longer.

    A first and a last half of one less word are the same for odd and for even
    lengths, so three keys are enough.
    """
    n = b - a
    odd = n % 2
    first, last = n // 2, (n + 1) // 2
    other = np.where(odd == 1, mix(seq.span(b - first, b) + _U(1)), mix(seq.span(a, a + first - 1 + odd)))
    return np.stack([mix(seq.span(a, a + first)), mix(seq.span(b - last, b) + _U(1)), other], axis=1)


def _read(least: int, near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column("text")):
                words, owner, number, a, b = _lines(slab, least)
                seq = Sequences(words)
                halves = _halves(seq, a, b).view(np.int64)
                long = b - a >= near
                offsets = np.concatenate([[0], np.cumsum(np.where(long, 3, 0))]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(halves[long].ravel()))
                at = pa.array(owner + slab.first)
                yield pa.RecordBatch.from_arrays([batch.column("row").take(at), batch.column("place").take(at), pa.array(number.astype(np.int32)), pa.array(seq.span(a, b).view(np.int64)), keys], ["row", "place", "number", "line", "halves"])

    return run


def _variants(least: int):
    """For the wanted lines of each text: the line's words, and all keys with at most one word deleted (-1: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column("text")):
                words, owner, number, a, b = _lines(slab, least)
                wanted = batch.column("wanted").slice(slab.first, slab.n)
                of = np.repeat(np.arange(slab.n), np.diff(wanted.offsets.to_numpy()))
                asked = (of << 32) | wanted.flatten().to_numpy()
                mine = np.isin((owner << 32) | number, asked)
                owner, number, a, b = (x[mine] for x in (owner, number, a, b))
                seq = Sequences(words)
                n = b - a
                which = np.repeat(np.arange(len(n)), n)
                i = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + a[which]
                line = seq.span(a, b)
                keys = np.concatenate([line, seq.without(a[which], b[which], i)])
                which, gone = np.concatenate([np.arange(len(n)), which]), np.concatenate([np.full(len(n), -1), i - a[which]])
                spread = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                sequence = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(gone < 0, n[which], 0))]).astype(np.int32)), pa.array(words[spread].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(line[which].view(np.int64)), pa.array(n[which].astype(np.int32)), pa.array(keys.view(np.int64)), pa.array(gone.astype(np.int32)), sequence], ["line", "n", "key", "gone", "words"])

    return run


def within_one(x: Column, y: Column) -> Column:
    """Whether arrays are at edit distance 0 or 1: what agrees from both ends covers all but one."""
    agree = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.coalesce(p == q, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])
    longer = F.greatest(F.size(x), F.size(y))
    return (F.abs(F.size(x) - F.size(y)) <= 1) & (agree(x, y) + agree(F.reverse(x), F.reverse(y)) >= longer - 1)


def _keyed(docs: DataFrame) -> DataFrame:
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    return docs.select(F.xxhash64("doc_id", text_of()).alias("row"), place.alias("place"), text_of().alias("text"))


def repeated_lines(docs: DataFrame, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """The lines to drop: row (a hash of doc_id and text), number (from 0), edited (0: equal to an earlier line, 1: one word off).

    A line of at least ``least`` words is dropped if an earlier line of the
    corpus equals it, or is within one word inserted, deleted or replaced and
    both have ``near`` words or more (one may have one less than that in the
    shorter's place: both must reach ``near``). Words are compared lower-cased
    in A-Z. Earlier is by doc_id (null last), then row, then line number.
    """
    rows = _keyed(docs)
    lines = stage(rows.mapInArrow(_read(least, near), "row long, place long, number int, line long, halves array<long>"), "lines")
    order = F.struct("place", "row", "number")
    first = stage(lines.groupBy("line").agg(F.min(order).alias("order"), F.count("*").alias("times")), "first")
    again = lines.join(first.filter("times > 1").select("line", "order"), "line").filter(order > F.col("order"))
    equal = again.select("row", "number", F.lit(0).alias("edited"))

    spark = docs.sparkSession
    entries = lines.agg(F.sum(F.greatest(F.size("halves"), F.lit(0)))).first()[0] or 0
    halves = lines.filter(F.size("halves") > 0).select(F.explode("halves").alias("key"), F.col("line").alias("value"), F.lit(0).alias("extra"))
    able = shared(halves, packs(spark, entries, 20)).select(F.col("value").alias("line")).distinct()
    wanted = stage(first.select("line", "order").join(able, "line", "left_semi").groupBy("order.row").agg(F.collect_set("order.number").alias("wanted")), "wanted")
    if wanted.isEmpty():
        return equal
    size = wanted.agg(F.sum(16 + 4 * F.size("wanted"))).first()[0]
    held = rows.join(F.broadcast(wanted) if size <= BROADCAST else wanted, "row")
    variants = stage(held.mapInArrow(_variants(least), "line long, n int, key long, gone int, words array<long>"), "variants")

    met = shared(variants.select("key", F.col("line").alias("value"), F.col("gone").alias("extra")), packs(spark, variants.count(), 20))
    met = met.distinct().select("key", F.col("value").alias("line"), F.col("extra").alias("gone"))
    size = variants.filter("gone < 0").select("line", "n").distinct()
    placed = stage(met.join(size, "line").join(first.select("line", "order"), "line"), "met")
    one = placed.filter("gone >= 0")
    leads = one.groupBy("key", "n", "gone").agg(F.min(F.struct("order", "line")).alias("lead"), F.count("*").alias("times")).filter("times > 1").drop("times")
    replaced = one.join(leads, ["key", "n", "gone"]).filter("order > lead.order").select("line", F.col("lead.line").alias("other"))
    whole = placed.filter("gone < 0").select("key", F.col("line").alias("whole"), F.col("order").alias("whole_order"))
    both = one.join(whole, "key").filter("line <> whole")
    later = F.col("order") > F.col("whole_order")
    inserted = both.select(F.when(later, F.col("line")).otherwise(F.col("whole")).alias("line"), F.when(later, F.col("whole")).otherwise(F.col("line")).alias("other"))
    pairs = stage(replaced.union(inserted).distinct(), "line-pairs")
    words = variants.filter("gone < 0").dropDuplicates(["line"]).select("line", "words")
    # A line that very many others resemble meets them in several tasks.
    hot = stage(pairs.groupBy("other").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("salts")).filter("salts > 1"), "hot-lines")
    hot = F.broadcast(hot) if hot.count() * 16 <= BROADCAST else hot
    salts = F.coalesce("salts", F.lit(1))
    dealt = pairs.join(hot, "other", "left").select("line", "other", F.pmod(F.xxhash64("line"), salts).cast("int").alias("salt"))
    others = words.select(F.col("line").alias("other"), F.col("words").alias("others")).join(hot, "other", "left")
    others = others.select("other", "others", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    checked = dealt.join(words, "line").join(others, ["other", "salt"]).filter(within_one(F.col("words"), F.col("others")))
    near_lines = checked.select("line").distinct()
    edited = first.join(near_lines, "line", "left_semi").select("order.row", "order.number", F.lit(1).alias("edited"))
    return equal.union(edited)


def without_repeats(docs: DataFrame, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """``docs`` with the repeated lines of ``text`` dropped, and n_chars, if there, counted anew; all else unchanged.

    A text without dropped lines, also null or empty, stays as it is. A row
    whose dropped lines leave no word goes: all it said is said earlier.
    Repeated rows count as one document and are treated alike.
    """
    row, drop = free_name(docs, "row"), free_name(docs, "drop")
    lines = repeated_lines(docs, least, near).groupBy("row").agg(F.collect_set("number").alias(drop)).withColumnRenamed("row", row)
    joined = docs.withColumn(row, F.xxhash64("doc_id", text_of())).join(lines, row, "left")
    whole = F.col(drop).isNull()
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(drop, i)), "\n")
    out = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.filter(whole | F.col("text").rlike(WORD)).select(*docs.columns)


def line_counts(docs: DataFrame, least: int = LEAST, near: int = NEAR) -> DataFrame:
    """doc_id, n_lines, n_equal and n_edited (lines dropped), and the text that is left (null: empty)."""
    drop = repeated_lines(docs, least, near).groupBy("row").agg(F.collect_set("number").alias("drop"), F.count_distinct(F.when(F.col("edited") == 0, F.col("number"))).alias("n_equal"))
    joined = docs.select("doc_id", text_of().alias("text"), F.xxhash64("doc_id", text_of()).alias("row")).join(drop, "row", "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("drop", i)), "\n"))
    n_equal = F.coalesce("n_equal", F.lit(0))
    return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), n_equal.alias("n_equal"), (F.coalesce(F.size("drop"), F.lit(0)) - n_equal).cast("long").alias("n_edited"), kept.alias("text"))
