"""Timed text: cutting timed words into cues, splicing, translation, and checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stilus.functions import text as tx
from stilus.operators.numbering import numbered


@dataclass(frozen=True)
class Limits:
    # Seconds and characters of a cue, and what closes one.
    longest: float = 5.8
    widest: int = 78
    shortest: float = 1.4
    joined: float = 8.0
    stops: str = ".،؟!"


def cut(segments: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Cues of ``segments`` (id, words: array of word, start, end): segment_id, number, id, start, end, text.

    A fold over the words of each segment: a word that would make the cue too
    long or too wide begins a new one; a stop ends a cue that is long enough.
    A short last cue joins the one before it if both together are not too
    long. All of it is one expression over the array.
    """
    cue = "struct<start:double,end:double,text:string,width:int>"

    def step(done: Column, w: Column) -> Column:
        open_ = F.when(done["open"].isNotNull() & ((w["end"] - done["open"]["start"] > limits.longest) | (done["open"]["width"] + F.length(w["word"]) > limits.widest)), F.lit(None).cast(cue)).otherwise(done["open"])
        out = F.when(done["open"].isNotNull() & open_.isNull(), F.array_append(done["out"], done["open"])).otherwise(done["out"])
        word = tx.trimmed(w["word"])
        grown = F.struct(F.coalesce(open_["start"], w["start"]).cast("double").alias("start"), w["end"].cast("double").alias("end"), F.when(open_.isNull(), word).otherwise(F.concat(open_["text"], F.lit(" "), word)).alias("text"), (F.coalesce(open_["width"] + 1, F.lit(0)) + F.length(w["word"])).alias("width"))
        closes = F.right(w["word"], F.lit(1)).isin(list(limits.stops)) & (w["end"] - grown["start"] >= limits.shortest)
        return F.struct(F.when(closes, F.array_append(out, grown)).otherwise(out).alias("out"), F.when(closes, F.lit(None).cast(cue)).otherwise(grown).alias("open"))

    start = F.struct(F.expr(f"cast(array() as array<{cue}>)").alias("out"), F.lit(None).cast(cue).alias("open"))
    closed = F.aggregate("words", start, step, lambda x: F.when(x["open"].isNull(), x["out"]).otherwise(F.array_append(x["out"], x["open"])))
    made = segments.select(F.col("id").alias("segment_id"), closed.alias("cues")).filter(F.size("cues") > 0)
    n = F.size("cues")
    last, prior = F.get("cues", n - 1), F.get("cues", n - 2)
    short = (n >= 2) & (last["end"] - last["start"] < limits.shortest) & (last["end"] - prior["start"] <= limits.joined)
    whole = F.struct(prior["start"].alias("start"), last["end"].alias("end"), F.concat(prior["text"], F.lit(" "), last["text"]).alias("text"), prior["width"].alias("width"))
    joined = F.when(short, F.array_append(F.slice("cues", F.lit(1), F.greatest(n - 2, F.lit(0))), whole)).otherwise(F.col("cues"))
    each = made.select("segment_id", F.posexplode(joined).alias("k", "c"))
    return each.select("segment_id", (F.col("k") + 1).alias("number"), F.format_string("%s.%d", F.col("segment_id").cast("string"), F.col("k") + 1).alias("id"), "c.start", "c.end", "c.text")


def shifted(segments: DataFrame, offset: Column) -> DataFrame:
    """Segments (start, end, words) moved by an offset in seconds."""
    words = F.transform("words", lambda w: F.struct(w["word"].alias("word"), (w["start"] + offset).alias("start"), (w["end"] + offset).alias("end")))
    return segments.withColumns({"words": words, "start": F.col("start") + offset, "end": F.col("end") + offset})


def spliced(segments: DataFrame, review: DataFrame, threshold: float = 915.3, reach: float = 950.0) -> DataFrame:
    """Segments that end before the threshold, then those of a review from it on, rounded to milliseconds and numbered anew.

    ``ValueError`` if the last of these does not end after ``reach``.
    """
    last = review.filter(F.col("start") >= threshold).agg(F.max_by("end", "start")).first()[0]
    if last is None or last <= reach:
        raise ValueError(f"the review must go on beyond {reach} s")
    ms = lambda c: F.bround(c, 3)
    words = F.transform("words", lambda w: F.struct(w["word"].alias("word"), ms(w["start"]).alias("start"), ms(w["end"]).alias("end")))
    base = segments.filter(F.col("end") < threshold).select(F.lit(0).alias("part"), "start", "end", "text", "words")
    tail = review.filter(F.col("start") >= threshold).select(F.lit(1).alias("part"), ms(F.col("start")).alias("start"), ms(F.col("end")).alias("end"), "text", words.alias("words"))
    return numbered(base.unionByName(tail), "id", "part", "start").drop("part")


def translated(cues: DataFrame, translations: DataFrame, trimmed=tx.trimmed) -> DataFrame:
    """Captions of cues by translations (id, parts: array of start, end, text; nulls take the cue's times).

    Every cue needs a translation and every translation a cue. ``trimmed``
    clears the ends of a text, of all white space if not given.
    """
    if not cues.join(translations, "id", "left_anti").isEmpty() or not translations.join(cues, "id", "left_anti").isEmpty():
        raise ValueError("Every source cue needs a translation.")
    each = cues.join(translations, "id").select(F.col("id").alias("source_id"), F.col("start").alias("cue_start"), F.col("end").alias("cue_end"), F.posexplode("parts").alias("k", "p"))
    return each.select("source_id", "k", "cue_start", "cue_end", F.coalesce("p.start", "cue_start").alias("start"), F.coalesce("p.end", "cue_end").alias("end"), trimmed(F.col("p.text")).alias("text"))


def checked(captions: DataFrame, duration: float, order: Window | None = None) -> DataFrame:
    """Captions with one boolean for each rule; ``group``, if there, keeps sequences apart.

    Rules: plain (text without Arabic letters or markup), inside (within 0.15 s
    of the cue), ordered (starts before it ends), ends (before the whole does),
    brief (10 s), slow (32 characters a second), follows (at most 0.01 s before
    the last one ended).
    """
    by = [c for c in ("group",) if c in captions.columns]
    window = order or Window.partitionBy(*by).orderBy("start", "end")
    length = F.col("end") - F.col("start")
    last = F.lag("end").over(window)
    return captions.select(
        "*",
        ((F.col("text") != "") & ~F.col("text").rlike("[؀-ۿ<>]")).alias("plain"),
        ((F.col("cue_start") - 0.15 <= F.col("start")) & (F.col("end") <= F.col("cue_end") + 0.15)).alias("inside"),
        (F.col("start") < F.col("end")).alias("ordered"),
        (F.col("end") <= duration).alias("ends"),
        (length <= 10).alias("brief"),
        F.coalesce(F.length("text") / F.when(length > 0, length) <= 32, F.lit(False)).alias("slow"),
        F.coalesce(F.col("start") >= last - 0.01, F.lit(True)).alias("follows"),
    )


RULES = ("plain", "inside", "ordered", "ends", "brief", "slow", "follows")


def require(rules: DataFrame) -> None:
    """``ValueError`` naming the rules that some caption breaks."""
    counts = rules.agg(*(F.count_if(~F.col(r)).alias(r) for r in RULES)).first()
    if broken := [r for r in RULES if counts[r]]:
        raise ValueError("captions break: " + ", ".join(broken))


def wrapped(captions: DataFrame, width: int = 52, lines: int = 2) -> DataFrame:
    """Captions with text wrapped into lines; more than ``lines`` is an error."""
    made = captions.withColumn("_lines", tx.wrapped(width)(F.col("text")))
    fits = F.when(F.size("_lines") <= lines, F.array_join("_lines", "\n")).otherwise(F.raise_error(F.concat(F.lit("Split this caption: "), "text")))
    return made.withColumn("text", fits).drop("_lines")
