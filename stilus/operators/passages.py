"""Known passages inside word streams: matching, conflicts, selection, overlay, quotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stilus.functions import text as tx

#: Letters by which a passage is first looked up, and which it must have at least.
ANCHOR = 24
#: Characters (or words) of a bucket in which intervals that may overlap meet.
BUCKET = 4096
#: Words of a block that is searched on its own, and blocks that a stream has at most (then they are longer).
WORDS, BLOCKS = 32, 4096
#: Known passages are broadcast up to so many bytes; beyond, word starts are shuffled by anchor.
BROADCAST_BYTES = 32 << 20


def anchors(passages: DataFrame, shortest: int = ANCHOR) -> DataFrame:
    """(row, key, display) of passages with enough letters, with the key's first letters as anchor."""
    return passages.filter(F.length(F.replace("key", F.lit(" "), F.lit(""))) >= shortest).withColumn("anchor", F.substring("key", 1, shortest))


def _small(given: DataFrame) -> tuple[bool, int]:
    """Whether the known passages may be broadcast, by their counted bytes, and the words of the longest."""
    size = F.sum(F.octet_length("key") + F.octet_length("display") + 32)
    held, longest = given.agg(size, F.max("size")).first()
    return (held or 0) <= BROADCAST_BYTES, longest or 0


def matched(streams: DataFrame, known: DataFrame, shortest: int = ANCHOR) -> DataFrame:
    """Whole passages found in texts: group, start, end, start_word, end_word, text, rows.

    ``streams``: group, tokens (normalised; may be empty strings, which take
    no width). ``known``: row, key, display. A passage starts and ends at word
    bounds and its display has as many words as the stream between. Streams
    are cut into blocks of words that look ahead as far as the longest passage
    reaches, so that each block is searched on its own: its word starts meet
    the anchors, and what follows decides. Equal matches of several rows
    become one.
    """
    given = anchors(known, shortest).withColumn("size", F.size(F.split("key", " "))).withColumn("words", F.size(F.split("display", " ")))
    small, longest = _small(given)
    words = F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda w: w["t"] != "")
    held = streams.select("group", F.transform(words, lambda w: w["t"]).alias("ts"), F.transform(words, lambda w: w["i"]).alias("places")).filter(F.size("ts") > 0)
    held = held.withColumn("step", F.greatest(F.lit(WORDS), F.expr(f"cast(size(ts) div {BLOCKS} as int)")))
    held = held.withColumn("firsts", F.expr("sequence(0, size(ts) - 1, step)"))

    def add(done: Column, first: Column) -> Column:
        width = F.aggregate(F.slice("ts", first + 1, F.col("step")), F.lit(0), lambda n, t: n + F.length(t) + 1)
        return F.struct((done["at"] + width).alias("at"), F.array_append(done["out"], done["at"]).alias("out"))

    before = F.aggregate("firsts", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), add, lambda x: x["out"])
    reach = F.col("step") + longest - 1
    part = lambda name, first: F.slice(name, first + 1, reach)
    cut = F.transform(F.arrays_zip("firsts", "bases"), lambda b: F.struct(b["bases"].alias("base"), F.array_join(part("ts", b["firsts"]), " ").alias("ahead"), part("places", b["firsts"]).alias("at_word")))
    blocks = held.withColumn("bases", before).select("group", "step", F.explode(cut).alias("b")).select("group", "step", "b.*")
    # One anchor a word start, in order; starts with too few characters ahead are the last ones.
    starts = F.regexp_extract_all("ahead", F.lit(f"(?s)(?<![^ ])(?=(.{{{shortest}}}))"), F.lit(1))
    probes = blocks.select("group", "base", "ahead", "at_word", F.posexplode(F.slice(starts, F.lit(1), F.col("step"))).alias("at", "anchor"))
    hits = probes.join(F.broadcast(given) if small else given, "anchor")
    skipped = F.length(F.expr("substring_index(ahead, ' ', at)")) + F.when(F.col("at") > 0, 1).otherwise(0)
    hits = hits.withColumn("skipped", skipped)
    exact = hits.filter(F.substring(F.concat("ahead", F.lit(" ")), F.col("skipped") + 1, F.length("key") + 1) == F.concat("key", F.lit(" ")))
    start = F.col("base") + F.col("skipped")
    start_word, end_word = F.get("at_word", F.col("at")), F.get("at_word", F.col("at") + F.col("size") - 1) + 1
    placed = exact.select("group", start.alias("start"), (start + F.length("key")).alias("end"), F.col("display").alias("text"), start_word.alias("start_word"), end_word.alias("end_word"), "row", "words")
    same = placed.filter("words = end_word - start_word")
    return same.groupBy("group", "start", "end", "text").agg(F.min("start_word").alias("start_word"), F.min("end_word").alias("end_word"), F.sort_array(F.collect_list("row")).alias("rows"))


def conflicts(found: DataFrame) -> DataFrame:
    """The matches that overlap another one of the group with different text in the overlap: group, start, end, text.

    Matches meet in the buckets of characters that they touch, so that only
    neighbours are compared.
    """
    spread = found.select("group", "start", "end", "text", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor((F.col("end") - 1) / BUCKET))).alias("bucket"))
    a, b = (spread.select("group", "bucket", *(F.col(c).alias(f"{c}_{k}") for c in ("start", "end", "text"))) for k in ("a", "b"))
    meet = a.join(b, ["group", "bucket"]).filter("start_a < end_b and start_b < end_a")
    low, high = F.greatest("start_a", "start_b"), F.least("end_a", "end_b")
    part = lambda k: F.substring(F.col(f"text_{k}"), low - F.col(f"start_{k}") + 1, high - low)
    return meet.filter(part("a") != part("b")).select("group", F.col("start_a").alias("start"), F.col("end_a").alias("end"), F.col("text_a").alias("text")).distinct()


def _islands(intervals: DataFrame, order: list[Column], apart) -> DataFrame:
    """Number as ``island`` the stretches of a group's intervals; a new one begins where ``apart`` of the furthest end so far holds.

    Running values go over buckets of starts, one narrow row each, and then
    within buckets, so that no task sorts a whole group.
    """
    bucket = F.floor(F.col("start") / BUCKET).alias("_b")
    own = Window.partitionBy("group", "_b").orderBy(*order)
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = Window.partitionBy("group").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)

    def based(rows: DataFrame, value: Column, over_buckets) -> DataFrame:
        total = rows.groupBy("group", "_b").agg(value.alias("_t"))
        total = total.select(F.col("group").alias("_g"), F.col("_b").alias("_c"), over_buckets("_t").over(by_bucket).alias("_before"))
        return rows.join(total, F.col("group").eqNullSafe(F.col("_g")) & F.col("_b").eqNullSafe(F.col("_c"))).drop("_g", "_c")

    reached = based(intervals.select("*", bucket), F.max("end"), F.max)
    reach = F.greatest("_before", F.max("end").over(earlier))
    begun = reached.withColumn("_new", F.coalesce(apart(reach).cast("int"), F.lit(1))).drop("_before")
    numbered = based(begun, F.sum("_new"), F.sum)
    # Equal intervals share an island: by rows, one that a sort puts before the equal one that begins it would stay in the last.
    island = F.coalesce("_before", F.lit(0)) + F.sum("_new").over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn("island", island).drop("_b", "_new", "_before")


def selected(found: DataFrame) -> DataFrame:
    """Matches without conflict that do not overlap: from the left, the longest first.

    Overlapping matches form runs, cut where a match starts after all earlier
    ones ended; the choice is a fold over each run, so a group's matches are
    never gathered in one place but for the runs themselves.
    """
    keys = ["group", "start", "end", "text"]
    clear = found.join(conflicts(found), keys, "left_anti")
    runs = _islands(clear, [F.col("start"), F.desc("end"), F.col("text")], lambda reach: F.col("start") >= reach).withColumnRenamed("island", "run")
    rows = F.sort_array(F.collect_list(F.struct("start", (-F.col("end")).alias("minus_end"), "text", "start_word", "end_word", "rows")))
    gathered = runs.groupBy("group", "run").agg(rows.alias("ms"))
    zero = F.expr("cast(null as int)")

    def step(done: Column, m: Column) -> Column:
        fits = F.coalesce(m["start"] >= done["at"], F.lit(True))
        return F.struct(F.when(fits, -m["minus_end"]).otherwise(done["at"]).alias("at"), F.when(fits, F.array_append(done["out"], m)).otherwise(done["out"]).alias("out"))

    empty = F.filter("ms", lambda m: F.lit(False))
    kept = F.aggregate("ms", F.struct(zero.alias("at"), empty.alias("out")), step, lambda x: x["out"])
    return gathered.select("group", F.explode(kept).alias("m")).select("group", "m.start", (-F.col("m.minus_end")).alias("end"), "m.text", "m.start_word", "m.end_word", "m.rows")


def attributed(passages: DataFrame, names: DataFrame) -> DataFrame:
    """``passages`` with poets: the names (row, name) of their rows, distinct, sorted, blank ones dropped."""
    key = ["group", "start", "end", "text"]
    named = passages.select(*key, F.explode("rows").alias("row")).join(names, "row").filter("name <> ''")
    poets = named.groupBy(*key).agg(F.sort_array(F.collect_set("name")).alias("poets"))
    return passages.join(poets, key, "left").withColumn("poets", F.coalesce("poets", F.expr("cast(array() as array<string>)")))


def merged(intervals: DataFrame) -> DataFrame:
    """(group, start, end) with overlapping or touching intervals made one, so that what they cover counts once."""
    numbered = _islands(intervals, [F.col("start"), F.col("end")], lambda reach: F.col("start") > reach)
    return numbered.groupBy("group", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def coverage(passages: DataFrame, totals: DataFrame) -> DataFrame:
    """group, matched_words, source_words, coverage_percent, passages."""
    own = passages.groupBy("group").agg(F.sum(F.col("end_word") - F.col("start_word")).alias("matched_words"), F.count("*").alias("passages"))
    joined = totals.join(own, "group", "left").na.fill(0, ["matched_words", "passages"])
    return joined.select("group", "matched_words", F.col("total").alias("source_words"), F.bround(100 * F.col("matched_words") / F.col("total"), 2).alias("coverage_percent"), "passages")


def overlaid(samples: DataFrame, passages: DataFrame) -> DataFrame:
    """Samples with display_text and display_spans: passages' own spelling where they cover the sample.

    ``samples``: sample, group, start_word, tokens (normalised, may be empty),
    text (the tokens that are not empty, joined). Passages are clipped to the
    sample; a clipped passage whose length differs from the sample's own text
    is an error, as offsets would drift.
    """
    buckets = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / BUCKET), F.floor((F.col(high) - 1) / BUCKET)))
    sized = samples.withColumn("stop_word", F.col("start_word") + F.size("tokens")).filter("stop_word > start_word").select("*", buckets("start_word", "stop_word").alias("_b"))
    p = passages.filter("end_word > start_word").select(F.col("group").alias("_g"), F.col("start_word").alias("p_start"), F.col("end_word").alias("p_end"), F.col("text").alias("p_text"), "rows", "poets", buckets("start_word", "end_word").alias("_c"))
    # A pair counts in the first bucket that both touch.
    once = F.col("_b") == F.greatest(F.floor(F.col("start_word") / BUCKET), F.floor(F.col("p_start") / BUCKET))
    met = sized.join(p, (F.col("group") == F.col("_g")) & (F.col("_b") == F.col("_c"))).filter((F.col("p_start") < F.col("stop_word")) & (F.col("p_end") > F.col("start_word")) & once)
    a, b = F.greatest("start_word", "p_start"), F.least("stop_word", "p_end")
    shown = F.array_join(F.slice(F.split("p_text", " "), a - F.col("p_start") + 1, b - a), " ")
    covered = F.array_join(F.filter(F.slice("tokens", a - F.col("start_word") + 1, b - a), lambda t: t != ""), " ")
    left = F.aggregate(F.slice("tokens", F.lit(1), a - F.col("start_word")), F.lit(0), lambda s, t: s + F.when(t == "", 0).otherwise(F.length(t) + 1))
    checked = F.when(F.length(shown) == F.length(covered), shown).otherwise(F.raise_error(F.concat(F.col("group"), F.lit(": poetry example alignment has changed. Rebuild the display sources."))))
    clipped = met.select("sample", F.struct(left.alias("start"), (left + F.length(shown)).alias("end"), F.col("rows").alias("csv_rows"), "poets", checked.alias("shown")).alias("s"))
    spans = clipped.groupBy("sample").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    joined = samples.join(spans, "sample", "left")

    def step(done: Column, s: Column) -> Column:
        kept = F.substring(F.col("text"), done["at"] + 1, s["start"] - done["at"])
        return F.struct(s["end"].alias("at"), F.concat(done["out"], kept, s["shown"]).alias("out"))

    text = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda x: F.concat(x["out"], F.substring(F.col("text"), x["at"] + 1, F.length("text"))))
    none = F.expr("cast(array() as array<struct<start:int,end:int,csv_rows:array<bigint>,poets:array<string>>>)")
    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["csv_rows"].cast("array<bigint>").alias("csv_rows"), s["poets"].alias("poets")))
    return joined.withColumn("display_text", F.coalesce(text, "text")).withColumn("display_spans", F.coalesce(plain, none)).drop("spans")


def outside(passages: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Passages that no chosen chunk (group, chunk) of ``width`` words touches."""
    touched = passages.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start_word") / width), F.floor((F.col("end_word") - 1) / width))))
    hit = touched.join(chunks, ["group", "chunk"], "left_semi").select("group", "start", "end", "text").distinct()
    return passages.join(hit, ["group", "start", "end", "text"], "left_anti")


def first_example(passages: DataFrame, feature: str, kind: str, analysed: Column) -> DataFrame:
    """For each group, the first passage that holds the feature, as a keyword in context of its own spelling.

    ``analysed``: the passage's text as the experiment counts it, of equal
    length. Returns group, start_word, end_word, rows, analysis_match, before,
    match, after.
    """
    if kind == "length":
        low = int(feature)
        size = f"{low},}}" if low >= 15 else f"{low}}}"
        pattern = "(?<!\\S)\\S{" + size + "(?!\\S)"
    else:
        pattern = tx.whole_word(feature, kind)
    found = passages.withColumn("analysed", analysed).withColumn("gap", F.get(F.split("analysed", pattern, 2), F.lit(0)))
    hit = found.withColumn("hit", F.regexp_extract("analysed", pattern, 0)).filter("hit <> ''")
    begin = F.length("gap")
    shown = tx.excerpt(F.col("text"), begin, begin + F.length("hit"))
    rows = hit.select("group", F.struct("start_word", "end_word", "rows", F.col("hit").alias("analysis_match"), shown.alias("e")).alias("x"))
    first = rows.groupBy("group").agg(F.min_by("x", "x.start_word").alias("x"))
    return first.select("group", "x.start_word", "x.end_word", "x.rows", "x.analysis_match", "x.e.*")


def sample_examples(samples: DataFrame, feature: str, kind: str) -> DataFrame:
    """For each group, the first occurrence in its samples that a display span covers, if the sample has spans.

    ``samples``: sample, group, ord, text, display_text, display_spans (null:
    any place may be quoted).
    """
    whole = kind in ("words", "wordgrams", "function")
    if kind == "length":
        wanted = int(feature)
        words = F.split("text", " ")
        starts = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(F.aggregate(F.slice(words, F.lit(1), i), F.lit(0), lambda a, w: a + F.length(w) + 1).alias("start"), F.length(F.get(words, i)).alias("size")))
        places = F.filter(starts, lambda s: F.least(s["size"], F.lit(15)) == wanted)
    else:
        places = F.transform(tx.occurrences(F.col("text"), feature, whole), lambda i: F.struct(i.alias("start"), F.lit(len(feature)).alias("size")))
    at = samples.withColumn("p", F.explode(places)).select("*", F.col("p.start").alias("start"), (F.col("p.start") + F.col("p.size")).alias("end"))
    span = F.get(F.filter("display_spans", lambda s: (s["start"] <= F.col("start")) & (s["end"] >= F.col("end"))), F.lit(0))
    held = at.withColumn("span", span).filter("display_spans is null or span is not null")
    shown = tx.excerpt(F.coalesce("display_text", "text"), F.col("start"), F.col("end"), F.col("span.start"), F.col("span.end"))
    order = F.struct("ord", "start")
    first = held.select("group", F.struct(order.alias("o"), "sample", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")).alias("analysis_match"), shown.alias("e")).alias("x")).groupBy("group").agg(F.min_by("x", "x.o").alias("x"))
    return first.select("group", "x.sample", "x.analysis_match", "x.e.*")

