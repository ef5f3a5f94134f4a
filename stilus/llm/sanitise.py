"""Information-theoretic sanitisation of personal data.

Patterns find protected entities. Terms of their texts can reveal them as well:
the corpus tells how much. With P(e) the share of texts that hold entity e and
P(e | t) that of the texts with term t that do, a term discloses
``1 - log P(e | t) / log P(e)`` of the entity's information. Terms anywhere in
several texts with e whose disclosure passes a threshold are found wherever
they stand, and removed together with the entities.

Only DataFrame functions are used. Positions are code points: a text's pieces
between matches and the matches give them by running sums of their lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stilus.functions.arrays import bound, running_totals
from stilus.llm.common import stage, text_of

#: Texts in which a term must stand with an entity.
SUPPORT = 3
#: Share of an entity's information that a term may not disclose.
DISCLOSURE = 0.9
#: Tables of terms are broadcast up to so many bytes; larger ones are joined by shuffling.
BROADCAST = 16 << 20
#: A word from its first letter or digit to its last.
TERM = r"[\p{L}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{N}])?"
_SPANS = "array<struct<kind:string,match:string,start:bigint,end:bigint>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, place: Column) -> Column:
        d = F.substring(digits, n - place + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(place % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _is_ip(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:|[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def _is_card(match: Column) -> Column:
    d = _digits(match)
    return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)


def _always(match: Column) -> Column:
    return F.lit(True)


#: Kind, what a text must hold at all, pattern, and what a match must pass. A
#: pattern may start only where a run starts or the last match ended: the
#: leftmost match always does, and long runs are then read once.
ENTITIES = [
    ("email", "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _always),
    ("ip", r"[0-9]\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _is_ip),
    ("card", r"[0-9](?:[ -]?[0-9]){12}", r"[0-9](?:[ -]?[0-9])++", _is_card),
    ("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15)),
]


def matches(text: Column, pattern: Column) -> Column:
    """All matches, leftmost and not overlapping: array of (match, start, end).

    Lengths of gaps and matches add up to positions.
    """
    cells = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))

    def placed(cells: Column) -> Column:
        ends = running_totals(F.transform(cells, lambda c: (F.length(c["gap"]) + F.coalesce(F.length(c["match"]), F.lit(0))).cast("long")))
        all_ = F.zip_with(cells, ends, lambda c, end: F.struct(c["match"].alias("match"), (end - F.length(c["match"])).alias("start"), end.alias("end")))
        return F.filter(all_, lambda m: m["match"].isNotNull())

    return bound(cells, placed)


def entities(text: Column) -> Column:
    """All spans of protected entities, by kind and then start: array of (kind, match, start, end)."""
    none = F.expr(f"cast(array() as {_SPANS})")

    def of_kind(kind: str, holds: str, pattern: str, passes) -> Column:
        own = F.filter(matches(text, F.lit(pattern)), lambda m: passes(m["match"]))
        own = F.transform(own, lambda m: F.struct(F.lit(kind).alias("kind"), m["match"].alias("match"), m["start"].alias("start"), m["end"].alias("end")))
        held = F.contains(text, F.lit(holds)) if holds == "@" else text.rlike(holds)
        return F.when(held, own).otherwise(none)

    return F.concat(*(of_kind(*e) for e in ENTITIES))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _small(table: DataFrame) -> DataFrame:
    """A staged table, marked for broadcasting if its counted bytes are few."""
    size = sum((F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)) for c in table.columns), 16 * F.count("*"))
    return F.broadcast(table) if table.agg(size).first()[0] <= BROADCAST else table


def revealing(found: DataFrame, texts: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """The terms that disclose too much of some entity, and where candidates stand.

    ``found``: doc_id, text and entities of the texts that hold any. ``texts``:
    all, with ``row``, their key. Returns (entity, term, disclosure) and (row,
    term) of all texts. A term is a word from its first letter or digit to its
    last, in lower case, whatever its length; whole texts are its context.
    """
    names = F.array_distinct(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], F.lower(e["match"]))))
    own = F.flatten(F.transform("entities", lambda e: terms_of(e["match"])))
    terms = F.array_except(terms_of(F.col("text")), own)
    # Equal texts are one row with their number.
    whole = found.groupBy(F.xxhash64("text").alias("row"), "text").agg(F.count_distinct(F.coalesce("doc_id", F.lit(-1))).alias("copies"), F.first("entities").alias("entities"))
    whole = stage(whole.select("row", "copies", names.alias("names"), terms.alias("terms")), "whole")
    named = whole.select("row", "copies", F.explode("names").alias("entity"))
    n_e = named.groupBy("entity").agg(F.sum("copies").alias("n_e")).filter(F.col("n_e") >= support)
    there = whole.select("row", F.explode("terms").alias("term"), "copies")
    least = there.groupBy("term").agg(F.sum("copies").alias("least")).filter(F.col("least") >= support)
    everything = F.log2(F.lit(float(texts.count()) + 1))

    def told(n_t: Column, n_te: Column) -> Column:
        return 1 - F.log2((n_t + 1) / n_te) / (everything - F.log2("n_e"))

    # A term of too many texts that hold entities tells too little, however many others have it.
    there = there.drop("copies").join(least, "term")
    pairs = named.join(n_e, "entity").join(there, "row").filter(told(F.col("least"), F.least("least", "n_e")) >= disclosure)
    counted = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.first("n_e").alias("n_e"), F.first("least").alias("least"))
    able = stage(counted.filter((F.col("n_te") >= support) & (told(F.col("least"), F.col("n_te")) >= disclosure)), "able")
    candidates = stage(able.select("term").distinct(), "candidates")
    if candidates.isEmpty():
        return able.select("entity", "term", F.lit(1.0).alias("disclosure")), texts.select("row", F.lit("").alias("term")).limit(0)
    words = texts.select("row", F.explode(terms_of(F.col("text"))).alias("term"))
    held = stage(words.join(_small(candidates), "term", "left_semi").select("row", "term"), "held")
    times = held.groupBy("term").agg(F.count_distinct("row").alias("n_t"))
    rated = able.join(times, "term").select("entity", "term", told(F.col("n_t"), F.col("n_te")).alias("disclosure"))
    return rated.filter(F.col("disclosure") >= disclosure), held


def any_of(terms: Column) -> Column:
    """A pattern for the terms as whole words, the longest first."""
    longest = F.array_sort(terms, lambda a, b: F.coalesce(F.nullif(F.length(b) - F.length(a), F.lit(0)), F.when(a < b, -1).otherwise(1)))
    quoted = F.transform(longest, lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def found_spans(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """Personal data in every text of ``docs`` (doc_id, text).

    Returns doc_id, text (null: empty), entities (array of kind, match, start,
    end by kind and start; code points, end exclusive) and terms (the same for
    revealing terms, kind ``term``, where they are not inside an entity; of
    terms that overlap, the leftmost and longest). Repeated rows have the same
    spans; null ids are kept; an empty table gives no rows; other columns are
    ignored.
    """
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    found = stage(texts.select("doc_id", "text", entities(F.col("text")).alias("entities")).filter(F.size("entities") > 0), "entities")
    rated, held = revealing(found, texts, support, disclosure)
    terms = stage(rated.select("term").distinct(), "terms")
    none = F.expr(f"cast(array() as {_SPANS})")
    if terms.isEmpty():
        return texts.select("doc_id", "text", entities(F.col("text")).alias("entities"), none.alias("terms"))
    wanted = stage(held.join(_small(terms), "term", "left_semi").groupBy("row").agg(F.collect_set("term").alias("wanted")), "wanted")
    rows = texts.join(_small(wanted), "row", "left").withColumn("entities", entities(F.col("text")))
    placed = rows.withColumn("placed", F.when(F.col("wanted").isNotNull(), matches(F.col("text"), any_of(F.col("wanted")))))
    free = F.filter("placed", lambda p: ~F.exists("entities", lambda e: (p["start"] < e["end"]) & (e["start"] < p["end"])))
    named = F.transform(free, lambda p: F.struct(F.lit("term").alias("kind"), p["match"].alias("match"), p["start"].alias("start"), p["end"].alias("end")))
    return placed.select("doc_id", "text", "entities", F.coalesce(named, none).alias("terms"))


def sanitised(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id and the text with each span generalised to its kind in brackets, and terms removed."""
    found = found_spans(docs, **parameters)
    spans = F.sort_array(F.transform(F.concat("entities", "terms"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(done: Column, s: Column) -> Column:
        label = F.when(s["kind"] == "term", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        kept = F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.greatest(s["start"] - done["at"], F.lit(0)).cast("int"))
        fresh = s["start"] >= done["at"]
        return F.struct(F.greatest(s["end"], done["at"]).alias("at"), F.concat(done["out"], F.when(fresh, F.concat(kept, label)).otherwise("")).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.aggregate(spans, zero, step, lambda x: F.concat(x["out"], F.substring(F.col("text"), (x["at"] + 1).cast("int"), F.length("text"))))
    return found.select("doc_id", text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, a hash of the entities' spans, and all spans as a string."""

    def count(kind: str) -> Column:
        return F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in ENTITIES]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("entities")), 256).alias("base_sha256"), joined(F.concat("entities", "terms")).alias("spans"))
