"""Feature events of a text or its words, as array columns to explode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {
    "words": ("Most frequent words", "Relative frequencies of the most frequent words."),
    "chargrams": ("Character n-grams", "Sequences of 1 to 7 characters, or all lengths; spaces keep word boundaries."),
    "wordgrams": ("Word n-grams", "Sequences of 1 to 5 words, or all lengths."),
    "characters": ("Individual letters", "Relative letter frequencies without spaces."),
    "function": ("Function words", "A fixed list of particles, pronouns and prepositions."),
    "length": ("Word lengths", "Word lengths, those of 15 letters or more together."),
}
LONGEST_WORD = 15


def _places(n: Column) -> Column:
    """1 to n; empty where n is not positive (a sequence would count down)."""
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<int>)"))


def word_ngrams(words: Column, n: int) -> Column:
    return F.transform(_places(F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def char_ngrams(text: Column, n: int) -> Column:
    """Overlapping substrings with boundary spaces; those of white space only are left out."""
    grams = F.transform(_places(F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))
    return F.filter(grams, lambda g: F.trim(g) != "")


def length_classes(words: Column) -> Column:
    return F.transform(words, lambda w: F.least(F.length(w), F.lit(LONGEST_WORD)).cast("string"))


def lengths_of(kind: str, ngram: int) -> list[int]:
    """The n-gram lengths of a setting; 0 is all."""
    if kind not in ("chargrams", "wordgrams"):
        return [1]
    return list(range(1, 8 if kind == "chargrams" else 6)) if ngram == 0 else [ngram]


def events(kind: str, ngram: int, words: Column, text: Column) -> Column:
    """All events of one feature kind: array of (size, feature)."""
    if kind == "wordgrams":
        made = [(n, word_ngrams(words, n)) for n in lengths_of(kind, ngram)]
    elif kind == "chargrams":
        made = [(n, char_ngrams(text, n)) for n in lengths_of(kind, ngram)]
    elif kind == "characters":
        made = [(1, char_ngrams(F.replace(text, F.lit(" "), F.lit("")), 1))]
    elif kind == "length":
        made = [(1, length_classes(words))]
    else:
        made = [(1, words)]

    def sized(n: int, grams: Column) -> Column:
        return F.transform(grams, lambda g: F.struct(F.lit(n).alias("size"), g.alias("feature")))

    return F.concat(*(sized(n, grams) for n, grams in made))


def label(name: Column, kind: str) -> Column:
    """Feature name for display: visible spaces, and the open class of lengths."""
    if kind == "length":
        return F.when(name == str(LONGEST_WORD), F.lit(f"{LONGEST_WORD}+ letters")).otherwise(F.concat(name, F.lit(" letters")))
    return F.replace(name, F.lit(" "), F.lit("␣"))
