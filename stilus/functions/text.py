"""Parsing and formatting of strings."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from stilus.functions.arrays import bound, running_totals

CONTEXT = 70


def first_integer(text: Column) -> Column:
    """The first run of digits, Arabic ones too, as an integer; null if there is none."""
    digits = F.translate(F.regexp_extract(text, r"(?U)\d+", 0), "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    return digits.try_cast("int")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def unspaced(text: Column) -> Column:
    """Without spaces, Unicode's too, at the ends; line ends and tabs stay, as in SQL's trim."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def parts(text: Column, separator: str) -> Column:
    """Trimmed pieces between separators, blank ones dropped."""
    pieces = F.transform(F.split(text, f"\\Q{separator}\\E"), trimmed)
    return F.filter(pieces, lambda p: p != "")


def line_count(text: Column) -> Column:
    """Lines that are not blank, with all of Unicode's line ends."""
    return F.size(F.filter(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), lambda x: x.rlike(r"(?U)\S")))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def tag_class(tag: Column) -> Column:
    """meter, rhyme, form or topic; null for other tags. A tag may be of more than one: the first is given."""
    # Prefixes, a word, and the form tags.
    forms = ["عموديه", "تفعيله", "نثريه", "عمودية", "تفعيلة", "نثرية", "التفعيله"]
    return F.when(tag.startswith("بحر "), "meter").when(F.contains(tag, F.lit("قافية")), "rhyme").when(tag.isin(forms), "form").when(tag.startswith("قصائد "), "topic")


def timestamp(seconds: Column, separator: str = ".") -> Column:
    """HH:MM:SS.mmm, milliseconds rounded half to even."""
    ms = F.rint(seconds * 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", (ms / 3_600_000).cast("long"), (ms / 60_000).cast("long") % 60, (ms / 1000).cast("long") % 60, ms % 1000)


def ass_timestamp(seconds: Column) -> Column:
    """H:MM:SS.cc, hundredths rounded half to even."""
    cs = F.rint(seconds * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", (cs / 360_000).cast("long"), (cs / 6000).cast("long") % 60, (cs / 100).cast("long") % 60, cs % 100)


def wrapped(width: int = 52):
    """A UDF that wraps at spaces only: array of lines."""

    @F.pandas_udf(ArrayType(StringType()))
    def wrap(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else textwrap.wrap(t, width=width, break_long_words=False, break_on_hyphens=False))

    return wrap


def whole_word(feature: str, kind: str) -> str:
    """A pattern for a feature: between white space for word features, anywhere else for others."""
    quoted = "\\Q" + feature.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return f"(?<!\\S){quoted}(?!\\S)" if kind in ("words", "wordgrams", "function") else quoted


def occurrences(text: Column, feature: str, whole: bool) -> Column:
    """Start offsets (from 0) of all occurrences, overlapping ones too; ``whole``: between spaces or the ends.

    The text is split before each occurrence; the pieces' lengths add up to the offsets.
    """
    quoted = "\\Q" + feature.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    here = f"(?<![^ ])(?={quoted}(?![^ ]))" if whole else f"(?={quoted})"
    none = F.expr("cast(array() as array<int>)")
    ends = running_totals(F.transform(F.split(text, here), lambda x: F.length(x).cast("long")))
    inner = bound(ends, lambda x: F.slice(x, F.lit(1), F.size(x) - 1)).cast("array<int>")
    return F.when(F.lit(feature) == "", none).otherwise(F.concat(F.when(text.rlike(f"^{here}"), F.array(F.lit(0))).otherwise(none), inner))


def excerpt(text: Column, start: Column, end: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """A keyword in context: (before, match, after).

    The context starts after the last space at or before ``start - 70`` and
    ends at the first space from ``end + 70``, but stays between ``low`` and
    ``high``; an ellipsis marks what is cut.
    """
    n = F.length(text)
    head = F.substring(text, F.lit(1), F.greatest(start - CONTEXT + 1, F.lit(0)))
    back = F.locate(" ", F.reverse(head))
    left = F.when((start > CONTEXT) & (back > 0), F.length(head) - back + 1).otherwise(0)
    beyond = F.substring(text, end + CONTEXT + 1, n)
    ahead = F.locate(" ", beyond)
    right = F.when((end + CONTEXT < n) & (ahead > 0), end + CONTEXT + ahead - 1).otherwise(n)
    if low is not None:
        left = F.greatest(left, F.coalesce(low, F.lit(0)))
    if high is not None:
        right = F.least(right, F.coalesce(high, n))
    before = F.concat(F.when(left > 0, "… ").otherwise(""), F.substring(text, left + 1, start - left))
    after = F.concat(F.substring(text, end + 1, right - end), F.when(right < n, " …").otherwise(""))
    return F.struct(before.alias("before"), F.substring(text, start + 1, end - start).alias("match"), after.alias("after"))


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def csv_cell(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(value.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))


def verdict(purity: Column, testable: Column) -> Column:
    return F.when(~testable, "Not testable").when(purity == 1, "Separate").otherwise("Mixed")
