"""Text normalisation as column expressions.

``arabic`` keeps runs of Arabic letters without marks; ``letters`` keeps runs
of letters of any script, lower-cased. Only compatibility normalisation has no
built-in counterpart and runs in an Arrow UDF, which callers skip for texts
that are known to be stable under it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Marks that are removed, letters that are kept, and letters that are folded.
MARKS = "[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0640]"
LETTERS = "[\u0621-\u063a\u0641-\u064a\u066e-\u066f\u0671-\u06d3]+"
FOLD = ("أإآٱى", "ااااي")
COMPARISON_FOLD = ("أإآٱىةئؤ", "اااايهيو")
PROFILE_LETTERS = "أإآٱىةئؤء"

# The function words.
FUNCTION_WORDS = (
    "في من علي الى الي عن ان إن أن إذا اذا ما لا لم لن قد لقد هل بل ثم او أو و ف ب ك ل حتى حتي كل بعض هو هي هم هن نحن انا أنا انت أنت "
    "هذا هذه ذلك تلك الذي التي الذين كان كانت ليس علي على به بها له لها بهم لهم فيه فيها بين عند مع بعد قبل إذ اذ"
).split()


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def letter_runs(text: Column, pattern: str) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), " ")


def arabic(text: Column, fold: bool = True, stable: bool = False) -> Column:
    """Arabic words joined by single spaces; ``stable``: compatibility normalisation would change nothing."""
    clean = F.regexp_replace(text if stable else nfkc(text), MARKS, "")
    return letter_runs(F.translate(clean, *FOLD) if fold else clean, LETTERS)


def letters(text: Column) -> Column:
    """Lower-cased words of any script joined by single spaces."""
    return letter_runs(F.lower(text), r"\p{L}+")


def comparison_text(text: Column) -> Column:
    """Fold eight letters one to one, so that character offsets stay."""
    return F.translate(text, *COMPARISON_FOLD)


def white_words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def words(text: Column) -> Column:
    """Words of a normalised text."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def collapsed(text: Column) -> Column:
    return F.array_join(white_words(text), " ")


def function_vocabulary(fold: bool = True) -> list[str]:
    table = str.maketrans(*FOLD)
    return sorted({w.translate(table) if fold else w for w in FUNCTION_WORDS})
