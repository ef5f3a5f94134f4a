import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def rows(docs):
    return {r.doc_id: r for r in docs.collect()}


LINE = "the quick brown fox jumps over the lazy dog today"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with the operators' own names."""
    texts = [None, "", " \t\n", "one", "two words", LINE, LINE, LINE.upper(), LINE.replace("fox", "cat"), f"{LINE}\n\n{LINE}\nother", "long " * 60000, "x" * 300000, "é ß 漢字 😀 a@b.co"]
    made = [(k, t, "en", "s", 0, True, "row", 1) for k, t in enumerate(texts)]
    made += [made[5], (None, LINE, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, part int").cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
