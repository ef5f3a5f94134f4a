from pyspark.sql import functions as F

from stilus.functions import features, normalize
from stilus.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalisation_goldens(spark):
    assert one(spark, normalize.arabic(F.lit("إِنَّـا أَعْطَيْنَاكَ ٱلْكَوْثَرَ ١٢٣"))) == "انا اعطيناك الكوثر"
    assert one(spark, normalize.arabic(F.lit("إِنَّـا أَعْطَيْنَاكَ"), fold=False)) == "إنا أعطيناك"
    assert one(spark, normalize.arabic(F.lit("ﷲ abc ﻻ"))) == "الله لا"
    assert one(spark, normalize.comparison_text(F.lit("أولئك يؤمنون الصلاة على"))) == "اوليك يومنون الصلاه علي"
    assert len(normalize.FUNCTION_WORDS) == 67 and len(normalize.function_vocabulary()) == 56


def test_white_words_take_all_unicode_space(spark):
    assert one(spark, normalize.white_words(F.lit(" a b\tc\n"))) == ["a", "b", "c"]
    assert one(spark, normalize.collapsed(F.lit(" a  b \n"))) == "a b"


def test_ngrams(spark):
    words = F.array(*map(F.lit, ["a", "b", "c"]))
    assert one(spark, features.word_ngrams(words, 2)) == ["a b", "b c"]
    assert one(spark, features.word_ngrams(words, 4)) == []
    assert one(spark, features.char_ngrams(F.lit("ab c"), 1)) == ["a", "b", "c"]
    assert one(spark, features.char_ngrams(F.lit("ab c"), 2)) == ["ab", "b ", " c"]
    assert one(spark, features.length_classes(F.array(F.lit("abc"), F.lit("x" * 20)))) == ["3", "15"]
    assert one(spark, features.label(F.lit("a b"), "chargrams")) == "a␣b"
    assert one(spark, features.label(F.lit("15"), "length")) == "15+ letters"


def test_parsing(spark):
    assert one(spark, tx.first_integer(F.lit("عدد ٤٢ بيت"))) == 42
    assert one(spark, tx.first_integer(F.lit("none"))) is None
    assert one(spark, tx.parts(F.lit(" a , ,b"), ",")) == ["a", "b"]
    assert one(spark, tx.parts(F.lit("a|b | c"), "|")) == ["a", "b", "c"]
    assert one(spark, tx.line_count(F.lit("a\r\n \nb c"))) == 3
    assert one(spark, tx.tag_class(F.lit("بحر الطويل"))) == "meter"
    assert one(spark, tx.html_escaped(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, tx.csv_cell(F.lit('a"b'))) == '"a""b"'


def test_timestamps_round_half_to_even(spark):
    assert one(spark, tx.timestamp(F.lit(3661.0005))) == "01:01:01.000"
    assert one(spark, tx.timestamp(F.lit(59.9996), ",")) == "00:01:00,000"
    assert one(spark, tx.ass_timestamp(F.lit(3661.239))) == "1:01:01.24"
    assert one(spark, tx.wrapped(10)(F.lit("aaaa bbbb cccc"))) == ["aaaa bbbb", "cccc"]


def test_occurrences(spark):
    assert one(spark, tx.occurrences(F.lit("aaa"), "aa", False)) == [0, 1]
    assert one(spark, tx.occurrences(F.lit("in pin in"), "in", True)) == [0, 7]
    assert one(spark, tx.occurrences(F.lit("in pin in"), "in", False)) == [0, 4, 7]
    assert one(spark, tx.occurrences(F.lit("a.b a.b"), "a.b", True)) == [0, 4]
    assert one(spark, tx.occurrences(F.lit(""), "a", False)) == []


def keyword(text, start, end):
    left = text.rfind(" ", 0, start - 70 + 1) + 1 if start > 70 else 0
    right = text.find(" ", end + 70)
    right = len(text) if right < 0 else right
    return ("… " if left else "") + text[left:start], text[start:end], text[end:right] + (" …" if right < len(text) else "")


def test_excerpts(spark):
    text = " ".join(f"w{k}" for k in range(120))
    for word in ("w0", "w20", "w30", "w60", "w100", "w119"):
        start = text.index(word)
        e = one(spark, tx.excerpt(F.lit(text), F.lit(start), F.lit(start + len(word))))
        assert tuple(e) == keyword(text, start, start + len(word))


def test_whole_word_patterns(spark):
    pattern = tx.whole_word("a+b", "words")
    assert one(spark, F.regexp_like(F.lit("x a+b y"), F.lit(pattern))) is True
    assert one(spark, F.regexp_like(F.lit("xa+b y"), F.lit(pattern))) is False
    assert one(spark, F.regexp_like(F.lit("xa+by"), F.lit(tx.whole_word("a+b", "chargrams")))) is True
