"""Passages, profiles, audits, cues, sources and sinks."""

import gzip
import json
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from stilus import queries
from stilus.operators import audit, cues, passages, profile
from stilus.sources import readers, sinks
from stilus.streaming import cues as streaming_cues

KEY = "abcdefgh ijklmnop qrstuvwx yz"


def found(spark, tokens, known):
    s = spark.createDataFrame([("g", tokens)], "group string, tokens array<string>")
    k = spark.createDataFrame(known, "row long, key string, display string")
    return passages.matched(s, k)


def test_matching_needs_whole_passages_and_word_bounds(spark):
    words = KEY.split()
    shown = KEY.replace("a", "A")
    rows = found(spark, ["pre", *words, "", "post"], [(7, KEY, shown), (5, KEY, shown), (9, KEY + " more", KEY + " more")]).collect()
    assert [(r.start, r.end, r.start_word, r.end_word, r.text, r.rows) for r in rows] == [(4, 4 + len(KEY), 1, 5, shown, [5, 7])]
    assert found(spark, [*words[:-1], "yzz"], [(1, KEY, KEY)]).collect() == []
    assert found(spark, ["x" + words[0], *words[1:]], [(1, KEY, KEY)]).collect() == []
    assert found(spark, [words[0], "", *words[1:]], [(1, KEY, KEY)]).collect() == []
    assert found(spark, ["short", "key"], [(1, "short key", "short key")]).collect() == []


def test_conflicts_exclude_both(spark):
    rows = [("g", 0, 4, "aaaa", 0, 1, [1]), ("g", 2, 6, "abcc", 0, 1, [2]), ("g", 6, 8, "xx", 2, 3, [3]), ("g", 6, 9, "xxy", 2, 3, [4]), ("g", 9, 10, "z", 4, 5, [5])]
    m = spark.createDataFrame(rows, "group string, start int, end int, text string, start_word int, end_word int, rows array<long>")
    assert sorted(r.text for r in passages.conflicts(m).collect()) == ["aaaa", "abcc"]
    assert sorted(r.text for r in passages.selected(m).collect()) == ["xxy", "z"]
    merged = passages.merged(m.select("group", "start", "end")).orderBy("start").collect()
    assert [(r.start, r.end) for r in merged] == [(0, 10)]
    names = spark.createDataFrame([(4, "b"), (4, "a"), (5, "")], "row long, name string")
    poets = {r.text: r.poets for r in passages.attributed(passages.selected(m), names).collect()}
    assert poets == {"xxy": ["a", "b"], "z": []}


def test_selection_equals_a_sweep(spark):
    import random

    rng = random.Random(4)
    rows = sorted({(a := rng.randrange(300), a + rng.randrange(1, 12)) for _ in range(120)})
    m = spark.createDataFrame([("g", a, b, "x" * (b - a), a, b, [1]) for a, b in rows], "group string, start int, end int, text string, start_word int, end_word int, rows array<long>")
    end, kept = -1, []
    for a, b in sorted(rows, key=lambda r: (r[0], -r[1])):
        if a >= end:
            kept.append((a, b))
            end = b
    assert sorted((r.start, r.end) for r in passages.selected(m).collect()) == kept


EQUAL = """
from pyspark.sql import SparkSession, functions as F
from stilus.operators import passages
conf = {"spark.sql.shuffle.partitions": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.ui.enabled": "false", "spark.shuffle.spill.numElementsForceSpillThreshold": "37"}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
each = spark.range(2400).select(F.lit("g").alias("group"), (F.col("id") % 300 * 10).cast("int").alias("start"), F.array("id").alias("rows"))
m = each.select("*", (F.col("start") + 5).alias("end"), F.lit("aaaaa").alias("text"), F.col("start").alias("start_word"), (F.col("start") + 5).alias("end_word"))
wanted = [(10 * k, 10 * k + 5) for k in range(300)]
print(sorted((r.start, r.end) for r in passages.merged(m.select("group", "start", "end")).collect()) == wanted, sorted((r.start, r.end) for r in passages.selected(m).collect()) == wanted)
"""


def test_equal_intervals_share_an_island_when_sorts_spill():
    """Sorts that spill put equal rows in any order, another one each time; a session of its own makes them spill."""
    made = subprocess.run([sys.executable, "-c", EQUAL], capture_output=True, text=True, check=True)
    assert made.stdout.split() == ["True", "True"]


def test_overlay_clips_and_checks(spark):
    s = spark.createDataFrame([("s", "g", 1, ["bb", "", "cc", "dd"], "bb cc dd")], "sample string, group string, start_word int, tokens array<string>, text string")
    schema = "group string, start int, end int, start_word int, end_word int, text string, rows array<long>, poets array<string>"
    p = spark.createDataFrame([("g", 0, 0, 0, 2, "AA BB", [3], ["p"]), ("g", 0, 0, 4, 6, "DD EE", [4], [])], schema)
    r = passages.overlaid(s, p).first()
    assert r.display_text == "BB cc DD" and [(x.start, x.end, x.csv_rows, x.poets) for x in r.display_spans] == [(0, 2, [3], ["p"]), (6, 8, [4], [])]
    drift = spark.createDataFrame([("g", 0, 0, 0, 2, "AA BBB", [3], ["p"])], schema)
    with pytest.raises(Exception, match="alignment has changed"):
        passages.overlaid(s, drift).collect()


def test_examples(spark):
    p = spark.createDataFrame([("g", 0, 10, 0, 10, "one two in", [1]), ("g", 20, 30, 20, 30, "we are in here", [2])], "group string, start int, end int, start_word int, end_word int, text string, rows array<long>")
    chunks = spark.createDataFrame([("g", 2)], "group string, chunk long")
    assert [r.start for r in passages.outside(p, chunks, 10).collect()] == [0]
    r = passages.first_example(p, "in", "words", F.col("text")).first()
    assert (r.start_word, r.before, r.match, r.after) == (0, "one two ", "in", "")
    assert passages.first_example(p, "4", "length", F.col("text")).first().analysis_match == "here"
    spans = "array<struct<start:int,end:int>>"
    s = spark.createDataFrame([("s1", "g", 0, "in a pin", "In a pin", [(3, 8)]), ("s2", "g", 1, "we in", None, None)], f"sample string, group string, ord int, text string, display_text string, display_spans {spans}")
    r = passages.sample_examples(s, "in", "words").first()
    assert (r.sample, r.before, r.match) == ("s2", "we ", "in")
    assert passages.sample_examples(s, "in", "chargrams").first().before == "… a p"
    assert passages.sample_examples(s, "3", "length").first().match == "pin"


def poems(spark):
    rows = [
        (2, "x", "p1", "t", "a b\nc", "بحر الطويل, قصائد حب", "1"),
        (3, "y", "p1", "t", "a b\nc", "بحر الطويل", "none"),
        (4, "x", "p2", "t", " ", "", "٣"),
        (5, "x", "p2", "t", " ", "", "٣"),
    ]
    return spark.createDataFrame(rows, "record long, author string, period string, title string, text string, tags string, count string")


def test_profile(spark):
    t = poems(spark)
    r = profile.records(t).cache()
    assert [(x.words, x.reported_verses, x.nonempty_lines) for x in r.orderBy("record").collect()] == [(3, 1, 2), (3, None, 2), (0, 3, 0), (0, 3, 0)]
    totals = {x.period: (x.poems, x.authors, x.words, x.reported_verses) for x in profile.period_totals(r).collect()}
    assert totals == {"p1": (2, 2, 6, 1), "p2": (2, 1, 0, 6)}
    assert [(x.tag, x["class"], x.occurrences) for x in profile.tag_counts(r).collect()] == [("بحر الطويل", "meter", 2), ("قصائد حب", "topic", 1)]
    assert {x.column: x.missing for x in profile.missing(t, ["text", "tags"]).collect()} == {"text": 2, "tags": 2}
    assert profile.duplicate_rows(t, ["author", "text"]).first().duplicates == 1
    groups = profile.text_groups(t)
    assert tuple(profile.repeated_texts(groups).first()) == (1, 1, 1)
    assert [y.record for y in profile.cross_author_examples(t, groups).first().records] == [2, 3]
    assert [x.author for x in profile.authors_in_periods(r).collect()] == ["x"]
    assert tuple(profile.spread(r, "words").first()) == (6, 0, 1.5, 1.5, 3)
    assert tuple(profile.line_mismatches(r).first()) == (2, 1)
    assert [x.record for x in profile.unread_verses(r).collect()] == [3]
    assert [x.record for x in profile.longest(r, "reported_verses", 2).collect()] == [4, 5]
    assert [x.period for x in profile.author_totals(r).collect()] == ["p2", "p1", "p1"]


def test_catalogue(spark):
    periods = spark.createDataFrame([("العباسي", "Abbasid", "Abbasid")], "period_ar string, period string, period_name string")
    schema = "record long, era_ar string, poet_id string, author_ar string, primary_poem_title string, poem_titles string"
    rows = [(2, "العباسي", "a", "x_y", " t ", "one|two| |one"), (3, "العباسي", "a", "other", "u", "three|two"), (4, "القرآن_الكريم", "QURAN", "", "", "")]
    r = profile.catalogue(spark.createDataFrame(rows, schema), periods).collect()
    assert [(x.id, x.author, x.primary_poem_title, x.poem_titles) for x in r] == [("a", "x y", "t", ["one", "two", "three"])]
    with pytest.raises(Exception, match="unknown period"):
        profile.catalogue(spark.createDataFrame([(2, "?", "a", "", "", "")], schema), periods).collect()


def test_audit(spark):
    old = spark.createDataFrame([(1, "ab cd"), (2, "x")], "line long, text string")
    new = spark.createDataFrame([(1, "ab ce"), (2, "x")], "line long, text string")
    pairs = audit.word_pairs(old, new)
    assert [tuple(r) for r in audit.confusions(pairs).collect()] == [("cd", "ce", 1)]
    assert [tuple(r) for r in audit.restored_letters(old, new).collect()] == [("e", 1)]
    assert tuple(audit.totals(old, new, pairs).first()) == (3, 3, 1, 1, 1)
    words = spark.createDataFrame([("é",), ("e",), ("a",), ("e",)], "word string")
    assert [tuple(r) for r in audit.ambiguous_forms(words, F.translate("word", "é", "e")).collect()] == [("e", ["e", "é"])]
    v = spark.createDataFrame([("o",), (None,), ("",)], "opening string")
    assert audit.prefixed(v).first().prefixed == 1


def test_versions_meet_as_texts(spark):
    old = spark.range(3).select(F.col("id").alias("line"), F.col("id").cast("string").alias("text"))
    new = old.withColumn("text", F.concat("text", F.lit(" x")))
    for made, cut in ((audit.restored_letters(old, new), "split("), (audit.word_pairs(old, new), "regexp_extract_all(")):
        above, below = made._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)
        assert cut in above and cut not in below


def brute_cues(words):
    out, group = [], []

    def close():
        if group:
            out.append([group[0][1], group[-1][2], " ".join(w.strip() for w, *_ in group)])
            group.clear()

    for w, a, b in words:
        if group and (b - group[0][1] > 5.8 or len(" ".join(x for x, *_ in group)) + len(w) > 78):
            close()
        group.append((w, a, b))
        if w[-1:] in ".،؟!" and b - group[0][1] >= 1.4:
            close()
    close()
    if len(out) > 1 and out[-1][1] - out[-1][0] < 1.4 and out[-1][1] - out[-2][0] <= 8:
        last = out.pop()
        out[-1][1], out[-1][2] = last[1], f"{out[-1][2]} {last[2]}"
    return [tuple(x) for x in out]


def timed(seed, n):
    import random

    rng, at, out = random.Random(seed), 0.0, []
    for _ in range(n):
        d = rng.random()
        out.append(("w" * rng.randrange(1, 15) + rng.choice(["", "", "", ".", "!"]), round(at, 2), round(at + d, 2)))
        at += d + rng.random() / 3
    return out


def test_cues(spark):
    segments = {k: timed(k, n) for k, n in enumerate((0, 1, 5, 40, 90))}
    df = spark.createDataFrame([(k, w) for k, w in segments.items()], "id long, words array<struct<word:string,start:double,end:double>>")
    made = cues.cut(df).orderBy("segment_id", "number").collect()
    for k, w in segments.items():
        assert [(r.start, r.end, r.text) for r in made if r.segment_id == k] == brute_cues(w)


def test_streaming_cues_are_the_batch_ones_without_the_last_join(spark, tmp_path):
    words = timed(9, 60)
    rows = [(1, a, b, w) for w, a, b in words] + [(1, 1e6, 1e6 + 1, "end")]
    spark.createDataFrame(rows, "segment_id long, start double, end double, word string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("segment_id long, start double, end double, word string").parquet(str(tmp_path / "in"))
    q = streaming_cues.cut(stream).writeStream.format("memory").queryName("cut").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.start, r.end, r.text) for r in spark.table("cut").orderBy("start").collect()]
    expected = brute_cues([*words, ("x" * 90, 1e6, 1e6 + 1)])[:-1]
    assert got == expected


def test_splice_translate_check(spark):
    schema = "id long, start double, end double, text string, words array<struct<word:string,start:double,end:double>>"
    base = spark.createDataFrame([(1, 0.0, 5.0, "a", []), (2, 914.0, 916.0, "b", [])], schema)
    review = spark.createDataFrame([(1, 900.0, 901.0, "no", []), (2, 915.30049, 960.0, "c", [("w", 915.30049, 916.0)])], schema)
    out = cues.spliced(base, review).orderBy("id").collect()
    assert [(r.id, r.text) for r in out] == [(1, "a"), (2, "c")] and out[1].words[0].start == 915.3
    with pytest.raises(ValueError, match="beyond"):
        cues.spliced(base, review, reach=970.0)
    assert cues.shifted(base, F.lit(2.0)).first().end == 7.0
    c = spark.createDataFrame([("1.1", 0.0, 4.0), ("1.2", 4.0, 8.0)], "id string, start double, end double")
    parts = "array<struct<start:double,end:double,text:string>>"
    t = spark.createDataFrame([("1.1", [(None, None, " Hello ")]), ("1.2", [(4.0, 5.0, "a b"), (4.5, 8.0, "<i>")])], f"id string, parts {parts}")
    rules = cues.checked(cues.translated(c, t), 100).orderBy("start").collect()
    assert [(r.text, r.plain, r.follows) for r in rules] == [("Hello", True, True), ("a b", True, True), ("<i>", False, False)]
    with pytest.raises(ValueError, match="plain, follows"):
        cues.require(cues.checked(cues.translated(c, t), 100))
    with pytest.raises(ValueError, match="translation"):
        cues.translated(c, t.limit(1))
    assert cues.wrapped(cues.translated(c, t), 3).filter("source_id = '1.2'").orderBy("start").first().text == "a b"


def test_captions_of_the_query_keep_line_ends_as_its_sql(spark, tmp_path):
    rows = [(1, 3, "user", " a \n"), (1, 4, "user", "x" * 119 + "\nmore"), (1, 5, "user", "\u00a0\tb \u3000"), (1, 6, "user", "c\r\n "), (1, 7, "user", " ")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    made = sorted((r.source_id, r.k, r.text) for r in queries.found["translated_captions"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert made == sorted(con.sql(f"SELECT source_id, k, text FROM ({queries.sql['translated_captions']})").fetchall())
    assert ("1.3", 0, "a \n") in made and ("1.4", 1, "x" * 119 + "\n") in made


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿# note\none two\n  # more\nthree four\n", encoding="utf-8")
    assert readers.corpus(spark, str(tmp_path / "a.txt")).first().text.split() == ["one", "two", "three", "four"]
    assert [(r.line, r.text) for r in readers.lines(spark, str(tmp_path / "a.txt")).collect()] == [(1, "one two"), (2, "three"), (3, "four")]
    (tmp_path / "a.csv").write_text('﻿name,text\nx,"l1\nl2 ""q"""\ny,\n', encoding="utf-8")
    assert [tuple(r) for r in readers.csv_records(spark, str(tmp_path / "a.csv")).collect()] == [("x", 'l1\nl2 "q"', 2), ("y", "", 3)]
    (tmp_path / "t.json").write_text(json.dumps({"1.1": "plain", "1.2": [{"start": 1, "end": 2, "text": "x"}]}))
    got = {r.id: [tuple(p) for p in r.parts] for r in readers.translations(spark, str(tmp_path / "t.json")).collect()}
    assert got == {"1.1": [(None, None, "plain")], "1.2": [(1.0, 2.0, "x")]}
    (tmp_path / "q.xml").write_text('<quran><sura index="1" name="n"><aya index="1" text="b" bismillah="a"/><aya index="2" text="c"/></sura></quran>')
    assert [(r.sura, r.aya, r.text) for r in readers.verses(spark, str(tmp_path / "q.xml")).orderBy("aya").collect()] == [(1, 1, "a b"), (1, 2, "c")]
    index = {"version": 2, "analysis_source_sha256": "h", "display_source_sha256": "d", "passages": [{"start_word": 0, "end_word": 2, "text": "a b", "csv_rows": [4]}]}
    (tmp_path / "i.json.gz").write_bytes(gzip.compress(json.dumps(index).encode()))
    assert readers.passage_index(spark, str(tmp_path / "i.json.gz"), "h", "g").first().poets == []
    with pytest.raises(ValueError, match="out of date"):
        readers.passage_index(spark, str(tmp_path / "i.json.gz"), "other", "g")
    assert readers.feature_kinds(spark).count() == 6


def test_csv_keeps_every_character(spark, tmp_path):
    texts = [" a", "a ", "\ta\t", "\na", "a\n", "a\r\n", "\r", " ", "a\0b", "\0", '"', 'a\0"', '",\n"', "\\", "é\u00a0", "\ufeffa", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(2)
    sinks.table(df, str(tmp_path / "t"))
    assert {int(r.n): r.t for r in readers.csv_records(spark, str(tmp_path / "t")).collect()} == {n: t or "" for n, t in enumerate(texts)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b'), (2, "é")], "n int, t string")
    sinks.csv_file(df, str(tmp_path / "a.csv"), quote_all=True)
    assert (tmp_path / "a.csv").read_bytes() == '﻿"n","t"\r\n"1","a""b"\r\n"2","é"\r\n'.encode()
    sinks.json_file({"é": 1}, str(tmp_path / "a.json"))
    assert (tmp_path / "a.json").read_text() == '{\n  "é": 1\n}\n'
    sinks.gzip_json_file([1], str(tmp_path / "a.gz"))
    sinks.gzip_json_file([1], str(tmp_path / "b.gz"))
    assert (tmp_path / "a.gz").read_bytes() == (tmp_path / "b.gz").read_bytes()
    sinks.json_lines_file(df, str(tmp_path / "a.jsonl"))
    assert (tmp_path / "a.jsonl").read_text().splitlines()[1] == '{"n": 2, "t": "é"}'
    assert sinks.once(df, str(tmp_path / "p")) and not sinks.once(df, str(tmp_path / "p"))
    sinks.table(df, str(tmp_path / "t"), "json.gz")
    assert spark.read.json(str(tmp_path / "t")).count() == 2
    c = spark.createDataFrame([(1, 0.0, 1.5, "a\nb")], "n int, start double, end double, text string")
    sinks.caption_files(c, str(tmp_path / "c"))
    assert (tmp_path / "c.vtt").read_text() == "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.500\na\nb\n"
    assert (tmp_path / "c.srt").read_text() == "1\n00:00:00,000 --> 00:00:01,500\na\nb\n"
    assert "a\\Nb" in (tmp_path / "c.ass").read_text()
