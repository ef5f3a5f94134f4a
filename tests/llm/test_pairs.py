"""Operators 1, 3 and 7 against brute force."""

from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from stilus.llm import linededup, partenum, queries, vptree
from stilus.llm.components import connected
from stilus.llm.sharing import shared

from .conftest import LINE, WORDS, lowered


def best(vectors, query, k):
    """(score, id), by cosine in double precision."""
    i, q = query
    scored = [(-float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), j) for j, v in vectors if j != i]
    return [(j, -s) for s, j in sorted(scored)[:k]]


def test_nearest_is_exact_with_factor_one(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    vectors = [(r.id, np.array(r.vector, float)) for r in e.collect()]
    found = {}
    for r in vptree.nearest(e, e.filter("id % 50 = 0"), 5, factor=1).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    exact = {q[0]: best(vectors, q, 5) for q in vectors if q[0] % 50 == 0}
    assert found.keys() == exact.keys()
    for q, rows in exact.items():
        assert [i for i, _ in found[q]] == [i for i, _ in rows]
        assert np.allclose([s for _, s in found[q]], [s for _, s in rows], atol=1e-12)
    hits = [(r.query_id, r.vec_id) for r in queries.op1_nearest(spark, sf_dir).collect()]
    assert np.mean([h[1] in {i for i, _ in exact[h[0]]} for h in hits]) >= 0.9


def test_tree_prunes_and_keeps_recall():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    tree = vptree.Tree(np.arange(3000), x)
    score, found = tree.search(np.arange(50), x[:50], 4, 1.0)
    for i in range(50):
        assert [j for j, _ in best(list(enumerate(x)), (i, x[i]), 4)] == found[i].tolist()


def test_shards_are_skipped_and_nothing_is_lost(spark, monkeypatch):
    """Clustered vectors in many shards, one of them with a third of all rows: exact, and few vectors are looked at."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    x = centres[np.arange(3000) % 40] + rng.normal(size=(3000, 24)) * 0.02
    x[2000:] = x[0]
    monkeypatch.setattr(vptree, "SHARD", 100)
    monkeypatch.setattr(vptree, "BLOCK", 16)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    found = {}
    for r in vptree.nearest(df, df.filter("id % 100 = 1"), 3, factor=1).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {i: [j for j, _ in best(list(enumerate(x)), (i, x[i]), 3)] for i in range(1, 3000, 100)}
    tree = vptree.Tree(np.arange(2000), x[:2000])
    tree.search(np.arange(0, 2000, 20), x[:2000:20], 3, 1.0)
    assert tree.seen < 0.3 * 100 * 2000
    unit = vptree._unit(x[:2000])
    coarse = vptree.Coarse(unit, 20)
    who, _ = coarse.within(unit[:100], np.full(100, 0.2), 1.0)
    assert len(who) < 0.6 * 100 * coarse.shards


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 1.0], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [1.0, None], [1.0], []]
    df = spark.createDataFrame([*enumerate(v), (None, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, vector array<double>").withColumn("rank", F.lit("x"))
    found = {}
    for r in vptree.nearest(df, df, 2).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert found == {0: [(1, 1, 1.0), (2, 2, 1.0)], 1: [(1, 0, 1.0), (2, 2, 1.0)], 2: [(1, 0, 1.0), (2, 1, 1.0)], 3: [(1, 0, 0.0), (2, 1, 0.0)]}
    assert vptree.nearest(df.filter("false"), df.filter("false")).collect() == []


def shingles(text, width):
    w = WORDS(lowered(text))
    return set(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(texts, width, percent):
    sets, low = {i: shingles(t, width) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    ids = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if 100 * len(sets[i]) < percent * len(sets[j]):
                break
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 50)])
def test_components(docs, rows, width, percent):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.similar_documents(docs, width, percent).collect()}
    assert found == brute_components({i: r.text for i, r in rows.items()}, width, percent)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(7)
    for percent in (80, 90):
        for size in (1, 3, 5, 8, 11, 14, 17, 25, 60, 200, 900):
            for _ in range(15):
                x = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
                drop, grow = rng.integers(0, size // 8 + 2, 2)
                y = np.unique(np.concatenate([x[drop:], rng.integers(0, 1 << 62, grow).astype(np.uint64)]))
                common = len(np.intersect1d(x, y))
                if not len(y) or 100 * common < percent * (len(x) + len(y) - common):
                    continue
                sig, of = partenum.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), percent)
                assert set(sig[of == 0]) & set(sig[of == 1])


def test_bitmaps_bound_the_differences():
    rng = np.random.default_rng(8)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in rng.integers(1, 400, 2))
        y = np.union1d(x[: len(x) // 2], y)
        bits = [np.frombuffer(b, np.uint8) for b in partenum.bitmaps(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))]
        assert partenum.differences(*bits) <= len(np.setxor1d(x, y))


def test_near_copies_around_the_threshold(spark):
    """Many different copies of one text, most of them too far from each other: clusters are compared in full."""
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for i in range(150):
        words = base.copy()
        for at in rng.choice(120, rng.integers(0, 4), replace=False):
            words[at] = f"x{i}y{at}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.similar_documents(df, 3, 90).collect()}
    assert found == brute_components(texts, 3, 90)


def test_a_large_cluster_is_written_once(spark, monkeypatch):
    """Texts of many sizes around one passage, some of them near copies: each node is in one file, and no link is lost."""
    rng = np.random.default_rng(10)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = {}
    for i in range(0, 160, 2):
        words = [f"w{i}x{k}" for k in range(rng.integers(5, 400))]
        texts[i] = " ".join([*words, passage])
        texts[i + 1] = " ".join([*words[1:], passage]) if i % 4 else " ".join([*words[: len(words) // 2], passage])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = df.select("text").mapInArrow(partenum._items(3), "node long, items array<long>").cache()
    folders = []
    monkeypatch.setattr(partenum, "TOGETHER", 16)
    monkeypatch.setattr(partenum, "discard", lambda *x: folders.extend(f for f in x if isinstance(f, str)))
    links = partenum._inside(items.select(F.lit(-1).cast("long").alias("cluster"), "node"), items, 80)
    joined = {r.node: r.component for r in connected(links).collect()}
    sets = {r.node: set(r["items"]) for r in items.collect()}
    exact = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(exact) > 30 and all(joined[a] == joined[b] for a, b in exact)
    assert set(joined) == {x for pair in exact for x in pair}
    (folder,) = folders
    files = [np.fromfile(f, np.int64) for f in Path(urlparse(folder).path).iterdir() if not f.name.startswith(".")]
    assert len(files) > 5 and sorted(x for f in files for x in f[1 : f[0] + 1].tolist()) == sorted(sets)


def test_signatures_of_one_text_are_not_sent(spark, sf_dir, monkeypatch):
    """Of unrelated texts nearly no signature is sent with its node; of texts that resemble each other in two tasks all that they share."""
    shapes, real = {}, partenum.stage

    def staged(df, label):
        shapes[label] = real(df, label)
        return shapes[label]

    monkeypatch.setattr(partenum, "stage", staged)
    monkeypatch.setattr(partenum, "discard", lambda *x: None)
    texts = {i: " ".join(f"w{i}x{k}" for k in range(300)) for i in range(40)}
    texts |= {100 + i: f"new {texts[i]}" for i in range(3)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.component_id for r in partenum.similar_documents(df, 3, 90).collect()}
    assert found == {i: i % 100 if i >= 100 else i for i in texts}
    all_of, sent = (shapes[x].agg(F.sum(c)).first()[0] for x, c in (("sets", "signed"), ("repeated", "n")))
    assert 0 < sent < 0.1 * all_of


def test_odd_documents(odd, empty):
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in partenum.similar_documents(odd, 3, 90).collect())
    assert found[(None, 8, None)] == 1 and found[(None, 0, None)] == 1 and found[(0, 0, 0)] == 1 and found[(2, 0, 2)] == 1
    assert found[(5, 8, 5)] == 2 and found[(6, 8, 5)] == 1 and found[(7, 8, 5)] == 1 and found[(3, 1, 3)] == 1
    assert partenum.similar_documents(empty).collect() == []


def test_connected(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    low = {n: n for e in edges for n in e}
    for _ in range(50):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in connected(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    loops = {n for n in low if all(a == b for a, b in edges if n in (a, b))}
    assert got == {n: c for n, c in low.items() if n not in loops}


def test_shared_keys(spark):
    rng = np.random.default_rng(4)
    entries = [(int(k), int(v), 0) for k, v in zip(rng.integers(-50, 50, 300), rng.integers(-9, 9, 300), strict=True)] + [(77, v, 1) for v in range(500)]
    values = {}
    for k, v, _ in entries:
        values.setdefault(k, set()).add(v)
    got = {tuple(r) for r in shared(spark.createDataFrame(entries, "key long, value long, extra int"), 5).collect()}
    assert got == {e for e in entries if len(values[e[0]]) > 1}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def brute_lines(texts):
    """(equal, edited) as (doc, line): for each line of enough words, whether an earlier one is equal or within an edit."""
    lines = [(i, k, tuple(WORDS(lowered(x)))) for i in sorted(texts) for k, x in enumerate((texts[i] or "").split("\n"))]
    first, equal, edited = {}, set(), set()
    for i, k, w in lines:
        if len(w) >= linededup.LEAST:
            if w in first:
                equal.add((i, k))
            else:
                if len(w) >= linededup.NEAR and any(len(v) >= linededup.NEAR and one_edit(w, v) for v in first):
                    edited.add((i, k))
                first[w] = (i, k)
    return equal, edited


def test_lines(docs, rows):
    texts = {i: r.text for i, r in rows.items()}
    equal, edited = brute_lines(texts)
    for r in linededup.line_counts(docs).collect():
        lines = texts[r.doc_id].split("\n")
        gone = [k for k in range(len(lines)) if (r.doc_id, k) in equal | edited]
        assert r.n_equal == sum((r.doc_id, k) in equal for k in gone) and r.n_edited == len(gone) - r.n_equal
        assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in gone)


def test_edited_lines(spark):
    words = LINE.split()
    rng = np.random.default_rng(2)
    texts = {}
    for i in range(60):
        w = words.copy()
        for _ in range(rng.integers(0, 3)):
            at = rng.integers(len(w))
            w = [w[:at] + w[at + 1 :], w[:at] + [f"n{rng.integers(4)}"] + w[at:], w[:at] + [f"s{rng.integers(4)}"] + w[at + 1 :]][rng.integers(3)]
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    equal, edited = brute_lines(texts)
    got = {r.doc_id: (r.n_equal, r.n_edited) for r in linededup.line_counts(df).collect()}
    assert got == {i: (int((i, 0) in equal), int((i, 0) in edited)) for i in texts}
    assert edited and equal


def test_short_lines(spark):
    texts = ["All rights reserved.\nfirst text\n\n---", "second text\nall rights reserved.\n\n---", "---\nAll Rights Reserved.", "first text here\n \n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_equal, r.n_edited, r.text) for r in linededup.line_counts(df).collect()}
    assert got == {0: (4, 0, 0, texts[0]), 1: (4, 2, 0, "second text\n"), 2: (2, 2, 0, ""), 3: (4, 0, 0, texts[3])}
    assert {r.doc_id for r in linededup.without_repeats(df).collect()} == {0, 1, 3}


def test_odd_lines(odd, empty):
    got = {(r.doc_id, r.n_lines, r.n_equal, r.n_edited) for r in linededup.line_counts(odd).collect()}
    assert {(0, 1, 0, 0), (5, 1, 0, 0), (6, 1, 1, 0), (7, 1, 1, 0), (8, 1, 0, 1), (9, 4, 2, 0), (10, 1, 0, 0), (None, 1, 1, 0)} <= got
    left = linededup.without_repeats(odd)
    assert left.columns == odd.columns
    kept = {r.doc_id: (r.text, r.n_chars) for r in left.filter("doc_id is not null").collect()}
    assert kept[0] == (None, 0) and kept[9] == ("\nother", 6) and 6 not in kept and kept[1] == ("", 0)
    assert linededup.without_repeats(empty).collect() == []
