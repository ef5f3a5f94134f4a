"""Operators 2, 4, 5, 6, 8, 9, 10 and the pipeline against brute force, round trips and held-out rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stilus.llm import cascade, common, kneser_ney, langid, mixing, packing, queries, sanitise, urltree
from stilus.llm.common import stage

from .conftest import LINE, WORDS, lowered


def brute_scores(texts):
    """(n_tokens, n_known, base, score) of each text by plain counting."""
    tokens = {i: [*WORDS(lowered(t)), "</s>"] for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for i in train for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    pairs = Counter(p for i in train for p in zip(["<s>", *tokens[i]], tokens[i], strict=False))

    def discount(values):
        c = [sum(x == k for x in values) for k in (1, 2, 3, 4)]
        return kneser_ney.discounts(c)

    before = Counter(b for _, b in pairs)
    low, high, total = discount(before.values()), discount(pairs.values()), len(pairs)
    spare = sum(low[min(x, 3)] for x in before.values()) / total
    after, left = Counter(), Counter()
    for (a, _), x in pairs.items():
        after[a] += x
        left[a] += high[min(x, 3)]

    def p(a, b):
        base = max(before[b] - low[min(before[b], 3)], 0) / total + spare / (v + 1)
        x = pairs[(a, b)]
        return max(x - high[min(x, 3)], 0) / after[a] + left[a] / after[a] * base if after[a] else base

    out = {}
    for i, t in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out[i] = len(t), sum(counts[w] > 0 for w in t), n, base, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t], t, strict=False))
    return out


def test_language_model(spark, sf_dir, rows):
    expected = brute_scores({i: r.text for i, r in rows.items()})
    gain = 0
    for r in queries.op2_lm_scoring(spark, sf_dir).collect():
        n, known, total, base, score = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
        gain += (r.score - r.base_score) * r.held_out
    assert gain > 0


def test_probabilities_sum_to_one(docs):
    model = kneser_ney.fit(docs).open()
    words = np.concatenate([*model.vocabulary.words, np.array([12345], np.uint64)])
    context = words[7]
    tokens = np.stack([np.full(len(words), context), words], axis=1).ravel()
    p, _ = model.score(tokens, np.arange(0, len(tokens) + 1, 2))
    assert (10 ** p[1::2]).sum() == pytest.approx(1)


def test_odd_scores(odd, empty):
    got = kneser_ney.perplexity_scores(odd).collect()
    assert len(got) == odd.count() and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id == 0} == {1}
    assert kneser_ney.perplexity_scores(empty).collect() == []
    alone = kneser_ney.score(kneser_ney.held_out(odd), kneser_ney.fit(empty)).filter("doc_id = 3").first()
    assert alone.n_known == 0 and alone.score == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        rate = left / sum(weight[s] for s in free)
        over = [s for s in free if rate * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: rate * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def check_mix(got, texts):
    sizes = Counter({s: 0 for s in {s for s, _ in texts.values()}})
    for s, t in texts.values():
        sizes[s] += len(WORDS(t or ""))
    target, taken, largest = brute_targets(sizes), Counter(), Counter()
    for r in got:
        s, t = texts[r.doc_id]
        assert r.size == len(WORDS(t or "")) and r.source_size == sizes[s] and r.taken <= 3 * r.size
        assert r.target == pytest.approx(target[s])
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_mix(spark, sf_dir, rows):
    got = queries.op4_mixing(spark, sf_dir).collect()
    check_mix(got, {i: (r.source, r.text) for i, r in rows.items()})
    assert sorted(map(tuple, queries.op4_mixing(spark, sf_dir).collect())) == sorted(map(tuple, got))


def test_mix_with_full_and_null_sources(spark):
    made = {k: (["a", "b", "c", "d", None][min(k % 11, 4)], "w " * (1 + k % 7)) for k in range(400)}
    df = spark.createDataFrame([(k, *v) for k, v in made.items()], "doc_id long, source string, text string")
    check_mix(mixing.shares(df).collect(), made)


def test_mix_without_ids_comes_near_the_target(spark):
    made = [(None if k % 2 else k, "ab"[k % 2], f"{k} " + "w " * (k % 5)) for k in range(600)]
    df = spark.createDataFrame(made, "doc_id long, source string, text string")
    for r in mixing.shares(df).groupBy("target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) <= 6


def test_odd_mix(odd, empty):
    out = mixing.mixed(odd)
    assert out.columns == odd.columns and mixing.shares(empty).collect() == [] and mixing.mixed(empty).collect() == []
    taken = mixing.shares(odd).agg(F.sum("taken")).first()[0]
    assert taken == sum(len(WORDS(r.text or "")) for r in out.collect())


def brute_counts(t):
    t = t or ""
    w = WORDS(t)
    seen, repeats = set(), 0
    for x in t.split("\n"):
        if WORDS(x):
            repeats += x in seen
            seen.add(x)
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
    symbols = sum(c in "#*$%&|<>" for c in t)
    return len(w), sum(map(len, w)), symbols, repeats, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality(spark, sf_dir, rows):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = queries.op5_quality_rules(spark, sf_dir).collect()
    for r in got:
        assert tuple(r)[1:7] == brute_counts(rows[r.doc_id].text)
        assert not (r.base_failed and r.kept)
    good = [r for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in got if labels.get(r.doc_id) == 0]
    assert all(r.kept for r in good) and not any(r.kept for r in bad)


def test_cascade_order_does_not_change_the_verdict(docs, odd, empty):
    from stilus.llm.textkit import slabs

    rules = cascade.base_rules() + cascade.shape_rules()
    texts = docs.select("text").toArrow().column("text")
    verdicts = [np.concatenate([cascade.rejected(s, order) for s in slabs(texts)]) for order in (rules, rules[::-1])]
    assert (verdicts[0] == verdicts[1]).all()
    assert {r.name for r in cascade.ordered(docs, rules)} == {r.name for r in rules}
    kept = cascade.passing(odd)
    assert kept.columns == odd.columns and kept.count() == 0
    assert [tuple(r)[1:7] for r in cascade.measured(odd).orderBy("doc_id").collect()] == [brute_counts(r.text) for r in odd.orderBy("doc_id").collect()]
    assert cascade.measured(empty).collect() == [] and cascade.passing(empty).collect() == []


PROSE = {
    "Devanagari": "आज सुबह गाँव के लोग नदी के किनारे मिले और उन्होंने नए पुल के बारे में बात की क्योंकि पुराना पुल बारिश में टूट गया था",
    "Hangul": "오늘 아침 마을 사람들은 강가에 모여 새로운 다리에 대해 이야기를 나누었고 오래된 다리는 지난 여름 큰 비가 내렸을 때 무너져 더 이상 건널 수 없었다",
    "Thai": "เช้า วันนี้ ชาวบ้าน มา พบ กัน ที่ ริม แม่น้ำ และ พูดคุย เรื่อง สะพาน ใหม่ เพราะ สะพาน เก่า พัง ลง เมื่อ ฝน ตก หนัก ใน ปี ก่อน",
    "Arabic": "اجتمع أهل القرية هذا الصباح عند ضفة النهر وتحدثوا عن الجسر الجديد لأن الجسر القديم سقط في المطر ولم يعد أحد يستطيع أن يعبر إلى السوق",
}


PROSE |= {
    "Cyrillic": "сегодня утром жители деревни собрались на берегу реки и говорили о новом мосте потому что старый мост упал во время дождя и никто не мог перейти",
    "Greek": "σήμερα το πρωί οι κάτοικοι του χωριού μαζεύτηκαν στην όχθη του ποταμού και μίλησαν για τη νέα γέφυρα γιατί η παλιά έπεσε στη βροχή πέρυσι",
    "Hebrew": "הבוקר נפגשו אנשי הכפר על שפת הנהר ודיברו על הגשר החדש כי הגשר הישן נפל בגשם ואיש לא יכול היה לעבור אל השוק",
    "Tamil": "இன்று காலை கிராம மக்கள் ஆற்றின் கரையில் கூடி புதிய பாலம் பற்றி பேசினர் ஏனெனில் பழைய பாலம் மழையில் இடிந்து விழுந்தது அதனால் யாரும் கடக்க முடியவில்லை என்று அவர்கள் கூறினார்கள் பின்னர் வீடு திரும்பினர்",
    "Han": "今天 早上 村里 的 人们 聚 在 河边 谈论 新 的 大桥 因为 旧 的 大桥 在 去年 的 雨季 中 倒塌 了 没有 人 能够 过河",
    "Kana": "けさ むらの ひとびとは かわの きしに あつまって あたらしい はしに ついて はなしました なぜなら ふるい はしは あめで おちて だれも わたる ことが できなかった からです それから みんなは いえに かえって ゆうごはんを たべました",
    "Latin": "Éste ano os moradores da aldeia reuniram-se à beira do rio e falaram da nova ponte porque a velha caiu com a chuva",
}


def test_prose_of_any_script_is_kept(spark):
    junk = {"digits": " ".join(str(k) * 5 for k in range(10, 40)), "dashes": "— ” … € ₤ " * 20, "faces": "😀😀 😎😎 " * 20}
    df = spark.createDataFrame([*PROSE.items(), *junk.items()], "doc_id string, text string").withColumn("lang", F.lit(1))
    assert len(PROSE) > 10 and {r.doc_id: r.kept for r in cascade.measured(df).collect()} == dict.fromkeys(PROSE, True) | dict.fromkeys(junk, False)
    assert {r.doc_id for r in cascade.passing(df).collect()} == set(PROSE)


PATH = public_tokenizers.path("word_bpe_49k.json")


def check_pieces(pieces, texts):
    tokenizer = Tokenizer.from_file(PATH)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append(p)
    for s, own in by.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 64 or s == max(by)
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts.items()}
    at = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        own = ids[p.doc_id]
        assert p.start == at[p.doc_id] % len(own) and p.doc_tokens == len(own)
        assert bytes(p.ids) == np.array(own[p.start : p.start + p.length], "<u4").tobytes()
        at[p.doc_id] += p.length
    return {i: n / len(ids[i]) for i, n in at.items()}


def test_packing_round_trip(docs, rows):
    pieces = packing.pack(docs, PATH, window=64).collect()
    assert set(check_pieces(pieces, {i: r.text for i, r in rows.items()}).values()) == {1}


def test_odd_packing(spark, empty):
    texts = ["", None, "<|endoftext|> a<|startoftext|>b", "don't it's'll 'tis", "a\x1cb\x85c\xa0d　e", "ÀÉ ΣΑΣ İ ß ﬁ é", "x² ½ 12 😀!?", "ªº×÷", "à ̀b", "<|ENDOFTEXT|>", "I'LL"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    assert set(check_pieces(packing.pack(df, PATH, window=64).collect(), dict(enumerate(texts))).values()) == {1}
    assert packing.pack(empty, PATH).collect() == []


def place(url):
    if "://" not in (url or ""):
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL)
    return lowered(m[1]), m[2]


def test_urls(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op8_url_filters(spark, sf_dir).collect():
        host, path = place(urls[r.page_id])
        fits = [(len(q), q, v) for v, q in queries.URL_RULES if (host == q.split("/")[0] or host.endswith("." + q.split("/")[0])) and path.startswith(q[q.index("/") :])]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_templates_tell_good_from_bad(spark):
    made = [(k, f"http://h.org/{'spam' if k % 4 == 0 else 'news'}/{k}.html", (k % 4 == 0) if k < 300 else None) for k in range(400)]
    made += [(1000 + k, f"http://bad.net/x{k}", True) for k in range(80)] + [(2000 + k, f"http://bad.net/y{k}?q", None) for k in range(5)]
    odd = [(3000, None, True), (3001, "no scheme", None), (3002, "ftp://H.ORG", None), (3003, "http://new.com/a/b/c/d/e", None), (3003, "http://new.com/a/b/c/d/e", None)]
    df = spark.createDataFrame(made + odd, "page_id long, url string, bad boolean").withColumn("host", F.lit("x"))
    got = {r.page_id: r for r in urltree.judged(df, []).collect()}
    assert all(got[k].verdict == ("block" if k % 4 == 0 else "allow") for k in range(400))
    assert all(got[2000 + k].verdict == "block" for k in range(5))
    assert got[0].template == "/spam/*.html" or got[0].template == "/spam/*"
    assert (got[3000].host, got[3002].host, got[3003].verdict) == ("", "h.org", "allow")
    assert urltree.judged(df.filter("false"), []).collect() == []


def test_different_child_stays_apart_from_many_siblings(spark):
    sections = ["".join(chr(97 + int(d)) for d in f"{k:03}") for k in range(200)]
    made = [(k, f"http://h.org/{sections[k % 200]}/{k}", False) for k in range(4000)]
    made += [(5000 + k, f"http://h.org/spam/{k}", True) for k in range(1000)] + [(7000, "http://h.org/spam/x", None), (7001, "http://h.org/other/x", None)]
    got = {r.page_id: r for r in urltree.judged(spark.createDataFrame(made, "page_id long, url string, bad boolean"), []).collect()}
    assert all(r.verdict == ("block" if 5000 <= k <= 7000 else "allow") for k, r in got.items())


def test_deep_branches_are_told_apart(spark):
    made = [(k, f"http://h.org/shop/en/all/{'casino' if k % 4 == 0 else 'books'}/x/{k}", k % 4 == 0 if k < 1000 else None) for k in range(1010)]
    made += [(2000, f"http://h.org/{'a/' * 300}", True), (2001, f"http://h.org/{'a/' * 300}b", False)]
    got = {r.page_id: r for r in urltree.judged(spark.createDataFrame(made, "page_id long, url string, bad boolean"), []).collect()}
    assert len(got) == len(made)
    assert all(got[k].verdict == ("block" if k % 4 == 0 else "allow") for k in range(1010))


def brute_templates(pages):
    """host and key to (template, purity), by plain recursion over the labelled leaves."""
    leaves = {}
    for host, key, label in pages:
        x = leaves.setdefault((host, key), [0, 0])
        x[0] += label is not None
        x[1] += bool(label)
    labels, bad = (sum(x[k] for x in leaves.values()) for k in (0, 1))
    overall, w, z, out = (bad + 1) / (labels + 2), urltree.WEIGHT, urltree.APART, {}

    def grow(nodes, template, purity, everything, k):
        parts = {}
        for (host, key), x in nodes.items():
            pieces = key.split("/")
            parts.setdefault(pieces[k] if k < len(pieces) else "", {})[host, key] = x
        groups = {}
        for part, own in parts.items():
            n, b = (sum(x[i] for x in own.values()) for i in (0, 1))
            apart = n > 0 and abs(b / n - purity) > z * math.sqrt(purity * (1 - purity) / n)
            groups.setdefault(part if part == "" or apart else "*", {}).update(own)
        for part, own in groups.items():
            n, b = (sum(x[i] for x in own.values()) for i in (0, 1))
            p = purity if n == everything else (b + w * purity) / (n + w)
            name, good = template + ("/" + part if part else ""), n - b
            if part and b > 0 and good > 0 and (b * (1 - p) > z * z * p or good * p > z * z * (1 - p)):
                grow(own, name, p, n, k + 1)
            else:
                for host, key in own:
                    rest = len(key.split("/")) - k - 1
                    out[host, key] = name + ("" if rest <= 0 else "/*" if rest == 1 else "/**"), p

    for host in {h for h, _ in leaves}:
        own = {x: v for x, v in leaves.items() if x[0] == host}
        n, b = (sum(x[i] for x in own.values()) for i in (0, 1))
        grow(own, "", (b + w * overall) / (n + w), n, 0)
    return out


def test_template_verdicts(spark):
    rng, made = np.random.default_rng(3), []
    for k in range(3000):
        host, deep = f"h{k % 3}.org", rng.integers(1, 5)
        path = "/".join(str(rng.choice(["news", "spam", "shop", "x"])) for _ in range(deep)) + (f"/{k}.html" if k % 2 else "")
        rate = 0.9 if "spam" in path and host != "h2.org" else 0.1
        made.append((k, f"http://{host}/{path}", bool(rng.random() < rate) if rng.random() < 0.6 else None))
    got = urltree.judged(spark.createDataFrame(made, "page_id long, url string, bad boolean"), []).collect()
    general = lambda x: re.sub(r"^.*?(\.[A-Za-z]{1,5})?$", lambda m: "*" + (m[1] or ""), x) if re.search("[0-9]", x) else x
    keys = {k: (place(u)[0], "/".join(general(x) for x in place(u)[1].split("/") if x)) for k, u, _ in made}
    expected = brute_templates([(*keys[k], label) for k, _, label in made])
    assert len({t for t, _ in expected.values()}) > 10
    for r in got:
        template, purity = expected[keys[r.page_id]]
        assert r.template == template and r.purity == pytest.approx(purity) and r.verdict == ("block" if purity > urltree.REJECT else "allow")


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
]


def spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in KINDS for m in re.finditer(p, text or "") if ok(m[0])]


def test_personal_data(spark, sf_dir, rows):
    for r in queries.op9_pii(spark, sf_dir).collect():
        own = spans(rows[r.doc_id].text)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans.startswith(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in own) for kind, *_ in KINDS]


def test_odd_personal_data(spark, odd, empty):
    texts = ["a@b.c_x@d.e a@b.c@d.e", "+1 (377) 555-0271x +1 22", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.0255.4", "é😀 4111 1111 1111 1111 4111111111111112", "x" * 50000 + "@y" + ".z" * 5000, "1 " * 5000, "+1" + "(" * 5000, "1" * 20000, ". @ .. a@", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("entities", F.lit(1))
    for r in sanitise.digests(sanitise.found_spans(df)).collect():
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans(texts[r.doc_id]))
    assert sanitise.digests(sanitise.found_spans(odd)).count() == odd.count()
    assert sanitise.found_spans(empty).collect() == []


def test_revealing_terms(spark):
    made = [(k, f"filler{k} some words the cat sat on the mat" + (f"\nask quixby of dept{k % 3} at boss@corp.example.com soon{k}" if k < 6 else "")) for k in range(60)]
    made[30] = (30, made[30][1] + " here Quixby, walks")
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: r.text for r in sanitise.sanitised(df, disclosure=0.8).collect()}
    assert got[30].endswith("here , walks") and "quixby" not in got[0] and "[EMAIL]" in got[0] and "the cat sat" in got[0]
    assert got[40] == made[40][1]


def test_revealing_terms_of_equal_signatures_other_lines_and_digits(spark):
    made = [(k, f"the cat sat on the mat and word{k} went") for k in range(400)]
    for k in range(20):
        made[k] = (k, f"Quixby Zorn\nthe cat sat on the mat\nstaff 77413 write to <boss@corp.example.com>\nword{k}")
    made[300] = (300, "the cat sat by Zorn, number 77413")
    got = {r.doc_id: r.text for r in sanitise.sanitised(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got[300] == "the cat sat by , number " and got[350] == made[350][1]
    assert got[0].startswith(" \nthe cat sat on the mat\n") and "<[EMAIL]>" in got[0]


def test_disclosure(spark, docs):
    """All candidate terms and their disclosure against plain counting, and every span of theirs."""
    term = re.compile(r"[^\W_](?:[^\x20\x09-\x0D]*[^\W_])?").findall
    base = docs.select("doc_id", "text").limit(150).collect()
    made = [(r.doc_id, (r.text or "") + (f"\nVorgang K{r.doc_id % 4}-x frage chef{r.doc_id % 3}@firma.de" if r.doc_id % 5 == 0 else "")) for r in base]
    made += [(10_000 + k, f"wegen K{k % 4}-X, und Firma") for k in range(6)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    found = [(t, {f"{k}:{t[a:b].lower()}" for k, a, b in spans(t)}, set(term(t.lower())), {w for k, a, b in spans(t) for w in term(t[a:b].lower())}) for _, t in made]
    n, expected = math.log2(len(made) + 1), {}
    for e in set().union(*(x[1] for x in found)):
        n_e = sum(e in x[1] for x in found)
        if n_e < 3:
            continue
        for w in set().union(*(x[2] - x[3] for x in found if e in x[1])):
            n_te, n_t = sum(e in x[1] and w in x[2] - x[3] for x in found), sum(w in x[2] for x in found)
            told = 1 - math.log2((n_t + 1) / n_te) / (n - math.log2(n_e))
            if n_te >= 3 and told >= 0.5:
                expected[e, w] = told
    texts = df.withColumn("row", F.xxhash64("doc_id", "text"))
    with_any = texts.select("doc_id", "text", sanitise.entities(F.col("text")).alias("entities")).filter(F.size("entities") > 0)
    rated, _ = sanitise.revealing(with_any, texts, disclosure=0.5)
    got = {(r.entity, r.term): r.disclosure for r in rated.collect()}
    assert expected and got.keys() == expected.keys() and all(got[x] == pytest.approx(v) for x, v in expected.items())
    terms = {w for _, w in expected}
    marked = {r.doc_id: [(s.start, s.end) for s in r.terms] for r in sanitise.found_spans(df, disclosure=0.5).collect()}
    assert any(marked.values())
    for i, t in made:
        for a, b in marked[i]:
            assert t[a:b].lower() in terms
        for m in re.finditer(r"[^\W_](?:[^\x20\x09-\x0D]*[^\W_])?", t):
            if m[0].lower() in terms and not any(a < m.end() and m.start() < b for _, a, b in spans(t)):
                assert any(a <= m.start() and m.end() <= b for a, b in marked[i])


def test_many_matches_in_one_text(spark):
    text = " ".join(f"a{k}@b.co" if k % 2 else "+1 202 555 0100" for k in range(3000))
    r = sanitise.digests(sanitise.found_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans(text)) and r.n_email == 1500


def test_languages(spark, sf_dir):
    truth = {r.page_id: re.search(r"/(en|de|fr|es)/", r.url)[1] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op10_language_id(spark, sf_dir).collect()
    assert len(got) == len(truth)
    assert np.mean([r.text_lang == truth[r.page_id] for r in got]) >= 0.95 and np.mean([r.lang == truth[r.page_id] for r in got]) >= 0.95


def test_other_evidence_decides_without_text(spark, docs, empty):
    languages, model = langid.fit(docs)
    page = "<html lang='{}'><body>{}</body></html>"
    german = "und der die das in zu mit von auf für ist nicht ein eine als auch es an werden aus " * 3
    made = [(k, f"http://a.example.de/{k}", page.format("de-AT", german)) for k in range(30)]
    made += [(100, "http://a.example.de/x", ""), (101, None, None), (102, "http://b.example.de/", page.format("de", "")), (102, "http://b.example.de/", page.format("de", ""))]
    df = spark.createDataFrame(made, "page_id long, url string, html string").withColumn("lang", F.lit("x"))
    got = {r.page_id: r for r in langid.identify(df, languages, model).collect()}
    assert got[100].lang == "de" and got[102].lang == "de" and got[102].declared == "de" and 0 < got[101].confidence <= 1
    assert langid.identify(df.filter("false"), languages, model).collect() == []
    nothing, none = langid.fit(empty)
    assert nothing == [] and {(r.page_id, r.text_lang, r.lang) for r in langid.identify(df, nothing, none).collect()} >= {(102, None, "de"), (101, None, None)}


def test_many_languages(spark):
    words = {f"l{k:02}": " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in "abcdefghij") for k in range(80)}
    languages, model = langid.fit(spark.createDataFrame(list(words.items()), "lang string, text string"))
    pages = spark.createDataFrame([(k, "http://h.org/", f"<p>{t}</p>") for k, t in words.items()], "page_id string, url string, html string")
    assert languages == sorted(words) and all(r.text_lang == r.page_id for r in langid.identify(pages, languages, model).collect())


def test_declared_language_and_shown_text():
    said = lambda x: (m := langid._DECLARED.search(langid.shown(x))) and m[1]
    assert said("<html data-lang='fr' xml:lang=\"es\" lang=de>") == "de" and said('<HTML title=" lang=fr >" LANG = "en-US">') == "en"
    assert said("<!-- <html lang='fr'> --><html>") is None and said("<html data-lang='fr'>") is None and said("<htmlx lang='fr'>") is None
    assert langid.shown("a<script>b</script>c<!-- d --><style x>e</style >f<script>g").replace(" ", "") == "acf<script>g"
    for many in ("<script " * 60000, "<!-- " * 60000, "<" * 200000, '<html a="' * 30000):
        assert said(many) is None and len(langid._TAG.sub("", langid.shown(many))) > 0


def test_posteriors(spark, docs):
    """The fused evidence against its formula, page by page."""
    languages, model = langid.fit(docs)
    rows = docs.filter("lang is not null and text is not null").orderBy("doc_id").limit(40).collect()
    made = [(k, f"http://{'ab'[k % 2]}.{'xy'[k % 3 % 2]}.{('de', 'org')[k % 2]}/{k}", f"<html{' lang=' + r.lang if k % 2 else ''}><p>{' '.join(r.text.split()[:6]).replace('<', ' ')}</p></html>") for k, r in enumerate(rows)]
    made.append((99, "http://a.x.de/", ""))
    df = spark.createDataFrame(made, "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify(df, languages, model).collect()}
    seen = {}
    for k, url, page in made:
        data = np.frombuffer(__import__("html").unescape(re.sub("<[^<>]*>", " ", page)).encode().lower(), np.uint8).astype(np.uint32)
        h = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(17) if len(data) > 2 else np.zeros(0, int)
        text = model[:, h].sum(axis=1) * langid.TEMPER
        host = place(url)[0]
        declared = re.search("lang=([a-z]+)", page)
        p = np.exp(text - text.max())
        seen[k] = text - text.max(), p / p.sum(), host, ".".join(host.split(".")[-2:]), host.split(".")[-1], declared and declared[1]
    all_p = sum(x[1] for x in seen.values())
    n, trust = all_p.sum(), langid.TRUST
    for k, (text, p, *own) in seen.items():
        def others(which, k=k, own=own):
            same = [x for j, x in seen.items() if j != k and x[2 + which] == own[which]]
            return sum((x[1] for x in same), np.zeros(len(languages))), len(same)
        overall = (all_p + 1) / (n + len(languages))
        (h, nh), (d, nd), (s, ns), (c, nc) = (others(x) for x in range(4))
        prior = (h + trust * (d + trust * overall) / (nd + trust)) / (nh + trust)
        lift = lambda sums, m: (sums + trust * (m + 1) / n) / (all_p + trust) / ((m + 1) / n)
        score = text + np.log(prior) + np.log(lift(s, ns)) + (np.log(lift(c, nc)) if own[3] else 0)
        p = np.exp(score - score.max())
        assert got[k].lang == languages[int(score.argmax())] and got[k].confidence == pytest.approx(1 / p.sum(), rel=1e-6)


def test_pipeline(spark, docs, sf_dir):
    from .test_pairs import brute_components, brute_lines

    names, now = docs.columns, docs
    out = []
    for name, step in corpus_pipeline.STAGES:
        now = stage(step(spark, now, sf_dir), name)
        out.append(now)
        assert name == "pack" or now.columns == names
    text = [{r.doc_id: r.text for r in df.collect()} for df in (docs, *out[:4])]
    assert text[1].keys() <= text[0].keys() and all(brute_counts(t)[5] is False for t in text[1].values())
    equal, edited = brute_lines(text[1])
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in equal | edited) for i, t in text[1].items()}
    assert text[2] == {i: t for i, t in left.items() if t == text[1][i] or WORDS(t)}
    groups = brute_components(text[2], 5, 80)
    assert text[3] == {i: t for i, t in text[2].items() if groups[i][1] == i}
    copies = Counter(r.doc_id for r in out[3].collect())
    assert max(copies.values()) <= 3
    source = {r.doc_id: (r.source, r.text) for r in out[2].collect()}
    taken = {r.doc_id: r for r in mixing.shares(out[2]).collect()}
    check_mix(taken.values(), source)
    assert all(taken[i].taken == copies[i] * len(WORDS(t)) for i, (_, t) in source.items())
    packed = Counter()
    for r in out[4].collect():
        packed[r.doc_id] += r.length / r.doc_tokens
    assert {i: round(n, 6) for i, n in packed.items()} == dict(copies)


def test_pipeline_stages_on_odd_rows(spark, odd, empty, sf_dir):
    long = " ".join(f"w{k}" for k in range(30))
    near = long.replace("w29", "x")
    more = [(70, long), (70, long), (None, long), (71, near), (None, near), (70, "other words than these " * 3 + "here"), (None, None), (None, None)]
    made = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).withColumn("key", F.lit(1)).cache()
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, empty, sf_dir).collect() == []
        out = step(spark, made, sf_dir)
        assert name == "pack" or out.columns == made.columns
        kept = [(r.doc_id, r.text) for r in out.collect()] if name != "pack" else [r.doc_id for r in out.filter("start = 0").collect()]
        assert name not in ("mix", "pack") or len(kept) >= made.count() // 2
        if name == "near_duplicates":
            assert [x for x in kept if (x[1] or "").startswith("w0")] == [(70, long)]
            assert sum(t is None for _, t in kept) == 2 and kept.count((5, LINE)) == 1 and (8, LINE.replace("fox", "cat")) in kept




def test_quality_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = queries.op5_quality_rules(spark, sf_dir)
    rel = con.sql(queries.oracle_sql()["op5_quality_rules"])
    place = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in place) for r in rel.fetchall())


def test_pieces_are_sent_a_few_megabytes_at_a_time():
    """The second pass keeps no tokenizer, and sends no batch of far more than it may hold."""
    common.worker_cache("packing")["path"] = "tokenizer"
    rng = np.random.default_rng(3)
    n = np.append(rng.integers(1, 9000, 1500), 3 * packing.HELD)
    at = np.cumsum(n) - n
    ids = [rng.integers(0, 49000, k).astype("<u2").tobytes() for k in n]
    columns = [np.zeros(len(n), np.int32), np.full(len(n), 2, np.int32), at, np.arange(len(n)), n]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(ids, pa.binary())], ["part", "width", "at", "doc_id", "doc_tokens", "ids"])
    sent = list(packing._cut({0: 0}, 4096)(iter([batch])))
    assert common._caches == {}
    assert all(b.column("ids").nbytes < 2 * packing.HELD or len(set(b.column("doc_id").to_pylist())) == 1 for b in sent)
    found = {}
    for b in sent:
        for i, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
            found[i] = found.get(i, b"") + np.frombuffer(x, "<u4").astype("<u2").tobytes()
    assert [found[i] for i in range(len(n))] == ids


def test_plain_words_are_encoded_together(monkeypatch):
    """Only words that are not plain, and very long parts, take a call of the tokenizer each; the ids are the tokenizer's."""
    real, calls = Tokenizer.from_file(PATH), Counter()

    def counted(f):
        return lambda word, **options: calls.update([word]) or f(word, **options)

    made = SimpleNamespace(encode=counted(real.encode), model=SimpleNamespace(tokenize=counted(real.model.tokenize)), get_vocab_size=real.get_vocab_size)
    monkeypatch.setattr(tokenizers, "Tokenizer", SimpleNamespace(from_file=lambda path: made))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(4)
    signs = ["etaoinsh", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "'strvemldll'SLa", "éàüßÀÉÖØÞÿabc", "aB1'2,.!?-_<>", "=-'."]
    words = ["".join(rng.choice(list(signs[k % len(signs)]), rng.integers(1, 17))) for k in range(12000)]
    odd = ["<|endoftext|>", "a<|startoftext|>b", "ÀΣİſK", "x²½ª", "a×b÷c", "cafe\u0301", "c\xa0d\x85e\x1cf", "漢字", "😀!", "<|x", "x" * 500, "='" * 90]
    words += [w for w in odd for _ in range(3)]
    rng.shuffle(words)
    texts = ["", " \t\n\x0b\x0c\r ", *(" ".join(words[k : k + 50]) for k in range(0, len(words), 50)), " don't\n'tis ''s 's's I'LL x'r x'l 'sabc 're've'd o'clock' "]
    monkeypatch.setattr(packing, "READ", 8192, raising=False)
    common.worker_cache()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    sent = list(packing._tokenise(PATH, 2)(iter([batch.slice(0, 3), batch.slice(3)])))
    common.worker_cache()
    got = [x for b in sent for x in b.column("ids").to_pylist()]
    want = [np.array(real.encode(t, add_special_tokens=False).ids + [2], "<u2").tobytes() for t in texts]
    assert got == want and [n for b in sent for n in b.column("doc_tokens").to_pylist()] == [len(x) // 2 for x in want]
    assert [n for b in sent for n in b.column("at").to_pylist()] == [0, *np.cumsum([len(x) // 2 for x in want]).tolist()[:-1]]
    assert len(calls) <= len(odd) and len(sent) > 10
