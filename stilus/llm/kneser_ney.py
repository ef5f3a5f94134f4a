"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

The model is kept as sorted arrays of 64-bit keys with parallel counts, in raw
files that scoring workers memory-map:

* words: sorted word hashes in hash ranges; a word's rank is its id;
* bigrams: sorted ``id << 32 | id`` keys in blocks;
* for each word id, the counts of its contexts and successors.

Counting passes over the texts with NumPy and shuffles packed sorted arrays,
already summed within each task, so a frequent word or a group of copies costs
each task one entry. A block holds all bigrams of its contexts, except for
contexts with many tokens: those are dealt by the whole bigram.

Ids take 32 bits, so a vocabulary has at most 2**32 - 3 words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stilus.llm.common import Blobs, discard, new_dir, stage, text_of, worker_cache
from stilus.llm.textkit import mix, slabs

_U = np.uint64
_MASK = _U(0xFFFFFFFF)
#: The hash of the end token: no word is empty.
END = mix(np.array([0x656E64], np.uint64))[0]
PACK = "part int, payload binary"
#: Bytes of text that a task looks at together.
READ = 4 << 20
#: Bytes of text for each range of words; tokens for each block of bigrams; words for each part of their counts.
RANGE, BLOCK, PART = 32 << 20, 1_000_000, 500_000
#: Files of bigrams that a worker keeps mapped; a larger model is mapped as it is looked into.
MAPPED = 8192


def _pack(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8")
    return sizes.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(payload, *kinds: str) -> list[np.ndarray]:
    n = int(np.frombuffer(payload, "<i8", 1)[0])
    sizes = np.frombuffer(payload, "<i8", n + 1)[1:]
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(payload, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _rows(parts: dict[int, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(list(parts.values()), pa.binary())], ["part", "payload"])


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and for each the sums of its values."""
    if not len(keys):
        return (keys, *(v.astype(np.int64) for v in values))
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at], *(np.add.reduceat(v[order].astype(np.int64), at) for v in values))


def _tokens(slab) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (each text's words, then END), and where each text begins."""
    starts, ends, first = slab.words
    words = slab.hashes(starts, ends, lower=True)
    begin = first + np.arange(slab.n + 1)
    out = np.full(begin[-1], END, np.uint64)
    place = np.ones(begin[-1], bool)
    place[begin[1:] - 1] = False
    out[place] = words
    return out, begin


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(ranges)) >> _U(32)


def _count_words(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for slab in slabs(batch.column("text"), READ):
                k, n = np.unique(_tokens(slab)[0], return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > 3_000_000:
                    k, n = _summed(np.concatenate(keys), np.concatenate(counts))
                    keys, counts = [k], [n]
                    if len(k) > 2_000_000:
                        yield _rows(_by_range(k, n, ranges))
                        keys, counts = [], []
                    held = sum(map(len, keys))
        if keys:
            yield _rows(_by_range(*_summed(np.concatenate(keys), np.concatenate(counts)), ranges))

    return run


def _by_range(keys: np.ndarray, counts: np.ndarray, ranges: int) -> dict[int, bytes]:
    cut = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1, dtype=np.uint64))
    return {r: _pack(keys[a:b], counts[a:b].astype(np.int64)) for r, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a}


def _store_words(uri: str):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        found = [_unpack(x.as_buffer(), "<u8", "<i8") for x in table.column("payload")]
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
        store = Blobs(uri)
        store.put(f"words-{part}", keys)
        store.put(f"counts-{part}", counts)
        return pa.table({"part": pa.array([part], pa.int32()), "n": [len(keys)], "tokens": [int(counts.sum())]})

    return run


@dataclass
class Vocabulary:
    """Word ids: ranks of the sorted hashes. ``before`` counts the words of lower ranges."""

    uri: str
    before: list[int]

    def open(self) -> Vocabulary:
        if hasattr(self, "words"):
            return self
        store = Blobs(self.uri)
        sizes = np.diff(self.before)
        self.words = [store.get(f"words-{r}", np.uint64) if n else np.empty(0, np.uint64) for r, n in enumerate(sizes)]
        self.counts = [store.get(f"counts-{r}", np.int64) if n else np.empty(0, np.int64) for r, n in enumerate(sizes)]
        self.n = self.before[-1]
        #: Ids of the place before a text, and of a word that training has not seen.
        self.begin, self.unknown = self.n, self.n + 1
        return self

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the distinct hashes: their ids and counts; and which of them each token is."""
        distinct, which = np.unique(hashes, return_inverse=True)
        ids = np.full(len(distinct), self.unknown, np.int64)
        counts = np.zeros(len(distinct), np.int64)
        ranges = len(self.words)
        cut = np.searchsorted(_range_of(distinct, ranges), np.arange(ranges + 1, dtype=np.uint64))
        for r in range(ranges):
            a, b = cut[r], cut[r + 1]
            if b > a and len(self.words[r]):
                at = np.minimum(np.searchsorted(self.words[r], distinct[a:b]), len(self.words[r]) - 1)
                hit = self.words[r][at] == distinct[a:b]
                ids[a:b] = np.where(hit, at + self.before[r], self.unknown)
                counts[a:b] = np.where(hit, self.counts[r][at], 0)
        return ids, counts, which


def opened(made):
    """A vocabulary or model as this worker has opened it: once, for all its tasks."""
    cache = worker_cache("kneser_ney")
    key = type(made).__name__, made.uri
    if key not in cache:
        cache.clear()
        cache[key] = made.open()
    return cache[key]


def _bigrams(vocabulary: Vocabulary, tokens: np.ndarray, begin: np.ndarray):
    """Ids of each token and of the one before it, and the counts of both."""
    ids, counts, which = vocabulary.look(tokens)
    ids, counts = ids[which], counts[which]
    before, weight = np.empty_like(ids), np.empty_like(counts)
    before[1:], weight[1:] = ids[:-1], counts[:-1]
    before[begin[:-1]], weight[begin[:-1]] = vocabulary.begin, np.iinfo(np.int64).max
    return before, ids, weight, counts


def _block_of(before: np.ndarray, keys: np.ndarray, weight: np.ndarray, blocks: int, heavy: int) -> np.ndarray:
    """The block of each bigram: by its context, or for a heavy context by the whole bigram."""
    dealt = np.where(weight > heavy, mix(keys), mix(before.astype(np.uint64)))
    return (dealt % _U(blocks)).astype(np.int64)


def _count_bigrams(vocabulary: Vocabulary, blocks: int, heavy: int):
    def packed(keys, counts, where):
        order = np.lexsort((keys, where))
        keys, counts, where = keys[order], counts[order], where[order]
        cut = np.searchsorted(where, np.arange(blocks + 1))
        out = {}
        for k in range(blocks):
            a, b = cut[k], cut[k + 1]
            if b > a:
                n = counts[a:b]
                many = np.flatnonzero(n > 254)
                out[k] = _pack(keys[a:b], np.minimum(n, 255).astype(np.uint8), n[many])
        return _rows(out)

    def merged(found):
        keys, where = (np.concatenate(x) for x in zip(*((f[0], f[1]) for f in found), strict=True))
        n = np.concatenate([f[2] for f in found])
        order = np.argsort(keys)
        keys, where, n = keys[order], where[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], where[at], np.add.reduceat(n, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(vocabulary)
        found, held = [], 0
        for batch in batches:
            for slab in slabs(batch.column("text"), READ):
                before, ids, weight, _ = _bigrams(own, *_tokens(slab))
                keys = before.astype(np.uint64) << _U(32) | ids.astype(np.uint64)
                where = _block_of(before, keys, weight, blocks, heavy).astype(np.int32)
                keys, at, n = np.unique(keys, return_index=True, return_counts=True)
                found.append((keys, where[at], n.astype(np.int64)))
                held += len(keys)
                if held > 3_000_000:
                    found = [merged(found)]
                    held = len(found[0][0])
                    if held > 2_000_000:
                        yield packed(*(found[0][k] for k in (0, 2, 1)))
                        found, held = [], 0
        if found:
            keys, where, n = merged(found)
            yield packed(keys, n, where)

    return run


STATS = "part int, kind string, payload binary, n array<long>"


def _store_bigrams(uri: str, parts: int):
    """Keep a block's bigrams; give the counts of its contexts and of its words' contexts by range of ids."""

    def by_part(kind: str, ids: np.ndarray, *values: np.ndarray):
        dealt = mix(ids) % _U(parts)
        order = np.argsort(dealt, kind="stable")
        cut = np.searchsorted(dealt[order], np.arange(parts + 1, dtype=np.uint64))
        for k in range(parts):
            at = order[cut[k] : cut[k + 1]]
            if len(at):
                yield k, kind, _pack(ids[at].astype(np.uint32), *(v[at].astype(np.int64) for v in values)), None

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        keys, counts = [], []
        for x in table.column("payload"):
            k, few, many = _unpack(x.as_buffer(), "<u8", "u1", "<i8")
            n = few.astype(np.int64)
            n[few == 255] = many
            keys.append(k)
            counts.append(n)
        keys, counts = _summed(np.concatenate(keys), np.concatenate(counts))
        store = Blobs(uri)
        store.put(f"bigrams-{part}", keys)
        store.put(f"times-{part}", counts.astype(np.uint32 if int(counts.max(initial=0)) <= 0xFFFFFFFF else np.int64))
        context, one, two, more, total = _summed(keys >> _U(32), counts == 1, counts == 2, counts > 2, counts)
        after, contexts = _summed(keys & _MASK, np.ones(len(keys), np.uint8))
        rows = [(part, "block", None, [len(keys), *(int((counts == k).sum()) for k in (1, 2, 3, 4))])]
        rows += by_part("context", context, one, two, more, total)
        rows += by_part("after", after, contexts)
        a, b, c, d = zip(*rows, strict=True)
        return pa.table({"part": pa.array(a, pa.int32()), "kind": b, "payload": pa.array(c, pa.binary()), "n": pa.array(d, pa.list_(pa.int64()))})

    return run


def _store_stats(uri: str):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        store, seen = Blobs(uri), [0] * 6
        for kind, width in (("context", 4), ("after", 1)):
            found = [_unpack(p.as_buffer(), "<u4", *["<i8"] * width) for k, p in zip(table.column("kind"), table.column("payload"), strict=True) if k.as_py() == kind]
            columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.uint32)] * (width + 1)
            ids, *values = _summed(*columns)
            store.put(f"{kind}-{part}", ids.astype(np.uint32))
            store.put(f"{kind}s-{part}", np.stack(values, axis=1).astype(np.int64))
            if kind == "after":
                seen = [int(values[0].sum()), *(int((values[0] == k).sum()) for k in (1, 2, 3, 4)), int((values[0] > 2).sum())]
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([seen], pa.list_(pa.int64()))})

    return run


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more, from how many n-grams occur 1 to 4 times.

    Where these counts cannot give one between 0 and the count, it is half of it.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = [0.0]
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else -1.0
        out.append(d if 0 < d < k else k / 2)
    return out


@dataclass
class Model:
    """A fitted model; workers open it and score. Every part is a file of ``uri``."""

    uri: str
    vocabulary: Vocabulary
    tokens: int
    blocks: int
    parts: int
    heavy: int
    discount: list[float]
    lower: list[float]
    continuations: int
    #: What discounting leaves of the words' distribution for an even one over all words and the unseen.
    spare: float

    def open(self) -> Model:
        if hasattr(self, "block"):
            return self
        store = Blobs(self.uri)
        self.vocabulary.open()

        def block(k: int) -> tuple[np.ndarray, np.ndarray]:
            keys, times = store.get(f"bigrams-{k}", np.uint64), store.get(f"times-{k}", np.uint8)
            return keys, times.view(np.int64 if len(times) == 8 * len(keys) else np.uint32)

        self.block = lru_cache(MAPPED)(block)
        self.stats = {kind: [(store.get(f"{kind}-{k}", np.uint32), store.get(f"{kind}s-{k}", np.int64).reshape(-1, width)) for k in range(self.parts)] for kind, width in (("context", 4), ("after", 1))}
        return self

    def _stats(self, kind: str, ids: np.ndarray) -> np.ndarray:
        """Rows of ``kind`` for distinct ids; zeros for ids it lacks."""
        out = np.zeros((len(ids), self.stats[kind][0][1].shape[1]), np.int64)
        dealt = mix(ids.astype(np.uint64)) % _U(self.parts)
        order = np.argsort(dealt, kind="stable")
        cut = np.searchsorted(dealt[order], np.arange(self.parts + 1, dtype=np.uint64))
        for k, (keys, values) in enumerate(self.stats[kind]):
            at = order[cut[k] : cut[k + 1]]
            if len(at) and len(keys):
                near = np.minimum(np.searchsorted(keys, ids[at].astype(np.uint32)), len(keys) - 1)
                out[at] = np.where((keys[near] == ids[at])[:, None], values[near], 0)
        return out

    def score(self, tokens: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability after the one before it, and its training count."""
        before, ids, weight, counts = _bigrams(self.vocabulary, tokens, begin)
        keys = before.astype(np.uint64) << _U(32) | ids.astype(np.uint64)
        keys, at, which = np.unique(keys, return_index=True, return_inverse=True)
        before, ids, weight = before[at], ids[at], weight[at]
        where = _block_of(before, keys, weight, self.blocks, self.heavy)
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange(self.blocks + 1))
        times = np.zeros(len(keys), np.int64)
        for k in range(self.blocks):
            o = order[cut[k] : cut[k + 1]]
            if len(o):
                known, often = self.block(k)
                if len(known):
                    near = np.minimum(np.searchsorted(known, keys[o]), len(known) - 1)
                    times[o] = np.where(known[near] == keys[o], often[near], 0)
        each, of = np.unique(ids, return_inverse=True)
        contexts = self._stats("after", each)[:, 0]
        d = np.array(self.lower)
        total = max(self.continuations, 1)
        low = (np.maximum(contexts - d[np.minimum(contexts, 3)], 0) / total + self.spare / (self.vocabulary.n + 1))[of]
        each, of = np.unique(before, return_inverse=True)
        one, two, more, total = self._stats("context", each)[of].T
        d = np.array(self.discount)
        known = total > 0
        some = np.maximum(total, 1)
        rest = np.where(known, (d[1] * one + d[2] * two + d[3] * more) / some, 1.0)
        p = np.maximum(times - d[np.minimum(times, 3)], 0) / some + rest * low
        return np.log10(p)[which], counts


def fit(docs: DataFrame) -> Model:
    """Count a model over all texts of ``docs`` (text; null: empty).

    An empty table gives a model without words, which scores every token alike.
    """
    spark = docs.sparkSession
    uri = new_dir(spark, "lm")
    texts = docs.select(text_of().alias("text"))
    ranges = max(16, (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE)
    found = texts.mapInArrow(_count_words(ranges), PACK).groupBy("part").applyInArrow(_store_words(uri), "part int, n long, tokens long").collect()
    sizes = dict.fromkeys(range(ranges), 0) | {r.part: r.n for r in found}
    vocabulary = Vocabulary(uri, [0, *np.cumsum([sizes[r] for r in range(ranges)]).tolist()])
    if vocabulary.before[-1] > 0xFFFFFFFD:
        raise ValueError("the vocabulary has more words than 32-bit ids")
    tokens = sum(r.tokens for r in found)
    blocks = max(40, tokens // BLOCK)
    parts = max(16, vocabulary.before[-1] // PART)
    heavy = max(1000, tokens // (8 * blocks))
    counted = stage(texts.mapInArrow(_count_bigrams(vocabulary, blocks, heavy), PACK).groupBy("part").applyInArrow(_store_bigrams(uri, parts), STATS), "lm-stats")
    store = Blobs(uri)
    high, seen = [0] * 5, set()
    for r in counted.filter("kind = 'block'").select("part", "n").collect():
        high = [a + b for a, b in zip(high, r.n, strict=True)]
        seen.add(r.part)
    for k in set(range(blocks)) - seen:
        store.put(f"bigrams-{k}", np.empty(0, np.uint64))
        store.put(f"times-{k}", np.empty(0, np.uint32))
    low, seen = [0] * 6, set()
    have = counted.filter("kind <> 'block'").groupBy("part").applyInArrow(_store_stats(uri), "part int, n array<long>")
    for r in have.collect():
        low = [a + b for a, b in zip(low, r.n, strict=True)]
        seen.add(r.part)
    for k in set(range(parts)) - seen:
        for kind in ("context", "after"):
            store.put(f"{kind}-{k}", np.empty(0, np.uint32))
            store.put(f"{kind}s-{k}", np.empty(0, np.int64))
    discard(counted)
    lower = discounts(low[1:5])
    spare = (low[1] * lower[1] + low[2] * lower[2] + low[5] * lower[3]) / low[0] if low[0] else 1.0
    return Model(uri, vocabulary, tokens, blocks, parts, heavy, discounts(high[1:5]), lower, low[0], spare)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = opened(model)
        n, v = own.tokens, own.vocabulary.n
        for batch in batches:
            for slab in slabs(batch.column("text"), READ):
                tokens, begin = _tokens(slab)
                p, counts = own.score(tokens, begin)
                base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
                at = begin[:-1]
                kept = [batch.column(k).slice(slab.first, slab.n) for k in range(batch.num_columns - 1)]
                sums = [np.diff(begin), np.add.reduceat((counts > 0).astype(np.int64), at), np.full(slab.n, n, np.int64), np.add.reduceat(base, at), np.add.reduceat(p, at)]
                yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums)], [*batch.schema.names[:-1], "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, held_out, text) without the text, with sums of log10 over the tokens of each.

    n_tokens: words and one end; n_known: those seen in training;
    train_tokens: all tokens of training; base_score: by counts with 0.1 added;
    score: by the model. Perplexity is ``10 ** (-score / n_tokens)``. A null or
    empty text is its end token. Repeated rows are scored alike.
    """
    names = ["doc_id", "held_out"]
    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in names)
    return docs.select(*names, text_of().alias("text")).mapInArrow(_score(model), f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Mark the rows whose crc32 of the id as text (null: empty text) is a multiple of ``folds``."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0)


def perplexity_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Fit on the rows that are not held out, and score all rows."""
    marked = held_out(docs, folds)
    return score(marked, fit(marked.filter(~F.col("held_out"))))
