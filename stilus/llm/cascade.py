"""Quality rules as a short-circuit cascade.

A text is rejected if any rule rejects it, so the order of the rules changes
only the cost. On a small sample each rule is timed and its rejections are
counted; rules then run in the order of rejections per cost, and each sees
only the texts that all before it have passed.
"""

from __future__ import annotations

import time
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stilus.llm.common import text_of, worker_cache
from stilus.llm.textkit import Slab, mix, slabs, windows

_U = np.uint64


def _table(*ranges: str) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[ord(r[0]) : ord(r[-1]) + 1] = True
    return out


_SYMBOL = _table(*"#*$%&|<>")
_UPPER, _LOWER = _table("AZ"), _table("az")
_WINDOW = 8


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter or a mark on one, by its Unicode category."""
    return np.array([unicodedata.category(chr(k))[0] in "LM" for k in range(0x110000)])


def n_letters(slab: Slab) -> np.ndarray:
    """Letters and the marks on them, of any script."""
    data = slab.data
    found = (_UPPER | _LOWER)[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        first = data[lead].astype(np.int32)
        more = np.where(first >= 0xF0, 3, np.where(first >= 0xE0, 2, 1))
        point = first & (0x3F >> more)
        for k in (1, 2, 3):
            own = more >= k
            point[own] = point[own] << 6 | data[lead[own] + k] & 0x3F
        found[lead] = _letters()[point]
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(found, out=sums[1:])
    return sums[slab.offsets[1:]] - sums[slab.offsets[:-1]]


def n_words(slab: Slab) -> np.ndarray:
    return np.diff(slab.words[2])


def n_chars(slab: Slab) -> np.ndarray:
    return np.diff(slab.code_points()[slab.offsets])


def word_chars(slab: Slab) -> np.ndarray:
    """Code points in words."""
    starts, ends, first = slab.words
    points = slab.code_points()
    sums = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
    return sums[first[1:]] - sums[first[:-1]]


def n_symbols(slab: Slab) -> np.ndarray:
    return slab.count(_SYMBOL)


def _repeats(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks keys that their owner has more than once: 1 the first time, 2 later."""
    out = np.zeros(len(keys), np.int8)
    keys = keys ^ mix(owner.astype(np.uint64) + _U(1))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    again = np.zeros(len(keys) + 1, bool)
    again[1:-1] = keys[1:] == keys[:-1]
    out[order] = np.where(again[:-1], 2, again[1:])
    return out


def n_dup_lines(slab: Slab) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    starts, ends, first = slab.lines
    words = slab.words[0]
    some = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    owner = (np.searchsorted(first, np.arange(len(starts)), side="right") - 1)[some]
    found = _repeats(slab.hashes(starts[some], ends[some], lower=False), owner) == 2
    return np.bincount(owner[found], minlength=slab.n)


def n_repeat_words(slab: Slab) -> np.ndarray:
    """Words in 8-word windows that the text has twice or more, the first included."""
    starts, ends, first = slab.words
    rolled, at = windows(slab.hashes(starts, ends, lower=False), first, _WINDOW)
    owner = np.searchsorted(first, at, side="right") - 1
    at = at[_repeats(rolled, owner) > 0]
    edge = np.bincount(at, minlength=len(starts) + 1) - np.bincount(at + _WINDOW, minlength=len(starts) + 1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
    return sums[first[1:]] - sums[first[:-1]]


def n_stutters(slab: Slab) -> np.ndarray:
    """Words equal to the word before them."""
    starts, ends, first = slab.words
    words = slab.hashes(starts, ends, lower=True)
    same = np.zeros(len(words) + 1, np.int64)
    same[1:-1] = words[1:] == words[:-1]
    same[first[:-1]] = 0
    sums = np.concatenate([[0], np.cumsum(same)])
    return sums[first[1:]] - sums[first[:-1]]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a boolean for each text of a slab."""

    name: str
    rejects: Callable[[Slab], np.ndarray]


def base_rules(least: int = 20, percent: int = 30) -> list[Rule]:
    return [
        Rule("few words", lambda s: n_words(s) < least),
        Rule("repeated words", lambda s: 100 * n_repeat_words(s) > percent * n_words(s)),
    ]


def shape_rules() -> list[Rule]:
    """Rules on the shape of a text. They leave running prose of any language alone."""
    return [
        Rule("symbols", lambda s: n_symbols(s) > 0.1 * n_words(s)),
        Rule("repeated lines", lambda s: (d := n_dup_lines(s)) * (d > 2) > 0.3 * np.diff(s.lines[2])),
        Rule("stuttering", lambda s: n_stutters(s) > 0.3 * n_words(s)),
        Rule("word length", lambda s: (m := _share(word_chars(s), n_words(s))) * (m < 1.25) + (m > 20) > 0),
        Rule("capitals", lambda s: _share(s.count(_UPPER), n_letters(s)) > 0.5),
        Rule("few letters", lambda s: _share(n_letters(s), n_chars(s)) < 0.4),
        Rule("shouting", lambda s: s.count(_table("!")) > 0.3 * n_words(s)),
    ]


def _subset(slab: Slab, keep: np.ndarray) -> Slab:
    size = np.diff(slab.offsets)
    return Slab(slab.data[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]), slab.first)


def rejected(slab: Slab, rules: list[Rule]) -> np.ndarray:
    """Which texts some rule rejects; each rule runs only on what is left."""
    out = np.zeros(slab.n, bool)
    left = np.arange(slab.n)
    for rule in rules:
        if not len(left):
            break
        bad = rule.rejects(slab)
        if bad.any():
            out[left[bad]] = True
            slab, left = _subset(slab, ~bad), left[~bad]
    return out


def ordered(docs: DataFrame, rules: list[Rule], sample: int = 256) -> list[Rule]:
    """The rules by rejections per cost on up to ``sample`` rows, timed on an executor.

    The sample sets the order only. Ties and an empty sample keep the order given.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spent, bad, n = np.zeros(len(rules)), np.zeros(len(rules)), 0
            for slab in slabs(batch.column("text")):
                n += slab.n
                for k, rule in enumerate(rules):
                    own = Slab(slab.data, slab.offsets, slab.first)
                    began = time.perf_counter()
                    bad[k] += rule.rejects(own).sum()
                    spent[k] += time.perf_counter() - began
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(spent), pa.array(bad), pa.array(np.full(len(rules), float(n)))], ["rule", "s", "bad", "n"])

    found = docs.select(text_of().alias("text")).limit(sample).mapInArrow(measure, "rule int, s double, bad double, n double").collect()
    worth = [0.0] * len(rules)
    for k in range(len(rules)):
        own = [r for r in found if r.rule == k]
        n, bad, spent = (sum(r[name] for r in own) for name in ("n", "bad", "s"))
        worth[k] = (bad + 0.5) / (n + 1) / max(spent / n, 1e-9) if n else 0.0
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: -worth[k])]


def measured(docs: DataFrame, least: int = 20, percent: int = 30) -> DataFrame:
    """Counts and verdict for each row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed (too few words, or too large a share of words
    in repeated windows) and kept: false if base_failed, else whether the
    cascade of shape rules passes the text. A null text counts as empty and
    fails. Repeated rows and null ids are judged like any others; other
    columns are ignored.
    """
    rules = ordered(docs, shape_rules())
    columns = (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column("text")):
                counts = [f(slab) for f in columns]
                failed = (counts[0] < least) | (100 * counts[4] > percent * counts[0])
                kept = ~failed
                kept[kept] = ~rejected(_subset(slab, kept), rules)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(slab.first, slab.n), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(kept)], [batch.schema.names[0], *(f.__name__ for f in columns), "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{f.__name__} long" for f in columns) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the base rules and the shape rules pass, all columns unchanged.

    A null text counts as empty and is rejected for having too few words.
    """
    rules = ordered(docs.select(docs[text].alias("text")), base_rules() + shape_rules())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            bad = [rejected(slab, rules) for slab in slabs(batch.column(text))]
            if bad:
                yield batch.filter(pa.array(~np.concatenate(bad)))

    return docs.mapInArrow(run, docs.schema)
