"""Packing token streams into fixed windows: concatenate and cut.

Two passes. The first tokenises every text once and writes the ids with each
row's partition and running offset inside it. Partition totals are then summed
up to global offsets, one number a partition. The second pass reads the ids,
adds its partition's offset and cuts at multiples of the window; a document
that crosses a cut gets one piece on either side. Nothing is sorted and no row
moves, so skewed sources or very long texts cost only their own tokens.

Texts are split, and the distinct words of a few megabytes of them encoded, in
arrays; a worker keeps no plain word from one batch to the next.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stilus.llm.common import released, stage, text_of, worker_cache

#: Distinct words that a worker remembers of those that go through the whole tokenizer.
CACHE = 250_000
#: Bytes of ids that a task holds before it sends them.
HELD = 4 << 20
#: Bytes of texts that a task encodes at once.
READ = 4 << 20
#: Bytes of the longest part that is merged beside others.
LONGEST = 32
#: The steps before the model that plain words can do without.
_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_OPTIONS = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
#: By byte of a plain word: ASCII and the letters of Latin-1, of which \xc3 is the first byte.
_LETTER, _DIGIT, _OTHER = 0, 1, 2
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_KIND[48:58] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(33, 127), 0xC3]] = True
_NO_RANK = 1 << 24


def _gathered(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values that begin there and have that size one after another, and the limits between them."""
    limits = np.append(0, np.cumsum(size))
    return values[np.repeat(begin - limits[:-1], size) + np.arange(limits[-1])], limits


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, and the limits between words in them."""
    words = words.cast(pa.large_binary())
    _, limits, data = words.buffers()
    limits = np.frombuffer(limits, np.int64)[words.offset : words.offset + len(words) + 1] if limits else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[limits[0] : limits[-1]] if data else np.empty(0, np.uint8), limits - limits[0]


class Merges:
    """Byte-pair merges of many parts at once.

    Parts of one length stand side by side. In each of them the lowest rank is
    merged, the leftmost of equal ones, as the model does; the part then stands
    with those one shorter, and one without a pair to merge is done.
    """

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        #: The character that the model has for each byte.
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.inner = np.array([vocab[self.shown[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[self.shown[b] + end] for b in range(256)], np.int32)
        self.width = 1 + max(vocab.values())
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.rank_of, self.keys = np.append(order, _NO_RANK).astype(np.int32), np.append(keys[order], np.iinfo(np.int64).max)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        if len(set(keys.tolist())) < len(keys) or len(keys) >= _NO_RANK:
            raise ValueError("merges are not distinct, or too many")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[at], _NO_RANK)

    def __call__(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts, and how many each has; none is empty."""
        order, count = np.argsort(size, kind="stable"), np.bincount(size, minlength=1)
        to, out, many = len(order), [], np.empty(len(size), np.int64)
        row, ids, ranks = np.empty(0, np.int64), np.empty((len(count) - 1, 0), np.int32), np.empty((max(0, len(count) - 2), 0), np.int32)
        for n in range(len(count) - 1, 0, -1):
            new = order[to - count[n] : to]
            to -= count[n]
            if len(new):
                found = data[begin[new] + np.arange(n)[:, None]]
                found = np.concatenate([self.inner[found[:-1]], self.last[found[-1:]]])
                row, ids, ranks = np.append(row, new), np.concatenate([ids, found], 1), np.concatenate([ranks, self.ranks(found[:-1], found[1:])], 1)
            # Rank and place in one number, so that the least is the leftmost of the lowest rank.
            best = (ranks.astype(np.int64) * LONGEST + np.arange(n - 1)[:, None]).min(0) if n > 1 else np.full(len(row), _NO_RANK * LONGEST)
            done = best >= _NO_RANK * LONGEST
            out.append((row[done], ids[:, done]))
            many[row[done]] = n
            if n == 1:
                break
            row, ids, ranks, best = row[~done], ids[:, ~done], ranks[:, ~done], best[~done]
            rank, place = best // LONGEST, best % LONGEST
            each, step = np.arange(len(row)), np.arange(n - 1)[:, None]
            ids = np.where(step <= place, ids[:-1], ids[1:])
            ids[place, each] = self.made[rank]
            ranks = np.where(step[:-1] < place, ranks[:-1], ranks[1:])
            k = np.flatnonzero(place > 0)
            ranks[place[k] - 1, k] = self.ranks(ids[place[k] - 1, k], ids[place[k], k])
            k = np.flatnonzero(place < n - 2)
            ranks[place[k], k] = self.ranks(ids[place[k], k], ids[place[k] + 1, k])
        limits = np.append(0, np.cumsum(many))
        made = np.empty(limits[-1], np.int32)
        for own, ids in out:
            made[limits[own] + np.arange(len(ids))[:, None]] = ids
        return made, many


class WordEncoder(dict):
    """Finds the ids of distinct white-space delimited words.

    The tokenizer drops white space and no token spans it, so a text's ids are
    its words' ids in order. Plain words, of ASCII and of Latin-1's letters,
    only need lower-casing; they are cut into parts and merged in arrays, all
    words of a batch at once. All others go through the whole tokenizer, and
    this maps them to the bytes of their little-endian ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        with open(path) as f:
            made = json.load(f)
        self.merges = None
        known = all(made.get(k) == v for k, v in _STEPS.items()) and all(made["model"].get(k) == v for k, v in _OPTIONS.items())
        if known and all(x["content"].startswith("<|") for x in made["added_tokens"]):
            with contextlib.suppress(KeyError, ValueError):  # without all bytes, or of repeated merges: the tokenizer knows what to do
                self.merges = Merges(made["model"])
        #: The type that ids are kept in.
        self.kind = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"

    def __missing__(self, word: str) -> bytes:
        made = np.array(self.whole.encode(word, add_special_tokens=False).ids, self.kind).tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[word] = made
        return made

    def _plain(self, words: pa.Array) -> np.ndarray:
        """Which words are plain and hold nothing like a special token."""
        if not self.merges:
            return np.zeros(len(words), bool)
        data, limits = _bytes_of(words)
        before, after = np.append(np.uint8(0), data[:-1]), np.append(data[1:], np.uint8(0))
        letter = (before == 0xC3) & (data >= 0x80) & (data != 0x97) & (data != 0xB7)
        odd = ~(_PLAIN[data] | letter) | ((data == ord("<")) & (after == ord("|")))
        seen = np.append(0, np.cumsum(odd))
        return seen[limits[1:]] == seen[limits[:-1]]

    def _parts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The lower-cased bytes of plain words, the limits of their parts in them, and the number of parts before each word and in all."""
        data, limits = _bytes_of(words)
        total = len(data)
        low = np.append(_LOWER[data], np.zeros(3, np.uint8))
        low[:total][(data >= 0x80) & (data <= 0x9E)] += 32
        kind = _KIND[low]
        word = np.zeros(total + 3, bool)
        word[limits] = word[total:] = True
        first = word.copy()
        first[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        # An apostrophe takes s, t, m, d, re, ve or ll along, if no other such sign is beside it.
        k = np.flatnonzero(low[:total] == ord("'"))
        k = k[first[k] & ~word[k + 1] & (kind[k + 1] == _LETTER)]
        one, two = low[k + 1], np.where(word[k + 2], 0, low[k + 2])
        pair = (np.isin(one, list(b"rv")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        taken = np.where(pair, 2, np.where(np.isin(one, list(b"stmd")), 1, 0))
        k, taken = k[taken > 0], taken[taken > 0]
        first[k + 1] = False
        first[k + 1 + taken] = True
        first = first[:total]
        return low[:total], np.append(np.flatnonzero(first), total), np.append(0, np.cumsum(first))[limits]

    def _merged(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct parts, and how many each has."""
        data, limits = _bytes_of(parts)
        size = np.diff(limits)
        short = size <= LONGEST
        if short.all():
            return self.merges(data, limits[:-1], size)
        many = np.empty(len(size), np.int64)
        made, many[short] = self.merges(data, limits[:-1][short], size[short])
        rest = [[t.id for t in self.whole.model.tokenize(x.as_py().decode("latin-1").translate(self.merges.shown))] for x in parts.filter(pa.array(~short))]
        many[~short] = [len(x) for x in rest]
        made, begin = np.concatenate([made, *(np.array(x, np.int32) for x in rest)]), np.empty(len(size), np.int64)
        begin[short] = np.cumsum(many[short]) - many[short]
        begin[~short] = many[short].sum() + np.cumsum(many[~short]) - many[~short]
        return _gathered(made, begin, many)[0], many

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where in them those of each word begin and how many they are."""
        plain = self._plain(words)
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        ids = np.empty(0, self.kind)
        if plain.any():
            data, limits, word = self._parts(words.filter(pa.array(plain)))
            found = pa.Array.from_buffers(pa.large_binary(), len(limits) - 1, [None, pa.py_buffer(limits), pa.py_buffer(data)]).dictionary_encode()
            made, many = self._merged(found.dictionary)
            which = found.indices.to_numpy()
            ids, limits = _gathered(made.astype(self.kind), (np.cumsum(many) - many)[which], many[which])
            begin[plain], size[plain] = limits[word[:-1]], np.diff(limits[word])
        if not plain.all():
            rest = [np.frombuffer(self[w], self.kind) for w in words.filter(pa.array(~plain)).to_pylist()]
            size[~plain] = [len(x) for x in rest]
            begin[~plain] = len(ids) + np.cumsum(size[~plain]) - size[~plain]
            ids = np.concatenate([ids, *rest])
        return ids, begin, size


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows of ``most`` bytes; a larger row is a run of its own."""
    ends, k = np.cumsum(sizes), 0
    while k < len(ends):
        end = max(k + 1, int(np.searchsorted(ends, most + (ends[k - 1] if k else 0), side="right")))
        yield k, end
        k = end


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = worker_cache("packing")
        if path not in encoders:
            encoders[path] = WordEncoder(path)
        encoder = encoders[path]
        width = np.dtype(encoder.kind).itemsize
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            texts.validate(full=True)
            for k, end in _runs(pc.binary_length(texts).to_numpy().astype(np.int64) + width, READ):
                split = pc.ascii_split_whitespace(texts.slice(k, end - k))
                words = split.flatten().dictionary_encode()
                ids, begin, size = encoder.encode(words.dictionary)
                which = words.indices.to_numpy()
                ids, limits = _gathered(ids, begin[which], size[which])
                limits = limits[split.offsets.to_numpy()]
                ids, n = np.insert(ids, limits[1:], end_id), np.diff(limits) + 1
                ends = np.cumsum(n)
                starts, at = at + ends - n, at + int(ends[-1])
                held = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((width * np.append(0, ends)).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(np.full(len(n), width, np.int32)), pa.array(starts), ids_of.slice(k, end - k), pa.array(n), held],
                    ["part", "width", "at", "doc_id", "doc_tokens", "ids"],
                )
        released()

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``HELD`` bytes of ids at a time; a longer document is a slice of its own."""
    for batch in batches:
        for k, end in _runs(4 * batch.column("doc_tokens").to_numpy(), HELD):
            yield batch.slice(k, end - k)


def _cut(base: dict[int, int], window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in _slices(batches):
            part, width, at, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("part", "width", "at", "doc_tokens"))
            begin = at + np.array([base[p] for p in part.tolist()], np.int64)
            first, last = begin // window, (begin + n - 1) // window
            row = np.repeat(np.arange(len(n)), last - first + 1)
            sequence = np.arange(len(row)) - np.searchsorted(row, row) + first[row]
            low = np.maximum(begin[row], sequence * window)
            high = np.minimum((begin + n)[row], (sequence + 1) * window)
            start = low - begin[row]
            source = batch.column("ids")
            ids, held = [], (-1, None)
            for r, a, b in zip(row.tolist(), start.tolist(), (high - begin[row]).tolist(), strict=True):
                if held[0] != r:
                    held = r, np.frombuffer(source[r].as_buffer(), f"<u{width[r]}")
                ids.append(held[1][a:b].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(high - low), pa.array(n[row]), pa.array(sequence), pa.array(low - sequence * window), pa.array(ids, pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into windows of ``window`` token ids.

    One row per piece: doc_id, start (the document's ids before the piece),
    length, doc_tokens, sequence_id, offset in the sequence, and the ids as
    little-endian unsigned 32-bit bytes. Every document ends with ``end_id``.
    Sequences are gapless from offset 0; only the last may be shorter than the
    window, so at most ``window - 1`` positions of padding are ever needed.

    Null and empty texts are one ``end_id``. Repeated rows, equal ids and null
    ids are packed like any others. An empty table gives no rows. Other
    columns are ignored. The driver holds one number per input partition.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = f"part int, width int, at long, doc_id {kind}, doc_tokens long, ids binary"
    pieces = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    rows = docs.select("doc_id", text_of().alias("text"))
    ids = stage(rows.mapInArrow(_tokenise(tokenizer_path, end_id), tokens), "tokens")
    total, base = 0, {}
    for part, n in sorted(ids.groupBy("part").agg(F.max(F.col("at") + F.col("doc_tokens"))).collect()):
        base[part] = total
        total += n
    return ids.mapInArrow(_cut(base, window), pieces)
