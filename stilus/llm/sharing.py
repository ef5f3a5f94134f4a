"""Keys that several values share, found by packed arrays instead of rows.

Each task sorts its own (key, value) and sends packed arrays by range of keys,
so one shuffle of 20 bytes an entry finds all shared keys. Where a task has
several values of a key already, it passes them on as found and sends the
first alone, marked; so a key of very many values costs each task one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stilus.llm.textkit import mix

_U = np.uint64
HELD = 2_000_000
PACK = "part int, key binary, value binary, extra binary, many binary, found binary"


def _sorted(key: np.ndarray, value: np.ndarray, extra: np.ndarray):
    """Distinct entries in order, where each key's begin, and whether each entry's key has several values."""
    order = np.lexsort((extra, value, key))
    key, value, extra = key[order], value[order], extra[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1]) | (extra[1:] != extra[:-1])
    key, value, extra = key[fresh], value[fresh], extra[fresh]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    several = value[first] != value[first + size - 1] if len(first) else np.zeros(0, bool)
    return key, value, extra, first, np.repeat(several, size), size


def _send(parts: int):
    def packed(key, value, extra) -> pa.RecordBatch:
        key, value, extra, first, several, _ = _sorted(key, value, extra)
        leads = np.zeros(len(key), bool)
        leads[first] = True
        sent, found = np.flatnonzero(~several | leads), np.flatnonzero(several)
        by = (((key[sent] >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)
        deal = (mix(value[found]) % _U(parts)).astype(np.int64)
        found, deal = found[np.argsort(deal, kind="stable")], np.sort(deal)
        cut, deals = np.searchsorted(by, np.arange(parts + 1)), np.searchsorted(deal, np.arange(parts + 1))
        out = [[] for _ in range(6)]
        for k in range(parts):
            s, f = sent[cut[k] : cut[k + 1]], found[deals[k] : deals[k + 1]]
            if len(s) + len(f):
                for c, v in zip(out, (k, key[s].tobytes(), value[s].tobytes(), extra[s].tobytes(), several[s].tobytes(), np.stack([key[f], value[f], extra[f].astype(np.uint64)]).tobytes()), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["part", "key", "value", "extra", "many", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            held.append([batch.column(k).to_numpy().astype(t) for k, t in ((0, np.uint64), (1, np.uint64), (2, np.uint32))])
            n += len(batch)
            if n > HELD:
                yield packed(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _meet(table: pa.Table) -> pa.Table:
    read = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])
    key, value, extra, many = read("key", np.uint64), read("value", np.uint64), read("extra", np.uint32), read("many", bool)
    found = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64).reshape(3, -1) for x in table.column("found")], axis=1)
    marked = np.unique(key[many])
    key, value, extra, _, several, _ = _sorted(key, value, extra)
    kept = several | np.isin(key, marked)
    columns = (np.concatenate(x) for x in ((key[kept], found[0]), (value[kept], found[1]), (extra[kept].astype(np.uint64), found[2])))
    key, value, extra = columns
    return pa.table([pa.array(key.view(np.int64)), pa.array(value.view(np.int64)), pa.array(extra.astype(np.uint32).view(np.int32))], ["key", "value", "extra"])


def shared(entries: DataFrame, parts: int) -> DataFrame:
    """The entries (key long, value long, extra int) of keys with two values or more; some may come twice.

    Nulls must not occur.
    """
    packed = entries.mapInArrow(_send(parts), PACK)
    return packed.groupBy("part").applyInArrow(_meet, "key long, value long, extra int")
