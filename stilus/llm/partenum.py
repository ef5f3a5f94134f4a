"""Jaccard self-join of shingle sets by PartEnum signatures.

Sets fall into bands of sizes; similar sets are in the same band or in
neighbouring ones, and then differ in at most k elements. For each pair of
bands the feature domain is hashed into n1 parts of three cells each, with
n1 > k / 2: some part then holds at most one difference, so two of its three
cells agree. A set's signatures are its projections on each two cells of each
part. For small sets the domain's elements are their own parts, and the
enumerated subsets are the set without up to k elements. Either way, sets
that are similar enough share a signature: no link is lost.

A projection may be empty and say nothing. Bands have a few parts to spare: a
pair agrees in one part more than these at least, and agreeing projections are
empty together, so it agrees in one that is not empty if either set has no
more empty ones than that. A set that has more signs again under another
partition of the domain, as the other then does too. Only sets that fail in
all of several turns sign with their empty projections.

Equal sets are one node, known by a fingerprint. Nearly all signatures are of
one node. So 32 bits of each, by range, are sent first; a second pass sends
signatures with their nodes only where these bits came again. Nodes that share
a signature are compared with the smallest of them. Where these links leave a shared
signature in several components, the nodes around it are a cluster to compare
in full: block against block, as matrix products that give back a forest of
links, never a row for each pair. A block is a file that the tasks of its
pairs read, so what is written grows with the nodes and not with the pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stilus.llm.common import Blobs, discard, new_dir, packs, released, stage, tasks, text_of, worker_cache
from stilus.llm.components import connected
from stilus.llm.textkit import mix, shingle_sets, slabs

_U = np.uint64
#: Sets of one signature that a task sends one by one; it links more among themselves and sends the first.
FEW = 64
#: Signatures that a task holds before it sends them.
HELD = 1_000_000
#: Nodes of a block and their shingles, and shingles of a matrix, that are compared at once.
TOGETHER, SHINGLES, COLUMNS = 512, 1 << 20, 4096
#: Ids of texts to read again are broadcast up to so many bytes; beyond, texts are shuffled by id.
BROADCAST = 16 << 20
#: Partitions of the domain that are tried in turn for sets with too many empty projections.
TURNS = 8
#: Up to this size of the larger set, and two differences, subsets of elements are enumerated.
SMALL = 16


@lru_cache(maxsize=8)
def bands(percent: int, up_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest sizes of the bands, and for each band with the next: differences k, parts n1 (0: enumerate elements), parts to spare."""
    last = [100 // percent]
    while last[-1] < up_to or len(last) < 2:
        last.append((last[-1] + 1) * 100 // percent)
    last.append((last[-1] + 1) * 100 // percent)
    k, parts, spare = [], [], []
    smallest = 1
    for low, high in itertools.pairwise(last):
        differ = (low + high) * (100 - percent) // (100 + percent)
        need = differ // 2 + 1
        empty = 3 * need * np.exp(-smallest / need * 2 / 3)
        extra = min(int(np.ceil(empty + np.sqrt(empty))), need // 4 + 1) if empty > 1e-2 else 0
        k.append(differ)
        parts.append(0 if differ <= 2 and high <= SMALL else need + extra)
        spare.append(extra)
        smallest = low + 1
    return np.array(last), np.array(k), np.stack([parts, spare], axis=1)


def fingerprints(items: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One hash for each set of items."""
    sums = [np.zeros(len(items) + 1, np.uint64) for _ in range(2)]
    np.cumsum(mix(items), out=sums[0][1:])
    np.cumsum(mix(items ^ _U(0x5851F42D4C957F2D)), out=sums[1][1:])
    a, b = (s[begin[1:]] - s[begin[:-1]] for s in sums)
    return mix(a + mix(b + np.diff(begin).astype(np.uint64)))


def _projections(keys: np.ndarray, begin: np.ndarray, made: np.ndarray, tag: np.ndarray, n1: np.ndarray, spare: np.ndarray, turn: int):
    """Signatures of the sets ``made`` under one partition of the domain, and the sets with more empty projections than may be spared.

    Those sets sign with their empty projections as well in the last turn.
    """
    seed = mix(np.array([turn + 1], np.uint64))[0]
    cells = 3 * n1
    base = np.concatenate([[0], np.cumsum(cells)])
    n = begin[made + 1] - begin[made]
    own = keys[np.repeat(begin[made] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    own = mix(own ^ seed) if turn else own
    cell = np.repeat(base[:-1], n) + (own % np.repeat(cells, n).astype(np.uint64)).astype(np.int64)
    full = np.bincount(cell, minlength=base[-1]).reshape(-1, 3)
    sums = np.zeros(base[-1], np.uint64)
    np.add.at(sums, cell, mix(own + _U(0x2545F4914F6CDD1D)))
    sums = mix(sums).reshape(-1, 3)
    owner = np.repeat(np.arange(len(made)), n1)
    part = np.arange(len(owner)) - np.repeat(base[:-1] // 3, n1)
    label = mix(part.astype(np.uint64) * _U(3) + mix(tag[owner].astype(np.uint64) * _U(TURNS) + _U((1 << 40) + turn)))
    empty = np.stack([full[:, (j + 1) % 3] + full[:, (j + 2) % 3] == 0 for j in range(3)], axis=1)
    over = np.bincount(owner, weights=empty.any(axis=1), minlength=len(made)) > spare
    needed = ~empty | over[owner][:, None] if turn == TURNS - 1 else ~empty
    sigs = [mix(sums[:, (j + 1) % 3] + mix(sums[:, (j + 2) % 3] + label + _U(j)))[needed[:, j]] for j in range(3)]
    return np.concatenate(sigs), np.concatenate([made[owner[needed[:, j]]] for j in range(3)]), over


def signatures(items: np.ndarray, begin: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of the sets, and the set each is of; the sets' items are distinct."""
    size = np.diff(begin)
    last, differ, parts = bands(percent, max(64, int(size.max(initial=1)) * 2))
    band = np.searchsorted(last, size)
    out, of = [], []
    keys = mix(items)
    for down in (0, 1):
        tag = band - down
        able = (size > 0) & (tag >= 0)
        n1 = np.where(able, parts[np.maximum(tag, 0), 0], 0)
        made = np.flatnonzero(able & (n1 == 0))
        for x in made.tolist():
            own, label = keys[begin[x] : begin[x + 1]], mix(np.array([tag[x] + 1], np.uint64))[0]
            whole = own.sum(dtype=np.uint64)
            subsets = [whole]
            if differ[tag[x]] >= 1:
                subsets += (whole - own).tolist()
            if differ[tag[x]] >= 2:
                left, right = np.triu_indices(len(own), 1)
                subsets += (whole - own[left] - own[right]).tolist()
            sigs = mix(mix(np.array(subsets, np.uint64)) + label)
            out.append(sigs)
            of.append(np.full(len(sigs), x))
        made = np.flatnonzero(n1 > 0)
        for turn in range(TURNS):
            if not len(made):
                break
            sigs, owner, over = _projections(keys, begin, made, tag[made], n1[made], parts[tag[made], 1], turn)
            out.append(sigs)
            of.append(owner)
            made = made[over]
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def signature_count(size: np.ndarray, percent: int) -> np.ndarray:
    """How many signatures sets of these sizes have, but for empty projections and further turns."""
    last, differ, parts = bands(percent, max(64, int(size.max(initial=1)) * 2))
    band, out = np.searchsorted(last, size), np.zeros(len(size), np.int64)
    for down in (0, 1):
        tag = np.maximum(band - down, 0)
        k, n1 = differ[tag], parts[tag, 0]
        few = 1 + size * (k >= 1) + size * (size - 1) // 2 * (k >= 2)
        out += np.where((size > 0) & (band >= down), np.where(n1 > 0, 3 * n1, few), 0)
    return out


def bitmaps(items: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """For each set a bitmap of its hashed items, of at least four bits an item and a power of two."""
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        bits = np.zeros(max(256, 1 << (4 * (b - a) - 1).bit_length()), bool)
        bits[items[a:b] >> _U(64 - (len(bits).bit_length() - 1))] = True
        out.append(np.packbits(bits).tobytes())
    return out


def differences(x: np.ndarray, y: np.ndarray) -> int:
    """How many items of two sets differ at least, by their bitmaps: a bit of one alone is an item of one alone.

    The larger bitmap is folded to the size of the other: its neighbours there
    share the leading bits of their hashes.
    """
    if len(x) > len(y):
        x, y = y, x
    if len(x) < len(y):
        wide = np.unpackbits(y).reshape(8 * len(x), -1).any(axis=1)
        y = np.packbits(wide)
    return int(np.bitwise_count(x ^ y).sum())


def _sets(width: int, percent: int):
    """doc_id, n_shingles, expected signatures, fingerprint (null for the empty set), bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for batch in batches:
            for slab in slabs(batch.column("text")):
                items, begin = shingle_sets(slab, width)
                n = np.diff(begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(slab.first, slab.n), pa.array(n), pa.array(signature_count(n, percent)), pa.array(fingerprints(items, begin).view(np.int64), mask=n == 0), pa.array(bitmaps(items, begin), pa.binary())],
                    ["doc_id", "n_shingles", "signed", "node", "bits"],
                )

    return run


def _possible(percent: int):
    """The pairs (a, b) whose bitmaps (x, y) and sizes (n, m) do not rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            most = n * (100 - percent) // (100 + percent)
            pairs = zip(batch.column("x"), batch.column("y"), most.tolist(), strict=True)
            keep = [differences(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) <= k for x, y, k in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _items(width: int):
    """fingerprint and shingles of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column("text")):
                items, begin = shingle_sets(slab, width)
                some = np.diff(begin) > 0
                nodes = fingerprints(items, begin).view(np.int64)[some]
                bounds = np.concatenate([begin[:-1][some], begin[-1:]])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(items.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), lists], ["node", "items"])

    return run


def _held(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Signatures of the texts and their nodes, about ``HELD`` at a time."""
    held, n = [], 0
    for batch in batches:
        for slab in slabs(batch.column("text")):
            items, begin = shingle_sets(slab, width)
            sig, of = signatures(items, begin, percent)
            held.append((sig, fingerprints(items, begin)[of]))
            n += len(sig)
            if n > HELD:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _part(sig: np.ndarray, parts: int) -> np.ndarray:
    """Which range of signatures each is in."""
    return (((sig >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)


def _low(sig: np.ndarray) -> np.ndarray:
    return sig.astype(np.uint32)


def _hashed(width: int, percent: int, parts: int):
    """The low 32 bits of the signatures of each range, each once a batch; ``many``: those that several nodes of the batch have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        for sig, node in _held(batches, width, percent):
            order = np.argsort(sig, kind="stable")
            sig, node = sig[order], node[order]
            same = sig[1:] == sig[:-1]
            many = np.unique(sig[1:][same & (node[1:] != node[:-1])])
            sig = sig[np.concatenate([[True], ~same])]
            cut, cut_many = (np.searchsorted(_part(x, parts), np.arange(parts + 1)) for x in (sig, many))
            there = np.flatnonzero(np.diff(cut)).tolist()
            rows = [(_low(sig[cut[k] : cut[k + 1]]).tobytes(), _low(many[cut_many[k] : cut_many[k + 1]]).tobytes()) for k in there]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], ["part", "low", "many"])
        released()

    return run


def _repeated(folder: str):
    """Writes the sorted low bits that more than one batch, or several nodes of one, have in a range."""

    def run(table: pa.Table) -> pa.Table:
        low, many = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column(c)]) for c in ("low", "many"))
        low = np.sort(low)
        again = np.unique(np.concatenate([low[1:][low[1:] == low[:-1]], many]))
        part = table.column("part")[0].as_py()
        Blobs(folder).put(str(part), again)
        return pa.table([pa.array([part], pa.int32()), pa.array([len(again)], pa.int64())], ["part", "n"])

    return run


def _signed(width: int, percent: int, parts: int, folder: str):
    """Packed (signature, node) of each range of signatures, each once a task; those that ``folder`` does not have are of one node.

    A signature of many nodes of the task is sent with the first of them and
    marked; all its nodes go along, dealt by node, to be passed on.
    """

    def packed(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[fresh], node[fresh]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sig))))
        many = (np.diff(np.append(first, len(sig))) >= FEW)[run]
        leads = np.zeros(len(sig), bool)
        leads[first] = True
        passed, lead = np.flatnonzero(many), node[first[run]]
        sent = np.flatnonzero(~many | leads)
        by = _part(sig[sent], parts)
        deal = (mix(node[passed]) % _U(parts)).astype(np.int64)
        passed = passed[np.argsort(deal, kind="stable")]
        deal = np.sort(deal)
        cut, deals = np.searchsorted(by, np.arange(parts + 1)), np.searchsorted(deal, np.arange(parts + 1))
        columns = [[] for _ in range(6)]
        for k in range(parts):
            s, p = sent[cut[k] : cut[k + 1]], passed[deals[k] : deals[k + 1]]
            if len(s) + len(p):
                mine = many[s]
                names, index = np.unique(node[s], return_inverse=True)
                index = index.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32)
                for c, v in zip(columns, (k, sig[s].tobytes(), index.tobytes(), names.tobytes(), sig[s][mine].tobytes(), np.stack([sig[p], node[p], lead[p]]).tobytes()), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["part", "sig", "index", "names", "many", "passed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = worker_cache("partenum")
        if folder not in again:
            again.clear()
            again[folder] = {}
        files, blobs = again[folder], Blobs(folder)
        held, n = [], 0
        for sig, node in _held(batches, width, percent):
            order = np.argsort(sig)
            sig, node = sig[order], node[order]
            cut, low, keep = np.searchsorted(_part(sig, parts), np.arange(parts + 1)), _low(sig), np.zeros(len(sig), bool)
            for k in np.flatnonzero(np.diff(cut)).tolist():
                if k not in files:
                    files[k] = blobs.get(str(k), np.uint32)
                if len(files[k]):
                    mine = low[cut[k] : cut[k + 1]]
                    place = np.minimum(np.searchsorted(files[k], mine), len(files[k]) - 1)
                    keep[cut[k] : cut[k + 1]] = files[k][place] == mine
            held.append((sig[keep], node[keep]))
            n += int(keep.sum())
            if n > HELD:
                yield packed(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield packed(*map(np.concatenate, zip(*held, strict=True)))
        released()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Pairs of nodes to compare (sig null), and the nodes of each signature that three or more share."""

    def read(name: str, kind=np.uint64) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]

    sig, many = np.concatenate(read("sig")), np.unique(np.concatenate(read("many")))
    index = [np.frombuffer(x.as_buffer(), np.uint16 if len(names) <= 1 << 16 else np.uint32) for x, names in zip(table.column("index"), read("names"), strict=True)]
    node = np.concatenate([names[i] for names, i in zip(read("names"), index, strict=True)])
    passed = [np.frombuffer(x.as_buffer(), np.uint64).reshape(3, -1) for x in table.column("passed")]
    p_sig, p_node, p_lead = np.concatenate(passed, axis=1)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[fresh], node[fresh]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(sig)), bool), sig[1:] != sig[:-1]]))
    size = np.diff(np.append(first, len(sig)))
    run = np.repeat(np.arange(len(first)), size)
    lead = node[first[run]]
    star = lead != node
    a, b = np.concatenate([lead[star], p_lead[p_lead != p_node]]), np.concatenate([node[star], p_node[p_lead != p_node]])
    pair = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    sums = np.zeros(len(sig) + 1, np.uint64)
    np.cumsum(mix(node), out=sums[1:])
    alike = sums[first + size] - sums[first]
    known = np.isin(sig[first], many)
    _, once = np.unique(alike, return_index=True)
    kept = np.zeros(len(first), bool)
    kept[once] = True
    kept = (kept & (size > 2)) | known
    rows = kept[run]
    columns = [
        pa.array(np.concatenate([np.zeros(len(pair), np.uint64), sig[rows], p_sig]).view(np.int64), mask=np.arange(len(pair) + rows.sum() + len(p_sig)) < len(pair)),
        pa.array(np.concatenate([pair[:, 0], node[rows], p_node]).view(np.int64)),
        pa.array(np.concatenate([pair[:, 1], node[rows], p_node]).view(np.int64)),
    ]
    return pa.table(columns, ["sig", "a", "b"])


def _items_of(nodes: DataFrame, sets: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """node and its shingles, read again from one text of each of ``nodes``."""
    from_docs = stage(nodes.join(sets, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "read-again")
    few = from_docs.count() * 8 <= BROADCAST
    return texts.join(F.broadcast(from_docs) if few else from_docs, "doc_id", "left_semi").select("text").mapInArrow(_items(width), "node long, items array<long>")


def _links(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar: those that bitmaps do not rule out are checked on the sets."""
    ends = lambda p: p.select(F.col("a").alias("node")).union(p.select("b")).distinct()
    known = sets.join(ends(pairs), "node", "left_semi").dropDuplicates(["node"])
    x, y = (known.select(F.col("node").alias(e), F.col("n_shingles").alias(n), F.col("bits").alias(c)) for e, n, c in (("a", "n", "x"), ("b", "m", "y")))
    able = stage(pairs.join(x, "a").join(y, "b").mapInArrow(_possible(percent), "a long, b long"), "possible")
    items = _items_of(ends(able), sets, texts, width)
    both = able.join(items.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _forest(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the components of a block's nodes, or of two blocks' with each other: a forest, not all pairs.

    Blocks are nodes, sizes of their sets, and shingles. Common shingles are
    counted by products of incidence matrices, some columns at a time;
    shingles of a single node do not count.
    """
    nodes, size, items = map(np.concatenate, zip(*blocks, strict=True))
    of = np.repeat(np.arange(len(nodes)), size)
    _, which, times = np.unique(items, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    use = shared[which]
    of, which = of[use], place[which[use]]
    order = np.argsort(which, kind="stable")
    of, which = of[order], which[order]
    cut = len(blocks[0][0])
    left, right = (np.arange(len(nodes)),) * 2 if len(blocks) == 1 else (np.arange(cut), np.arange(cut, len(nodes)))
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(which, [low, low + COLUMNS])
        part = np.zeros((len(nodes), min(COLUMNS, int(shared.sum()) - low)), np.float32)
        part[of[a:b], which[a:b] - low] = 1
        common += part[left] @ part[right].T
    common = common.astype(np.int64)
    similar = 100 * common >= percent * (size[left][:, None].astype(np.int64) + size[right][None, :] - common)
    x, y = np.nonzero(similar)
    x, y = left[x], right[y]
    x, y = x[x != y], y[x != y]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        seen = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (seen == root).all():
            break
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[linked]], nodes[linked]


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = table.column("items").combine_chunks()
    return table.column("node").to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy()


def _compared(percent: int):
    """Links of the nodes of one block."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table([pa.array(x) for x in _forest([_block(table)], percent)], ["a", "b"])

    return run


def _name(cluster: int, band: int, own: int) -> str:
    return f"{cluster & (1 << 64) - 1:016x}-{band}-{own}"


def _kept(folder: str):
    """Writes a block as a file of its number of nodes, nodes, sizes and shingles."""

    def run(table: pa.Table) -> pa.Table:
        nodes, size, items = _block(table)
        key = [table.column(c)[0].as_py() for c in ("cluster", "band", "own")]
        Blobs(folder).put(_name(*key), np.concatenate([np.array([len(nodes)], np.int64), nodes, size, items]))
        return pa.table([pa.array([k], pa.int64()) for k in key], ["cluster", "band", "own"])

    return run


def _read(folder: str, percent: int):
    """Links of the pairs (cluster, band, own, other_band, other) of blocks that are kept as files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache()
        blobs = Blobs(folder)

        def block(*key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            data = blobs.get(_name(*key), np.int64)
            n = int(data[0])
            return data[1 : n + 1], data[n + 1 : 2 * n + 1], data[2 * n + 1 :]

        for batch in batches:
            for cluster, band, own, other_band, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks = [block(cluster, band, own)]
                if (band, own) != (other_band, other):
                    blocks.append(block(cluster, other_band, other))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(blocks, percent)], ["a", "b"])

    return run


def _inside(clusters: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what is similar in each of ``clusters`` (cluster, node).

    A block has so many nodes or shingles at most, about; a single larger set
    is what it is. A cluster of one block is compared at once. A larger one is
    dealt to blocks by bands of sizes, of which only neighbouring ones hold
    similar sets. Each block is written once, however many others it meets:
    tasks get pairs of names, and read.
    """
    spark = clusters.sparkSession
    held = stage(clusters.join(items, "node"), "open")
    # A band is a little wider than the ratio of sizes that similar sets may have, so rounding puts no two of them further apart.
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(np.log(100 / percent * (1 + 1e-9)).item())).cast("long")
    need = F.greatest(F.ceil(F.count("*") / TOGETHER), F.ceil(F.sum("n") / SHINGLES)).cast("long")
    nodes = held.select("cluster", "node", F.size("items").alias("n"))
    large = stage(nodes.groupBy("cluster").agg(need.alias("blocks")).filter("blocks > 1").select("cluster"), "large")
    small = held.join(large, "cluster", "left_anti").groupBy("cluster").applyInArrow(_compared(percent), "a long, b long")
    if large.isEmpty():
        links = stage(small, "inside")
        discard(held, large)
        return links
    banded = nodes.join(large, "cluster").withColumn("band", band)
    sized = banded.groupBy("cluster", "band").agg(need.alias("blocks"))
    dealt = banded.join(sized, ["cluster", "band"]).select("cluster", "band", F.pmod(F.xxhash64("node"), "blocks").alias("own"), "node")
    folder = new_dir(spark, "blocks")
    kept = dealt.join(held.select("node", "items"), "node").groupBy("cluster", "band", "own").applyInArrow(_kept(folder), "cluster long, band long, own long")
    kept = stage(kept, "kept")
    other = kept.select("cluster", F.col("band").alias("other_band"), F.col("own").alias("other"))
    met = kept.withColumn("next", F.explode(F.array("band", F.col("band") + 1))).join(other.withColumn("next", F.col("other_band")), ["cluster", "next"]).filter("other_band > band or other >= own").select("cluster", "band", "own", "other_band", "other")
    met = stage(met, "block-pairs")
    paired = met.repartition(max(tasks(spark), met.count() >> 6)).mapInArrow(_read(folder, percent), "a long, b long")
    links = stage(small.union(paired), "inside")
    discard(held, large, kept, met, folder)
    return links


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Components of ``docs`` (doc_id, text) whose ``width``-word shingle sets have Jaccard similarity of ``percent`` or more.

    Returns doc_id, n_shingles (size of the set) and component_id, the
    smallest doc_id reachable by links. Words are lower-cased in A-Z; a text
    of fewer words has one shingle, the whole sequence; a null, empty or blank
    text has the empty set, is linked with nothing and is its own component.
    Rows of equal doc_id count as one document and so are linked. A row with a
    null doc_id takes no part and has a null component_id. Other columns are
    ignored. Links are checked on the sets of 64-bit shingle hashes.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    sets = stage(texts.mapInArrow(_sets(width, percent), "doc_id long, n_shingles long, signed long, node long, bits binary"), "sets")
    named = sets.filter("doc_id is not null and node is not null")
    n = packs(docs.sparkSession, sets.agg(F.sum("signed")).first()[0] or 0, 16)
    packed = "part int, sig binary, index binary, names binary, many binary, passed binary"
    signing, folder = texts.filter("doc_id is not null").select("text"), new_dir(docs.sparkSession, "repeated")
    hashed = signing.mapInArrow(_hashed(width, percent, n), "part int, low binary, many binary")
    repeated = stage(hashed.groupBy("part").applyInArrow(_repeated(folder), "part int, n long"), "repeated")
    signed = signing.mapInArrow(_signed(width, percent, n, folder), packed)
    shared = stage(signed.groupBy("part").applyInArrow(_shared, "sig long, a long, b long"), "shared")
    discard(repeated, folder)
    pairs = shared.filter("sig is null").select("a", "b").distinct()
    links = stage(_links(pairs, named, texts, width, percent), "links")
    repeated = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    same_id = named.join(repeated.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b"))
    components = connected(links.union(same_id))
    discard(links)

    held = shared.filter("sig is not null").select("sig", F.col("a").alias("node")).distinct()
    held = held.join(components, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
    split = held.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("first")).filter("low <> high").select("sig", "first")
    met = stage(held.join(split, "sig").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "met")
    discard(shared)
    if not met.isEmpty():
        clusters = stage(connected(met).withColumnRenamed("component", "cluster"), "clusters")
        discard(met)
        items = _items_of(clusters.select("node"), named, texts, width).dropDuplicates(["node"])
        more = _inside(clusters, items, percent)
        components = connected(components.toDF("a", "b").union(more))
        discard(clusters, more)

    of = sets.join(components, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component"))
    first = of.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = of.join(first, "component", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
