"""Approximate nearest neighbours by vantage-point trees, one per shard.

A node holds a vantage point and the ranges of the distances of its two halves
from it. On unit vectors the Euclidean distance is a metric and orders as the
cosine does, so the triangle inequality bounds the distance of a query from
all of a half. A half is skipped if that bound times ``factor`` exceeds the
distance of the query's k-th best; factor 1 is exact search.

Shards are the leaves of a coarse tree of the same kind, whose vantage points
and radii come from a bounded sample; every vector goes down it, and leaves
with many vectors, copies for example, are dealt further by number. Each
shard's tree is built once and stored in the shared folder. A query first
searches the shard that it falls into itself. What it finds there bounds the
others, which are skipped whole or searched from the stored trees; only
queries move.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stilus.llm.common import Blobs, new_dir, stage, worker_cache

#: Vectors of a shard and queries that a task searches it for at once, about.
SHARD, BLOCK = 8192, 1024
LEAF = 64
#: Vectors, and their bytes, that the coarse tree is fitted on at most; and those for each of its leaves.
SAMPLE, SAMPLE_BYTES, EACH = 65_536, 32 << 20, 8
#: So many trees' names are broadcast; more are joined by shuffling.
LISTED = 200_000
#: With this factor recall and the share of vectors looked at are measured (see the README); 1 is exact.
FACTOR = 6.0
#: Cosines of one pair computed in different ways differ by less.
SLACK = 1e-9


def distance(cosine: np.ndarray) -> np.ndarray:
    """Distance of unit vectors of this cosine."""
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _vantage(unit: np.ndarray) -> np.ndarray:
    """The vector furthest from the mean of all."""
    return unit[np.argmin(unit @ unit.mean(axis=0))]


def _gap(far: np.ndarray) -> float:
    """Where to cut sorted distances: in the widest gap among the middle ones, so that clusters stay whole."""
    low, high = int(0.3 * (len(far) - 1)), max(int(0.7 * (len(far) - 1)), 1)
    at = low + int(np.argmax(np.diff(far[low : high + 1]))) if high > low else low
    return float((far[at] + far[min(at + 1, len(far) - 1)]) / 2)


class Coarse:
    """Halves of a sample, again and again: which shard a vector falls into, and which shards may be near enough."""

    def __init__(self, unit: np.ndarray, shards: int):
        self.nodes: list[tuple] = []
        self.shards = 0
        self._build(unit, shards)

    def _build(self, unit: np.ndarray, shards: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if shards > 1 and len(unit) > 1:
            point = _vantage(unit)
            far = distance(unit @ point)
            radius = _gap(np.sort(far))
            close = far <= radius
            if not close.all():
                self.nodes[at] = point, radius, self._build(unit[close], (shards + 1) // 2), self._build(unit[~close], shards // 2)
                return at
        self.nodes[at] = (self.shards,)
        self.shards += 1
        return at

    def shard_of(self, unit: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(unit), np.int32), [(0, np.arange(len(unit)))]
        while todo:
            node, who = todo.pop()
            if len(self.nodes[node]) == 1:
                out[who] = self.nodes[node][0]
            elif len(who):
                point, radius, near, away = self.nodes[node]
                close = distance(unit[who] @ point) <= radius
                todo += [(near, who[close]), (away, who[~close])]
        return out

    def within(self, unit: np.ndarray, reach: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Which vectors' bound for which shards, times ``factor``, is within their reach."""
        found, todo = [], [(0, np.arange(len(unit)), np.zeros(len(unit)))]
        while todo:
            node, who, bound = todo.pop()
            if not len(who):
                continue
            if len(self.nodes[node]) == 1:
                found.append((who, np.full(len(who), self.nodes[node][0], np.int32)))
                continue
            point, radius, near, away = self.nodes[node]
            beyond = distance(unit[who] @ point) - radius
            for half, more in ((near, beyond), (away, -beyond)):
                least = np.maximum(bound, more - SLACK)
                left = least * factor <= reach[who]
                todo.append((half, who[left], least[left]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))


class Tree:
    """A vantage-point tree over rows of ``vectors``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.raw = ids[order], vectors[order]
        self.unit = _unit(self.raw)
        self.order = np.arange(len(ids))
        #: Inner nodes: vantage point, ranges of both halves, and the halves; leaves: a range of ``order``.
        self.nodes: list[tuple] = []
        self._build(0, len(ids), leaf)
        self.__setstate__(self.__getstate__())

    def __getstate__(self):
        return self.ids, self.raw, self.order, self.nodes

    def __setstate__(self, state) -> None:
        self.ids, self.raw, self.order, self.nodes = state
        self.norm = np.sqrt((self.raw * self.raw).sum(axis=1))
        self.sorted_unit = _unit(self.raw)[self.order]
        #: Cosines computed so far.
        self.seen = 0

    def _build(self, a: int, b: int, leaf: int) -> int:
        at = len(self.nodes)
        if b - a <= leaf:
            self.nodes.append((a, b))
            return at
        self.nodes.append(())
        own = self.order[a:b]
        point = _vantage(self.unit[own])
        d = distance(self.unit[own] @ point)
        by = np.argsort(d, kind="stable")
        self.order[a:b], d, half = own[by], d[by], (b - a) // 2
        ranges = (d[0], d[half - 1], d[half], d[-1])
        near, away = self._build(a, a + half, leaf), self._build(a + half, b, leaf)
        self.nodes[at] = (point, ranges, near, away)
        return at

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, known: np.ndarray | float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The k best (score, id) of each query, best first; score -inf where there are fewer.

        ``known``: scores that must be reached to matter. Ties go to the
        smaller id; rows of the query's own id are not found.
        """
        n = len(ids)
        norm = np.sqrt((queries * queries).sum(axis=1))
        unit = queries / norm[:, None]
        score, best = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        first, known = np.full(n, -1), np.broadcast_to(known, n)
        least = lambda who: np.maximum(score[who, -1], known[who])

        def visit(node: int, who: np.ndarray) -> None:
            a, b = self.nodes[node]
            self.seen += len(who) * (b - a)
            rough = unit[who] @ self.sorted_unit[a:b].T
            x, y = np.nonzero((rough >= least(who)[:, None] - SLACK) & (self.ids[self.order[a:b]][None, :] != ids[who][:, None]))
            if not len(x):
                return
            row, col = who[x], self.order[a + y]
            exact = (queries[row] * self.raw[col]).sum(axis=1) / (norm[row] * self.norm[col])
            some, place = np.unique(row, return_inverse=True)
            nth = np.arange(len(x)) - np.searchsorted(row, row)
            wide = k + int(nth.max()) + 1
            scores, names = np.full((len(some), wide), -np.inf), np.full((len(some), wide), np.iinfo(np.int64).max)
            scores[:, :k], names[:, :k] = score[some], best[some]
            scores[place, k + nth], names[place, k + nth] = exact, self.ids[col]
            take = np.lexsort((names, -scores), axis=1)[:, :k]
            score[some], best[some] = np.take_along_axis(scores, take, 1), np.take_along_axis(names, take, 1)

        todo = [(0, np.arange(n))]
        while todo:
            node, who = todo.pop()
            if len(self.nodes[node]) == 2:
                first[who] = node
                visit(node, who)
                continue
            point, (_, inner, outer, _), near, away = self.nodes[node]
            close = distance(unit[who] @ point) <= (inner + outer) / 2
            todo += [(half, part) for half, part in ((near, who[close]), (away, who[~close])) if len(part)]
        todo = [(0, np.arange(n))]
        while todo:
            node, who = todo.pop()
            if len(self.nodes[node]) == 2:
                who = who[first[who] != node]
                if len(who):
                    visit(node, who)
                continue
            point, (a, b, c, d), near, away = self.nodes[node]
            from_point = distance(unit[who] @ point)
            reach = distance(least(who)) + SLACK
            for half, low, high in ((away, c, d), (near, a, b)):
                bound = np.maximum(np.maximum(from_point - high, low - from_point), 0)
                left = who[bound * factor <= reach]
                if len(left):
                    todo.append((half, left))
        return score, best


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null or zero, and all components finite."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of each length: length, rows, vectors."""
    lists = batch.column("vector")
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    for own in np.unique(size).tolist():
        rows = np.flatnonzero(size == own)
        yield own, rows, flat[at[rows][:, None] + np.arange(own)]


VECTORS = "id long, vector array<double>"


def _dealt(coarse: dict[int, Coarse]):
    """Rows with their vector's size and shard, and a number that spreads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() * 7919
        for batch in batches:
            sizes, shards = np.zeros((2, len(batch)), np.int32)
            for size, rows, vectors in _by_size(batch):
                sizes[rows] = size
                if size in coarse:
                    shards[rows] = coarse[size].shard_of(_unit(vectors))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(shards), pa.array(np.arange(n, n + len(batch)))], [*batch.schema.names, "size", "shard", "spread"])
            n += len(batch)

    return run


def _build(uri: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        size, shard, sub = (k.as_py() for k in key)
        lists = table.column("vector").combine_chunks()
        tree = Tree(table.column("id").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1))
        Blobs(uri).put(f"tree-{size}-{shard}-{sub}", np.frombuffer(pickle.dumps(tree), np.uint8))
        return pa.table([pa.array([x], pa.int32()) for x in (size, shard, sub)], ["size", "shard", "sub"])

    return run


def _others(coarse: dict[int, Coarse], factor: float):
    """Queries for each shard but their own that may hold better vectors than those known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                for size, rows, vectors in _by_size(batch):
                    if size in coarse:
                        reach = distance(batch.column("known").to_numpy()[rows]) + SLACK
                        who, shard = coarse[size].within(_unit(vectors), reach, factor)
                        other = shard != batch.column("shard").to_numpy()[rows][who]
                        taken = batch.take(pa.array(rows[who[other]]))
                        yield pa.RecordBatch.from_arrays([pa.array(shard[other]) if n == "shard" else taken.column(n) for n in taken.schema.names], taken.schema.names)

    return run


def _search(uri: str, k: int, factor: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        name = "tree-{}-{}-{}".format(*(x.as_py() for x in key[:3]))
        cache = worker_cache("vptree")
        if (uri, name) not in cache:
            cache.clear()
            cache[uri, name] = pickle.loads(Blobs(uri).get(name, np.uint8))
        lists = table.column("vector").combine_chunks()
        vectors = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
        score, best = cache[uri, name].search(ids, vectors, k, factor, table.column("known").to_numpy())
        x, y = np.nonzero(np.isfinite(score))
        return pa.table([pa.array(own[x]), pa.array(ids[x]), pa.array(best[x, y]), pa.array(score[x, y])], ["own", "query_id", "vec_id", "score"])

    return run


def _coarse(vectors: DataFrame) -> dict[int, Coarse]:
    """Coarse trees of the vector lengths that fill more than a shard, each fitted on a bounded sample."""
    out = {}
    size = F.size("vector")
    for r in vectors.groupBy(size.alias("size")).count().filter(F.col("count") > SHARD).collect():
        most = min(SAMPLE, SAMPLE_BYTES // (8 * r["size"]))
        part = vectors.filter(size == r["size"]).select("vector").sample(min(1.0, most / r["count"]), seed=7).limit(2 * most).toArrow()
        lists = part.column("vector").combine_chunks()
        unit = _unit(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1))
        out[r["size"]] = Coarse(unit, min(-(-r["count"] // SHARD), max(1, len(unit) // EACH)))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = FACTOR) -> DataFrame:
    """The ``k`` rows of ``vectors`` (id, vector) of largest cosine with each row of ``queries`` (id, vector).

    Returns query_id, rank from 1, vec_id and score: the cosine in double
    precision on the vectors as given. Rows of the query's own id are no
    candidates; ties go to the smaller id. Vectors that are null, zero or hold
    null or non-finite components, and null ids, take no part; vectors are
    compared with those of equal length. Repeated rows are candidates of their
    own, and a repeated query has the best of its rows' results. With factor 1
    the result is exact; with a larger one shards and halves are skipped
    sooner. Empty tables give no rows.
    """
    whole, asked = (x.select(F.col("id").cast("long").alias("id"), F.transform("vector", lambda v: v.cast("double")).alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector"))) for x in (vectors, queries))
    coarse, uri = _coarse(whole), new_dir(vectors.sparkSession, "trees")
    place, schema = ["size", "shard"], f"{VECTORS}, size int, shard int, spread long"
    dealt = stage(whole.mapInArrow(_dealt(coarse), schema), "dealt")
    subs = dealt.groupBy(*place).agg(F.ceil(F.count("*") / SHARD).cast("int").alias("subs"))
    numbered = dealt.join(F.broadcast(subs), place).withColumn("sub", F.pmod(F.xxhash64("spread"), "subs").cast("int"))
    trees = stage(numbered.select("id", "vector", *place, "sub").groupBy(*place, "sub").applyInArrow(_build(uri), "size int, shard int, sub int"), "trees")
    listed = F.broadcast(trees) if trees.count() <= LISTED else trees

    def searched(sent: DataFrame) -> DataFrame:
        """Results of queries (own, id, vector, known, size, shard), dealt in blocks over their shards' trees."""
        blocks = sent.groupBy(*place).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        keyed = sent.join(F.broadcast(blocks), place).withColumn("block", F.pmod(F.xxhash64("own"), "blocks").cast("int")).join(listed, place)
        rows = keyed.select(*place, "sub", "block", "own", "id", "vector", "known")
        return rows.groupBy(*place, "sub", "block").applyInArrow(_search(uri, k, factor), "own long, query_id long, vec_id long, score double")

    def best(found: DataFrame, by: str) -> DataFrame:
        order = Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    asked = asked.withColumn("own", F.xxhash64("id", "vector")).dropDuplicates(["own"]).withColumn("known", F.lit(-float("inf")))
    home = stage(asked.mapInArrow(_dealt(coarse), f"{VECTORS}, own long, known double, size int, shard int, spread long").drop("spread"), "queries")
    first = stage(best(searched(home), "own").drop("rank"), "first")
    bound = first.groupBy("own").agg(F.when(F.count("*") == k, F.min("score")).otherwise(-float("inf")).alias("known"))
    ready = home.drop("known").join(bound, "own", "left").withColumn("known", F.coalesce("known", F.lit(-float("inf"))))
    ready = ready.select("id", "vector", "own", "known", *place)
    more = stage(ready.mapInArrow(_others(coarse, factor), f"{VECTORS}, own long, known double, size int, shard int"), "others")
    return best(first.union(searched(more)), "query_id").select("query_id", "rank", "vec_id", "score")
