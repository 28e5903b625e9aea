"""Approximate nearest neighbours by the largest inner product: vantage-point trees, one for each shard.

Inner products become distances: with one more coordinate, sqrt(M^2 - |x|^2) for a vector x and 0 for a query q, where M
is the greatest length, the squared distance is |q|^2 + M^2 - 2 q.x, so for each query the order is the same, and the
triangle inequality holds. A shard's tree splits its points at the median distance from a vantage point until LEAF or
fewer are left. All queries go down the tree together; at each node, a query leaves out a side that no point of can be
closer than its k-th so far: the lower bound of the distance times `factor` is held against it. Factor 1 drops nothing
that could count; a greater factor prunes more and may lose some. Leaves are scored by matrix products in double
precision on the original vectors.

Every row is indexed, in shards dealt by a hash of the id. Each block of queries meets each shard once; that unit of work
holds one shard and one block, and returns its k best for each query. The k best of these are the result.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, and neither do
rows with a null id; vectors of several lengths are an error, unless dim says which one counts. Other columns, whatever
their names, aren't passed on. Equal scores go to the smaller id. Fewer than k candidates: all. Rows
that repeat an id are each a candidate, but none is a candidate for a query with its own id; a repeated query id asks
once, with its least vector. No vectors: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, plan_bytes, spans_index, string_columns

LEAF = 512
#: Compressed bytes of a shard, and queries in a block: each a hundred megabytes or two of a worker's memory.
SHARD_BYTES = 8 << 20
QUERY_BLOCK = 32768
#: Scores that are held at a time.
SCORES = 1 << 21


class Tree:
    """A vantage-point tree over points; nodes are rows of arrays, and points are reordered so that a leaf is a slice."""

    def __init__(self, points: np.ndarray, seed: int = 7):
        self.points = points
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []
        self.rng = np.random.default_rng(seed)
        if len(points):
            self._grow(0, len(points))

    def _grow(self, lo: int, hi: int) -> int:
        me = len(self.nodes)
        if hi - lo <= LEAF:
            self.nodes.append((lo, hi))
            return me
        own = self.order[lo:hi]
        sample = own[self.rng.integers(0, len(own), 16)]
        spread = [np.var(np.linalg.norm(self.points[own[:: max(1, len(own) // 256)]] - self.points[v], axis=1)) for v in sample]
        vantage = self.points[sample[int(np.argmax(spread))]]
        d = np.linalg.norm(self.points[own] - vantage, axis=1)
        half = len(own) // 2
        split = np.argpartition(d, half)
        self.order[lo:hi] = own[split]
        d = d[split]
        self.nodes.append(())
        inner, outer = self._grow(lo, lo + half), self._grow(lo + half, hi)
        self.nodes[me] = (vantage, (d[:half].min(), d[:half].max()), (d[half:].min(), d[half:].max()), inner, outer)
        return me


def best_of(q: np.ndarray, i: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, by score and then id: query, rank, id, score."""
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q)))) + 1
    keep = rank <= k
    return q[keep], rank[keep], i[keep], s[keep]


class Best:
    """The k best of each query so far, by score and then id, among points that each stand for some ids."""

    def __init__(self, n: int, k: int):
        self.ids, self.scores = np.zeros((n, k), np.int64), np.full((n, k), -np.inf)

    @property
    def last(self) -> np.ndarray:
        """The k-th score of each query, -inf where there are fewer."""
        return self.scores[:, -1]

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        k = self.ids.shape[1]
        some = np.unique(row)
        row, rank, found, score = best_of(np.concatenate([np.repeat(some, k), row]), np.concatenate([self.ids[some].reshape(-1), ids]), np.concatenate([self.scores[some].reshape(-1), score]), k)
        self.ids[row, rank - 1], self.scores[row, rank - 1] = found, score

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of all that was found."""
        row, column = np.nonzero(self.scores > -np.inf)
        return row, self.ids[row, column], self.scores[row, column]


def search(tree: Tree, vectors: np.ndarray, queries: np.ndarray, top: float, k: int, factor: float, ids: np.ndarray | None = None, first: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[Best, int]:
    """The k best of vectors for each query, and how many scores were made.

    A vector stands for ids[first[i]:first[i + 1]] (for its own place, without ids); own are the queries' ids, which they
    don't find. Matrix products only choose what may count: what is within their rounding of a query's k-th score is
    scored by itself, and held against the k best by that score and then by id, so equal scores are told apart by id alone.
    """
    ids = np.arange(len(vectors)) if ids is None else ids
    first = np.arange(len(vectors) + 1) if first is None else first
    n, dim = queries.shape
    best, made = Best(n, k), 0
    lifted = np.hstack([queries, np.zeros((n, 1))])
    length = (queries**2).sum(1)
    square = length + top * top
    rounding = 4.0 * (dim + 4) * 2.0**-53 * np.sqrt(length) * top

    def leaf(rows: np.ndarray, points: np.ndarray) -> None:
        step = max(1, SCORES // len(points))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            scores = queries[some] @ vectors[points].T
            least = best.last[some]
            if len(points) > k:  # one of k + 1 may be the query itself
                least = np.maximum(least, -np.partition(-scores, k, axis=1)[:, k])
            r, c = np.nonzero(scores >= (least - rounding[some])[:, None])
            for lo in range(0, len(r), SCORES // dim + 1):
                row, point = some[r[lo : lo + SCORES // dim + 1]], points[c[lo : lo + SCORES // dim + 1]]
                score = (vectors[point] * queries[row]).sum(1)
                times = first[point + 1] - first[point]
                row, score, found = np.repeat(row, times), np.repeat(score, times), ids[spans_index(first[point], times)]
                if own is not None:
                    other = found != own[row]
                    row, score, found = row[other], score[other], found[other]
                best.add(row, found, score)

    def visit(node: int, rows: np.ndarray, bound: np.ndarray) -> None:
        nonlocal made
        limit = np.sqrt(np.maximum(square[rows] - 2 * best.last[rows], 0))  # the distance of the k-th so far
        live = bound * factor <= limit * (1 + 1e-9) + 1e-7 * top
        rows, bound = rows[live], bound[live]
        if not len(rows):
            return
        found = tree.nodes[node]
        if len(found) == 2:
            made += len(rows) * (found[1] - found[0])
            leaf(rows, tree.order[found[0] : found[1]])
            return
        vantage, inner, outer, left, right = found
        d = np.linalg.norm(lifted[rows] - vantage, axis=1)
        bounds = [np.maximum(bound, np.maximum(d - far, near - d)) for near, far in (inner, outer)]
        nearer = bounds[0] <= bounds[1]
        for chosen, sides in ((nearer, (0, 1)), (~nearer, (1, 0))):
            for side in sides if chosen.any() else ():
                visit((left, right)[side], rows[chosen], bounds[side][chosen])

    if tree.nodes and n:
        visit(0, np.arange(n), np.zeros(n))
    return best, made


def shard_best(v: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, top: float, k: int, factor: float):
    """The k best of a shard for each query. Equal vectors are one point with its k + 1 smallest ids, so that ties are exact."""
    order = np.lexsort((ids, *v.T[::-1]))
    v, ids = v[order], ids[order]
    start = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]).any(1)])
    times = np.minimum(np.diff(np.append(start, len(v))), k + 1)
    distinct, few = v[start], ids[spans_index(start, times)]
    lifted = np.hstack([distinct, np.sqrt(np.maximum(top * top - (distinct**2).sum(1), 0))[:, None]])
    best, _ = search(Tree(lifted), distinct, queries, top, k, factor, few, np.concatenate([[0], np.cumsum(times)]), query_ids)
    row, found, score = best.found()
    return query_ids[row], found, score


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part; components stay single where they are single, and are doubles otherwise."""
    kind = df.schema[vector].dataType.elementType
    v = F.col(vector) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    return rows.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, factor: float = 1.0, dim: int | None = None, shard_bytes: int = SHARD_BYTES, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each row whose id is divisible by every.

    dim: only vectors of that length take part; without it, vectors of several lengths are an error. A unit of work holds
    shard_bytes of points and query_block queries; what is shuffled falls as these grow.
    """
    string_columns(df, key, vector)
    if k < 1 or every < 1 or factor <= 0:
        raise ValueError("k, every and factor have to be positive")
    rows = usable(df, key, vector)
    rows = materialize(rows if dim is None else rows.where(F.size("v") == dim), "vectors")
    shards = max(12, plan_bytes(rows) // shard_bytes)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    facts = rows.agg(F.max(F.sqrt(square)), F.min(F.size("v")), F.max(F.size("v"))).first()
    if facts[1] != facts[2]:
        raise ValueError(f"vectors have {facts[1]} to {facts[2]} components: say which with dim")
    top = facts[0] or 0.0
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, asked.count() // query_block)
    shard, block = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    points = rows.select(shard.alias("shard"), all_of(blocks).alias("block"), F.lit(False).alias("asks"), "id", "v")
    queries = asked.select(all_of(shards).alias("shard"), block.alias("block"), F.lit(True).alias("asks"), "id", "v")

    def run(table: pa.Table) -> pa.Table:
        asks, ids = table.column("asks").to_numpy().astype(bool), table.column("id").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        found = shard_best(v[~asks], ids[~asks], v[asks], ids[asks], top, k, factor) if asks.any() and not asks.all() else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": found[0], "id": found[1], "score": found[2]})

    found = points.unionByName(queries).groupBy("shard", "block").applyInArrow(run, "query_id long, id long, score double")

    def merge(table: pa.Table) -> pa.Table:
        q, rank, i, s = best_of(*(table.column(n).to_numpy() for n in ("query_id", "id", "score")), k)
        return pa.table({"query_id": q, "rank": pa.array(rank, pa.int32()), key: i, "score": s})

    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks * 512)).alias("part")
    return found.withColumn("part", part).groupBy("part").applyInArrow(merge, f"query_id long, rank int, `{key}` long, score double")
