"""Connected components of a graph that no single machine holds: forests of pieces, then alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trim

#: Edges that a task puts together at a time.
PIECE = 1 << 20


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), ascending, and the least node that each can reach."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a and b are roots
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _forest(e: DataFrame, pieces: int, piece: int) -> DataFrame:
    """(u, v): for pieces of the edges, each node that they have and the least one it can reach in them, v <= u.

    Without an exchange: a task takes what it reads, puts it together whenever it holds two pieces, and hands on what has
    more than one piece's nodes.
    """

    def run(batches):
        some, held = [], 0

        def together() -> tuple[np.ndarray, np.ndarray]:
            return least_reachable(*(np.concatenate([s[k] for s in some]) for k in (0, 1)))

        def rows(u: np.ndarray, v: np.ndarray):
            for at in range(0, len(u), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(u[at : at + (1 << 16)]), pa.array(v[at : at + (1 << 16)])], ["u", "v"])

        for batch in batches:
            for at in range(0, batch.num_rows, piece):
                part = batch.slice(at, piece)
                some.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
                held += part.num_rows
                if held >= 2 * piece:
                    found = together()
                    some, held = [found], len(found[0])
                    if held > piece:
                        yield from rows(*found)
                        some, held = [], 0
        if some:
            yield from rows(*together())
        trim()

    return e.coalesce(pieces).mapInArrow(run, "u long, v long")


def _star(edges: DataFrame) -> DataFrame:
    """Link each node's neighbours to the least of them; edges are (u, v), v a neighbour of u.

    The least comes by an aggregate that is combined before the shuffle, and is written: so the join that brings it back to
    the neighbours is one of two shuffles, of which adaptive execution splits the partition of a node with very many.
    """
    least = materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return edges.join(least.hint("merge"), "u")


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, a: str, b: str, piece: int = PIECE) -> DataFrame:
    """(node, component): the nodes of edges and the least node that each can reach.

    Edges may repeat or lead from a node to itself; a node without edges isn't returned, edges with a null end count for
    nothing, and no edges give no rows. First, each task puts the edges that it reads together, `piece` or so at a time, and
    a tree is left of each component of them; if all edges are one piece, that is the result. Else rounds of stars go on
    with the trees. Each round halves the depth of
    the trees or better, shuffles no more than the edges, and is written to the shared folder, so that plans stay short.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")  # null ends go too
    e = materialize(e, "edges")
    pieces = -(-e.count() // piece)
    e = materialize(_forest(e, max(1, pieces), piece), "forest")
    if pieces <= 1:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    e = materialize(e.where("u <> v").distinct(), "edges")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = _star(materialize(large, "large"))  # edges lead from the greater node to the less
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(small, "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
