"""Near-duplicate documents by HyperMinHash, confirmed on full sets.

1. Each text becomes its set of word shingles and a HyperMinHash sketch: 128 buckets that hold the leading zeros and ten
   mantissa bits of their least hash. Documents with one set form a class, and only one of each class goes on.
2. 25 bands of five registers are hashed. A band's least document is its leader; each other document of the band is
   paired with it, so a band of n gives n - 1 pairs. Two documents at similarity 0.85 share no band with probability
   4e-7. The collision-corrected estimate drops pairs far below any use (under 0.25, for sets of 64 or more), and what
   is left is put together to families: two similar documents are in one family.
3. Families of up to TILE documents are compared on full sets, all against all: common shingles by a matrix product,
   rare ones by their lists. In larger families, each document is compared with the leader that it is estimated to be
   nearest to; what that links is put together. There, all pairs are compared only within bands that still hold documents
   of several groups, in tiles. A comparison gives no pairs, only a tree of links.
4. The links' connected components are the result.

Texts with one 128-bit digest and size of their sets are taken for equal, and sets are of 64-bit hashes: a collision of
these, at 2**-64 for a pair of shingles, is not looked for.

Defined results: null and empty texts and texts without words have an empty set, belong to no pair, and are a component
of their own. A row with a null doc_id takes part in nothing; its component is null and it is kept. Rows with one doc_id
and several texts count as one document for links; rows that are alike in both get the same result. Computed columns
replace input columns of the same name; other columns are passed on by drop_near_duplicates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, parts_for, raw, string_columns, trim, trimmed
from .components import components
from .shingles import digests, estimate, registers, shingle_sets

BUCKETS = 128
BAND = 5
#: Sets of this size or more need this estimated similarity to a band's leader.
LARGE, FLOOR = 64, 0.25
TILE = 2048
#: Documents that are compared with their leader at a time.
STAR = 256
#: Shingles that at most so many sets have are compared by their lists.
RARE = 24


def sketch(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(doc, n, d0, d1, sig): size, digest and registers of each row's set."""

    def run(batches):
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 1000):
                part = batch.slice(at, 1000)
                sets, sizes = shingle_sets(*raw(part.column(1)), width)
                both = digests(sets, sizes).view(np.int64)
                sig = registers(sets, sizes, BUCKETS).astype("<u2")
                values = pa.array([x.tobytes() for x in sig], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), values], ["doc", "n", "d0", "d1", "sig"])
        trim()

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, "doc long, n long, d0 long, d1 long, sig binary")


def band_keys(classes: DataFrame, least: int) -> DataFrame:
    """(band, doc): hashes of the bands that aren't empty, for sets that can have a partner other than themselves."""
    size = 2 * BAND
    one = f"substring(sig, {size} * i + 1, {size})"
    keys = f"filter(transform(sequence(0, {BUCKETS // BAND - 1}), i -> if({one} = unhex('{'00' * size}'), null, xxhash64(i, {one}))), x -> x is not null)"
    return classes.where(F.col("n") >= least).select(F.explode(F.expr(keys)).alias("band"), "doc")


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (doc, leader, near) whose estimated similarity isn't far below any use."""
    side = classes.select("doc", "n", "sig")
    wide = pairs.join(side, "doc").join(side.select(F.col("doc").alias("leader"), F.col("n").alias("m"), F.col("sig").alias("other")), "leader").select("doc", "leader", "n", "m", "sig", "other")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, BUCKETS) for i in (4, 5))
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            found, _ = estimate(a, b, n, m)
            keep = (found >= FLOOR) | (np.maximum(n, m) < LARGE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["doc", "leader", "near"]).filter(pa.array(keep))

    return wide.mapInArrow(run, "doc long, leader long, near double")


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b (b None: with a)."""
    m, k = len(a), len(a if b is None else b)
    every = a if b is None else a + b
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    values = np.concatenate(every)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    times = np.diff(np.append(start, len(values)))
    out = np.zeros((m, k), np.float32)
    cut = RARE if len(every) > RARE else 0
    for f in range(2, cut + 1):
        lists = owner[start[times == f][:, None] + np.arange(f)]
        if len(lists):
            i, j = np.repeat(lists, f, axis=1).reshape(-1), np.tile(lists, (1, f)).reshape(-1)
            if b is not None:
                cross = (i < m) & (j >= m)
                i, j = i[cross], j[cross] - m
            out += np.bincount(i * k + j, minlength=m * k).reshape(m, k)
    common = np.flatnonzero(times > max(cut, 1))
    for at in range(0, len(common), 2048):
        own = common[at : at + 2048]
        dense = np.zeros((len(every), len(own)), np.float32)
        column = np.repeat(np.arange(len(own)), times[own])
        pos = np.repeat(start[own] - (np.cumsum(times[own]) - times[own]), times[own]) + np.arange(len(column))
        dense[owner[pos], column] = 1
        out += dense[:m] @ (dense if b is None else dense[m:]).T
    return out


def link(a: list[np.ndarray], b: list[np.ndarray] | None, share: tuple[int, int]) -> np.ndarray:
    """Labels of the sets of a, then b: the least index that links within the comparison reach."""
    num, den = share
    m = len(a)
    sizes_a = np.array([len(x) for x in a], np.int64)
    sizes_b = sizes_a if b is None else np.array([len(x) for x in b], np.int64)
    inter = overlaps(a, b).astype(np.int64)
    near = den * inter >= num * (sizes_a[:, None] + sizes_b[None, :] - inter)
    label = np.arange(m + (0 if b is None else len(b)))
    top = len(label)
    while True:
        rows, columns = (label, label) if b is None else (label[:m], label[m:])
        by_row = np.minimum(rows, np.where(near, columns[None, :], top).min(1, initial=top))
        by_column = np.minimum(columns, np.where(near, by_row[:, None], top).min(0, initial=top))
        new = np.minimum(by_row, by_column) if b is None else np.concatenate([by_row, by_column])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def likely(df: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """The rows of df whose key may be among ids, by a hash of 16 bits: no more than 65,536 numbers are broadcast."""
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(1 << 16))
    return df.join(F.broadcast(ids.select(bucket(name).alias("__bucket")).distinct()), bucket(key) == F.col("__bucket"), "left_semi")


UNIT = ["component", "low", "high", "tile", "node"]


def with_sizes(rows: DataFrame, by: str, name: str) -> DataFrame:
    """rows and the size of their group. Sizes are written, so that the join is one of two shuffles, of which adaptive
    execution splits the partition of a very large group."""
    sizes = materialize(rows.groupBy(by).agg(F.count("*").alias("size")), name)
    return rows.join(sizes.hint("merge"), by)


def tiled(groups: DataFrame, most: int) -> DataFrame:
    """Units of comparison of groups (component, node, size): tiles of about `most` nodes, and each pair of tiles of a group."""
    rows = groups.where("size > 1").withColumn("tiles", F.ceil(F.col("size") / most).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).select(*UNIT, (F.col("tiles") == 1).alias("alone"))


def stars(pairs: DataFrame, most: int) -> DataFrame:
    """Units of comparison of pairs (doc, leader): a leader with about `most` of its documents at a time."""
    tiles = F.ceil(F.col("size") / most).cast("int").alias("tiles")
    mine = with_sizes(pairs, "leader", "star-sizes").select("doc", "leader", tiles).withColumn("high", (F.pmod(F.xxhash64("doc"), F.col("tiles")) + 1).cast("int"))
    mine = mine.select(F.col("leader").alias("component"), F.lit(0).alias("low"), "high", F.col("high").alias("tile"), F.col("doc").alias("node"))
    lead = pairs.groupBy("leader").agg(F.count("*").alias("size")).select("leader", F.explode(F.sequence(F.lit(1), tiles)).alias("high"))
    lead = lead.select(F.col("leader").alias("component"), F.lit(0).alias("low"), "high", F.lit(0).alias("tile"), F.col("leader").alias("node"))
    return mine.unionByName(lead).withColumn("alone", F.lit(False))


class Comparison:
    """Comparisons of documents on their full sets."""

    def __init__(self, df: DataFrame, key: str, text: str, width: int, share: tuple[int, int]):
        self.texts = df.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text"))
        self.width, self.share, self.bins = width, share, parts_for(df, 4 << 20)

    def links(self, units: DataFrame, few: bool) -> DataFrame:
        """(node, root): a tree of links for each unit. few: most texts aren't in any unit, and stay where they are."""
        width, share = self.width, self.share
        packed = F.pmod(F.xxhash64("component"), F.lit(self.bins))
        unit = F.when(F.col("alone"), packed).otherwise(F.lit(self.bins) + F.pmod(F.xxhash64("component", "low", "high"), F.lit(1 << 40)))
        members = units.withColumn("unit", unit).groupBy("node").agg(F.collect_list(F.struct("unit", "component", "low", "high", "tile")).alias("at"))
        texts = likely(self.texts, "node", units, "node") if few else self.texts

        def sets_of(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    sets, sizes = shingle_sets(*raw(part.column(2)), width)
                    ends = np.cumsum(sizes)
                    values = pa.array([sets[e - n : e].tobytes() for n, e in zip(sizes.tolist(), ends.tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), values], ["node", "at", "shingles"])
            trim()

        # the ids grow with the corpus: one plan at every size, never a broadcast that a larger table has to give up
        placed = texts.join(members.hint("merge"), "node").select("node", "at", "text").mapInArrow(sets_of, "node long, at array<struct<unit: long, component: long, low: int, high: int, tile: int>>, shingles binary")
        placed = placed.select("node", "shingles", F.explode("at").alias("at")).select("at.*", "node", "shingles").where("octet_length(shingles) > 0")

        @trimmed
        def confirm(table: pa.Table) -> pa.Table:
            t = {n: table.column(n).to_numpy() for n in UNIT}
            sets = table.column("shingles")
            order = np.lexsort((t["node"], t["tile"], t["high"], t["low"], t["component"]))
            place = np.stack([t["component"][order], t["low"][order], t["high"][order]], 1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            nodes, roots = [], []
            for own in np.split(order, cuts):
                found = [np.frombuffer(sets[i].as_py(), np.uint64) for i in own.tolist()]
                left = int((t["tile"][own] == t["low"][own]).sum())
                apart = t["low"][own[0]] != t["high"][own[0]]
                if apart and not 0 < left < len(own):
                    continue
                label = link(found[:left], found[left:], share) if apart else link(found, None, share)
                moved = np.flatnonzero(label != np.arange(len(own)))
                nodes.append(t["node"][own[moved]])
                roots.append(t["node"][own[label[moved]]])
            return pa.table({"node": pa.array(np.concatenate(nodes) if nodes else [], pa.int64()), "root": pa.array(np.concatenate(roots) if roots else [], pa.int64())})

        return placed.groupBy("unit").applyInArrow(confirm, "node long, root long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row for each row of df: key, n_shingles, component_id (the least key reachable), kept.

    Two rows are linked where the intersection of their sets has share[0] / share[1] of the union or more.
    """
    string_columns(df, key, text)
    bounded_batches(df)
    num, den = share
    if not 0.5 <= num / den < 1 or width < 1:
        raise ValueError("a share from 0.5 to below 1 and a positive width are needed")
    rows = materialize(sketch(df, key, text, width), "sketch")
    classes = materialize(rows.where("n > 0 and doc is not null").groupBy("d0", "d1", "n").agg(F.min("doc").alias("doc"), F.first("sig").alias("sig")), "classes")
    bands = band_keys(classes, -(-num // (den - num)))
    leaders = bands.groupBy("band").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).where("leader < last").select("band", "leader")
    pairs = bands.join(leaders, "band").where("doc <> leader").select("doc", "leader").distinct()
    pairs = materialize(plausible(pairs, classes), "pairs")
    family = materialize(components(pairs, "doc", "leader"), "families")
    sized = with_sizes(family, "component", "sizes")
    small = sized.where(F.col("size") <= TILE)
    large = sized.where(F.col("size") > TILE).select("node")

    compare = Comparison(df, key, text, width, share)
    own = likely(pairs, "doc", large, "node").join(large.withColumnRenamed("node", "doc"), "doc", "left_semi")
    nearest = materialize(own.groupBy("doc").agg(F.max_by("leader", F.struct("near", -F.col("leader"))).alias("leader")), "nearest")
    first = materialize(compare.links(tiled(small, TILE).unionByName(stars(nearest, STAR)), False), "first-links")
    # of larger families, the bands that hold documents of several groups
    together = materialize(components(first, "node", "root"), "together")
    left = likely(bands, "doc", large, "node").join(large.withColumnRenamed("node", "doc"), "doc", "left_semi")
    left = left.join(together, F.col("doc") == F.col("node"), "left").select("band", "doc", F.coalesce("component", "doc").alias("group"))
    mixed = left.groupBy("band").agg(F.min("group").alias("__low"), F.max("group").alias("__high")).where("__low < __high").select("band")
    spread = materialize(left.join(mixed, "band").select(F.col("band").alias("component"), F.col("doc").alias("node")), "spread")
    found = together
    if not spread.isEmpty():
        second = compare.links(tiled(with_sizes(spread, "component", "sizes"), TILE), True)
        found = components(together.select("node", F.col("component").alias("root")).unionByName(second), "node", "root")
    of_class = classes.join(found, F.col("doc") == F.col("node"), "left").select("d0", "d1", "n", F.coalesce("component", "doc").alias("component_id"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    out = rows.join(materialize(of_class, "classes"), ["d0", "d1", "n"], "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), own).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """The rows of df without those that aren't the first of their group; rows without words and without a key stay."""
    gone = near_duplicates(df, key, text, width, share).where(~F.col("kept")).select(F.col(key).alias("__gone")).distinct()
    return df.join(gone.hint("merge"), F.col(key).cast("long") == F.col("__gone"), "left_anti")
