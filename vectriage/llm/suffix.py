"""Removal of passages that an earlier document has: every byte covered by a 50-byte string that also starts in a
document with a smaller doc_id goes.

A distributed form of bucket-pointer refinement. Sorting all suffixes of a corpus would move every byte many times, so
two exchanges first narrow the suffixes down to those that can matter, and the refinement runs on these alone:

1. Each 50-byte window has an anchor, the least hash of its 24-byte strings. Equal windows have equal anchors. A run of
   neighbouring windows with one anchor is a context (a string of 50 bytes or more). Blocks of documents send their
   distinct anchors to the part that the anchor names; the part answers with one bit for each: has another document it?
2. For those, blocks send the contexts themselves, distinct in a block, with the least doc_id. The part finds equal
   contexts by their bytes. Where an anchor has several contexts, it sorts their suffixes: initial 8-byte buckets are
   refined by sorting on the bucket pointers of later offsets (8, 16, then 18), each round using the pointers that the
   rounds before have updated, and leaving buckets of one suffix alone. A 50-byte bucket's least doc_id then says which
   windows go, one bit for each.
3. Blocks put the bits back on their documents.

Beyond DIRECT parts, messages go by way of ranges of parts, see `exchange`.

No hash decides a result: hashes only pick candidates. A very common passage reaches a part once from each block, not
once from each document.

Defined results: a null or empty text has no bytes and stays as it is; texts under 50 bytes are kept whole. Only a
smaller doc_id counts, so rows that repeat a doc_id don't affect each other, and repeats within a document stay.
A row with a null doc_id is kept whole and is no reason to remove anything. Computed columns replace input columns of
the same name; other columns are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ODD, U, binary_array, from_blocks, gather, materialize, mix, pack, part_of, parts_for, raw, spans_index, string_columns, to_blocks, trimmed, unpack

WINDOW = 50
GRAM = 24
#: Bytes of text that are hashed at a time; their arrays stay in a core's cache.
SLAB = 1 << 17
#: Compressed bytes of a block of documents; there are 96 blocks at least.
BLOCK_BYTES = 4 << 20


def gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each position on (of fewer at the end), by doubling."""
    n = len(b)
    h, width, out, done = b.astype(np.uint64) + U(1), 1, None, 0
    while True:
        if k & width:
            if out is None:
                out, done = h.copy(), width
            else:
                out *= U(pow(ODD, width, 1 << 64))
                out[: max(0, n - done)] += h[done:]
                done += width
        if 2 * width > k:
            return mix(out)
        longer = h * U(pow(ODD, width, 1 << 64))
        longer[: max(0, n - width)] += h[width:]
        h, width = longer, 2 * width


def sliding_min(h: np.ndarray, span: int) -> np.ndarray:
    m, width = h.copy(), 1
    while 2 * width <= span:
        m[: max(0, len(m) - width)] = np.minimum(m[: max(0, len(m) - width)], m[width:])
        width *= 2
    if (rest := span - width) > 0:
        m[: max(0, len(m) - rest)] = np.minimum(m[: max(0, len(m) - rest)], m[rest:])
    return m


def contexts(data: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Runs of windows with one anchor: key, document, first position, number of windows."""
    keys, docs, firsts, counts = [], [], [], []
    lengths = np.diff(offsets)
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLAB, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[to])
        if hi - lo >= window:
            least = sliding_min(gram_hashes(data[lo:hi], gram), window - gram + 1)
            n_windows = np.maximum(lengths[at:to] - window + 1, 0)
            pos = spans_index(offsets[at:to] - lo, n_windows)
            if len(pos):
                own = np.repeat(np.arange(at, to), n_windows)
                m = least[pos]
                new = np.ones(len(pos), bool)
                new[1:] = (m[1:] != m[:-1]) | (own[1:] != own[:-1])
                first = np.flatnonzero(new)
                keys.append(mix(m[first] ^ U(ODD)))
                docs.append(own[first])
                firsts.append(pos[first] + lo)
                counts.append(np.diff(np.append(first, len(pos))))
        at = to
    if not keys:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(firsts), np.concatenate(counts)


class Block:
    """The documents of one block, in a fixed order, and their contexts sorted by key."""

    def __init__(self, values: pa.ChunkedArray, key: str, text: str, window: int, gram: int):
        rows = from_blocks(values)
        ids = rows.column(key).combine_chunks()
        order = pc.sort_indices(pa.table({"k": ids, "t": rows.column(text)}), [("k", "ascending"), ("t", "ascending")])
        self.rows = rows.take(order)
        self.data, self.offsets = raw(self.rows.column(text))
        column = self.rows.column(key)
        self.known = np.asarray(column.is_valid().combine_chunks().to_numpy(zero_copy_only=False), bool) if len(column) else np.zeros(0, bool)
        self.ids = column.fill_null(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.zeros(0, np.int64)
        self.key, self.doc, self.first, self.count = contexts(self.data, self.offsets, window, gram)
        if not self.known.all():
            own = self.known[self.doc]
            self.key, self.doc, self.first, self.count = (x[own] for x in (self.key, self.doc, self.first, self.count))
        self.window = window
        by_key = np.argsort(self.key, kind="stable")  # the documents of a key stay in the order of their ids
        self.key, self.doc, self.first, self.count = (x[by_key] for x in (self.key, self.doc, self.first, self.count))

    def anchors(self):
        """Distinct keys; whether several documents of the block have them."""
        start, sizes = runs(self.key)
        return self.key[start], self.ids[self.doc[start]] != self.ids[self.doc[start + sizes - 1]], sizes

    def keep_shared(self, bits: dict[int, bytes], parts: int, spread: int) -> None:
        """Leave the contexts whose anchor another document has."""
        keys, _, repeats = self.anchors()
        shared = np.zeros(len(keys), bool)
        for p, (lo, hi) in slices(part_of(keys, parts) // spread).items():
            shared[lo:hi] = np.unpackbits(unpack(bits[p])[-1], count=hi - lo).astype(bool)
        own = np.repeat(shared, repeats)
        self.key, self.doc, self.first, self.count = (x[own] for x in (self.key, self.doc, self.first, self.count))

    def distinct(self):
        """Distinct contexts in the order of their keys: the context of each run, the run that stands for each context."""
        lengths = self.count + self.window - 1
        found = binary_array(gather(self.data, self.first, lengths), lengths).dictionary_encode()
        of_run = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(found.dictionary)
        head = np.full(n, len(of_run), np.int64)
        np.minimum.at(head, of_run, np.arange(len(of_run)))
        return of_run, head  # numbered as they come up, so in the order of keys; the head has the least doc_id


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal elements begins, and its size."""
    start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(a)))


def slices(part: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where each part's share of a sorted array begins and ends."""
    if not len(part):
        return {}
    start, sizes = runs(part)
    return {int(part[a]): (int(a), int(a + n)) for a, n in zip(start, sizes)}


def refine(bucket: np.ndarray, at: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket pointers of the suffixes at, after sorting each bucket on the pointers of the suffixes later.

    A pointer is the last place of its bucket among the sorted suffixes, so a bucket of one keeps its own.
    """
    out = np.full(len(bucket), -1, np.int64)
    order = np.lexsort((bucket[later], bucket[at]))
    b, l = bucket[at][order], bucket[later][order]
    if len(b):
        new = np.r_[True, (b[1:] != b[:-1]) | (l[1:] != l[:-1])]
        group = np.cumsum(new) - 1
        last = np.append(np.flatnonzero(new)[1:], len(b)) - 1
        out[at[order]] = last[group]
    return out


def window_buckets(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """For each window of each string, one string after another, a number that equal windows alone share."""
    q = 8
    at = spans_index(starts, np.maximum(lengths - q + 1, 0))
    padded = np.concatenate([data, np.zeros(q, np.uint8)])
    grams = np.lib.stride_tricks.sliding_window_view(padded, q)[at].copy().view(">u8").reshape(-1)
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    new = np.r_[True, s[1:] != s[:-1]]
    last = np.append(np.flatnonzero(new)[1:], len(s)) - 1
    bucket = np.full(len(data), -1, np.int64)
    bucket[at[order]] = last[np.cumsum(new) - 1]
    width = q
    while width < window:
        step = min(width, window - width)
        width += step
        at = spans_index(starts, np.maximum(lengths - width + 1, 0))
        # a suffix alone in its bucket is sorted already: only the others are sorted on
        size = np.bincount(bucket[at], minlength=1)
        many = size[bucket[at]] > 1
        refined = refine(bucket, at[many], at[many] + step)
        single = at[~many]
        offset = len(data) + 1
        nxt = np.full(len(bucket), -1, np.int64)
        nxt[at[many]] = refined[at[many]]
        nxt[single] = offset + np.arange(len(single))
        ids = nxt[at]
        # renumber, so that pointers stay below the number of suffixes
        _, nxt[at] = np.unique(ids, return_inverse=True) if width < window else (None, ids)
        bucket = nxt
    return bucket[spans_index(starts, np.maximum(lengths - window + 1, 0))]


#: Bytes of contexts that a part is worked through at a time.
SUB_BYTES = 2 << 20


def messages(rows: pa.Table) -> list[list[np.ndarray]]:
    """A message holds the entries of some blocks: the blocks, how many entries each has, then the entries' columns."""
    return [unpack(x.as_py()) for x in rows.column("blob")]


def five_bytes(keys: np.ndarray) -> np.ndarray:
    """Five bytes of each key, plane by plane."""
    return np.ascontiguousarray((keys >> U(16)).view(np.uint8).reshape(-1, 8)[:, :5].T).reshape(-1)


def answer_anchors(rows: pa.Table) -> list[tuple[int, bytes]]:
    """For each message: one bit for each of its anchors, set if several documents have it."""
    asked = messages(rows)
    sizes = [len(m[2]) // 5 for m in asked]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :5] = np.concatenate([m[2].reshape(5, -1).T for m in asked]) if asked else 0
    keys = wide.view("<u8").reshape(-1)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    shared = np.zeros(len(s), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    out, at = [], 0
    for group, n, (blocks, counts, _, flags) in zip(rows.column("group").to_pylist(), sizes, asked):
        own = shared[at : at + n] | flags.astype(bool)
        out.append((group, pack(blocks, counts, np.packbits(own))))
        at += n
    return out


def gone_windows(key: np.ndarray, doc: np.ndarray, lengths: np.ndarray, data: np.ndarray, window: int) -> np.ndarray:
    """For each window of each context, one after another: has a smaller doc_id the window?"""
    found = binary_array(data, lengths).dictionary_encode()
    of_entry = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own_data, offsets = raw(found.dictionary)
    own, n = np.diff(offsets), len(found.dictionary)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, of_entry, doc)
    key_of = np.zeros(n, np.uint64)
    key_of[of_entry] = key
    counts = own - window + 1
    ends = np.cumsum(counts)
    window_least = np.repeat(least, counts)
    _, inverse, times = np.unique(key_of, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[inverse] > 1)
    if len(several):
        buckets = window_buckets(own_data, offsets[:-1][several], own[several], window)
        at = spans_index((ends - counts)[several], counts[several])
        order = np.argsort(buckets, kind="stable")
        s = buckets[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        low = np.minimum.reduceat(window_least[at][order], first)
        window_least[at[order]] = np.repeat(low, np.diff(np.append(first, len(s))))
    return window_least[spans_index((ends - counts)[of_entry], counts[of_entry])] < np.repeat(doc, counts[of_entry])


def answer_contexts(rows: pa.Table, window: int) -> list[tuple[int, bytes]]:
    """For each message: one bit for each window of its contexts, set if a smaller doc_id has the window.

    The part is worked through by ranges of its key, of about SUB_BYTES of contexts each (more, if one key has more).
    """
    asked = messages(rows)
    key, doc, lengths, data = (np.concatenate([m[k] for m in asked]) for k in (2, 3, 4, 5))
    shape = [(m[0], np.add.reduceat(np.r_[m[4].astype(np.int64) - window + 1, 0], np.cumsum(m[1]) - m[1]) * (m[1] > 0)) for m in asked]
    del asked
    lengths = lengths.astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    counts = lengths - window + 1
    places = np.cumsum(counts) - counts
    gone = np.zeros(int(counts.sum()), bool)
    order = np.argsort(key, kind="stable")
    upto = np.cumsum(lengths[order])
    edges, _ = runs(key[order])
    edges = np.append(edges, len(order))
    at = 0
    while at < len(order):
        to = int(np.searchsorted(upto, upto[at] + SUB_BYTES))
        to = int(edges[np.searchsorted(edges, max(to, at + 1))])  # contexts with one key stay together
        own = order[at:to]
        gone[spans_index(places[own], counts[own])] = gone_windows(key[own], doc[own], lengths[own], gather(data, starts[own], lengths[own]), window)
        at = to
    out, at = [], 0
    for group, (blocks, own) in zip(rows.column("group").to_pylist(), shape):
        n = int(own.sum())
        out.append((group, pack(blocks, own, np.packbits(gone[at : at + n]))))
        at += n
    return out


def _replies(found: list[tuple[int, bytes]], part: int, turn: int) -> pa.Table:
    return pa.table({"group": pa.array([g for g, _ in found], pa.int32()), "part": pa.array([part] * len(found), pa.int32()), "turn": pa.array([turn] * len(found), pa.int32()), "blob": pa.array([x for _, x in found], pa.binary())})


# ---- the exchange between blocks and parts. Up to DIRECT parts, each block has a row for each part. Beyond, a row would
# hold next to nothing: blocks send to ranges of sqrt(parts) parts, where the rows of sqrt(blocks) blocks are put
# together for each part, and replies go back the same way. So rows grow with the power 1.5 of the input, not 2.

#: Parts beyond which rows go by way of ranges of parts.
DIRECT = 2048
ASKS, REPLIES = "part int, group int, blob binary", "group int, part int, turn int, blob binary"


def spread_over(parts: int, direct: int) -> int:
    """How many neighbouring parts (and blocks) are one range."""
    return 1 if parts <= direct else int(np.ceil(np.sqrt(parts)))


def merge_asks(rows: pa.Table, parts: int, wide: bool) -> list[tuple[int, list[np.ndarray]]]:
    """The entries of some blocks for one range of parts as (part, message): blocks in order, each one's entries by key."""
    asked = sorted(messages(rows), key=lambda m: int(m[0][0]))
    of = []
    for m in asked:
        if wide:
            of.append(part_of(m[2], parts))
        else:
            key = np.zeros((len(m[3]), 8), np.uint8)
            key[:, 2:7] = m[2].reshape(5, -1).T
            key[:, 7] = m[4]
            of.append(part_of(key.view("<u8").reshape(-1), parts))
    out = []
    for part in np.unique(np.concatenate(of)).tolist():
        cut = [(int(np.searchsorted(p, part)), int(np.searchsorted(p, part, "right"))) for p in of]
        some = [(m, a, b) for m, (a, b) in zip(asked, cut) if a < b]
        head = [np.array([m[0][0] for m, _, _ in some], np.int32), np.array([b - a for _, a, b in some], np.int64)]
        if wide:
            ends = [np.cumsum(m[4], dtype=np.int64) for m, _, _ in some]
            columns = [np.concatenate([m[k][a:b] for m, a, b in some]) for k in (2, 3, 4)]
            columns.append(np.concatenate([m[5][int(e[a - 1]) if a else 0 : int(e[b - 1])] for (m, a, b), e in zip(some, ends)]))
        else:
            columns = [np.concatenate([m[2].reshape(5, -1)[:, a:b] for m, a, b in some], axis=1).reshape(-1), np.concatenate([m[3][a:b] for m, a, b in some])]
        out.append((part, head + columns))
    return out


def split_replies(rows: pa.Table) -> list[tuple[int, bytes]]:
    """The replies of a range of parts to some blocks as (block, bits), each block's parts in order."""
    bits: dict[int, list[np.ndarray]] = {}
    for i in np.argsort(rows.column("part").to_numpy(), kind="stable").tolist():
        blocks, counts, packed = unpack(rows.column("blob")[i].as_py())
        found = np.unpackbits(packed, count=int(counts.sum()))
        for block, own in zip(blocks.tolist(), np.split(found, np.cumsum(counts)[:-1])):
            bits.setdefault(block, []).append(own)
    return [(b, pack(np.packbits(np.concatenate(x)))) for b, x in bits.items()]


def exchange(asks: DataFrame, answer, name: str, turn: int, parts: int, spread: int, wide: bool) -> DataFrame:
    """Replies (block, range, turn, blob) to asks (range, block, blob), written to the shared folder."""

    @trimmed
    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = merge_asks(table, parts, wide)
        return pa.table({"part": pa.array([p for p, _ in found], pa.int32()), "group": pa.array([key[1].as_py()] * len(found), pa.int32()), "blob": pa.array([pack(*m) for _, m in found], pa.binary())})

    @trimmed
    def decide(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _replies(answer(table), key[0].as_py(), turn)

    @trimmed
    def split(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _replies(split_replies(table), key[1].as_py(), turn)

    if spread > 1:
        asks = asks.groupBy("part", F.floor(F.col("group") / spread).cast("int").alias("__group")).applyInArrow(merge, ASKS)
    replies = asks.groupBy("part").applyInArrow(decide, REPLIES)
    if spread > 1:
        replies = replies.groupBy("group", F.floor(F.col("part") / spread).cast("int").alias("__range")).applyInArrow(split, REPLIES)
    return materialize(replies, name)


def remove_repeated(df: DataFrame, key: str = "doc_id", text: str = "text", kept: str = "kept", spans: str = "removed_spans", window: int = WINDOW, gram: int = GRAM, whole_characters: bool = False, block_bytes: int = BLOCK_BYTES, direct: int = DIRECT) -> DataFrame:
    """df and what is left of each text: kept (binary), n_bytes, n_removed, n_spans and removed_spans (start and end bytes).

    whole_characters: kept is a string, without the bytes of characters that lost some of theirs.
    """
    string_columns(df, key, text)
    if not 1 <= gram <= window or window < 8:
        raise ValueError("1 <= gram <= window and window >= 8 are needed")
    blocks = parts = parts_for(df, block_bytes)
    spread = spread_over(parts, direct)
    dealt = to_blocks(df, key, blocks)

    def rows_of(block: int, keys: np.ndarray, columns) -> pa.Table:
        """A row for each range of parts; columns gives the message's columns of a slice of the keys."""
        found = slices(part_of(keys, parts) // spread)
        blobs = [pack(np.array([block], np.int32), np.array([hi - lo], np.int64), *columns(lo, hi)) for lo, hi in found.values()]
        return pa.table({"part": pa.array(list(found), pa.int32()), "group": pa.array([block] * len(found), pa.int32()), "blob": pa.array(blobs, pa.binary())})

    @trimmed
    def ask_anchors(table: pa.Table) -> pa.Table:
        block = Block(table.column("rows"), key, text, window, gram)
        keys, several, _ = block.anchors()

        def columns(lo: int, hi: int) -> list[np.ndarray]:
            top = [(keys[lo:hi] >> U(56)).astype(np.uint8)] if spread > 1 else []  # without it, a key's part can't be told
            return [five_bytes(keys[lo:hi]), several[lo:hi].astype(np.uint8), *top]

        return rows_of(table.column("block")[0].as_py(), keys, columns)

    first = exchange(dealt.groupBy("block").applyInArrow(ask_anchors, ASKS), answer_anchors, "anchors", 1, parts, spread, False)

    def bits_of(answers: pa.Table, turn: int) -> dict[int, bytes]:
        own = answers.filter(pc.equal(answers.column("turn"), turn))
        return dict(zip(own.column("part").to_pylist(), own.column("blob").to_pylist()))

    @trimmed
    def ask_contexts(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "group": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        block = Block(table.column("rows"), key, text, window, gram)
        block.keep_shared(bits_of(answers, 1), parts, spread)
        _, head = block.distinct()

        def columns(lo: int, hi: int) -> list[np.ndarray]:
            own = head[lo:hi]
            lengths = block.count[own] + window - 1
            return [block.key[own], block.ids[block.doc[own]], lengths.astype(np.uint32), gather(block.data, block.first[own], lengths)]

        return rows_of(table.column("block")[0].as_py(), block.key[head], columns)

    asked = dealt.groupBy("block").cogroup(first.groupBy("group")).applyInArrow(ask_contexts, ASKS)
    second = exchange(asked, lambda table: answer_contexts(table, window), "windows", 2, parts, spread, True)

    computed = {kept: T.StringType() if whole_characters else T.BinaryType(), "n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), spans: T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))}
    schema = T.StructType([f for f in df.schema if f.name not in computed] + [T.StructField(n, k) for n, k in computed.items()])
    passed = [f.name for f in df.schema if f.name not in computed]

    @trimmed
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: [] for n in schema.names})
        block = Block(table.column("rows"), key, text, window, gram)
        block.keep_shared(bits_of(answers, 1), parts, spread)
        of_run, head = block.distinct()
        heads = block.count[head]
        gone = np.zeros(int(heads.sum()), bool)
        ends = np.cumsum(heads)
        bits = bits_of(answers, 2)
        for p, (lo, hi) in slices(part_of(block.key[head], parts) // spread).items():
            a, b = int(ends[lo] - heads[lo]), int(ends[hi - 1])
            gone[a:b] = np.unpackbits(unpack(bits[p])[-1], count=b - a).astype(bool)
        # a run behind the one that was asked about has that one's document before it
        behind = block.ids[block.doc] > block.ids[block.doc[head]][of_run]
        begins, stops, left = [], [], []
        n_removed, n_spans = (np.zeros(len(block.offsets) - 1, np.int64) for _ in range(2))
        by_doc = np.argsort(block.doc, kind="stable")
        docs = block.doc[by_doc]
        at = 0
        while at < len(n_spans):  # some documents at a time
            to = max(at + 1, int(np.searchsorted(block.offsets, block.offsets[at] + SUB_BYTES, "right")) - 1)
            lo, hi = int(block.offsets[at]), int(block.offsets[to])
            run = by_doc[np.searchsorted(docs, at) : np.searchsorted(docs, to)]
            count = block.count[run]
            windows = gone[spans_index((ends - heads)[of_run[run]], count)] | np.repeat(behind[run], count)
            where = spans_index(block.first[run] - lo, count)[windows]
            edge = np.zeros(hi - lo + 1, np.int32)
            edge[where] += 1  # each window is in one run
            edge[where + window] -= 1
            removed = np.cumsum(edge[:-1]) > 0
            own = block.offsets[at : to + 1] - lo
            first_of_doc = np.zeros(len(removed) + 1, bool)
            first_of_doc[own] = True
            begin = np.flatnonzero(removed & (~np.r_[False, removed[:-1]] | first_of_doc[:-1])) if len(removed) else np.zeros(0, np.int64)
            stop = np.flatnonzero(removed & (~np.r_[removed[1:], False] | first_of_doc[1:])) + 1 if len(removed) else begin
            owner = np.searchsorted(own, begin, "right") - 1
            n_spans[at:to] = np.bincount(owner, minlength=to - at)
            n_removed[at:to] = np.bincount(owner, stop - begin, minlength=to - at).astype(np.int64)
            begins.append(begin - own[owner])
            stops.append(stop - own[owner])
            left.append(block.data[lo:hi][~removed])
            at = to
        together = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        spans_offsets = np.concatenate([[0], np.cumsum(n_spans)]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(together(begins), pa.int64()), pa.array(together(stops), pa.int64())], ["start", "end"])
        columns = {x: block.rows.column(x) for x in passed}
        sizes = np.diff(block.offsets)
        rest = binary_array(together(left).astype(np.uint8, copy=False), sizes - n_removed)
        rest = pa.array([x.decode("utf-8", "ignore") for x in rest.to_pylist()], pa.string()) if whole_characters else rest.cast(pa.binary())
        columns |= {kept: rest, "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), spans: pa.ListArray.from_arrays(pa.array(spans_offsets), pairs)}
        return pa.table(columns)

    return dealt.groupBy("block").cogroup(first.unionByName(second).groupBy("group")).applyInArrow(remove, schema)
