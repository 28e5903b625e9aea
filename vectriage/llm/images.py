"""Copies among images, cropped or edited, by local descriptors.

At two scales, corners are the strongest Harris responses within RADIUS pixels. Around each, 128 binary tests compare
smoothed pixels at a fixed pattern of places, turned to one of 16 orientations by the patch's centroid. Each descriptor is
entered in four tables by 32 of its bits, so descriptors that differ in up to three bits meet in one at least. Within a
table's bucket, all distinct descriptors are compared in tiles, equal ones once for all their corners, and corners up to
NEAR bits apart vote for the change of scale, turn and shift that they imply. Images that have the same corners at the same
places (the same face, a 64-bit hash) are one in this, and linked with each other by it. The shift is that
between one corner and where the other lies when it is resized and turned; what lies in one square of SHIFT pixels agrees.
Orientations are 16, so copies turned by a multiple of 90 degrees have one shift, and others only as far as their corners
are near each other. Images are linked if VOTES corners agree on one change, and a SHARE of the corners of the poorer one
(where that has fewer than VOTES: all of them, two at least); links' connected components are the groups of copies. The
corners that an image's frame makes are in n_points, but neither vote nor count for this: they tell nothing of what it
shows, and images that have nothing in common share them. An image without others has only equal images as copies.

All arithmetic on pixels is whole numbers, so an image's descriptors don't depend on the images beside it. The exchange has
one row for each map batch and part, not for each descriptor. Equal images cost nothing. Images that are copies of one
are found in a first round, where each corner votes with two others that have its descriptor: what that links is linked.
The second round compares all pairs of corners of images that aren't together yet, so no link between groups is lost; a
patch that many images share that are no copies of each other costs a vote for each two of them.

Images are grey PGM (binary, P5). Defined results: null, empty and undecodable images have no corners and are groups of
their own, as are images without contrast. Rows with a null key take part in nothing; their component is null. Rows that
repeat a key are one image for links, which has the links of each of them. An empty table gives no rows. Other columns aren't passed on: join by the key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ODD, U, bounded_batches, materialize, mix, pack, part_of, parts_for, spans_index, string_columns, trim, unpack
from .components import components

RADIUS, PAD, TURNS, TESTS = 10, 10, 16, 128
NEAR, VOTES, SHARE, SHIFT = 16, 6, 0.1, 8
#: Pixels from a border, at a corner's scale, within which its strength depends on what lies beyond the image: one each of
#: the smoothing, the gradient and the sums. From two borders, pixels within which a corner is that of the image's frame.
EDGE, FRAME = 3, 4
#: Pixels that are described at a time; their arrays stay in a core's cache.
PIXELS = 1 << 16
#: Pairs that are held at a time.
TILE = 1 << 19
_HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+(\d+)\s")


def _pattern() -> np.ndarray:
    """[TURNS, 2 * TESTS, 2] places (y, x), drawn once from a seed and turned."""
    places = np.clip(np.random.default_rng(20).normal(0, 3, (2 * TESTS, 2)), -6, 6)
    out = []
    for k in range(TURNS):
        a = 2 * np.pi * k / TURNS
        y, x = places[:, 0], places[:, 1]
        out.append(np.stack([np.rint(y * np.cos(a) + x * np.sin(a)), np.rint(x * np.cos(a) - y * np.sin(a))], 1))
    return np.array(out, np.int64)


PATTERN = _pattern()
SINES, COSINES = (np.round(f(2 * np.pi * np.arange(TURNS) / TURNS), 12) for f in (np.sin, np.cos))


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    found = _HEADER.match(data or b"")
    if not found or int(found[3]) > 255:
        return None
    width, height = int(found[1]), int(found[2])
    body = np.frombuffer(data, np.uint8, offset=found.end())
    return body[: width * height].reshape(height, width) if width and height and len(body) >= width * height else None


def text_as_image(text: Column, width: int = 64) -> Column:
    """A PGM of a text's bytes, one pixel each, in rows of `width`, filled up with zeros."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    rows = F.greatest(F.ceil(F.octet_length(data) / width), F.lit(1))
    header = F.concat(F.lit(f"P5\n{width} "), rows.cast("string"), F.lit("\n255\n")).cast("binary")
    zeros = F.unhex(F.repeat(F.lit("00"), (rows * width - F.octet_length(data)).cast("int")))
    return F.concat(header, data, zeros)


def _box(a: np.ndarray) -> np.ndarray:
    """Sums over squares of 3; the outermost lines stay as they are, and margins are wide enough for that."""
    out = a.copy()
    out[1:-1] += a[:-2]
    out[1:-1] += a[2:]
    a = out.copy()
    a[:, 1:-1] += out[:, :-2]
    a[:, 1:-1] += out[:, 2:]
    return a


def _near_peak(a: np.ndarray, r: int) -> np.ndarray:
    """Maxima over squares of 2 r + 1, in an array that is smaller by r on each side."""
    want = 2 * r + 1
    for axis in (0, 1):
        span = 1
        while span < want:
            step = min(span, want - span)
            lead, lag = [slice(None)] * 2, [slice(None)] * 2
            lead[axis], lag[axis] = slice(step, None), slice(None, -step)
            a = np.maximum(a[tuple(lag)], a[tuple(lead)])
            span += step
    return a


def _peaks(a: np.ndarray, r: int, near: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Where a is positive and greatest in its square of 2 r + 1: peaks of a small square first, and of these the ones that
    nothing in the large one exceeds. Margins of r around a hold no positive values."""
    inner = a[near:-near, near:-near]
    y, x = np.nonzero((inner > 0) & (inner == _near_peak(a, near)))
    y, x = y + near, x + near
    line, flat = a.shape[1], a.reshape(-1)
    reach = np.arange(-r, r + 1)
    keep = np.zeros(len(y), bool)
    for at in range(0, len(y), 4096):
        place = (y[at : at + 4096] * line + x[at : at + 4096])[:, None]
        some = np.arange(len(place))
        for dy in sorted(reach, key=abs):  # the nearest lines decide most
            values = flat[np.clip(place[some] + (dy * line + reach)[None, :], 0, len(flat) - 1)]
            some = some[values.max(1) <= flat[place[some, 0]]]
        keep[at + some] = True
    return y[keep], x[keep]


def describe(images: list[np.ndarray | None]):
    """Corners of all images: owner, scale, turn, y, x (in pixels of the image) and 128-bit descriptors as two numbers."""
    parts = []
    widths: dict[int, list[int]] = {}
    for i, im in enumerate(images):
        if im is not None:
            widths.setdefault(im.shape[1], []).append(i)
    for width, own in widths.items():
        at = 0
        while at < len(own):
            to, size = at, 0
            while to < len(own) and (to == at or size + images[own[to]].size < PIXELS):
                size += images[own[to]].size
                to += 1
            parts.append(_describe([images[i] for i in own[at:to]], np.array(own[at:to]), width))
            at = to
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros((0, 2), np.uint64),)
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(6))


def _describe(images, names, width):
    heights = np.array([len(im) for im in images])
    room = -(-(heights + 2 * PAD) // 2) * 2 + 2 * PAD
    start = np.cumsum(room) - room + 2 * PAD
    tall = np.zeros((int(room.sum()) + 2 * PAD, -(-(width + 4 * PAD) // 2) * 2), np.int32)
    owner = np.full(len(tall), -1)
    for k, im in enumerate(images):
        tall[start[k] : start[k] + len(im), 2 * PAD : 2 * PAD + width] = im
        owner[start[k] : start[k] + len(im)] = k
    inside = np.zeros(tall.shape, bool)
    inside[owner >= 0, 2 * PAD : 2 * PAD + width] = True
    out = []
    for scale in (1, 2):
        if scale == 2:
            tall = tall[: len(tall) // 2 * 2]
            tall = (tall[::2, ::2] + tall[1::2, ::2] + tall[::2, 1::2] + tall[1::2, 1::2]) >> 2
            inside = inside[: len(tall) * 2 : 2, ::2]
            owner = owner[: len(tall) * 2 : 2]
        smooth = _box(tall)
        gx, gy = np.zeros_like(smooth), np.zeros_like(smooth)
        np.subtract(smooth[:, 2:], smooth[:, :-2], out=gx[:, 1:-1])
        np.subtract(smooth[2:], smooth[:-2], out=gy[1:-1])
        xx, yy, xy = (_box(a * b).astype(np.float64) for a, b in ((gx, gx), (gy, gy), (gx, gy)))
        strength = xx * yy
        strength -= xy * xy
        xx += yy
        xx *= xx
        xx *= 0.05
        strength -= xx
        strength *= inside
        y, x = _peaks(strength, RADIUS)
        flat, line = smooth.reshape(-1), smooth.shape[1]
        place = y * line + x
        offsets = np.arange(-7, 8)
        dy, dx = np.repeat(offsets, 15), np.tile(offsets, 15)
        turn = np.zeros(len(place), np.int64)
        bits = np.zeros((len(place), 2), np.uint64)
        for a in range(0, len(place), 8192):
            own = place[a : a + 8192]
            patch = flat[own[:, None] + (dy * line + dx)[None, :]].astype(np.int64)
            angle = np.arctan2(patch @ dy, patch @ dx)
            t = np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS
            turn[a : a + 8192] = t
            step = (PATTERN[:, :, 0] * line + PATTERN[:, :, 1])[t]
            values = flat[own[:, None] + step]
            bits[a : a + 8192] = np.packbits(values[:, :TESTS] < values[:, TESTS:], axis=1).view(">u8")
        k = owner[y]
        out.append((names[k], np.full(len(k), scale), turn, y * scale - start[k], (x - 2 * PAD // scale) * scale, bits))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(6))


def face(owner, scale, turn, y, x, d, n: int) -> np.ndarray:
    """A 64-bit hash of all the corners of each image, in any order; images that have the same corners share it."""
    h = mix(d[:, 0]) + mix(d[:, 1] ^ U(ODD))
    for a in (scale, turn, y, x):
        h = mix(h + a.astype(np.int64).view(U))
    out = np.zeros(n, U)
    np.add.at(out, owner, h)
    return mix(out).view(np.int64)


def of_frame(images: list[np.ndarray | None], owner, scale, y, x) -> np.ndarray:
    """Where corners are made by the image's frame, not by what it shows: images that have nothing in common share them."""
    height, width = np.array([im.shape if im is not None else (0, 0) for im in images]).reshape(-1, 2)[owner].T
    within = lambda n, at, size: (at < n * scale) | (at >= size - n * scale)
    return within(EDGE, y, height) | within(EDGE, x, width) | (within(FRAME, y, height) & within(FRAME, x, width))


def _pairs(start: np.ndarray, d: np.ndarray):
    """Tiles (u, v) of all pairs u < v within buckets that are up to NEAR bits apart; start is each descriptor's bucket."""
    n = len(d)
    end = np.searchsorted(start, start, "right")
    small = end - start <= 64
    left = np.where(small, end - np.arange(n) - 1, 0)
    sums = np.cumsum(left)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + TILE, "right")))
        u, v = np.repeat(np.arange(at, to), left[at:to]), spans_index(np.arange(at, to) + 1, left[at:to])
        ok = np.bitwise_count(d[u] ^ d[v]).sum(1) <= NEAR
        yield u[ok], v[ok]
        at = to
    for lo in np.flatnonzero(~small & (start == np.arange(n))).tolist():
        hi = int(end[lo])
        step = max(1, TILE // (hi - lo))
        for at in range(lo, hi, step):
            own = d[at : min(at + step, hi)]
            apart = np.bitwise_count(own[:, None, 0] ^ d[None, at:hi, 0]) + np.bitwise_count(own[:, None, 1] ^ d[None, at:hi, 1])
            u, v = np.nonzero(apart <= NEAR)
            yield u[u < v] + at, v[u < v] + at


def _spans(i: np.ndarray, start: np.ndarray, length: np.ndarray):
    """Tiles (i, j) with j in [start, start + length) of each i."""
    sums = np.cumsum(length)
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + TILE, "right")))
        yield np.repeat(i[at:to], length[at:to]), spans_index(start[at:to], length[at:to])
        at = to


def summed(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of all columns but the last, sorted, with the last one's sums."""
    *by, times = columns
    order = np.lexsort(by[::-1])
    by, times = [c[order] for c in by], times[order]
    if not len(times):
        return (*by, times)
    cut = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in by], axis=0)])
    return (*(c[cut] for c in by), np.add.reduceat(times, cut))


def _corners(doc, scale, turn, y, x, d, *first: np.ndarray, last: tuple = ()):
    """The order of distinct corners: by first, descriptor, last and document."""
    order = np.lexsort((turn, scale, x, y, doc, *last, d[:, 1], d[:, 0], *first))
    columns = [a[order] for a in (*first, d[:, 0], d[:, 1], doc, scale, turn, y, x)]
    return order[np.r_[True, np.any([a[1:] != a[:-1] for a in columns], axis=0)]] if len(order) else order


def _votes(i: np.ndarray, j: np.ndarray, doc, scale, turn, y, x):
    """(doc, other, change, how many) of pairs of corners, the greater document first."""
    swap = doc[i] < doc[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    return summed(doc[a], doc[b], change_of(scale[a], turn[a], y[a], x[a], scale[b], turn[b], y[b], x[b]), np.ones(len(a), np.int64))


def matches(key: np.ndarray, doc: np.ndarray, scale: np.ndarray, turn: np.ndarray, y: np.ndarray, x: np.ndarray, d: np.ndarray, chunk: np.ndarray, group: np.ndarray | None = None):
    """Tiles of votes (doc, other, change, how many) of all pairs of corners within the buckets of one part, but for those
    of documents that are in one group already (without groups: of one document)."""
    group = doc if group is None else group
    order = _corners(doc, scale, turn, y, x, d, key, last=(group,))
    key, doc, scale, turn, y, x, d, chunk, group = (a[order] for a in (key, doc, scale, turn, y, x, d, chunk, group))
    if not len(key):
        return
    new = np.r_[True, (key[1:] != key[:-1]) | (d[1:] != d[:-1]).any(1)]
    head = np.flatnonzero(new)  # the first corner of each distinct descriptor
    size = np.diff(np.r_[head, len(key)])

    def voted(i: np.ndarray, j: np.ndarray):
        i, j = i[group[i] != group[j]], j[group[i] != group[j]]
        # the tables compare all pairs of a bucket: a pair that meets in several counts in the first
        halves = (d[i] ^ d[j]).view(np.uint32).reshape(-1, 2, 2)[:, :, ::-1].reshape(-1, 4) == 0
        first = np.argmax(halves, axis=1) == chunk[i]
        return _votes(i[first], j[first], doc, scale, turn, y, x)

    ends = np.repeat(head + size, size)
    every = np.arange(len(key))
    mine = np.flatnonzero(new | np.r_[True, group[1:] != group[:-1]])  # of a descriptor, the corners of one group
    past = np.repeat(np.r_[mine[1:], len(key)], np.diff(np.r_[mine, len(key)]))
    for i, j in _spans(every, past, ends - past):
        yield voted(i, j)
    least, most = np.minimum.reduceat(group, head), np.maximum.reduceat(group, head)
    for u, v in _pairs(np.searchsorted(key[head], key[head]), d[head]):
        apart = (np.minimum(least[u], least[v]) != np.maximum(most[u], most[v])) if len(u) else np.zeros(0, bool)
        u, v = u[apart], v[apart]
        if len(u):
            i = spans_index(head[u], size[u])
            for tile in _spans(i, np.repeat(head[v], size[u]), np.repeat(size[v], size[u])):
                yield voted(*tile)


def leads(doc: np.ndarray, scale: np.ndarray, turn: np.ndarray, y: np.ndarray, x: np.ndarray, d: np.ndarray):
    """Some of the votes of equal descriptors: of each corner with the first document's, and with the one before it."""
    order = _corners(doc, scale, turn, y, x, d)
    doc, scale, turn, y, x, d = (a[order] for a in (doc, scale, turn, y, x, d))
    if not len(doc):
        return _votes(order, order, doc, scale, turn, y, x)
    new = np.r_[True, (d[1:] != d[:-1]).any(1)]
    head = np.flatnonzero(new)
    first = np.repeat(head, np.diff(np.r_[head, len(doc)]))
    every = np.arange(len(doc))
    chained = ~new & (every - 1 != first)
    i, j = np.concatenate([every[~new], every[chained]]), np.concatenate([first[~new], every[chained] - 1])
    other = doc[i] != doc[j]
    return _votes(i[other], j[other], doc, scale, turn, y, x)


def change_of(scale_a, turn_a, y_a, x_a, scale_b, turn_b, y_b, x_b) -> np.ndarray:
    """A change of scale, turn and shift as one number: one corner lies at the shift from the other, resized and turned."""
    kind = (scale_a - scale_b + 1) * TURNS + (turn_a - turn_b) % TURNS
    swap = scale_a < scale_b  # the shift is in pixels of the larger image, whichever has the greater id
    (turn_a, turn_b), (y_a, y_b), (x_a, x_b) = ((np.where(swap, b, a), np.where(swap, a, b)) for a, b in ((turn_a, turn_b), (y_a, y_b), (x_a, x_b)))
    turn = (turn_a - turn_b) % TURNS
    size = 1 + np.abs(scale_a - scale_b)
    y = y_a - size * (x_b * SINES[turn] + y_b * COSINES[turn])
    x = x_a - size * (x_b * COSINES[turn] - y_b * SINES[turn])
    y, x = (np.floor(v / (SHIFT // 2)).astype(np.int64) + (1 << 19) & 0xFFFFF for v in (y, x))
    return kind << 40 | y << 20 | x


def match(key: np.ndarray, doc: np.ndarray, scale: np.ndarray, turn: np.ndarray, y: np.ndarray, x: np.ndarray, d: np.ndarray, chunk: np.ndarray, group: np.ndarray | None = None):
    """All the votes of one part."""
    tiles = list(matches(key, doc, scale, turn, y, x, d, chunk, group))
    return np.column_stack(summed(*(np.concatenate([t[k] for t in tiles]) for k in range(4)))) if tiles else np.zeros((0, 4), np.int64)


def agreement(doc: np.ndarray, other: np.ndarray, change: np.ndarray, times: np.ndarray):
    """(doc, other, votes) of the pairs that have two votes or more for one change: the most votes for one."""
    doc, other, change, times = summed(doc, other, change, times)
    pair = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])][: len(doc)]) - 1
    keep = np.bincount(pair, times)[pair] >= 2
    doc, other, change, times = (a[keep] for a in (doc, other, change, times))
    # a change is the bins of SHIFT / 2 pixels that a square of SHIFT covers, wherever it begins
    near = np.concatenate([change + s for s in (0, 1, 1 << 20, 1 << 20 | 1)])
    doc, other, change, times = summed(np.tile(doc, 4), np.tile(other, 4), near, np.tile(times, 4))
    keep = times >= 2
    doc, other, times = doc[keep], other[keep], times[keep]
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])][: len(doc)])
    return doc[cut], other[cut], np.maximum.reduceat(times, cut) if len(cut) else times


#: A corner as it is written: scale, turn, place and descriptor.
CORNER = np.dtype([("scale", "u1"), ("turn", "u1"), ("y", "<i4"), ("x", "<i4"), ("d0", "<u8"), ("d1", "<u8")])


def find_copies(df: DataFrame, key: str, image: str, count_links: bool = False) -> DataFrame:
    """(key, n_points, component_id, kept): component_id is the least key reachable, kept its own row.

    Two rounds: in the first, corners with equal descriptors vote with few others only, and the images that this links
    already are put together; in the second, all pairs of corners vote whose images aren't together yet. count_links:
    all pairs vote, and n_links counts an image's links with all others.
    """
    string_columns(df, key, image)
    bounded_batches(df)
    parts = parts_for(df, 2 << 20)
    pair_parts = 4 * parts

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                images = [decode_pgm(v) for v in rows.column(1).to_pylist()]
                n = len(images)
                owner, scale, turn, y, x, d = describe(images)
                inner = ~of_frame(images, owner, scale, y, x)
                faces = face(owner, scale, turn, y, x, d, n)
                points, own = (np.bincount(o, minlength=n)[:n] for o in (owner, owner[inner]))
                order = np.flatnonzero(inner)[np.argsort(owner[inner], kind="stable")]
                out = np.empty(len(order), CORNER)
                for name, a in (("scale", scale), ("turn", turn), ("y", y), ("x", x), ("d0", d[:, 0]), ("d1", d[:, 1])):
                    out[name] = a[order]
                ends = np.cumsum(own)
                blobs = [out[e - k : e].tobytes() for e, k in zip(ends.tolist(), own.tolist())]
                yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array(faces), pa.array(points, pa.int64()), pa.array(own, pa.int64()), pa.array(blobs, pa.binary())], ["doc", "face", "points", "inner", "corners"])
        trim()

    rows = materialize(df.select(F.col(key).cast("long"), image).mapInArrow(run, "doc long, face long, points long, inner long, corners binary"), "corners")
    images = rows.where("doc is not null and points >= 2").select("doc", "face", "inner").distinct()
    faces = materialize(images.groupBy("face").agg(F.max("inner").alias("points"), F.min("doc").alias("first"), F.count("*").alias("n")), "faces")
    least = F.least("points", "others")
    needed = F.greatest(F.lit(2), F.least(least, F.greatest(F.lit(VOTES), F.ceil(least * SHARE))))
    theirs = faces.select(F.col("face").alias("other"), F.col("points").alias("others"), F.col("first").alias("other_first"), F.col("n").alias("other_n"))

    def dealt(part: np.ndarray, columns) -> pa.RecordBatch:
        """Rows that hold the columns' elements by part; part is sorted."""
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        blobs = [pack(*(c[a:b] for c in columns)) for a, b in zip(cut, np.append(cut[1:], len(part)))]
        return pa.RecordBatch.from_arrays([pa.array(part[cut], pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def by_pair(tiles) -> pa.RecordBatch:
        doc, other, change, times = summed(*(np.concatenate([t[k] for t in tiles]) for k in range(4)))
        part = part_of(mix(mix(doc.view(np.uint64)) + other.view(np.uint64)), pair_parts)
        order = np.argsort(part, kind="stable")
        return dealt(part[order], [a[order] for a in (doc, other, change, times.astype(np.int32))])

    def gathered(batches, most: int = 4096):
        """(faces, groups, corners) of some images at a time: each corner with its image's place."""
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                some = batch.slice(at, most)
                blobs = some.column("corners").to_pylist()
                out = np.frombuffer(b"".join(blobs), CORNER)
                if len(out):
                    owner = np.repeat(np.arange(len(blobs)), [len(b) // CORNER.itemsize for b in blobs])
                    yield some.column("face").to_numpy()[owner], some.column("group").to_numpy()[owner], out

    def once(batches):
        """Corners by descriptor."""
        for faces_, _, c in gathered(batches):
            part = part_of(mix(mix(c["d0"]) + c["d1"]), parts)
            i = np.argsort(part, kind="stable")
            yield dealt(part[i], [faces_[i], *(c[n][i] for n in CORNER.names)])
        trim()

    def four_times(batches):
        """Corners by each quarter of their descriptor."""
        for faces_, groups, c in gathered(batches):
            low = U(0xFFFFFFFF)
            chunks = np.stack([c["d0"] >> U(32), c["d0"] & low, c["d1"] >> U(32), c["d1"] & low], 1)
            part = part_of(mix(chunks + (np.arange(4, dtype=np.uint64) << U(32))), parts)
            i, table = np.divmod(np.argsort(part.reshape(-1), kind="stable"), 4)
            together = (faces_ ^ groups)[i]  # most images are alone, and zeros take no room
            yield dealt(part[i, table], [table.astype(np.uint8), faces_[i], together, *(c[n][i] for n in CORNER.names)])
        trim()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
        found = [unpack(blob) for batch in batches for blob in batch.column("blob").to_pylist()]
        return [np.concatenate([f[k] for f in found]) for k in range(len(found[0]))] if found else None

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = unpacked(batches)
        if found:
            doc, scale, turn, y, x, d0, d1 = found
            votes = leads(doc, *(a.astype(np.int64) for a in (scale, turn, y, x)), np.stack([d0, d1], 1))
            if len(votes[0]):
                yield by_pair([votes])
        trim()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = unpacked(batches)
        if found:
            chunk, doc, together, scale, turn, y, x, d0, d1 = found
            del found
            d = np.stack([d0, d1], 1)
            c = chunk.astype(np.int64)
            half = d[np.arange(len(c)), c // 2]
            value = np.where(c % 2 == 0, half >> U(32), half & U(0xFFFFFFFF))
            some, size = [], 0
            tiles = matches(mix(value + (c.astype(np.uint64) << U(32))), doc, *(a.astype(np.int64) for a in (scale, turn, y, x)), d, c, doc ^ together)
            for tile in tiles:
                some.append(tile)
                size += len(tile[0])
                if size > 4 * TILE:
                    yield by_pair(some)
                    some, size = [], 0
            if size:
                yield by_pair(some)
        trim()

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = unpacked(batches)
        if found:
            doc, other, change, times = found
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in agreement(doc, other, change, times.astype(np.int64))], ["face", "other", "votes"])
        trim()

    def linked(corners: DataFrame, deal, votes, name: str) -> DataFrame:
        """Pairs of faces that enough corners agree on."""
        exchanged = corners.mapInArrow(deal, "part int, blob binary").groupBy("part").applyInArrow(votes, "part int, blob binary")
        agreed = exchanged.groupBy("part").applyInArrow(agree, "face long, other long, votes long")
        found = agreed.join(faces, "face").join(theirs, "other").where(F.col("votes") >= needed)
        return materialize(found.select("face", "other", "first", "other_first", "n", "other_n"), name)

    corners = rows.where("doc is not null and inner > 0").select("face", "corners")
    if count_links:
        links = linked(corners.withColumn("group", F.col("face")), four_times, vote, "links")
    else:
        leading = linked(corners.withColumn("group", F.col("face")), once, lead, "leading")
        together = materialize(components(leading, "face", "other"), "together")
        # the table of groups grows with the corpus: one plan at every size, never a broadcast
        grouped = corners.join(together.hint("merge"), F.col("face") == F.col("node"), "left").select("face", F.coalesce("component", "face").alias("group"), "corners")
        links = leading.unionByName(linked(grouped, four_times, vote, "links"))
    mine = images.join(faces.select("face", "first"), "face")
    stars = mine.where(F.col("doc") != F.col("first")).select("doc", F.col("first").alias("other"))
    edges = materialize(links.where(F.col("first") != F.col("other_first")).select(F.col("first").alias("doc"), F.col("other_first").alias("other")).unionByName(stars), "edges")
    groups = components(edges, "doc", "other")
    out = rows.select("doc", "points").join(groups, F.col("doc") == F.col("node"), "left").select("doc", F.col("points").alias("n_points"), F.coalesce("component", "doc").alias("component_id"))
    if count_links:
        # an image's links: the others of its face, and all images of the faces that its face is linked with
        both = links.select("face", F.col("other_n").alias("m")).unionByName(links.select(F.col("other").alias("face"), F.col("n").alias("m")))
        both = both.unionByName(faces.select("face", (F.col("n") - 1).alias("m"))).groupBy("face").agg(F.sum("m").alias("m"))
        degree = images.join(both, "face").groupBy("doc").agg(F.sum("m").cast("long").alias("n_links"))
        out = out.join(degree.withColumnRenamed("doc", "__of"), F.col("doc") == F.col("__of"), "left")
        out = out.select("doc", "n_points", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True))).withColumnRenamed("doc", key)
