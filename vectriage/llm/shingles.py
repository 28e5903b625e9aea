"""Word shingles as sets of 64-bit hashes, computed over the bytes of many texts at a time.

Words are maximal runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return, with A-Z
lower-cased. A document's set has its distinct runs of `width` words; with fewer words, the whole sequence as one; with
no words, nothing.
"""

from __future__ import annotations

import numpy as np

from .common import ODD, U, mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: list[np.ndarray] = []
#: Bytes that are hashed at a time.
SLAB = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLAB + 1)
        both = []
        for base in (ODD, pow(ODD, -1, 1 << 64)):
            p, done = np.ones(size, np.uint64), 1
            while done < size:
                step = min(done, size - done)
                p[done : done + step] = p[:step] * U(pow(base, done, 1 << 64))
                done += step
            both.append(p)
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, one document after another, and the number of words of each document."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + U(1)) * up[:n], out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * U(0xD1B54A32D192ED03))
    counts = np.searchsorted(s, offsets[1:]) - np.searchsorted(s, offsets[:-1])
    return h, counts


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of all documents, each sorted, one after another; the size of each."""
    sets, sizes, at = [], [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLAB, "right")) - 1)
        lo = offsets[at]
        found, n = _sets(data[lo : offsets[to]], offsets[at : to + 1] - lo, width)
        sets.append(found)
        sizes.append(n)
        at = to
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    h, counts = words(data, offsets)
    n = len(counts)
    first = np.cumsum(counts) - counts
    many = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begin = np.cumsum(many) - many
    owner = np.repeat(np.arange(n), many)
    at = first[owner] + np.arange(len(owner)) - begin[owner]
    length = np.minimum(counts, width)[owner]
    out = length.astype(np.uint64) * U(0xA0761D6478BD642F)
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    for k in range(width):
        out = np.where(k < length, mix(out * U(ODD) + padded[at + k]), out)
    for b, m in zip(begin.tolist(), many.tolist()):
        out[b : b + m].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.bincount(owner[new], minlength=n)


def digests(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """128 bits for each set, as rows of two numbers; sets of one size and digest count as equal."""
    if not len(sets):
        return np.zeros((len(sizes), 2), np.uint64)
    out = np.zeros((len(sizes), 2), np.uint64)
    some = sizes > 0
    begin = (np.cumsum(sizes) - sizes)[some]
    for i, salt in enumerate((0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)):
        out[some, i] = mix(np.add.reduceat(mix(sets ^ U(salt)), begin) + sizes[some].astype(np.uint64))
    return out


# ---- HyperMinHash registers

MANTISSA = 10


def registers(sets: np.ndarray, sizes: np.ndarray, buckets: int) -> np.ndarray:
    """One row of 16-bit registers for each set: of the least hash in a bucket the leading zeros (and one more) and the
    bits after the leading one; 0 for an empty bucket. buckets is a power of two."""
    bits = buckets.bit_length() - 1
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bucket = (sets >> U(64 - bits)).astype(np.int64)
    cell = owner * buckets + bucket
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    x = sets[first] << U(bits)
    length = np.frexp((x >> U(11)).astype(np.float64))[1].astype(np.uint64)
    zeros = U(53) - length
    mantissa = np.where(zeros < U(53), (x << np.minimum(zeros + U(1), U(63))) >> U(64 - MANTISSA), U(0))
    out = np.zeros(len(sizes) * buckets, np.uint16)
    out[cell[first]] = ((zeros + U(1)) << U(MANTISSA) | mantissa).astype(np.uint16)
    return out.reshape(len(sizes), buckets)


def chance(n: np.ndarray, m: np.ndarray, buckets: int) -> np.ndarray:
    """How likely registers of unrelated sets of n and m elements agree: leading zeros alike, times mantissas alike."""
    total = np.zeros(len(n))
    for j in range(40):
        lo, hi = 0.5 ** (j + 1), 0.5**j
        p = [np.exp(-s / buckets * lo) - np.exp(-s / buckets * hi) for s in (n, m)]
        total += p[0] * p[1]
    return total * 0.5**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of pairs of rows of registers, corrected for chance; the number of registers it rests on."""
    used = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    c = chance(n.astype(float), m.astype(float), a.shape[1])
    return np.clip((same / np.maximum(used, 1) - c) / (1 - c), 0, 1), used
