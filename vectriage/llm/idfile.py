"""Token ids in files: an adaptive context-mixing range coder.

A file is a row of segments, and a segment has models that its header holds: how often each id comes up (order 0), and
how often it follows each other id (order 1), where saying so costs less than it saves. Its ids are in blocks of BLOCK,
which all start from these models and adapt on their own. In a block, slots for the two ids before (order 2) and the one
before (order 1) remember which id came next, and how far that is trusted. For each id,

1. logistic mixing of order 2, order 1 and order 0 gives the probability that the more trusted slot is right. Weights,
   and how often a slot of a trust is right, learn as the block goes on;
2. an id that isn't the slot's is coded by order 1, or else, after an escape, by order 0.

All of it is integer arithmetic, so decoding repeats it exactly. Probabilities drive a range coder with 48-bit registers
that moves 16-bit words; carries stay in the words until a block ends. Many blocks are coded in step, one array element
each. Each block has a CRC-32 of its ids, so a damaged block is found and the others stay readable.

A segment: magic, header, CRC-32 of the tables, tables (ids of documents and whether they are null, their numbers of
ids, words and CRC-32 of each block, models), then the blocks' words. Documents follow one another without regard to
blocks; a document is in one segment.

Files are written to a temporary name in the shared folder and renamed: a task that runs again writes the same file. They
go through pyarrow's file systems, and are read back by Spark's binaryFile source. A task holds one segment at a time,
and what it has coded.

Defined results: a null or empty text has no ids but the end id. Documents are in ascending order of id, null first, rows
that repeat an id by text. A document's start counts all ids before it, end ids too. An empty table gives no files' rows.
Other columns take no part, whatever their names. Vocabularies of more than 65,536 ids are refused.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ODD, bounded_batches, gather, materialize, mix, parts_for, shared_dir, string_columns, texts, trim

MAGIC = b"VTCM0002"
#: Ids of a block; blocks that are coded in step; slots of each order and block; ids of a segment, but for its last document.
BLOCK, LANES, SLOTS, SEGMENT = 1024, 4096, 256, 1 << 22
#: Segments of a file, so that it stays well below two gigabytes; a task's files are numbered from ROLLS times its own number.
SEGMENTS, ROLLS = 64, 1_000_000
#: Precision of order 0 and of order 1, in bits.
PRECISE, ROW = 18, 14
#: Parts of a row that decoding begins to look in; places of a table that encoding looks in.
COARSE, HASHED = 64, 1 << 20
FAR = 1 << 18
END = 0
FILE_BYTES = 8 << 20
#: Words and bytes of long words that are remembered, words that are looked up at a time, bytes from which a word is long.
MEMO_WORDS, MEMO_BYTES, WORDS, WIDE = 1 << 21, 32 << 20, 1 << 17, 24

_U = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """stretch(p) = ln(p / (1 - p)) for p in 4096ths, in 256ths, and its inverse for -2048..2047, both rounded once."""
    p = (np.arange(4096) + 0.5) / 4096
    stretch = np.clip(np.rint(np.log(p / (1 - p)) * 256), -2047, 2047).astype(np.int32)
    x = (np.arange(4096) - 2048) / 256
    squash = np.clip(np.rint(65536 / (1 + np.exp(-x))), 64, 65536 - 64).astype(np.int32)
    return stretch, squash


STRETCH, SQUASH = _tables()
#: By 4 for a right guess, and its trust so far: its trust from now on.
TRUST = np.array([0, 0, 1, 2, 1, 2, 3, 3], np.int32) << 16
SIGN = np.array([1, -1], np.int32)
#: The lowest bytes of eight, by how many.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def scaled(counts: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers of 1 and more that are nearly in proportion to counts and add up to total."""
    n = len(counts)
    out = 1 + counts.astype(np.int64) * (total - n) // max(1, int(counts.sum()))
    out[np.argmax(counts)] += total - int(out.sum())
    return out


class Models:
    """Order 0 and order 1 of a segment: ids with their shares, and pairs of ids with their shares of the first one's row."""

    def __init__(self, ids: np.ndarray, share: np.ndarray, pairs: np.ndarray, pair_share: np.ndarray):
        self.ids, self.share, self.pairs, self.pair_share = ids, share, pairs, pair_share
        self.begin = np.zeros(65536, np.int64)  # of each id in order 0
        self.width = np.zeros(65536, np.int64)
        begin = np.cumsum(share) - share
        self.begin[ids], self.width[ids] = begin, share
        self.bent = STRETCH[np.minimum(self.width >> (PRECISE - 12), 4095)]
        # the row of an id: its pairs in order, then the escape; all rows one after another make one increasing array
        first = pairs >> 16
        self.row_from = np.searchsorted(first, np.arange(65536))
        self.row_to = np.searchsorted(first, np.arange(65536), "right")
        upto = np.concatenate([[0], np.cumsum(pair_share)])
        self.taken = (upto[self.row_to] - upto[self.row_from]).astype(np.int32)  # what the escape leaves of a row
        self.pair_begin = (upto[:-1] - upto[self.row_from[first]]).astype(np.int32)
        self.pair_share = self.pair_share.astype(np.int32)
        self.rising = np.append((first.astype(np.int64) << ROW) + self.pair_begin, 1 << 62)
        # for decoding: where to begin looking, for each COARSE part of each row
        rows = np.unique(first)
        self.row = np.zeros(65536, np.int64)
        self.row[rows] = np.arange(len(rows)) * COARSE
        parts = (rows[:, None] << ROW) + (np.arange(COARSE) << ROW) // COARSE
        self.coarse = np.searchsorted(self.rising, parts.reshape(-1), "right") - 1 if len(rows) else np.zeros(COARSE, np.int64)
        # for encoding: two tables by hashes of pairs, and the few that found no place in either
        names = np.arange(len(pairs))
        self.tables, self.hashed = [], pairs
        for shift in (0, 20):
            table = np.full(HASHED, -1, np.int32)
            table[self._hash(pairs[names], shift)] = names
            names = names[table[self._hash(pairs[names], shift)] != names]
            self.tables.append(table)
        self.others, self.other_pairs = names, pairs[names]

    @classmethod
    def of(cls, ids: np.ndarray) -> Models:
        """The models of a segment; a pair of ids is in order 1 if that saves more than the 32 bits that it takes."""
        times = np.bincount(ids, minlength=65536)
        known = np.flatnonzero(times)
        if not len(known):
            none = np.zeros(0, np.int64)
            return cls(none, none, none, none)
        n = len(ids)
        pairs, often = np.unique(np.concatenate([[0], ids[:-1]]).astype(np.uint32) << np.uint32(16) | ids, return_counts=True)
        pairs = pairs.astype(np.int64)
        before, after = np.maximum(times[pairs >> 16], 1), times[pairs & 0xFFFF]
        some = (often > 2) & (often * np.log2(np.maximum(often * (n / before / after), 1e-9)) > 32)
        pairs, often = pairs[some], often[some]
        # shares of the row: in proportion to all that follows the first id, so that what isn't listed is left to the escape
        share = np.maximum(1, often * ((1 << ROW) - 1) // np.maximum(before[some], often))
        first, at = np.unique(pairs >> 16, return_index=True)
        total = np.add.reduceat(share, at) if len(at) else share
        fits = np.ones(65536, bool)
        fits[first[total >= 1 << ROW]] = False
        own = fits[pairs >> 16]
        return cls(known, scaled(times[known], 1 << PRECISE), pairs[own], share[own])

    def dump(self) -> bytes:
        row = np.diff(np.concatenate([[0], self.pairs]))
        parts = [np.diff(np.concatenate([[0], self.ids])).astype("<u2"), self.share.astype("<u4"), row.astype("<u4"), self.pair_share.astype("<u2")]
        planes = [np.ascontiguousarray(p.view(np.uint8).reshape(len(p), -1).T).tobytes() if len(p) else b"" for p in parts]
        return struct.pack("<II", len(self.ids), len(self.pairs)) + zstandard.ZstdCompressor(level=3).compress(b"".join(planes))

    @classmethod
    def load(cls, data: bytes) -> Models:
        n, m = struct.unpack_from("<II", data)
        flat, at, out = zstandard.ZstdDecompressor().decompress(data[8:]), 0, []
        for kind, size in (("<u2", n), ("<u4", n), ("<u4", m), ("<u2", m)):
            wide = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(np.frombuffer(flat, np.uint8, size * wide, at).reshape(wide, size).T).reshape(-1).view(kind).astype(np.int64))
            at += size * wide
        return cls(np.cumsum(out[0]), out[1], np.cumsum(out[2]), out[3])

    @staticmethod
    def _hash(pairs: np.ndarray, shift: int) -> np.ndarray:
        return ((pairs * 0x9E3779B1) >> (13 + shift // 4)) & (HASHED - 1)

    def place(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ids after the ids before: where each begins in its row, and its width; the escape where it isn't listed."""
        taken = self.taken.take(before)
        if not len(self.pairs):
            return taken, (1 << ROW) - taken, np.zeros(len(ids), bool)
        pair = before << 16 | ids
        at = self.tables[0].take(self._hash(pair, 0))
        rest = np.flatnonzero(self.pairs.take(at) != pair)  # -1 is some pair, and another one than this
        own = self.tables[1].take(self._hash(pair[rest], 20))
        at[rest] = own
        if len(self.others):
            rest = rest[self.pairs.take(own) != pair[rest]]
            at[rest] = self.others[np.minimum(np.searchsorted(self.other_pairs, pair[rest]), len(self.others) - 1)]
        listed = self.pairs.take(at) == pair
        return np.where(listed, self.pair_begin.take(at), taken), np.where(listed, self.pair_share.take(at), (1 << ROW) - taken), listed

    def listed_at(self, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which pair of a row is at a place below the row's escape."""
        key = (before << ROW) + at
        place = self.coarse.take(self.row.take(before) + (at * COARSE >> ROW))
        some = np.flatnonzero(self.rising.take(place + 1) <= key)
        for _ in range(3):
            if not len(some):
                return place
            place[some] += 1
            some = some[self.rising.take(place[some] + 1) <= key[some]]
        place[some] = np.searchsorted(self.rising, key[some], "right") - 1
        return place


class _Words:
    """The words of many blocks, side by side: where each lane reads or writes. A word above 16 bits carries into the one
    before."""

    def __init__(self, lanes: int, size: int, kind=np.uint32):
        self.lanes = lanes
        self.data = np.zeros(size * lanes, kind)
        self.at = np.arange(lanes)

    def put(self, lanes: np.ndarray, words: np.ndarray) -> None:
        at = self.at[lanes]
        if int(at.max(initial=0)) >= len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[at] = words
        self.at[lanes] = at + self.lanes

    def get(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        self.at[lanes] = at + self.lanes
        return self.data.take(at, mode="clip").astype(np.uint64)

    def settled(self) -> list[bytes]:
        """The words of each lane, carries added."""
        used = self.at // self.lanes
        rows = self.data.reshape(-1, self.lanes)[: int(used.max(initial=0))]
        carry = np.zeros(self.lanes, np.uint32)
        for row in rows[::-1]:
            row += carry
            np.right_shift(row, 16, out=carry)
        each = np.ascontiguousarray(rows.astype("<u2").T)
        return [each[i, :n].tobytes() for i, n in enumerate(used.tolist())]


class _Coder:
    """Range coders in step: registers of 48 bits, a range of 32 or more between codes. Decoding if words are given."""

    LEAST = _U(1 << 32)

    def __init__(self, lanes: int, words: _Words, reads: bool):
        self.range = np.full(lanes, (1 << 48) - 1, np.uint64)
        self.low = np.zeros(lanes, np.uint64)  # decoding: the value above low
        self.words, self.reads = words, reads
        if reads:
            every = np.arange(lanes)
            for _ in range(3):
                self.low = (self.low << _U(16)) | words.get(every)

    def renew(self, lanes: np.ndarray) -> None:
        """Move the top words of lanes whose range is short."""
        while len(lanes):
            if self.reads:
                self.low[lanes] = (self.low[lanes] << _U(16)) | self.words.get(lanes)
            else:
                low = self.low[lanes]
                self.words.put(lanes, low >> _U(32))
                self.low[lanes] = (low & _U(0xFFFFFFFF)) << _U(16)
            width = self.range[lanes] << _U(16)
            self.range[lanes] = width
            lanes = lanes[width < self.LEAST]

    def bit(self, p: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """One bit of every lane, 1 with probability p / 65536."""
        cut = (self.range >> _U(16)) * p.astype(np.uint64)
        if self.reads:
            bit = self.low < cut
            self.low -= np.where(bit, _U(0), cut)
        else:
            self.low += np.where(bit, _U(0), cut)
        self.range = np.where(bit, cut, self.range - cut)
        self.renew(np.flatnonzero(self.range < self.LEAST))
        return bit

    def write(self, lanes: np.ndarray, begin: np.ndarray, width: np.ndarray, bits: int) -> None:
        unit = self.range[lanes] >> _U(bits)
        self.low[lanes] += unit * begin.astype(np.uint64)
        unit *= width.astype(np.uint64)
        self.range[lanes] = unit
        self.renew(lanes[unit < self.LEAST])

    def peek(self, lanes: np.ndarray, bits: int) -> np.ndarray:
        """Where in 2 ** bits the next code lies."""
        return np.minimum(self.low[lanes] // (self.range[lanes] >> _U(bits)), _U((1 << bits) - 1)).astype(np.int64)

    def took(self, lanes: np.ndarray, begin: np.ndarray, width: np.ndarray, bits: int) -> None:
        unit = self.range[lanes] >> _U(bits)
        self.low[lanes] -= unit * begin.astype(np.uint64)
        unit *= width.astype(np.uint64)
        self.range[lanes] = unit
        self.renew(lanes[unit < self.LEAST])

    def finish(self) -> None:
        every = np.arange(len(self.low))
        for k in (32, 16, 0):
            self.words.put(every, (self.low >> _U(k)) & _U(0xFFFF) if k < 32 else self.low >> _U(32))


def _code(models: Models, lanes: int, steps: int, ids: np.ndarray | None, words: _Words | None):
    """Code [steps, lanes] ids, or decode them from words."""
    reads = ids is None
    out = np.zeros((steps, lanes), np.uint16) if reads else ids
    coder = _Coder(lanes, words if reads else _Words(lanes, max(64, steps // 2)), reads)
    symbols = np.repeat(models.ids, models.share) if reads else None  # of each place in order 0
    # orders 1 and 2 are rows of arrays; a slot holds a guess and how far it is trusted
    base = np.arange(2 * lanes).reshape(2, lanes)
    base_slot, base_cell = base * SLOTS, base * 4
    guess = np.zeros(2 * lanes * SLOTS, np.int32)
    record = np.full(2 * lanes * 4, 8192, np.int32)  # how often a guess of this trust is right
    weight = np.repeat(np.array([[24000], [40000], [8000]], np.int32), lanes, 1)  # of orders 1, 2 and 0
    bent = np.zeros((3, lanes), np.int32)
    one, two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    slot = np.zeros((2, lanes), np.int64)
    for step in range(steps):
        if not reads and step % 64 == 0:
            ahead = out[step : step + 64].astype(np.int64)
            earlier = np.concatenate([one[None], ahead[:-1]])
            begins, widths, listed = (a.reshape(-1, lanes) for a in models.place(earlier.reshape(-1), ahead.reshape(-1)))
        mixed = one * 40503
        slot[0] = mixed >> 4
        two *= 30103
        two += mixed
        slot[1] = two >> 5
        slot &= SLOTS - 1
        slot += base_slot
        entry = guess.take(slot)
        trust, seen = entry >> 16, entry & 0xFFFF
        cell = base_cell + trust
        known = record.take(cell)
        chosen = np.where(trust[1] >= trust[0], seen[1], seen[0])
        other = seen != chosen
        own = STRETCH.take(known >> 4)
        np.multiply(own, SIGN.take(other), out=bent[:2])
        bent[2] = models.bent.take(chosen)
        sums = weight * bent
        p = SQUASH.take((sums[0] + sums[1] + sums[2] >> 16) + 2048, mode="clip")
        x = None if reads else ahead[step % 64]
        hit = coder.bit(p, None if reads else x == chosen)
        some = np.flatnonzero(~hit)
        if reads:
            x = chosen.astype(np.int64)
            before = one[some]
            at = coder.peek(some, ROW)
            begin = models.taken.take(before)
            width = (1 << ROW) - begin
            escaped = at >= begin
            inside = np.flatnonzero(~escaped)
            place = models.listed_at(before[inside], at[inside])
            begin[inside], width[inside] = models.pair_begin[place], models.pair_share[place]
            x[some[inside]] = models.pairs[place] & 0xFFFF
            coder.took(some, begin, width, ROW)
            some = some[escaped]
            own = symbols[coder.peek(some, PRECISE)]
            x[some] = own
            coder.took(some, models.begin[own], models.width[own], PRECISE)
            out[step] = x
        else:
            coder.write(some, begins[step % 64].take(some), widths[step % 64].take(some), ROW)
            some = some[~listed[step % 64].take(some)]
            own = x[some]
            coder.write(some, models.begin[own], models.width[own], PRECISE)
        bent *= hit * np.int32(16384) - (p >> 2)
        bent >>= 14
        weight += bent
        if step % 16 == 15:  # three products stay within 32 bits
            np.minimum(np.maximum(weight, -FAR, out=weight), FAR, out=weight)
        right = seen == x
        record[cell] = known + ((right * np.int32(65408) + np.int32(64) - known) >> 4)
        state = right * 4 + trust
        guess[slot] = np.where(state, seen, x) | TRUST.take(state)  # a wrong guess without trust goes
        two, one = one.copy(), x
    if reads:
        return out
    coder.finish()
    return coder.words


def encode_blocks(ids: np.ndarray, models: Models, block: int = BLOCK) -> list[bytes]:
    """The coded words of each block of ids (below 65536); the last one is filled up with its last id."""
    blocks = -(-len(ids) // block)
    padded = np.full(blocks * block, ids[-1] if len(ids) else 0, np.uint16)
    padded[: len(ids)] = ids
    out = []
    for part in np.array_split(padded.reshape(blocks, block), max(1, -(-blocks // LANES))):
        if len(part):
            out += _code(models, len(part), block, np.ascontiguousarray(part.T), None).settled()
    return out


def decode_blocks(models: Models, block: int, blocks: list[bytes]) -> np.ndarray:
    """The ids of all blocks, [blocks, block]."""
    out = [np.zeros((0, block), np.uint16)]
    for at in range(0, len(blocks), LANES):
        part = blocks[at : at + LANES]
        size = max(len(b) for b in part) // 2 + 8
        words = _Words(len(part), 0, np.uint16)
        words.data = np.ascontiguousarray(np.frombuffer(b"".join(b.ljust(2 * size, b"\0") for b in part), "<u2").reshape(-1, size).T).reshape(-1)
        out.append(_code(models, len(part), block, None, words).T.astype(np.uint16))
    return np.concatenate(out)


def _sums(ids: np.ndarray, block: int) -> np.ndarray:
    """CRC-32 of each block as it is coded."""
    return np.array([zlib.crc32(row.tobytes()) for row in ids.reshape(-1, block).astype("<u4")], "<u4")


def to_segment(keys: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    models = Models.of(ids)
    blocks = encode_blocks(ids, models, block)
    own = np.full(len(blocks) * block, ids[-1] if len(ids) else 0, np.uint16)
    own[: len(ids)] = ids
    dumped = models.dump()
    tables = b"".join(np.ascontiguousarray(a).tobytes() for a in (keys.astype("<i8"), known.astype("u1"), counts.astype("<i8"), np.array([len(b) // 2 for b in blocks], "<u4"), _sums(own, block))) + dumped
    return MAGIC + struct.pack("<QQQQQI", block, len(blocks), len(ids), len(keys), len(dumped), zlib.crc32(tables)) + tables + b"".join(blocks)


def from_file(data: bytes):
    """keys, known, counts, ids of each segment; a damaged one is an error that names the block."""
    at, head = 0, struct.calcsize("<QQQQQI")
    while at < len(data) or not data:
        if data[at : at + 8] != MAGIC or len(data) < at + 8 + head:
            raise ValueError("not a file of ids")
        size, n_blocks, n_ids, n_docs, n_models, total = struct.unpack_from("<QQQQQI", data, at + 8)
        at += 8 + head
        spans = [("<i8", n_docs), ("u1", n_docs), ("<i8", n_docs), ("<u4", n_blocks), ("<u4", n_blocks), ("u1", n_models)]
        end = at + sum(np.dtype(k).itemsize * n for k, n in spans)
        if end > len(data) or zlib.crc32(data[at:end]) != total:
            raise ValueError("the tables of a file of ids are damaged")
        found = []
        for k, n in spans:
            found.append(np.frombuffer(data, k, n, at))
            at += np.dtype(k).itemsize * n
        keys, known, counts, words, sums, models = found
        blocks = []
        for n in words.tolist():
            blocks.append(data[at : at + 2 * n])
            at += 2 * n
        ids = decode_blocks(Models.load(models.tobytes()), size, blocks).reshape(-1)
        wrong = np.flatnonzero(_sums(ids, size) != sums)
        if len(wrong):
            raise ValueError(f"block {wrong[0]} of a file of ids is damaged")
        yield keys, known.astype(bool), counts, ids[:n_ids]


# ---- the tokenizer

_TOKENIZERS: dict = {}


class Tokenizer:
    """The library's ids, by words: a text without neighbouring white space is cut at its blanks, which the library's
    pattern always does too, and each distinct word goes through the library once as long as it is remembered. A text
    that holds an added token (the library finds these in any text, whatever add_special_tokens says) goes as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.memo = _Memo()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]

        vocabulary = self.library.get_vocab(with_added_tokens=True)
        if max(vocabulary.values(), default=0) > 65535:
            raise ValueError("ids above 65535 don't fit into files of ids")
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that begin with a blank
        self.begins[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        #: White space other than blanks and line feeds, and a blank next to any.
        self.others, self.beside = re.compile(r"[^\S \n]").search, re.compile(r"\s(?<! ) | \s(?<! )").search

    def odd(self, text: str) -> bool:
        """Is there a blank that isn't a boundary, next to white space or at an end, or an added token?"""
        if text.startswith(" ") or text.endswith(" ") or "  " in text or " \n" in text or "\n " in text or any(a in text for a in self.added):
            return True
        if text.replace("\n", "").isprintable():  # no white space is, but for the blank
            return False
        return self.others(text) is not None and self.beside(text) is not None

    def whole(self, found: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.library.encode_batch_fast(found, add_special_tokens=False)]

    def words(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with the blank before each, `size` bytes of data one after another, and how many each has: many
        words go as one text, and ids that begin with a blank part them."""
        ends, flat = np.cumsum(size)[511::512].tolist(), data.tobytes()
        found = [str(flat[a:b], "utf-8") for a, b in zip([0, *ends], [*ends, len(flat)]) if a < b]
        ids = np.concatenate([np.array(e.ids, np.uint16) for e in self.library.encode_batch_fast(found, add_special_tokens=False)])
        counts = np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))
        if len(counts) != len(size):
            raise ValueError("the library parts words in another way")
        return ids, counts

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as 16-bit numbers."""
        odd = [self.odd(t) for t in batch]
        cut = [t.encode() for t, o in zip(batch, odd) if not o]
        own = iter(self._by_words(cut) if cut else ())
        rest = iter(self.whole([t for t, o in zip(batch, odd) if o]))
        return [next(rest if o else own) for o in odd]

    def _by_words(self, found: list[bytes]) -> list[bytes]:
        """Ids of texts that are cut at each blank, WORDS of their words at a time."""
        data = b" ".join(found)
        flat = np.frombuffer(data + bytes(WIDE), np.uint8)
        end = np.append(np.flatnonzero(flat[: len(data)] == 32), len(data))
        start = np.append(0, end[:-1] + 1)
        size = np.array([len(t) for t in found])
        heads = np.searchsorted(start, np.cumsum(size + 1) - size - 1)  # the first word of each text has no blank before it
        first = np.zeros(len(start), bool)
        first[heads] = True
        ids, counts = [], np.empty(len(start), np.int64)
        for at in range(0, len(start), WORDS):
            some = slice(at, at + WORDS)
            refs = self.memo.refs(data, flat, start[some], end[some], first[some], self)
            counts[some] = self.memo.size[refs]
            ids.append(gather(self.memo.ids, self.memo.at[refs], counts[some]))
        each, ends = np.concatenate(ids).tobytes(), 2 * np.cumsum(np.add.reduceat(counts, heads))
        return [each[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class _Memo:
    """Ids of words, by the words' bytes: a table of hashes leads to them, and the bytes decide.

    A word of fewer than WIDE bytes is its own key: its bytes in three numbers, and in the last byte its length, with 128
    added if it begins a text. Longer ones are in a dictionary. All words are forgotten when there are more than MEMO_WORDS,
    or the long ones have more than MEMO_BYTES.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.table = np.full(1 << (2 * (MEMO_WORDS + WORDS) - 1).bit_length(), -1, np.int32)  # half of it stays free
        self.keys = np.zeros((1 << 16, WIDE // 8), np.uint64)
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint16)
        self.long: dict[tuple[bytes, bool], int] = {}
        self.n = self.used = self.held = 0

    def _room(self, n: int) -> None:
        while n > len(self.keys):
            self.keys, self.at, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.keys, self.at, self.size))

    def _place(self, keys: np.ndarray, fresh: bool) -> np.ndarray:
        """Where each key is; -1 if it isn't there, or, fresh, a place that equal keys share."""
        h, last = keys[:, 0] * _U(ODD), len(self.table) - 1
        for k in range(1, keys.shape[1]):
            h = mix(h ^ keys[:, k])
        slot = (h >> _U(20)).astype(np.int64) & last
        out, some = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        if fresh:
            self._room(self.n + len(keys))
            self.keys[self.n : self.n + len(keys)] = keys
        while len(some):
            found = self.table.take(slot)
            if fresh:
                free = np.flatnonzero(found < 0)
                self.table[slot[free]] = self.n + some[free]  # of several that want one slot, one gets it
                found = self.table.take(slot)
            else:
                there = np.flatnonzero(found >= 0)
                some, slot, found = some[there], slot[there], found[there]
            same = (self.keys.take(found, axis=0) == keys.take(some, axis=0)).all(1)
            out[some[same]] = found[same]
            some, slot = some[~same], slot[~same] + 1 & last
        return out

    def refs(self, data: bytes, flat: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, tokenizer: Tokenizer) -> np.ndarray:
        """The number of each word; words that aren't known go through the library, each once."""
        if self.n > MEMO_WORDS or self.held > MEMO_BYTES:
            self.clear()
        size = end - start
        keys = np.empty((len(start), WIDE // 8), np.uint64)
        eight = np.ndarray((len(flat) - 7,), "<u8", flat, strides=(1,))  # the eight bytes from each place on
        for k in range(WIDE // 8):
            within = np.clip(size - 8 * k, 0, 8)
            keys[:, k] = eight[np.minimum(start + 8 * k, len(eight) - 1)] & MASKS.take(within)  # take would copy all of it
        keys[:, -1] |= (size | first * 128).astype(np.uint64) << _U(56)
        short = size < WIDE
        out = np.full(len(start), -1, np.int64)
        own = np.flatnonzero(short)
        out[own] = self._place(keys[own], False)
        missing = own[out[own] < 0]
        fresh, new = [], []  # where words are that aren't known, and their numbers
        if len(missing):
            out[missing] = found = self._place(keys[missing], True)
            place, which = np.unique(found, return_index=True)
            new, fresh = place.tolist(), missing[which].tolist()
            self.n += len(missing)
        for i in np.flatnonzero(~short).tolist():
            word = data[start[i] : end[i]], bool(first[i])
            if word not in self.long:
                self.long[word] = self.n
                self.held += len(word[0])
                fresh.append(i)
                new.append(self.n)
                self.n += 1
            out[i] = self.long[word]
        if fresh:
            self._room(self.n)
            fresh, new = np.array(fresh), np.array(new)
            begins = first[fresh]
            heads, later = fresh[begins], fresh[~begins]
            if len(heads):
                each = tokenizer.whole([data[a:b].decode() for a, b in zip(start[heads].tolist(), end[heads].tolist())])
                self._keep(new[begins], np.array([len(x) // 2 for x in each]), np.frombuffer(b"".join(each), "<u2"))
            if len(later):
                ids, counts = tokenizer.words(gather(flat, start[later] - 1, size[later] + 1), size[later] + 1)
                self._keep(new[~begins], counts, ids)
        return out

    def _keep(self, refs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[refs], self.size[refs] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(ids)


def tokenizer(path: str) -> Tokenizer:
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _TOKENIZERS[path] = Tokenizer(path)
    return _TOKENIZERS[path]


# ---- Spark


def _begin(uri: str, name: str):
    """A stream to a temporary file beside the one that is wanted, and its path."""
    fs, path = pa.fs.FileSystem.from_uri(uri)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    return fs.open_output_stream(draft), draft


def _finish(out, uri: str, draft: str, name: str) -> None:
    out.close()
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.move(draft, f"{path}/{name}")


def write_ids(df: DataFrame, tokenizer_path: str, uri: str, key: str = "doc_id", text: str = "text", segment: int = SEGMENT, segments: int = SEGMENTS) -> DataFrame:
    """Write the ids of all texts to files in the folder uri; (file, n_docs, n_ids, n_bytes) of each file, by number.

    A segment has `segment` ids or more; a task whose rows make more than `segments` of them goes on in another file.
    """
    string_columns(df, key, text)
    bounded_batches(df)
    if "://" not in uri:
        uri = ("file://" if uri.startswith("/") else "file:") + uri
    uri = uri.replace("file:/", "file:///") if uri.startswith("file:/") and not uri.startswith("file://") else uri
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    files = parts_for(df, FILE_BYTES, 24)
    ordered = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # the beginning of the text parts rows that repeat an id, in the order that they are sorted in
    ordered = ordered.repartitionByRange(files, "key", F.left("text", F.lit(64))).sortWithinPartitions("key", "text")
    ordered = ordered.withColumn("file", F.spark_partition_id())

    def run(batches):
        encode, end = tokenizer(tokenizer_path).encode, np.array([END], "<u2").tobytes()
        held = _Held()
        target, number, written = None, None, [0, 0, 0, 0]

        def flush() -> None:
            """The documents held, as a segment of the file that is open."""
            nonlocal target
            if target is None:
                target = (*_begin(uri, file_name(number)), file_name(number))
            data = to_segment(*held.taken())
            target[0].write(data)
            for k, n in enumerate((held.last_docs, held.last_ids, len(data), 1)):
                written[k] += n

        def closed() -> pa.RecordBatch:
            nonlocal target, number
            _finish(target[0], uri, *target[1:])
            row = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([n], pa.int64()) for n in written[:3])], ["file", "n_docs", "n_ids", "n_bytes"])
            target, number, written[:] = None, number + 1, [0, 0, 0, 0]
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                if number is None:
                    number = rows.column(2)[0].as_py() * ROLLS
                found = encode(texts(rows.column(1)))
                held.add(rows.column(0), np.array([len(x) // 2 + 1 for x in found]), end.join(found) + end)
                if held.n_ids >= segment:
                    flush()
                    if written[3] >= segments:
                        yield closed()
        if held.n_ids:
            flush()
        if target is not None:
            yield closed()
        trim()

    return ordered.mapInArrow(run, "file long, n_docs long, n_ids long, n_bytes long")


class _Held:
    """Documents that wait for their segment."""

    def __init__(self):
        self.parts, self.n_ids, self.last_docs, self.last_ids = [], 0, 0, 0

    def add(self, keys: pa.Array, counts: np.ndarray, ids: bytes) -> None:
        self.parts.append((keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_valid().to_numpy(zero_copy_only=False), counts, ids))
        self.n_ids += int(counts.sum())

    def taken(self) -> tuple[np.ndarray, ...]:
        keys, known, counts = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        ids = np.frombuffer(b"".join(p[3] for p in self.parts), "<u2")
        self.parts, self.n_ids, self.last_docs, self.last_ids = [], 0, len(keys), len(ids)
        return keys, known, counts, ids


def file_name(number: int) -> str:
    return f"ids-{number:015d}.ctm"


def read_ids(spark, uri: str, with_ids: bool = False) -> DataFrame:
    """(key, file, within, n_tokens, ids_crc32[, ids]) of the documents in the files of a folder; within counts from the file's start."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.ctm").load(uri).select("path", "content")
    more = ", ids binary" if with_ids else ""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                number, before = int(path.rsplit("/", 1)[-1][4:-4]), 0
                for keys, known, counts, ids in from_file(content.as_py()):
                    ends = np.cumsum(counts)
                    wide = ids.astype("<u4")
                    pieces = [wide[e - n : e] for n, e in zip(counts.tolist(), ends.tolist())]
                    columns = [pa.array(keys, mask=~known), pa.array(np.full(len(keys), number, np.int64)), pa.array(before + ends - counts), pa.array(counts), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                    names = ["key", "file", "within", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array([p.tobytes() for p in pieces], pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    before += len(ids)
        trim()

    return files.mapInArrow(run, "key long, file long, within long, n_tokens long, ids_crc32 long" + more)


def round_trip(df: DataFrame, tokenizer_path: str, uri: str | None = None, key: str = "doc_id", text: str = "text", segment: int = SEGMENT, segments: int = SEGMENTS) -> DataFrame:
    """(key, start, n_tokens, ids_crc32), from files that were written and read again."""
    spark = df.sparkSession
    uri = uri or f"{shared_dir(spark)}/vectriage/ids-{uuid.uuid4().hex}"
    written = write_ids(df, tokenizer_path, uri, key, text, segment, segments)
    totals = materialize(written.select("file", "n_ids"), "id-files")
    # one short row for each file, of some megabytes of ids each
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("__start"))
    if totals.isEmpty():
        return df.select(F.col(key).cast("long").alias(key), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("ids_crc32")).limit(0)
    return read_ids(spark, uri).join(starts, "file").select(F.col("key").alias(key), (F.col("__start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
