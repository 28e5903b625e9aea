"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Defined results: a null or empty text has no ids, and decodes to no bytes. Rows are independent, so ties, repeated
rows, repeated ids and empty tables need no rule. A computed column replaces an input column of the same name.
Text is encoded as it stands; the strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, string_columns, texts

#: A piece of text of at least this many characters is handed to the library at a time.
PIECE_CHARS = 1 << 16
_ENCODINGS: dict = {}


def encoding(ranks_path: str, pattern: str):
    """The library's encoding, read once by each Python worker."""
    if (ranks_path, pattern) not in _ENCODINGS:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODINGS[ranks_path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[ranks_path, pattern]


#: A single space between two ASCII letters or digits: a match of the pattern always begins at that space, and no match
#: looks beyond it, so the ids of both sides together are the ids of the whole.
SAFE = regex.compile(r"(?<=[A-Za-z0-9])(?= [A-Za-z0-9])")


def pieces(text: str, size: int = PIECE_CHARS):
    """Cut a long text at safe boundaries; where there is none, a piece grows until there is."""
    at = 0
    while len(text) - at > size:
        found = SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def ids_of(enc, text: str) -> bytes:
    if len(text) <= PIECE_CHARS:
        return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
    return b"".join(enc.encode_to_numpy(x, disallowed_special=()).astype("<u4", copy=False).tobytes() for x in pieces(text))


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != name] + [T.StructField(name, kind)])


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a binary column: the ids of text as little-endian unsigned 32-bit integers."""
    string_columns(df, text)
    bounded_batches(df)
    schema = _with(df, ids, T.BinaryType())
    keep = schema.names[:-1]

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            found = pa.array([ids_of(enc, x) for x in texts(batch.column(text))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [found], schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with a binary column: the bytes that the ids stand for. They need not be UTF-8."""
    string_columns(df, ids)
    bounded_batches(df)
    schema = _with(df, decoded, T.BinaryType())
    keep = schema.names[:-1]

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            found = pa.array([enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [found], schema.names)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the columns of encode and of decode: one worker does both, so ids don't pass to another one in between."""
    string_columns(df, text)
    bounded_batches(df)
    schema = T.StructType([f for f in df.schema if f.name not in (ids, decoded)] + [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())])
    keep = schema.names[:-2]

    def run(batches):
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            found = [ids_of(enc, x) for x in texts(batch.column(text))]
            back = [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(found, pa.binary()), pa.array(back, pa.binary())], schema.names)

    return df.mapInArrow(run, schema)
